"""Classification by weighted keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.config import Config
from docsift.functions.text import has_phrase

UNKNOWN = "Unknown"


def keyword_scores(text_c: Column, config: Config, low: Column | None = None) -> dict[str, Column]:
    """The score of each type but Unknown: the weights of its keywords that occur, however often, in collapsed text.

    ``low`` is the text in lower case, where a column has it already.
    """
    out = {}
    low = F.lower(text_c) if low is None else low
    for t in config.types:
        if t.name == UNKNOWN:
            continue
        score = F.lit(0)
        for k in t.keywords:
            score = score + F.when(has_phrase(text_c, low, k), t.weight).otherwise(0)
        out[t.name] = score
    return out


def document_type(scores: dict[str, Column]) -> Column:
    """The type of the highest score above 0, the earliest of equals; else Unknown."""
    if not scores:
        return F.lit(UNKNOWN)
    ranked = [F.struct(s.cast("int").alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores.items())]
    nothing = F.struct(F.lit(0).alias("score"), F.lit(1).alias("rank"), F.lit(UNKNOWN).alias("name"))
    return F.greatest(nothing, *ranked)["name"]
