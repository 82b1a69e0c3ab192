"""Connected components of documents over shared key values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.pointers import climb, relabelled
from docsift.session import HOT, HOT_KEYS, discard, join_hot, measured

#: Links that one task contracts, after the first round.
TAIL = 100_000


def star_edges(keys: DataFrame, hot: int = HOT) -> DataFrame:
    """``(field, value, hub, doc_ix)``: of every value the link of each later document to its first one, not all pairs.

    ``keys`` has ``doc_ix, field, value``; repeated rows count once. The link of a value of two documents comes from their
    least and largest number, without moving the rows again; the rows of values of more are joined with their first
    one, those of a value of very many apart.
    """
    on = ["field", "value"]
    rows = keys.select(*on, "doc_ix").filter("field is not null and value is not null")
    groups = rows.groupBy(*on).agg(F.min("doc_ix").alias("hub"), F.max("doc_ix").alias("last"), F.count("*").alias("n")).filter("hub <> last")
    groups, got = measured(groups, more=F.coalesce(F.sum(F.when(F.col("n") > 2, F.col("n"))), F.lit(0)), most=F.coalesce(F.max("n"), F.lit(0)))
    links = groups.filter("n = 2").select(*on, "hub", F.col("last").alias("doc_ix"))
    if not got["more"]:
        return links
    least = max(hot, got["more"] // HOT_KEYS)
    first = groups.filter("n > 2").select(*on, "hub")
    few = groups.filter(F.col("n") > least).select(*on) if got["most"] > least else None
    stars = join_hot(rows, first, on, few, "inner").filter("doc_ix <> hub").select(*on, "hub", "doc_ix").distinct()
    return links.unionByName(stars)


def smallest_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the links ``(a, b)``, and of each the smallest end linked to it."""
    ends, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    low = np.arange(len(ends))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        for side in (low[x], low[y], x, y):
            np.minimum.at(new, side, least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, low):
            return ends, ends[low]
        low = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(v, p) of at most TAIL links."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if got := [f for f in frames if len(f)]:
            v, p = smallest_linked(pd.concat(got)["a"].to_numpy(), pd.concat(got)["b"].to_numpy())
            yield pd.DataFrame({"v": v, "p": p})

    return edges.coalesce(1).mapInPandas(run, "v bigint, p bigint")


def components(docs: DataFrame, keys: DataFrame, hot: int = HOT, tail: int = TAIL) -> DataFrame:
    """``(doc_ix, component)``: the smallest document linked to each over ``keys (doc_ix, field, value)``.

    The links are the stars of star_edges(). Rounds of: every document points to its least neighbour, if that is smaller;
    pointers are doubled down to the smallest document of their tree; links are relabelled by it and deduplicated. Links
    shrink from round to round until none is left; few are contracted in one task. A document or component that very
    many links share is joined apart, so no task gets it whole. Documents without a key are alone.
    """
    edges, got = measured(star_edges(keys, hot).select(F.col("hub").alias("a"), F.col("doc_ix").alias("b")).distinct(), n=F.count("*"))
    steps: list[tuple[DataFrame, int]] = []
    while n := got["n"]:
        if steps and n <= tail:
            steps.append((_in_one_task(edges), 2 * n))
            break
        ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))))
        least = ends.groupBy("v").agg(F.min("u").alias("u"))
        up, got = measured(least.select("v", F.least("v", "u").alias("p"), (F.col("u") < F.col("v")).alias("open")), n=F.count("*"), open=F.count_if("open"))
        roots = climb(up, got["open"], hot)
        steps.append((roots, got["n"]))
        moved = relabelled(relabelled(edges, n, "a", roots, hot), n, "b", roots, hot).filter("a <> b")
        after, got = measured(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n=F.count("*"))
        discard(edges)
        edges = after
    labels = docs.select("doc_ix").distinct()
    if not steps:
        return labels.withColumn("component", F.col("doc_ix"))
    whole = steps[-1][0]
    for earlier, size in reversed(steps[:-1]):
        whole = relabelled(earlier, size, "p", whole, hot)
    return labels.join(whole.select(F.col("v").alias("doc_ix"), "p"), "doc_ix", "left").select("doc_ix", F.coalesce("p", "doc_ix").alias("component"))
