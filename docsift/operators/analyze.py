"""Classify and extract: one projection over a DataFrame of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.config import Config, default
from docsift.functions.text import collapse_ws, split_lines
from docsift.operators.classify import document_type, keyword_scores
from docsift.operators.extract import run_extractor


def split_text(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text_c`` (collapsed), ``text_low`` (that in lower case, computed once for all searches) and ``lines``."""
    return df.withColumn("text_c", collapse_ws(F.col(text))).withColumn("text_low", F.lower("text_c")).withColumn("lines", split_lines(F.col(text)))


def classify(df: DataFrame, config: Config | None = None, text: str = "text") -> DataFrame:
    """``df`` with ``documentType``; Unknown for null and empty texts."""
    config = config or default()
    return split_text(df, text).withColumn("documentType", document_type(keyword_scores(F.coalesce("text_c", F.lit("")), config, F.coalesce("text_low", F.lit("")))))


def _field(spec, config: Config) -> Column:  # noqa: ANN001
    value = run_extractor(spec, F.col("text_c"), F.col("lines"), F.col("text_low"))
    return (value if spec.applies_to is None else F.when(F.col("documentType").isin(list(spec.applies_to)), value)).alias(spec.name)


def analyze(df: DataFrame, config: Config | None = None, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``documentType`` and the struct ``fields`` of all configured fields.

    A field is null where it doesn't apply to the type, or nothing was found. Row by row: no shuffle, no Python.
    """
    config = config or default()
    typed = classify(df, config, text)
    return typed.withColumn("fields", F.struct(*(_field(f, config) for f in config.fields))).drop("text_c", "text_low", "lines", text)
