"""Analysing documents as they arrive. An extension: the row-local operators run unchanged on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from docsift.config import Config
from docsift.operators.analyze import analyze


def analyze_stream(texts: DataFrame, config: Config | None = None) -> DataFrame:
    """``analyze`` over a streaming DataFrame with a ``text`` column."""
    if not texts.isStreaming:
        raise ValueError("not a stream")
    return analyze(texts, config)


def write_batches(analyzed: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands every micro-batch to ``sink``; linking merges components there, as it isn't monotone."""
    return analyzed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
