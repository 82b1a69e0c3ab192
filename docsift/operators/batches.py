"""Batches of linked documents, what stays alone, conflicts, and the report's figures."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.operators.components import components, star_edges
from docsift.session import HOT, HOT_KEYS, cut, join_hot, measured

DOC = ["doc_ix", "file_name", "document_type", "source"]


def present(value: Column) -> Column:
    """The value, or null where it is missing or empty."""
    return F.nullif(value, F.lit(""))


def document_keys(docs: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``(doc_ix, field, value)`` of the key fields that are present, as often as the document is in ``docs``; ``keys``: field
    name to column expression."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), present(F.expr(c)).alias("value")) for f, c in keys.items())))
    return docs.select("doc_ix", pairs.alias("p")).select("doc_ix", "p.field", "p.value").filter("value is not null")


class Segregated:
    """Documents in batches (components of two and more) and alone.

    ``docs`` has one row per document with ``doc_ix, file_name, document_type, source`` and the key columns; values link
    per field, never across fields.
    """

    def __init__(self, docs: DataFrame, keys: dict[str, str]):
        self.keys = keys
        self.docs = cut(docs.select(*DOC, *(present(F.expr(c)).alias(f) for f, c in keys.items())))
        self.links = document_keys(self.docs, {f: f"`{f}`" for f in keys})
        self.labels = cut(components(self.docs, self.links))

    @cached_property
    def _sizes(self) -> tuple[DataFrame, DataFrame | None]:
        """The number of documents of each component, and the components that are joined apart."""
        sizes, got = measured(self.labels.groupBy("component").agg(F.count("*").alias("size")), n=F.coalesce(F.sum("size"), F.lit(0)), most=F.coalesce(F.max("size"), F.lit(0)))
        least = max(HOT, got["n"] // HOT_KEYS)
        return sizes, sizes.filter(F.col("size") > least).select("component") if got["most"] > least else None

    @cached_property
    def placed(self) -> DataFrame:
        """The documents of batches with their component."""
        sizes, hot = self._sizes
        return self.docs.join(join_hot(self.labels, sizes.filter("size >= 2").select("component"), ["component"], hot, "inner"), "doc_ix")

    def edges(self) -> DataFrame:
        return star_edges(self.links)

    def key_values(self) -> DataFrame:
        """Per batch the first value, in document order, of each key field."""
        firsts = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("doc_ix"))).alias(f) for f in self.keys]
        return self.docs.join(self.labels, "doc_ix").groupBy("component").agg(F.count("*").alias("file_count"), *firsts).filter("file_count >= 2")

    def batches(self) -> DataFrame:
        """One row per batch: ``component, batch_id, <keys>, file_count``; equal labels stay two rows."""
        label = F.coalesce(*(F.col(f) for f in self.keys), F.concat(F.lit("GROUP-"), F.col("component")))
        return self.key_values().withColumn("batch_id", F.concat(F.lit("BATCH-"), label))

    def members(self) -> DataFrame:
        """One row per document of a batch: ``component, batch_id, doc_ix, file_name, document_type, source``; the order
        within a batch is that of ``doc_ix``."""
        own = self.placed.select("component", *DOC)
        return join_hot(own, self.batches().select("component", "batch_id"), ["component"], self._sizes[1], "inner").select("component", "batch_id", *DOC)

    def conflicts(self) -> DataFrame:
        """``(component, field, kept, other, doc_ix)``: documents whose value differs from the one the batch keeps."""
        kept = self.key_values().select("component", *(F.col(f).alias(f"kept_{i}") for i, f in enumerate(self.keys)))
        both = join_hot(self.placed, kept, ["component"], self._sizes[1], "inner")
        fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"kept_{i}").alias("kept"), F.col(f).alias("other")) for i, f in enumerate(self.keys)))
        return both.select("component", "doc_ix", F.inline(fields)).filter("other <> kept").select("component", "field", "kept", "other", "doc_ix")

    def report_map(self) -> DataFrame:
        """The batches by label as a report has them: of two with one label the later one."""
        b = self.batches()
        return b.groupBy("batch_id").agg(F.max_by(F.struct("component", "file_count"), "component").alias("b")).select("batch_id", "b.component", "b.file_count")

    def unbatched(self) -> DataFrame:
        """``(key, doc_ix, ...)`` of the documents alone: 'field:value' of the first key present, else UNIDENTIFIED."""
        key = F.coalesce(*(F.concat(F.lit(f"{f}:"), F.col(f)) for f in self.keys), F.lit("UNIDENTIFIED"))
        alone = self._sizes[0].filter("size = 1").select(F.col("component").alias("doc_ix"))  # it is its own component
        return self.docs.join(alone, "doc_ix").select(key.alias("key"), *DOC)

    def summary(self, errors: DataFrame) -> DataFrame:
        """The six figures of the report, one row."""
        docs = self.docs.agg(F.count("*").alias("analyzed"), F.count_if(F.col("source") == "ocr").alias("ocr_used"))
        failed = errors.agg(F.count("*").alias("failed"))
        batches = self.batches().agg(F.count_distinct("batch_id").alias("batches"))
        alone = self.unbatched().agg(F.count_distinct("key").alias("unbatched_groups"))
        one = docs.crossJoin(failed).crossJoin(batches).crossJoin(alone)  # one row each
        return one.select((F.col("analyzed") + F.col("failed")).alias("total_pdfs"), "analyzed", "ocr_used", "failed", "batches", "unbatched_groups")
