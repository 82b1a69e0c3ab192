"""The queries of the core and their SQL, by name. Texts are those of ``documents``, batches those of ``analyzed``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.config import default
from docsift.functions import regexes as R
from docsift.functions import text as T
from docsift.operators import extract as X
from docsift.operators import images
from docsift.operators.analyze import analyze, classify, split_text
from docsift.operators.batches import Segregated
from docsift.operators.classify import keyword_scores
from docsift.operators.timestamps import instants, resolve_timestamps
from docsift.plans import sql
from docsift.plans.render import rendered_docs
from docsift.plans.report import flat_documents
from docsift.session import spread, table
from docsift.sources.ingest import concat_pages, guard_requests, guard_upload, ingest, route_text
from docsift.sources.pdf import text_pdf

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = default()
KEYS = {"documentNumber": "doc_fields.document_number", "referenceNumber": "doc_fields.reference_number"}
FIELDS = {f.name: f for f in CONFIG.fields}


def texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _on_texts(make: Callable[[DataFrame], DataFrame], spark: SparkSession, d: str) -> DataFrame:
    return make(split_text(texts(spark, d)))


def _column(name: str, column: Callable[[], Column], spark: SparkSession, d: str) -> DataFrame:
    """One value per text; ``column`` is made when the query runs, as columns need a session."""
    return split_text(texts(spark, d)).select("doc_id", column().alias(name))


def _scores(df: DataFrame) -> DataFrame:
    scores = keyword_scores(F.coalesce("text_c", F.lit("")), CONFIG)
    return df.select("doc_id", *(s.cast("int").alias("score_" + n.lower().replace(" ", "_")) for n, s in scores.items()))


def _analyze(spark: SparkSession, d: str) -> DataFrame:
    return analyze(texts(spark, d)).select("doc_id", F.col("documentType").alias("document_type"), *(F.col(f"fields.{f}").alias(f) for f in CONFIG.field_names))


def documents_to_batch(spark: SparkSession, d: str) -> DataFrame:
    """One row per analyzed document: deliveries repeat, the values don't."""
    return table(spark, d, "analyzed").select("doc_ix", "file_name", "source", "document_type", "doc_fields").dropDuplicates(["doc_ix"])


def _segregated(spark: SparkSession, d: str) -> Segregated:
    return Segregated(documents_to_batch(spark, d), KEYS)


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return _segregated(spark, d).batches().select("component", "batch_id", "documentNumber", "referenceNumber", "file_count")


def _rendered_analyze(spark: SparkSession, d: str) -> DataFrame:
    return analyze(rendered_docs(spark, d)).select("doc_ix", F.col("documentType").alias("document_type"), *(F.col(f"fields.{f}").alias(f) for f in CONFIG.field_names))


def _rendered(spark: SparkSession, d: str) -> Segregated:
    linking = replace(CONFIG, fields=tuple(CONFIG.batch_keys))  # no other field is extracted for batches
    return Segregated(flat_documents(rendered_docs(spark, d), linking), {f.name: f"fields.{f.name}" for f in linking.fields})


def rendered_batches(spark: SparkSession, d: str) -> DataFrame:
    """From texts to batches: render, classify, extract, link, group."""
    return _rendered(spark, d).batches().select("component", "batch_id", "documentNumber", "referenceNumber", "file_count")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of 64 values as images of 8 x 8 gray pixels."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "v"))
    return v.select("image_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 1) * 127.5))).cast("int").alias("gray"))


def colors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(61))).alias("p"))
    level = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("embedding")[F.col("p") + k].cast("double") + 1) * 127.5))).cast("int")
    return e.select("image_id", F.col("p").alias("x"), level(0).alias("r"), level(1).alias("g"), level(2).alias("b"))


def _summary(df: DataFrame) -> DataFrame:
    named = {n: F.col(f"doc_fields.{c}") for n, c in {"number": "document_number", "reference": "reference_number", "company": "company_name", "address": "address", "date": "doc_date", "amount": "amount"}.items()}
    return df.select("doc_ix", T.fields_summary(named).alias("summary"))


def _guard(spark: SparkSession, d: str) -> DataFrame:
    files = texts(spark, d).select("doc_id", F.concat(F.lit("f"), F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, ".PDF").otherwise(".txt")).alias("name"), (F.coalesce(F.length("text"), F.lit(0)) * 40_000).cast("bigint").alias("size"))
    return guard_upload(files).select("doc_id", "accepted", "problem")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a vendor as one request: some by media type, some by name, some no PDF, some too large."""
    t = table(spark, d, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".txt"))
    media = F.when((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 7 != 0), "application/pdf").otherwise("text/plain")
    return guard_requests(t.select(F.col("vendor_key").alias("request"), name.alias("name"), media.alias("media"), (F.coalesce("n_chars", F.lit(0)) * 10_000).alias("size")))


def _isolation(spark: SparkSession, d: str) -> DataFrame:
    docs, errors = ingest(buffers(spark, d))
    return docs.select(F.col("source").alias("outcome")).unionByName(errors.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


def buffers(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_ix, file_name, content)``: the texts of ``doc_text`` as PDF files, and a broken file for each row of
    ``doc_errors``: encrypted, no PDF, or cut off before its text ends."""
    good = table(spark, d, "doc_text").select("doc_ix", "file_name", "text", F.lit("").alias("broken")).dropna(subset=["text"]).distinct()
    broken = F.when(F.col("reason") == "Password required", "encrypted").when(F.col("reason") == "Invalid PDF structure", "no PDF").otherwise("cut off")
    bad = table(spark, d, "doc_errors").select(F.xxhash64("file_name", "reason", "noted_at").alias("doc_ix"), "file_name", F.lit("a text that nobody reads").alias("text"), broken.alias("broken"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for text, how in zip(frame["text"], frame["broken"], strict=True):
                pdf = text_pdf(text, how == "encrypted")
                made.append(text.encode() if how == "no PDF" else pdf[: pdf.index(b"endstream")] if how == "cut off" else pdf)
            yield frame[["doc_ix", "file_name"]].assign(content=made)

    return spread(good.unionByName(bad)).mapInPandas(run, "doc_ix bigint, file_name string, content binary")


def _ingest_split(spark: SparkSession, d: str) -> DataFrame:
    docs, errors = ingest(buffers(spark, d))
    return docs.unionByName(errors, allowMissingColumns=True)


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    files = documents_to_batch(spark, d).select("doc_ix", "file_name", F.length("file_name").alias("size"))
    return files.groupBy("file_name", "size").agg(F.min("doc_ix").alias("doc_ix"))


def queries() -> dict[str, Query]:
    """Every operator of the core by the name of its query."""
    labels = lambda f: FIELDS[f].labels
    value = lambda f: X.run_extractor(FIELDS[f], F.col("text_c"), F.col("lines"))
    lines = lambda: F.col("lines")
    out: dict[str, Query] = {
        "collapse_ws": partial(_column, "collapsed", lambda: F.col("text_c")),
        "split_lines": partial(_on_texts, lambda df: df.select("doc_id", F.posexplode("lines").alias("k", "line")).select("doc_id", (F.col("k") + 1).cast("bigint").alias("line_no"), "line")),
        "alnum_count": partial(_column, "alnum", lambda: T.alnum_count(F.col("text")).cast("bigint")),
        "phrase_match": partial(_on_texts, lambda df: df.select("doc_id", F.col("text_c").rlike("(?i)" + R.phrase("Invoice No")).alias("invoice_no"), F.col("text_c").rlike("(?i)" + R.phrase("P.O.")).alias("p_o"), F.col("text_c").rlike("(?i)" + R.phrase("Inv #")).alias("inv"))),
        "ocr_route": lambda s, d: route_text(texts(s, d).select("doc_id", F.col("text").alias("embedded_text"), F.reverse("text").alias("ocr_text"))).select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n")),
        "page_concat": lambda s, d: concat_pages(table(s, d, "doc_text").select("file_name", "doc_ix", "text").distinct(), "file_name", "doc_ix", "text"),
        "keyword_scores": partial(_on_texts, _scores),
        "classify": lambda s, d: classify(texts(s, d)).select("doc_id", F.col("documentType").alias("document_type")),
        "analyze": _analyze,
        "extract_document_number": partial(_column, "value", lambda: value("documentNumber")),
        "extract_reference_number": partial(_column, "value", lambda: value("referenceNumber")),
        "extract_amount_labeled": partial(_column, "value", lambda: X.amount_labeled(labels("amount"), lines())),
        "extract_amount_fallback": partial(_column, "value", lambda: X.amount_fallback(lines())),
        "extract_amount": partial(_column, "value", lambda: value("amount")),
        "extract_date_labeled": partial(_column, "value", lambda: X.date_labeled(labels("date"), lines())),
        "extract_date_fallback": partial(_column, "value", lambda: X.date_fallback(lines())),
        "extract_date": partial(_column, "value", lambda: value("date")),
        "extract_company": partial(_column, "value", lambda: value("companyName")),
        "address_line_score": partial(_on_texts, lambda df: df.select("doc_id", F.posexplode(F.transform(F.slice("lines", 1, 25), X.address_line_score)).alias("k", "score")).select("doc_id", (F.col("k") + 1).cast("bigint").alias("line_no"), "score")),
        "extract_address": partial(_column, "value", lambda: value("address")),
        "linkage_edges": lambda s, d: _segregated(s, d).edges(),
        "batch_components": lambda s, d: _segregated(s, d).labels,
        "batches": _batches,
        "batch_members": lambda s, d: _segregated(s, d).members(),
        "rendered_analyze": _rendered_analyze,
        "rendered_batches": rendered_batches,
        "rendered_unbatched": lambda s, d: _rendered(s, d).unbatched().select("key", "doc_ix", "document_type"),
        "batch_key_values": lambda s, d: _segregated(s, d).key_values(),
        "batch_conflicts": lambda s, d: _segregated(s, d).conflicts(),
        "batch_report_map": lambda s, d: _segregated(s, d).report_map(),
        "unbatched": lambda s, d: _segregated(s, d).unbatched(),
        "report_summary": lambda s, d: _segregated(s, d).summary(table(s, d, "doc_errors")),
        "grayscale": lambda s, d: images.pixel_grayscale(colors(s, d)),
        "median3x3": lambda s, d: images.pixel_median3x3(pixels(s, d)),
        "gray_histogram": lambda s, d: images.pixel_histogram(pixels(s, d)),
        "otsu_threshold": lambda s, d: images.pixel_otsu(pixels(s, d)),
        "binarize": lambda s, d: images.pixel_binarize(pixels(s, d)),
        "upload_guard": _guard,
        "upload_dedup": _dedup,
        "type_hue": lambda s, d: documents_to_batch(s, d).select("document_type").distinct().select("document_type", T.type_hue(F.col("document_type")).alias("hue")),
        "fields_summary": lambda s, d: _summary(documents_to_batch(s, d)),
        "upload_requests": _requests,
        "human_bytes": lambda s, d: table(s, d, "documents").select("doc_id", T.human_bytes(F.coalesce("n_chars", F.lit(0)) * 1_000).alias("size")),
        "error_isolation": _isolation,
        "ingest_split": _ingest_split,
        "p2_found": lambda s, d: instants(table(s, d, "analyzed"), table(s, d, "intake_sites")),
        "p2_resolved": lambda s, d: resolve_timestamps(table(s, d, "analyzed"), table(s, d, "intake_sites")),
    }
    return out


def oracle_sql() -> dict[str, str]:
    return sql.statements(CONFIG)
