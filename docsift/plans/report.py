"""The report of a run, and the command line."""

from __future__ import annotations

import json
import time
from collections import defaultdict
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.config import Config, default
from docsift.operators.analyze import analyze
from docsift.operators.batches import Segregated
from docsift.session import cut, discard
from docsift.sources.ingest import ImageEngine, OcrEngine, PageRasterizer, check_upload, ingest, read_buffers, read_directory


def flat_documents(docs: DataFrame, config: Config) -> DataFrame:
    """Analysed documents with their key fields as columns, as Segregated takes them."""
    return analyze(docs, config).select("doc_ix", "file_name", F.col("documentType").alias("document_type"), "source", "fields")


def report_json(spark: SparkSession, docs: DataFrame, errors: DataFrame, config: Config | None = None, source: str | None = None) -> str:
    """The report of ``docs (doc_ix, file_name, source, text)`` and ``errors (file_name, reason)`` as JSON with two spaces.

    It is one document for people, so its rows come to the driver, once each; write_report() is for more.
    """
    config = config or default()
    began = time.time()
    flat = cut(flat_documents(docs, config))
    seg = Segregated(flat, {f.name: f"fields.{f.name}" for f in config.batch_keys})
    of: dict[int, list[dict]] = defaultdict(list)
    for m in seg.members().orderBy("doc_ix").toLocalIterator():
        of[m["component"]].append({"fileName": m["file_name"], "documentType": m["document_type"], "source": m["source"]})
    batches: dict[str, dict] = {}
    for b in seg.batches().orderBy("component").toLocalIterator():
        batches[b["batch_id"]] = {k: b[k] for k in seg.keys if b[k]} | {"fileCount": b["file_count"], "documents": of[b["component"]]}
    unbatched: dict[str, list] = {}
    for u in seg.unbatched().join(flat.select("doc_ix", "fields"), "doc_ix").orderBy("doc_ix").toLocalIterator():
        unbatched.setdefault(u["key"], []).append({"fileName": u["file_name"], "documentType": u["document_type"], "source": u["source"], "fields": u["fields"].asDict()})
    s = seg.summary(errors).first()
    figures = {"totalPdfs": s["total_pdfs"], "analyzed": s["analyzed"], "ocrUsed": s["ocr_used"], "failed": s["failed"], "batches": len(batches), "unbatchedGroups": len(unbatched)}
    head = {"generatedAt": datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")}
    head |= {"sourceDirectory": source} if source is not None else {"durationMs": round((time.time() - began) * 1000)}
    failed = [{"fileName": e["file_name"], "reason": e["reason"]} for e in errors.select("file_name", "reason").collect()]
    discard(flat)
    return json.dumps(head | {"summary": figures, "batches": batches, "unbatched": unbatched, "errors": failed}, indent=2, ensure_ascii=False)


def write_report(docs: DataFrame, errors: DataFrame, folder: str, config: Config | None = None) -> None:
    """The report of ``docs`` and ``errors`` as folders of JSON lines below ``folder``, written by the tasks: ``summary``,
    ``batches`` (one row each), ``members`` (one row per document of a batch), ``unbatched`` and ``errors``."""
    config = config or default()
    flat = cut(flat_documents(docs, config))
    seg = Segregated(flat, {f.name: f"fields.{f.name}" for f in config.batch_keys})
    parts = {"summary": seg.summary(errors), "batches": seg.batches(), "members": seg.members(), "unbatched": seg.unbatched().join(flat.select("doc_ix", "fields"), "doc_ix"), "errors": errors}
    for name, part in parts.items():
        part.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
    discard(flat)


def run_directory(spark: SparkSession, folder: str, out: str, config: Config | None = None) -> str:
    """Reads a folder of PDF files and writes its report to ``out``."""
    docs, errors = ingest(read_directory(spark, folder))
    text = report_json(spark, docs, errors, config, source=folder)
    with open(out, "w", encoding="utf-8") as f:
        f.write(text)
    return text


def classify_buffers(
    spark: SparkSession, files: Sequence[tuple[str, bytes, str]], config: Config | None = None, engine: Callable[[], OcrEngine | ImageEngine] | None = None, rasterizer: Callable[[], PageRasterizer] | None = None
) -> dict:
    """The report of an upload ``(name, content, media type)``; raises ValueError if it breaks a limit."""
    check_upload(files)
    docs, errors = ingest(read_buffers(spark, [(n, c) for n, c, _ in files]), engine, rasterizer=rasterizer)
    return json.loads(report_json(spark, docs, errors, config))


def config_frame(spark: SparkSession, config: Config | None = None) -> DataFrame:
    """One row: the branding, and the names of the document types and fields."""
    config = config or default()
    branding = config.branding
    schema = ", ".join([*(f"{k} string" for k in branding), "documentTypes array<string>", "fields array<string>"])
    return spark.createDataFrame([(*branding.values(), config.type_names, config.field_names)], schema)
