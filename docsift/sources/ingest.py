"""Sources: directories and buffers of PDF files, the choice between embedded and recognised text, pages, uploads."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import alnum_count
from docsift.operators.images import preprocess
from docsift.session import cut, numbered
from docsift.sources.pdf import embedded_text

#: Fewer letters and digits than this in the embedded text mean recognition; limits of an upload.
ENOUGH_TEXT = 25
MAX_FILES = 200
MAX_BYTES = 25 * 1024 * 1024
#: Fixed value: how much larger than printed a page is drawn for recognition.
SCALE = 2


class OcrEngine(Protocol):
    """Recognises a PDF's pages; made once per Python worker by the factory given to ingest()."""

    def pages(self, content: bytes) -> Sequence[str]: ...


class PageRasterizer(Protocol):
    """Draws a PDF's pages as (h, w, 3) arrays of red, green, blue; made once per Python worker."""

    def images(self, content: bytes, scale: int) -> Sequence[np.ndarray]: ...


class ImageEngine(Protocol):
    """Recognises one page, black on white, that was drawn by a PageRasterizer; made once per Python worker."""

    def page(self, image: np.ndarray) -> str: ...


def read_directory(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_ix, file_name, content)`` of the files ``*.pdf`` (any case) in ``folder`` itself, numbered by name."""
    files = spark.read.format("binaryFile").load(folder).withColumn("file_name", F.regexp_extract("path", r"([^/]+)\z", 1))
    pdfs = files.filter(F.col("file_name").rlike(r"(?i)^.+\.pdf\z"))
    # the contents don't pass the sort, and the names don't pass the driver
    order = numbered(pdfs.select("path", "file_name"), ["file_name", "path"], "doc_ix")
    return order.join(pdfs.select("path", "content"), "path").select("doc_ix", "file_name", "content")


def read_pdf(path: str) -> str:
    """The text layer of one PDF file."""
    with open(path, "rb") as f:
        return embedded_text(f.read())


def read_buffers(spark: SparkSession, files: Sequence[tuple[str, bytes]]) -> DataFrame:
    """``(doc_ix, file_name, content)`` of files in memory, in their order."""
    return spark.createDataFrame([(i, n, bytearray(c)) for i, (n, c) in enumerate(files)], "doc_ix bigint, file_name string, content binary")


def guard_upload(files: DataFrame) -> DataFrame:
    """``files (name, size, ...)`` with ``accepted`` and ``problem`` ('type', 'size' or null) of each file."""
    problem = F.when(~F.col("name").rlike(r"(?i)\.pdf\z"), "type").when(F.col("size") > MAX_BYTES, "size")
    return files.withColumn("problem", problem).withColumn("accepted", F.col("problem").isNull())


def guard_requests(files: DataFrame) -> DataFrame:
    """One row per request of ``files (request, name, media, size)``: ``request, files, accepted, problem``.

    One file that breaks a limit, or more than MAX_FILES of them, refuse the whole request; of several problems the number
    of files is named first, then a type, then a size. A file is a PDF by its media type or by its name. A null size or
    name breaks its limit; a null request is a request.
    """
    pdf = F.coalesce((F.col("media") == "application/pdf") | F.col("name").rlike(r"(?i)\.pdf\z"), F.lit(False))
    small = F.coalesce(F.col("size") <= MAX_BYTES, F.lit(False))
    per = files.groupBy("request").agg(F.count("*").alias("files"), F.count_if(~pdf).alias("others"), F.count_if(~small).alias("large"))
    problem = F.when(F.col("files") > MAX_FILES, "count").when(F.col("others") > 0, "type").when(F.col("large") > 0, "size")
    return per.select("request", "files", problem.isNull().alias("accepted"), problem.alias("problem"))


def check_upload(files: Sequence[tuple[str, bytes, str]]) -> None:
    """Raises ValueError for an upload ``(name, content, media type)`` that breaks a limit: all of it is refused."""
    if not files:
        raise ValueError("no files")
    if len(files) > MAX_FILES:
        raise ValueError("too many files")
    for name, content, media in files:
        if media != "application/pdf" and not name.lower().endswith(".pdf"):
            raise ValueError(f"{name} is no PDF")
        if len(content) > MAX_BYTES:
            raise ValueError(f"{name} is too large")


def route_text(df: DataFrame) -> DataFrame:
    """``embedded_text, ocr_text`` as ``text, source``: embedded where it has enough letters and digits, else recognised
    text if that has any, else embedded. Null texts count as empty."""
    enough = F.coalesce(alnum_count(F.col("embedded_text")), F.lit(0)) >= ENOUGH_TEXT
    read = F.coalesce(alnum_count(F.col("ocr_text")), F.lit(0)) > 0
    ocr = ~enough & read
    return df.withColumn("source", F.when(ocr, "ocr").otherwise("text")).withColumn("text", F.when(ocr, F.col("ocr_text")).otherwise(F.col("embedded_text"))).drop("embedded_text", "ocr_text")


def concat_pages(pages: DataFrame, doc: str, position: str, text: str) -> DataFrame:
    """``(doc, text)``: the texts of a document's pages by position, with a blank line between; null pages are skipped."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(position).alias("pos"), F.col(text).alias("text"))))
    return pages.groupBy(doc).agg(ordered.alias("p")).select(doc, F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def ingest(
    files: DataFrame, engine: Callable[[], OcrEngine | ImageEngine] | None = None, read: Callable[[bytes], str] = embedded_text, rasterizer: Callable[[], PageRasterizer] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(docs, errors)`` of ``files (doc_ix, file_name, content)``.

    ``docs`` has ``doc_ix, file_name, source, text``, ``errors`` has ``doc_ix, file_name, reason``. A file that fails, also
    for lack of an engine, becomes an error and stops no other. An engine is made once per Python worker, and only for
    files whose embedded text is too short; what came out is written once, so no file is read twice. With a rasterizer each page is drawn, preprocessed and given to the
    ImageEngine; without one the OcrEngine gets the file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: OcrEngine | ImageEngine | None = None
        drawer: PageRasterizer | None = None
        try:
            for frame in frames:
                rows = []
                for ix, name, content in zip(frame["doc_ix"], frame["file_name"], frame["content"], strict=True):
                    try:
                        text, source = read(bytes(content)), "text"
                        if sum(c.isascii() and c.isalnum() for c in text) < ENOUGH_TEXT:
                            if engine is None:
                                raise RuntimeError("no engine for recognition is registered")
                            made = made or engine()
                            if rasterizer is not None:
                                drawer = drawer or rasterizer()
                                seen = "\n\n".join([made.page(preprocess(i)) for i in drawer.images(bytes(content), SCALE)])
                            else:
                                seen = "\n\n".join(made.pages(bytes(content)))
                            if any(c.isascii() and c.isalnum() for c in seen):
                                text, source = seen, "ocr"
                        rows.append((ix, name, source, text, None))
                    except Exception as e:  # a document's failure is its own
                        rows.append((ix, name, None, None, str(e) or type(e).__name__))
                yield pd.DataFrame(rows, columns=["doc_ix", "file_name", "source", "text", "reason"])
        finally:
            for held in (made, drawer):
                if held is not None and hasattr(held, "close"):
                    held.close()

    done = cut(files.mapInPandas(run, "doc_ix bigint, file_name string, source string, text string, reason string"))
    return done.filter("reason is null").drop("reason"), done.filter("reason is not null").select("doc_ix", "file_name", "reason")
