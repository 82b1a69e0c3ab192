"""Encoding with a public byte-level BPE vocabulary as a monoid over text halves.

``encode`` cuts a text into halves until a half is a leaf, encodes the leaves, and joins neighbours. A position between a
letter or digit and a following blank or line feed is *firm*: no alternative of the pre-tokenizer's pattern goes on from
the one to the other, none looks behind itself, and the one that looks ahead looks at blanks only. So a pre-token ends at
a firm position whatever stands around, and a text's ids are those of its part before and of its part after it.

When two nodes are joined at m, windows on both sides of m grow (doubling) until each holds a firm position, or the node
ends. The ids outside the two positions are those of the nodes, the text between them is encoded anew. The result equals
the encoding of the undivided text, and joining is associative.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import spread

VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published pre-tokenizer pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf; an ordinary text has several.
LEAF = 256
#: Characters of the first window on either side of a seam.
SEAM = 32
_FIRM = re.compile(r"[^\W_](?=[ \n])")


class Node(NamedTuple):
    lo: int
    hi: int
    ids: list[int]


class ByteBpe:
    """Encoder and decoder of one vocabulary file of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: len(b) for b, i in ranks.items()}

    def leaf(self, text: str, lo: int, hi: int) -> Node:
        return Node(lo, hi, self.bpe.encode_ordinary(text[lo:hi]))

    @staticmethod
    def _last_firm(text: str, lo: int, m: int) -> int:
        """The last firm position of the node from ``lo`` before ``m``, or ``lo``."""
        width = SEAM
        while True:
            begin = max(lo, m - width)
            found = -1
            for f in _FIRM.finditer(text, begin, m):
                found = f.end()
            if found > lo or begin == lo:
                return max(found, lo)
            width *= 2

    @staticmethod
    def _first_firm(text: str, m: int, hi: int) -> int:
        """The first firm position of the node to ``hi`` after ``m``, or ``hi``."""
        width = SEAM
        while True:
            end = min(hi, m + width)
            if f := _FIRM.search(text, m, end):
                return f.end()
            if end == hi:
                return hi
            width *= 2

    def _ids_in(self, ids: list[int], size: int, step: int) -> int:
        """How many ids from the begin (step 1) or the end (step -1) make up ``size`` bytes."""
        n = 0
        while size > 0:
            size -= self.bytes_of[ids[n if step > 0 else -1 - n]]
            n += 1
        return n

    def join(self, text: str, left: Node, right: Node) -> Node:
        """The node of both texts; ``right`` begins where ``left`` ends."""
        m = right.lo
        a, b = self._last_firm(text, left.lo, m), self._first_firm(text, m, right.hi)
        head = left.ids[: len(left.ids) - self._ids_in(left.ids, len(text[a:m].encode()), -1)]
        tail = right.ids[self._ids_in(right.ids, len(text[m:b].encode()), 1) :]
        return Node(left.lo, right.hi, head + self.bpe.encode_ordinary(text[a:b]) + tail)

    def tree(self, text: str, lo: int, hi: int, leaf: int) -> Node:
        if hi - lo <= leaf:
            return self.leaf(text, lo, hi)
        mid = (lo + hi) // 2
        return self.join(text, self.tree(text, lo, mid, leaf), self.tree(text, mid, hi, leaf))

    def encode(self, text: str | None, leaf: int = LEAF) -> list[int]:
        """Ids of ``text``; none for an empty or null text."""
        if not text:
            return []
        return self.tree(text, 0, len(text), max(1, leaf)).ids

    def decode(self, ids: list[int], leaf: int = LEAF) -> str:
        """The text of ``ids``: bytes of halves, concatenated up the tree."""
        return self._bytes(list(ids), leaf).decode("utf-8", errors="replace")

    def _bytes(self, ids: list[int], leaf: int) -> bytes:
        if len(ids) <= leaf:
            return self.bpe.decode_bytes(ids)
        mid = len(ids) // 2
        return self._bytes(ids[:mid], leaf) + self._bytes(ids[mid:], leaf)


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBpe:
    """One encoder per worker process and file."""
    return ByteBpe(path)


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(folder or VOCABULARY_DIR, name)


def encode_column(df: DataFrame, ident: str, text: str, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``(ident, ids ARRAY<INT>)`` of every row of ``df``, in its partitions, without a shuffle.

    Null and empty texts get the empty array. Repeated rows give repeated rows, other columns are dropped by the scan.
    """
    where = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(where)
        for batch in batches:
            texts = batch.column(1)
            step = 256
            for at in range(0, batch.num_rows, step):
                ids = [bpe.encode(t.as_py(), leaf) for t in texts.slice(at, step)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), pa.array(ids, pa.list_(pa.int32()))], ["i", "ids"])

    kind = df.schema[ident].dataType.simpleString()
    return spread(df.select(F.col(ident).alias("i"), F.col(text).cast("string").alias("t"))).mapInArrow(run, f"i {kind}, ids array<int>").withColumnRenamed("i", ident)


def count_tokens(df: DataFrame, text: str, name: str, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``df`` without ``text``, with the number of tokens of ``text`` as ``name`` (0 for null and empty texts)."""
    where = path or vocabulary_path()
    rest = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), f"`{name}` bigint"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(where)
        for frame in frames:
            sizes = [len(bpe.encode(t if isinstance(t, str) else None, leaf)) for t in frame[text]]
            yield frame.drop(columns=[text]).assign(**{name: sizes})

    return spread(df).mapInPandas(run, schema)
