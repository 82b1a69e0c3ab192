"""One consistent form for texts that look the same.

DuckDB runs inside Arrow partitions: one embedded SQL statement maps compatibility forms, spaces of other widths,
invisible characters and look-alike letters with ``translate``, ``regexp_replace`` and ``nfc_normalize``. The
compatibility forms come from the Unicode data: full and half width (Katakana as well) and unbreakable forms are the
plain characters; ligatures, digraphs, Roman numerals and rows of dots are the letters and dots they show. What a reader
can see stays: letter case, accents, digits, punctuation and line breaks, the number of spaces, and also superscripts,
ordinal signs, fractions, the long s or squared units, which a full compatibility decomposition would flatten.

Look-alikes are resolved by word: a word that holds a letter only Cyrillic (Greek) has is written in Cyrillic (Greek),
every other word in Latin letters. Letters with no double decide, and these are the same in all variants of a word,
so the form does not depend on the variant.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import classes_within, pairs_within
from docsift.session import spread

# Letters of other scripts and their Latin doubles.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜаеѕіјорсухһԁԛԝӏү", "ABESIJKMHOPCTYXYQWaesijopcyxhdqwly", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEZHIKMNOPTYXovj", strict=True))
OTHER = dict(zip("ոօսցհɡıK․꞉∕⁄‐‑ʼ;։∶∣ǀ−ɑ", "nouqhgiK.://--';::||-a", strict=True))
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\t]"
MARKS = "̧̨̀́̂̃̄̆̇̈̊̋̌͂"


#: Decomposed by the Unicode data, but of another look than what they decompose to: long s, Greek symbols, Coptic forms.
OTHER_LOOK = set(map(chr, [0x17F, *range(0x3D0, 0x3D7), *range(0x3F0, 0x3F6), 0x3F9]))


def compatible() -> dict[str, str]:
    """Characters and the plain ones that look the same, width apart, by the kind of their decomposition."""
    out = {}
    for c in map(chr, range(0x80, 0x110000)):
        kind, _, parts = unicodedata.decomposition(c).partition(" ")
        if kind not in ("<wide>", "<narrow>", "<noBreak>", "<compat>") or c in OTHER_LOOK:
            continue
        plain = "".join(chr(int(x, 16)) for x in parts.split())
        shown = unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo", "Nl", "Po") and plain[0] not in " /(" and "/" not in plain
        if kind != "<compat>" or shown:
            out[c] = unicodedata.normalize("NFKC", plain) if kind == "<compat>" else plain
    return out


def _with_accents(pairs: dict[str, str]) -> dict[str, str]:
    """``pairs``, and every composed letter of a base and a mark that exists on both sides."""
    out = dict(pairs)
    for a, b in pairs.items():
        for mark in MARKS:
            x, y = unicodedata.normalize("NFC", a + mark), unicodedata.normalize("NFC", b + mark)
            if len(x) == 1 == len(y):
                out[x] = y
    return out


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translate(expr: str, pairs: dict[str, str]) -> str:
    return f"translate({expr}, {_sql(''.join(pairs))}, {_sql(''.join(pairs.values()))})"


def statement(source: str = "batch") -> str:
    """The SQL over a relation of ``i, t``; gives ``i, t, form`` (null where t is null)."""
    plain = {c: x for c, x in compatible().items() if not c.isspace()}
    single = {c: x for c, x in plain.items() if len(x) == 1}
    several = {c: x for c, x in plain.items() if len(x) > 1}
    expr = f"regexp_replace(t, {_sql(INVISIBLE)}, '', 'g')"
    expr = f"regexp_replace({expr}, {_sql(SPACES)}, ' ', 'g')"
    expr = _translate(expr, single | OTHER)
    cut_up = "f1"
    for a, b in several.items():
        cut_up = f"replace({cut_up}, {_sql(a)}, {_sql(b)})"
    cyrillic, greek = _with_accents(CYRILLIC), _with_accents(GREEK)
    latin_of = cyrillic | greek
    # a word in Latin doubles; NFC before, so that composed letters are found, and after, as translating may leave a pair
    joined = f"nfc_normalize(CASE WHEN regexp_matches(f1, '[{''.join(several)}]') THEN {cut_up} ELSE f1 END)"
    back_cyrillic = {v: k for k, v in reversed(list(cyrillic.items()))}
    back_greek = {v: k for k, v in reversed(list(greek.items()))}
    only_cyrillic = "".join(sorted(c for c in map(chr, range(0x400, 0x530)) if c not in cyrillic and unicodedata.category(c)[0] == "L"))
    only_greek = "".join(sorted(c for c in map(chr, range(0x370, 0x400)) if c not in greek and unicodedata.category(c)[0] == "L"))
    word = _translate("w", latin_of)
    return f"""
        SELECT i, t, nfc_normalize(array_to_string(list_transform(
            regexp_extract_all(flat, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'),
            lambda w: CASE
                WHEN NOT regexp_matches(w, '[^\\x00-\\x7F]') THEN w
                WHEN regexp_matches(w, '[{only_cyrillic}]') THEN {_translate(word, back_cyrillic)}
                WHEN regexp_matches(w, '[{only_greek}]') THEN {_translate(word, back_greek)}
                ELSE {word} END), '')) AS form
        FROM (SELECT i, t, {joined} AS flat FROM (SELECT i, t, {expr} AS f1 FROM {source}))"""


def consistent_form(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``(ident, text, form)`` of every row of ``df``: null where the text is null, '' where it is empty."""
    kind = df.schema[ident].dataType.simpleString()
    query = statement()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 1_024):
                    con.register("batch", pa.Table.from_batches([batch.slice(at, 1_024)]))
                    for out in con.sql(query).to_arrow_table().to_batches():
                        yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(out.columns, (batch.schema.field("i").type, pa.string(), pa.string()), strict=True)], ["i", "t", "form"])
        finally:
            con.close()

    rows = spread(df.select(F.col(ident).alias("i"), F.col(text).cast("string").alias("t"))).mapInArrow(run, f"i {kind}, t string, form string")
    return rows.select(F.col("i").alias(ident), F.col("t").alias(text), "form")


def same_looking_pairs(df: DataFrame, ident: str = "doc_id", text: str = "text", left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Pairs of ids, smaller first, whose texts look the same but are not the identical string.

    Null and empty texts are in no pair; exact copies are no pair. Texts and forms are compared by 256-bit digests,
    so whole texts aren't shuffled.
    """
    return pairs_within(_digests(df, ident, text), "look", ident, "exact", left, right)


def same_looking_classes(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(ident, class_id, links)`` of every row whose text is neither null nor empty: the smallest id of the texts that
    look the same, and how many of them are not the identical string."""
    return classes_within(_digests(df, ident, text), "look", ident, "exact")


def _digests(df: DataFrame, ident: str, text: str) -> DataFrame:
    forms = consistent_form(df.filter(F.length(text) > 0), ident, text)
    return forms.select(ident, F.unhex(F.sha2("form", 256)).alias("look"), F.unhex(F.sha2(text, 256)).alias("exact"))
