"""Scalar text functions on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions.regexes import ASCII_WS, JSWS, PAGE_MARKER, phrase


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def has_phrase(text_c: Column, low: Column, words: str) -> Column:
    """Whether collapsed text holds a label or keyword; ``low`` is the text in lower case, searched first, as a plain
    search costs far less than the pattern with its boundaries."""
    return holds(low, words) & from_first(text_c, low, words).rlike("(?i)" + phrase(words))


def holds(low: Column, words: str) -> Column:
    """Whether collapsed text in lower case holds the words, whatever is around them."""
    return low.contains(_plain(words))


def from_first(text_c: Column, low: Column, words: str) -> Column:
    """Collapsed text from the character before the first place where ``low`` holds the words on; no pattern that begins
    with them matches earlier. Text that isn't ASCII stays whole, as its lower case may have other places."""
    return F.when(is_ascii(text_c), F.substring(text_c, F.instr(low, _plain(words)) - 1, F.length(text_c))).otherwise(text_c)


def _plain(words: str) -> str:
    return " ".join(words.lower().split())


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def collapse_ws(text: Column) -> Column:
    """Every run of white space as one space; not trimmed; null for null.

    In ASCII only runs that aren't one space already are matched, by a class that costs far less for each character.
    """
    quick = F.regexp_replace(text, rf"(?: (?={ASCII_WS})|[\t\n\x0B\f\r]){ASCII_WS}*", " ")
    return F.when(is_ascii(text), quick).otherwise(F.regexp_replace(text, JSWS + "+", " "))


def split_lines(text: Column) -> Column:
    """Trimmed lines with collapsed white space, without empty lines and page markers; null for null."""
    lines = F.transform(F.split(text, "\r?\n"), lambda line: F.trim(F.regexp_replace(line, JSWS + "+", " ")))
    return F.filter(lines, lambda line: (line != "") & ~line.rlike(PAGE_MARKER + r"\z"))


def alnum_count(text: Column) -> Column:
    """The number of ASCII letters and digits; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")), F.lit(0))


def utf16_length(text: Column) -> Column:
    """The length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def type_hue(name: Column) -> Column:
    """The hue of a type name: h * 31 + code, modulo 2^32, modulo 360."""
    codes = F.filter(F.split(name, ""), lambda c: c != "")
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % F.lit(4294967296)) % 360


def human_bytes(size: Column) -> Column:
    """A size for people."""
    return (
        F.when(size < 1024, F.format_string("%d B", size))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024.0))
        .otherwise(F.format_string("%.1f MB", size / (1024.0 * 1024.0)))
    )


def fields_summary(fields: dict[str, Column]) -> Column:
    """'name: value' of the fields that aren't null, joined by ' · '."""
    return F.array_join(F.filter(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items())), lambda x: x.isNotNull()), " · ")
