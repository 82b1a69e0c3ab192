"""Patterns in two dialects: Java's for Spark, RE2's for the SQL that checks it.

Word boundaries are ASCII in both: Java's own would look at Unicode letters. White space is the class JSWS in both, the
one that also holds non-breaking and other wide spaces.
"""

from __future__ import annotations

import re

JSWS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The part of JSWS that ASCII text can hold.
ASCII_WS = r"[\t\n\x0B\f\r ]"
#: An ASCII word boundary in Java.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
RE2_B = r"\b"

# Shapes of ids, money, dates, company and address lines.
ID = r"((?=[A-Za-z0-9/_-]*\d)[A-Za-z0-9][A-Za-z0-9/_-]{2,})"
RE2_ID = r"(\d[A-Za-z0-9/_-]{2,}|[A-Za-z]\d[A-Za-z0-9/_-]+|[A-Za-z][A-Za-z/_-]+\d[A-Za-z0-9/_-]*)"
CURRENCY = r"(?:(?:rs\.?|inr|usd|eur|gbp|aud|cad|₹|\$|€|£)\s*)?"
MONEY_FORMATTED = r"(\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?|\d+\.\d{1,2})"
MONEY_LABELED = r"(\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)"
MONTHS = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DATES = (r"(\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4})", rf"(\d{{1,2}}\s+{MONTHS}\.?\s+\d{{2,4}})", rf"({MONTHS}\.?\s+\d{{1,2}},?\s+\d{{2,4}})")
COMPANY_SUFFIX = (
    r"(?:pvt\.?\s*ltd\.?|private\s+limited|ltd\.?|limited|llp|llc|inc\.?|incorporated|corp\.?|corporation|co\.?|company|gmbh|s\.?a\.?|b\.?v\.?|plc"
    r"|enterprises?|traders?|industries|exports?|imports?|solutions|services|technologies|systems)"
)
NOT_COMPANY = r"(?:invoice|receipt|purchase\s+order|statement|bill\s+to|ship\s+to|date|gstin|tax|total|amount|tel|phone|email|www|http|page)"
ADDRESS_HINT = (
    r"(?:road|rd\.?|street|st\.?|lane|ln\.?|avenue|ave\.?|nagar|marg|estate|survey|plot|block|sector|floor|building|near|opp\.?|po\s+box|p\.?o\.?|district|dist\.?|state"
    r"|pin|pincode|zip|postal)"
)
POSTAL = r"(?<![A-Za-z0-9_-])\d{5,6}(?![0-9-])"
RE2_POSTAL = r"(?:^|[^A-Za-z0-9_-])\d{5,6}(?:[^0-9-]|$)"
KEY_VALUE = r"^[A-Za-z][A-Za-z0-9_ .#/-]*:\s*\S*\d"
PAGE_MARKER = r"(?i)^-{2,}\s*\d+\s+of\s+\d+\s*-{2,}"


def literal(text: str) -> str:
    """``text`` with the metacharacters escaped."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


def _start(word: bool) -> str:
    return r"(?<![A-Za-z0-9_])" if word else r"(?<=[A-Za-z0-9_])"


def _end(word: bool) -> str:
    return r"(?![A-Za-z0-9_])" if word else r"(?=[A-Za-z0-9_])"


def phrase(text: str, boundary: str = B) -> str:
    """The pattern of a label or keyword: white space is any run of it, with boundaries at both ends.

    What a boundary means at an end is known from the character there, so Java needs one look only.
    """
    body = re.sub(r"\s+", r"\\s+", literal(text))
    if boundary != B:
        return boundary + body + boundary
    is_word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    return _start(is_word(text[0])) + body + _end(is_word(text[-1]))


def labeled_id(label: str, boundary: str = B, ident: str = ID) -> str:
    return "(?i)" + phrase(label, boundary) + r"[\s:.#-]*" + ident


def labeled_amount(label: str, boundary: str = B) -> str:
    return "(?i)" + phrase(label, boundary) + r"\s*[:.]?\s*" + CURRENCY + MONEY_LABELED + (_end(True) if boundary == B else boundary)


def around(pattern: str, boundary: str = B) -> str:
    """``pattern``, which begins and ends with a word character, between boundaries."""
    return _start(True) + pattern + _end(True) if boundary == B else boundary + pattern + boundary


def any_amount(boundary: str = B) -> str:
    return around(MONEY_FORMATTED, boundary)


def dates(boundary: str = B) -> list[str]:
    return ["(?i)" + around(p, boundary) for p in DATES]


def words(pattern: str, boundary: str = B) -> str:
    return "(?i)" + (_start(True) if boundary == B else boundary) + pattern + boundary
