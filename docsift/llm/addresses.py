"""Deciding which postal addresses denote the same location.

Addresses are read into components (unit, house, street, town, postal code), rendered in several component orders, and
each order is a pass of sorted neighbourhoods: records are range-partitioned and sorted by the order's key, and every
record is compared with the records that follow it in a window. A pair is the same location if house and unit are
equal, the towns agree, and the streets are equal up to a transposition-tolerant edit. Records with equal components
are one record beforehand, so repeated spellings don't fill windows. In an order that begins with all that must be equal, a
window holds every partner of a record where at most WINDOW + 1 records agree in it; larger such blocks are compared in
cells, so no partner is lost. The matches of all passes are consolidated into locations.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import cells, classes_within, pairs_within
from docsift.llm.groups import connected_groups
from docsift.session import cut, hot_keys, join_hot, measured, numbered, spread

# Kinds of streets and their abbreviations; words before a unit; words before a landmark.
STREETS = {
    "street": "street str st", "road": "road rd", "lane": "lane ln la", "avenue": "avenue aven ave av", "boulevard": "boulevard blvd boul bvd bd",
    "crescent": "crescent cresc cres cr", "court": "court crt ct", "terrace": "terrace terr ter", "drive": "drive drv dr", "place": "place plc pl",
    "square": "square sqr sq", "parkway": "parkway pkwy pky pkw", "highway": "highway hwy hway", "estate": "estate est",
}
UNITS = "suite ste flat flt fl shop shp sh unit un u apartment apt room rm office off"
LANDMARKS = "opp opposite near nr behind above below beside adj adjacent"
_KIND = {w: k for k, ws in STREETS.items() for w in ws.split()}
_INDUSTRIAL = ("ind", "indl", "industrial")
_UNIT = re.compile(rf"\b(?:{'|'.join(UNITS.split())})\b\.?\s*(?:no\b\.?|nr\b\.?|#)?\s*(\d+[a-z]?)\b")
_LANDMARK = re.compile(rf"\b(?:{'|'.join(LANDMARKS.split())}|next to|close to)\b\.?\s+(?:the\s+)?[a-z]+(?:\s+([a-z]+)(?=(\s+[a-z]+)?))?")


def edits(a: str, b: str, most: int = 2) -> int:
    """Damerau-Levenshtein distance (a transposition is one edit), or most + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before = last
    return min(row[-1], most + 1)


class Reader:
    """Reads addresses into components, given the towns of the reference table (name, state, country, code prefix, length)."""

    def __init__(self, towns: list[tuple[str, str, str, str, int]]):
        self.towns = {t[0].lower(): t for t in towns}
        self.prefixes = {(t[3], t[4]): t[0].lower() for t in towns}
        self.others = {t[1].lower() for t in towns} | {t[2].lower() for t in towns}
        self.starts = {p: n for p, n in self.prefixes}
        self.town_of = lru_cache(maxsize=100_000)(self._town)

    def _town(self, word: str) -> str | None:
        if word in self.towns:
            return word
        if len(word) < 5:
            return None
        near = sorted((edits(word, t), t) for t in self.towns if abs(len(t) - len(word)) <= 2)
        if near and near[0][0] <= 2 and (len(near) == 1 or near[0][0] < near[1][0]):
            return near[0][1]
        return None

    def _without_landmark(self, m: re.Match[str]) -> str:
        """Drops a landmark of one or two words; the second word stays if it is a town or the name of a street."""
        second, third = m[1] or "", (m[2] or "").strip()
        stays = second and (third in _KIND or third in _INDUSTRIAL or self.town_of(second))
        return f" {second} " if stays else " "

    def _town_of_code(self, code: str) -> str:
        """The town whose codes begin as ``code`` does, or the only one whose codes begin one edit apart."""
        if town := self.prefixes.get((code[:3], len(code))):
            return town
        near = {t for (p, n), t in self.prefixes.items() if n == len(code) and edits(p, code[: len(p)], 1) <= 1}
        return near.pop() if len(near) == 1 else ""

    def read(self, text: str) -> tuple[str, str, str, str, str, str] | None:
        """(unit, house, street, kind, town, code), unknown parts empty; None for a text without a letter.

        Where no word is a kind of street, the street is all words that are no town, state or country, and its kind is
        empty; where there is no number, the house is empty.
        """
        t = unicodedata.normalize("NFKC", text).lower()
        t = re.sub(r"\s+", " ", re.sub(r"[;,|\n]", " , ", t)).strip()
        t = _LANDMARK.sub(self._without_landmark, t)
        unit = ""
        if m := _UNIT.search(t):
            unit, t = m[1], t[: m.start()] + " " + t[m.end() :]
        if m := re.search(r"\b(\d{1,4}[a-z]?)\s?/\s?(\d{1,4}[a-z]?)\b", t):
            unit, t = unit or m[1], t[: m.start()] + " " + m[2] + " " + t[m.end() :]
        # a number that is said to be the house's
        said = re.search(r"(?:\b(?:no\b\.?|number\b|house\b)|#)\s*(\d{1,4}[a-z]?)\b", t)
        t = re.sub(r"\b(?:no\b\.?|number\b|house\b)\s*(?=\d)|#\s*(?=\d)", " # ", t)
        tokens = re.findall(r"\d+[a-z]?\b|[^\W\d_]+(?:'[a-z]+)?|,|#", t)
        if not any(x[0].isalpha() for x in tokens):
            return None
        tokens, code = self._take_code(tokens)
        tokens = [x for x in tokens if x != "#"]
        at, kind = self._kind(tokens)
        if at is None:
            return self._without_kind(tokens, unit, said[1] if said else "", code)
        first = at - (2 if kind == "industrial estate" and tokens[at - 1] in _INDUSTRIAL else 1)
        street = tokens[first]
        back = [i for i in range(first - 1, -1, -1) if tokens[i] != ","][:1]
        ahead = [i for i in range(at + 1, len(tokens)) if tokens[i] != ","][:1]
        number = next((i for i, x in enumerate(tokens) if said and x == said[1]), None)
        if number is None:
            number = next((i for i in back + ahead if re.fullmatch(r"\d{1,4}[a-z]?", tokens[i])), None)
        if number is None:
            number = next((i for i, x in enumerate(tokens) if re.fullmatch(r"\d{1,4}[a-z]?", x)), None)
        rest = [x for i, x in enumerate(tokens) if i != number and not first <= i <= at]
        town, code = self._place(rest, code)
        return unit.lstrip("0"), _house(tokens[number]) if number is not None else "", street, kind, town, code

    def _take_code(self, tokens: list[str]) -> tuple[list[str], str]:
        """The tokens with a comma for the postal code, and the code, which may be written in two parts."""
        for i, x in enumerate(tokens):
            if re.fullmatch(r"\d{5,6}", x):
                return [*tokens[:i], ",", *tokens[i + 1 :]], x
            n = self.starts.get(x)
            if n and i + 1 < len(tokens) and tokens[i + 1].isdigit() and len(x) + len(tokens[i + 1]) == n and (i == 0 or tokens[i - 1] != "#"):
                return [*tokens[:i], ",", *tokens[i + 2 :]], x + tokens[i + 1]
        return tokens, ""

    @staticmethod
    def _kind(tokens: list[str]) -> tuple[int | None, str]:
        """Where the kind of street stands after the street's name, and the kind."""
        for i, x in enumerate(tokens):
            if i and x in _KIND and tokens[i - 1].isalpha() and tokens[i - 1] not in _INDUSTRIAL:
                return i, "industrial estate" if _KIND[x] == "estate" else _KIND[x]
            if i > 1 and x in _KIND and _KIND[x] == "estate" and tokens[i - 1] in _INDUSTRIAL and tokens[i - 2].isalpha():
                return i, "industrial estate"
        for i, x in enumerate(tokens):  # with a typing error
            if i and len(x) >= 5 and tokens[i - 1].isalpha() and (near := [k for k in STREETS if len(k) >= 4 and edits(x, k, 1) <= 1]):
                return i, "industrial estate" if near[0] == "estate" else near[0]
        return None, ""

    def _without_kind(self, tokens: list[str], unit: str, said: str, code: str) -> tuple[str, str, str, str, str, str]:
        house = said or next((x for x in tokens if re.fullmatch(r"\d{1,4}[a-z]?", x)), "")
        words = [x for x in tokens if x[0].isalpha()]
        town, code = self._place([x for x in tokens if x != house], code)
        named = [x for x in words if self.town_of(x) != town or not town] if len(words) > 1 else words
        street = "".join([x for x in named if x not in self.others] or words)
        return unit.lstrip("0"), _house(house) if house else "", street, "", town, code

    def _place(self, rest: list[str], code: str) -> tuple[str, str]:
        """The town and the postal code of what is left of an address."""
        if not code:
            joined = re.search(r"(?<![\d])(\d{2,3}) (\d{3}|\d{2})(?![\d])", " ".join(rest))
            code = joined[1] + joined[2] if joined else ""
        town = next((found for x in reversed(rest) if x.isalpha() and (found := self.town_of(x))), "")
        return town or (self._town_of_code(code) if code else ""), code


def _house(number: str) -> str:
    return number.lstrip("0") or "0"


def same_place(x: tuple[str, ...], y: tuple[str, ...]) -> bool:
    """Whether two readings (unit, house, street, kind, town, code) are one location.

    House, unit and kind of street must be equal. In one town, streets may differ by as many edits as a third of their
    letters, three at most, but by more than one only if the postal codes, if both are known, agree up to two edits. Where a town is unknown on either side, the postal codes must agree up to two edits and the
    streets up to one.
    """
    if x[1] != y[1] or x[0] != y[0] or x[3] != y[3]:
        return False
    a, b = x[2], y[2]
    if x[4] and y[4]:
        if x[4] != y[4]:
            return False
        most = min(3, max(1, min(len(a), len(b)) // 3))
        apart = edits(a, b, most)
        return apart <= most and (apart <= 1 or not x[5] or not y[5] or edits(x[5], y[5], 2) <= 2)
    return bool(x[5]) and bool(y[5]) and edits(x[5], y[5], 2) <= 2 and edits(a, b, 1) <= 1


PARTS = ["unit", "house", "street", "kind", "town", "code"]
#: The component orders of the passes; the first is a total order of the records and numbers them.
ORDERS = {
    "town first": ["town", "house", "unit", "kind", "street", "code"],
    "town first, street from its end": ["town", "house", "unit", "kind", "street_back"],
    "house first": ["house", "unit", "kind", "street", "town", "code"],
    "house first, street from its end": ["house", "unit", "kind", "street_back", "town", "code"],
}
#: Records that a record is compared with in each pass, and records of a task's block.
WINDOW = 12
BLOCK = 5_000


def _compare(window: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        rows = list(block[PARTS].itertuples(index=False, name=None))
        ids, own = block["rec"].tolist(), block["own"].tolist()
        left, right = [], []
        for i, x in enumerate(rows):
            if not own[i]:
                continue
            for j in range(i + 1, min(i + 1 + window, len(rows))):
                y = rows[j]
                if x[1] == y[1] and same_place(x, y):
                    left.append(ids[i])
                    right.append(ids[j])
        return pd.DataFrame({"a": pd.Series(left, dtype="int64"), "b": pd.Series(right, dtype="int64")})

    return run


def neighbourhood_pass(placed: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Matches ``(a, b)`` of record ids within ``window`` of the positions ``pos`` of ``placed``.

    Blocks of consecutive positions are the tasks' groups; the first records of a block are sent to the block before it
    as well, so no neighbour is lost at a boundary and no key, however frequent, fills a task.
    """
    at = F.floor(F.col("pos") / F.lit(block))
    reach = F.when((F.col("pos") % F.lit(block) < window) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    copied = placed.select("rec", "pos", *PARTS, F.explode(reach).alias("block")).withColumn("own", F.col("block") == F.floor(F.col("pos") / F.lit(block)))
    return spread(copied, "block").groupBy("block").applyInPandas(_compare(window), "a bigint, b bigint")


def beyond_windows(records: DataFrame, n: int, window: int = WINDOW, block: int = 1_000) -> DataFrame:
    """Matches ``(a, b)`` of records that agree with more than ``window`` others in all that must be equal, by comparison
    with each of them: in cells of two blocks, first by the plain edit distance in the JVM, then by same_place().

    Records with a town are compared within it, records without one with all of their house, unit and kind.
    """
    found = None
    for keys, asking in ((["town", "house", "unit", "kind"], F.col("town") != ""), (["house", "unit", "kind"], F.col("town") == "")):
        rows = records if len(keys) == 3 else records.filter(asking)
        large = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(asking).alias("asking")).filter((F.col("n") > window + 1) & (F.col("asking") > 0))
        mixed = join_hot(rows, large.select(*keys, F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")), keys, hot_keys(rows, keys, n), "inner")
        own = F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int")
        one, two = cells(mixed.withColumns({"own": own, "lo": own, "hi": own}))
        one = one.select(*keys, "x", "y", F.struct("rec", *PARTS).alias("l"))
        two = two.select(*keys, "x", "y", F.struct("rec", *PARTS).alias("r"))
        asked = F.lit(True) if len(keys) == 4 else (F.col("l.town") == "") | (F.col("r.town") == "")
        # a transposition is two plain edits, and three edits are the most
        near = F.levenshtein("l.street", "r.street", 6).between(0, 6)
        pairs = one.join(two, [*keys, "x", "y"]).filter(((F.col("x") < F.col("y")) | (F.col("l.rec") < F.col("r.rec"))) & asked & near).select("l", "r")
        found = pairs if found is None else found.unionByName(pairs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            same = [(x["rec"], y["rec"]) for x, y in zip(frame["l"], frame["r"], strict=True) if same_place(tuple(x[p] for p in PARTS), tuple(y[p] for p in PARTS))]
            yield pd.DataFrame(same, columns=["a", "b"], dtype="int64")

    return found.mapInPandas(run, "a bigint, b bigint")


def read_addresses(rows: DataFrame, text: str, towns: DataFrame) -> DataFrame:
    """``rows`` with the components of ``text``; rows whose text has no letter are left out. The reference table of towns
    goes to the workers in the task's closure: it is a gazetteer of fixed size, and more than a million towns are refused."""
    known = towns.select("city_name", "state_code", "country_name", "code_prefix", "code_length").dropna().distinct().limit(1_000_001).collect()
    if len(known) > 1_000_000:
        raise ValueError("the table of towns is too large for a gazetteer")
    known = [tuple(t) for t in known]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns), *(f"{p} string" for p in PARTS)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(known)
        for frame in frames:
            got = [reader.read(t) for t in frame[text]]
            keep = [g is not None for g in got]
            out = frame[keep].reset_index(drop=True)
            for k, part in enumerate(PARTS):
                out[part] = pd.Series([g[k] for g in got if g is not None], dtype="object")
            yield out

    return rows.mapInPandas(run, schema)


def place_classes(addresses: DataFrame, towns: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(text, place)`` of every distinct text in the column ``text`` of ``addresses`` that has a letter.

    Null and empty texts and texts without a letter are left out. ``place`` is the number of the first record linked to
    the text's components directly or through others; equal components share it without any comparison.
    """
    texts = spread(addresses.filter(F.length(F.trim("text")) > 0).select("text").distinct(), "text")
    read, texts_read = measured(read_addresses(texts, "text", towns), n=F.count("*"))
    orders = list(ORDERS.values())
    first, got = measured(numbered(read.select(*PARTS).distinct(), orders[0], "rec"), n=F.count("*"))
    matches = neighbourhood_pass(first.withColumn("pos", F.col("rec")), window).unionByName(beyond_windows(first, got["n"], window))
    for keys in orders[1:]:
        matches = matches.unionByName(neighbourhood_pass(numbered(first.withColumn("street_back", F.reverse("street")), keys, "pos"), window))
    groups = connected_groups(matches, "a", "b", "rec", "place")
    placed = first.join(groups, "rec", "left").select(*PARTS, F.coalesce("place", "rec").alias("place"))
    return join_hot(read, placed, PARTS, hot_keys(read, PARTS, texts_read["n"])).select("text", "place")


def _placed(analyzed: DataFrame, towns: DataFrame, window: int) -> DataFrame:
    docs, got = measured(analyzed.select("doc_ix", F.col("doc_fields.address").alias("text")).dropna().distinct(), n=F.count("*"))
    return join_hot(docs, cut(place_classes(docs, towns, window)), ["text"], hot_keys(docs, ["text"], got["n"]), "inner")


def same_place_pairs(analyzed: DataFrame, towns: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(left_ix, right_ix)``, smaller first: documents whose addresses are not the identical string, but one location.

    Documents without a letter in their address are in no pair; documents delivered again count once.
    """
    return pairs_within(_placed(analyzed, towns, window), "place", "doc_ix", "text", "left_ix", "right_ix")


def same_place_classes(analyzed: DataFrame, towns: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_ix, class_id, links)``: of every document with an address the smallest document of its location, and how
    many documents write the location differently."""
    return classes_within(_placed(analyzed, towns, window), "place", "doc_ix", "text")
