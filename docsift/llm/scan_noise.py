"""Repairing text of scanned pages: furniture, broken words, misread characters.

Furniture (running headers and footers, page numbers) is told by its form and its position on the page. The rest is
edited by characters: an averaged perceptron scores, for each word, the operations keep, replace, insert, delete and
line-join that the fixed table of confusions allows, one or two at a word, from the characters, their neighbours and how
often the word occurs in the whole corpus before and after the edit. Line-joins and letters for digits in numbers are its
decisions as well. It is trained on clean words of the corpus that are misread on purpose, and on numbers made up; the sample is bounded by TRAIN_WORDS, all counts cover all texts. Words are scored once each, however often
they occur, and candidates meet their counts in joins, so no vocabulary is broadcast or collected.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import cut, spread

# What is printed, and what scanners read instead.
CONFUSIONS = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("b", "6"), ("g", "9"), ("a", "@"), ("e", "c"), ("c", "e"), ("h", "b"), ("b", "h"),
    ("t", "f"), ("f", "t"), ("m", "rn"), ("rn", "m"), ("n", "ri"), ("u", "ii"), ("w", "vv"), ("d", "cl"), ("cl", "d"), ("ti", "b"),
    ("in", "m"), ("i", "l"), ("l", "i"), ("nn", "rm"), ("li", "h"), ("h", "li"), ("z", "2"),
]
DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "B": "8", "S": "5", "s": "5", "Z": "2", "z": "2", "b": "6", "G": "6", "g": "9", "q": "9"}
HYPHENS = "-­‐¬"
TRAIN_WORDS = 1_500
EPOCHS = 6

_DIGIT = r"[\dOoIlBSZ]"
_PAGE = re.compile(rf"(?:(?:page|pg\.?|p\.?|seite|s\.)\s*({_DIGIT}{{1,4}})(?:\s*(?:of|/|von)\s*{_DIGIT}{{1,4}})?|\[({_DIGIT}{{1,4}})/{_DIGIT}{{1,4}}\]|[-–—]\s?({_DIGIT}{{1,4}})\s?[-–—]|({_DIGIT}{{1,4}}) \| {_DIGIT}{{1,4}}|({_DIGIT}{{1,4}}))", re.I)
_HEADER = re.compile(r"(?:[\dOIl/]{1,7}\s+)?([^\W\d_][^:]{2,}?)(?:\s+[|/–—-]\s+| {2,})([^\W\d_][\w@]*(?: [\w@]+){1,3}?)(?:[\s|/–—-]+(?:page |p\. ?|pg |seite )?[\dOIl/]{1,7})?", re.I)
_NUMBERED = re.compile(r"(?:([\dOIl/]{1,7})\s+)?(\S.*?)(?:[\s|/–—-]+(?:page |p\. ?|pg |seite )?([\dOIl/]{1,7}))?", re.I)
_ROLE = re.compile(r"sole trader|proprietor|prop\.?$|owner", re.I)
_TABLE = re.compile(r"\S.* [\dOoIlBSZb]+ x [\dOoIlBSZb][\dOoIlBSZb,.]*")
_KIND = re.compile(r"[A-Z0-9@ ]*(?:INVOICE|ORDER|RECEIPT|STATEMENT|MEMO|[A-Z]{4,})[A-Z0-9@ ]*")
_LABEL = re.compile(r"[A-Za-z0-9@. ]{2,24}:")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:()[]\"!?“”'"
_WORD = r"[\p{L}0-9@][\p{L}0-9@'\-]*"


def _digits(text: str) -> str:
    return "".join(DIGITS.get(c, c) for c in text)


def _near(a: str, b: str) -> bool:
    """Equal up to two misread characters."""
    a, b = a.casefold(), b.casefold()
    return a == b or abs(len(a) - len(b)) <= 2 and len(a) > 8 and _digits(a.replace("rn", "m").replace("c", "e")) == _digits(b.replace("rn", "m").replace("c", "e")) or len(a) == len(b) > 8 and sum(x != y for x, y in zip(a, b, strict=True)) <= 2


def _unnumbered(line: str) -> str:
    """``line`` without the page number before or after it."""
    m = _NUMBERED.fullmatch(line)
    number = m and (m[1] or m[3])
    return m[2] if number and re.search(r"\d|^[lIO]$", number) else line


def furniture(lines: list[str]) -> dict[int, str]:
    """Which lines (from 0) are 'header' (running headers and footers) or 'page_number', by form and position."""
    out: dict[int, str] = {}
    text = [line.strip() for line in lines]
    n = len(text)
    names: list[str] = []
    for i, t in enumerate(text):
        if (m := _HEADER.fullmatch(t)) and not _ROLE.search(m[2]) and not _TABLE.fullmatch(t) and (len(m[1].split()) > 1 or i == 0):
            out[i] = "header"
            names.append(m[1].strip())
    first = next((i for i, t in enumerate(text) if t), None)
    if first is not None and first not in out:
        names.append(text[first])
    if first is not None and first + 1 < n and first in out:
        names.append(text[first + 1])
    # even pages may show the name alone, or with the page number
    for i, t in enumerate(text):
        if i not in out and t and first is not None and i > first + 1 and (not text[i - 1] or i + 1 == n or not text[i + 1] or _PAGE.fullmatch(text[i - 1]) or _PAGE.fullmatch(text[i + 1])):
            bare = _unnumbered(t)
            if any(_near(t, x) or _near(bare, x) for x in names):
                out[i] = "header"
    if first is not None and first + 1 < n and first not in out and _near(text[first], text[first + 1]):
        out[first] = "header"
    numbers = [(i, m) for i, t in enumerate(text) if i not in out and t and (m := _PAGE.fullmatch(t)) and re.search(r"\d|^[lIO]+$|[\[|-]|page|pg|seite", t, re.I)]
    styled = [(i, m) for i, m in numbers if m[5] is None]
    bare = [(i, int(_digits(m[5]))) for i, m in numbers if m[5] is not None]
    for i, _ in styled:
        out[i] = "page_number"
    if not styled and bare:
        held = [i for i, h in out.items() if h == "header" and re.search(r"^\d|\d$", text[i])]

        def edge(i: int) -> bool:
            """At an end of a page: before a blank line or the end, or beside a header."""
            return i + 1 >= n or not text[i + 1] or out.get(i + 1) == "header" or out.get(i - 1) == "header"

        def in_table(i: int) -> bool:
            return any(0 <= k < n and (_TABLE.fullmatch(text[k]) or (k not in out and _PAGE.fullmatch(text[k]))) for k in (i - 1, i + 1))

        at = [(i, v) for i, v in bare if edge(i)]
        beside = [i for i, _ in at if out.get(i + 1) == "header" or out.get(i - 1) == "header"]
        out |= {i: "page_number" for i in beside if not in_table(i)}
        if not held:
            # page numbers rise by one from page to page: the longest such chain
            best: dict[int, list[int]] = {}
            chains = []
            for i, v in at:
                chain = best.get(v - 1, []) + [i]
                if len(chain) > len(best.get(v, [])):
                    best[v] = chain
                chains.append(chain)
            longest = max(chains, key=lambda c: (len(c), -sum(in_table(i) for i in c), c[-1]), default=[])
            if len(longest) > 1 or longest and not in_table(longest[0]):
                out |= dict.fromkeys(longest, "page_number")
    return out


class Unit:
    """A word of the body: where it begins, and for a broken word where it goes on."""

    __slots__ = ("line", "start", "text", "cut", "next")

    def __init__(self, line: int, start: int, text: str, cut: int = -1, after: int = -1):
        self.line, self.start, self.text, self.cut, self.next = line, start, text, cut, after


def body_units(lines: list[str], gone: dict[int, str]) -> tuple[list[Unit], list[tuple[int, str, str, str]]]:
    """The words that may be misread, and the line-join candidates (line, mark, joined, hyphenated).

    The lines above the document's kind (issuer's name and address) have no words here. A word broken over lines is one
    unit with the place of the cut.
    """
    body = [i for i in range(len(lines)) if i not in gone and lines[i].strip()]
    head = next((k for k, i in enumerate(body[:6]) if _KIND.fullmatch(lines[i].strip()) and k < 5), None)
    name_lines = set(body[:head]) if head is not None and head <= 3 else set()
    units: list[Unit] = []
    joins: list[tuple[int, str, str, str]] = []
    skip_first: set[int] = set()
    for k, i in enumerate(body):
        line = lines[i].rstrip()
        tokens = list(_TOKEN.finditer(line))
        for j, m in enumerate(tokens):
            if j == 0 and i in skip_first:
                continue
            word = m[0]
            if j == len(tokens) - 1 and len(word) > 1 and word[-1] in HYPHENS and (word[-2].isalpha() or word[-2] in "01569@") and k + 1 < len(body):
                after = _TOKEN.search(lines[body[k + 1]])
                tail = after[0].rstrip(_EDGE) if after else ""
                stem = word[:-1].lstrip(_EDGE)
                if tail and any(c.isalpha() for c in tail):
                    joins.append((i, word[-1], (stem + tail).lower(), f"{stem}-{tail}".lower()))
                    skip_first.add(body[k + 1])
                    if i not in name_lines:
                        units.append(Unit(i, m.start(), stem + tail, len(stem), body[k + 1]))
                    continue
            if i in name_lines:
                continue
            bare = word.strip(_EDGE)
            if bare:
                units.append(Unit(i, m.start() + word.index(bare), bare))
    return units, joins


_AMOUNT = re.compile(r"\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?")
_NUMBERED_LINE = re.compile(r"\s*(?:invoice|receipt|order|transaction|po|ref|bill)\b.*:", re.I)
_MIXED = re.compile(r"(?=.*\d)(?=.*[A-Za-z])")


def number_features(text: str, line: str) -> list[str]:
    """Of replacing the letters of a token that has digits too by the digits they look like."""
    letters = [c for c in text if c.isalpha()]
    amount = _AMOUNT.fullmatch(_digits(text)) is not None
    coded = _NUMBERED_LINE.match(line) is not None
    return ["number", f"na {amount}", f"nc {coded}", f"na {amount} nc {coded}", f"nl {min(3, len(letters))}", f"nk {all(c in DIGITS for c in letters)}", f"n0 {text[0].isalpha()}", f"nu {len(letters) > 1 and text[:2].isupper()}"]


def number_examples(rng: random.Random, many: int) -> list[tuple[list[list[str]], int]]:
    """Examples for the editor: amounts and counts with a digit misread, and codes that are written with letters."""
    letters_for = defaultdict(list)
    for letter, digit in DIGITS.items():
        letters_for[digit].append(letter)
    out = []
    for _ in range(many):
        n = rng.randrange(10, 99_999)
        right = rng.choice([f"{n:,}.{rng.randrange(100):02d}", str(n), f"{n}.{rng.randrange(100):02d}"])
        at = rng.choice([i for i, c in enumerate(right) if c in letters_for] or [-1])
        if at >= 0:
            seen = right[:at] + rng.choice(letters_for[right[at]]) + right[at + 1 :]
            if _MIXED.match(seen):
                out.append(([number_features(seen, rng.choice(["Grand Total: ", "the carrier returned ", "4 x "]) + seen)], 0))
        code = rng.choice([f"{rng.choice('BSOI')}{n:07d}", f"{n:07d}{rng.choice('ABS')}", f"INV-{n:07d}", f"{n}th", f"{n}kg", f"PR-{n}"])
        out.append(([number_features(code, rng.choice(["Invoice No: ", "PO No: ", "Transaction ID: ", "the certificate "]) + code)], -1))
    return out


Edit = tuple[int, str, str]


def candidates(word: str) -> list[tuple[int, str, str, str]]:
    """Edits of a lower-case word: (position, seen, meant, edited)."""
    out = []
    for meant, seen in CONFUSIONS:
        at = word.find(seen)
        while at >= 0:
            out.append((at, seen, meant, word[:at] + meant + word[at + len(seen) :]))
            at = word.find(seen, at + 1)
    return out


def double_candidates(word: str) -> list[tuple[Edit, Edit, str]]:
    """Two edits of a lower-case word that don't overlap, the earlier first, and the edited word."""
    single = [c[:3] for c in candidates(word)]
    return [(x, y, word[: x[0]] + x[2] + word[x[0] + len(x[1]) : y[0]] + y[2] + word[y[0] + len(y[1]) :]) for x in single for y in single if x[0] + len(x[1]) <= y[0]]


def _bucket(n: int) -> int:
    return min(n.bit_length(), 12)


def features(word: str, edits: Sequence[Edit], before: int, after: int, clean: int) -> list[str]:
    """Of one or two edits of a word: the operations, their neighbours, the corpus counts before and after them, and how
    often the word occurs in texts that were not scanned."""
    ratio = max(-6, min(6, _bucket(after) - _bucket(before)))
    read = min(2, _bucket(clean))
    more = clean * 5 > before  # it occurs more in texts that were not scanned than by chance
    out = [
        "edit", f"{len(edits)} edits", f"b {_bucket(before)}", f"a {_bucket(after)}", f"r {ratio}", f"0 {before == 0}", f"c {_bucket(clean)}", f"c {read} r {ratio}",
        f"more {more}", f"more {more} r {ratio}", f"up {after > before}", f"{len(edits)} r {ratio}", f"{len(edits)} n {min(8, len(word))}",
    ]
    for at, seen, meant in edits:
        left = word[at - 1] if at else "^"
        right = word[at + len(seen)] if at + len(seen) < len(word) else "$"
        kind = "replace" if len(seen) == len(meant) else "delete" if len(seen) > len(meant) else "insert"
        out += [f"k {kind}", f"e {seen}>{meant}", f"k {kind} r {ratio}", f"e {seen}>{meant} 0 {before == 0}", f"l {left.isalpha()} {seen}", f"n {right.isalpha()} {seen}", f"s {seen.isalpha()}"]
    return out


def join_features(mark: str, joined: int, hyphenated: int) -> list[str]:
    """Of a line-join: the mark, and the corpus counts of the word joined and written with a hyphen."""
    ratio = max(-4, min(4, _bucket(joined) - _bucket(hyphenated)))
    return [
        "join", f"m {mark == '-'}", f"j {_bucket(joined)}", f"h {min(3, _bucket(hyphenated))}", f"jr {ratio}", f"j0 {joined == 0} {hyphenated == 0}", f"m {mark == '-'} jr {ratio}", f"less {joined < hyphenated}",
    ]


class Perceptron:
    """Averaged perceptron choosing between keep (score 0) and the candidate operations."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w: dict[str, float] = defaultdict(float, weights or {})
        self.total: dict[str, float] = defaultdict(float)
        self.t = 0

    def best(self, options: list[list[str]]) -> int:
        """The index of the best option, or -1 for keep."""
        best, top = -1, 0.0
        for k, fs in enumerate(options):
            s = sum(self.w.get(f, 0.0) for f in fs)
            if s > top:
                best, top = k, s
        return best

    def train(self, examples: list[tuple[list[list[str]], int]], epochs: int, seed: int = 1) -> dict[str, float]:
        rng = random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(examples)
            for options, gold in examples:
                self.t += 1
                got = self.best(options)
                if got != gold:
                    for k, step in ((gold, 1.0), (got, -1.0)):
                        for f in options[k] if k >= 0 else ():
                            self.w[f] += step
                            self.total[f] += step * self.t
        return {f: w - self.total[f] / max(1, self.t) for f, w in self.w.items() if w or self.total[f]}


def word_counts(texts: DataFrame, source: str = "ocr") -> DataFrame:
    """``(word, n, clean)`` in lower case over all rows of ``texts``, words broken by a mark at a line end joined.

    ``clean`` counts the rows of other sources than ``source``; ``n`` counts all.
    """
    whole = F.regexp_replace(F.lower("text"), "[­‐¬-]\\r?\\n", "")
    words = texts.select((F.col("source") != source).cast("long").alias("clean"), F.explode(F.regexp_extract_all(whole, F.lit(_WORD), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.sum("clean").alias("clean"))


def _misread(word: str, rng: random.Random) -> tuple[str, str, str, int] | None:
    """``word`` with one confusion: (misread, seen, meant, position)."""
    options = [(meant, seen, at) for meant, seen in CONFUSIONS for at in range(len(word)) if word.startswith(meant, at)]
    if not options:
        return None
    meant, seen, at = rng.choice(options)
    return word[:at] + seen + word[at + len(meant) :], seen, meant, at


def train_editor(counts: DataFrame, words: int = TRAIN_WORDS, epochs: int = EPOCHS) -> dict[str, float]:
    """Weights of the editor, trained on at most ``words`` clean words of the corpus, misread copies of them, as many clean
    tokens of other forms and as many numbers.

    Only the sample and the counts of its candidates are collected.
    """
    spark = counts.sparkSession
    plain = F.expr("length(word) >= 3 and word rlike '^[a-z][a-z-]*[a-z]$'")
    sample = counts.filter("clean >= 3").filter(plain).orderBy(F.xxhash64("word")).limit(words).collect()
    # other tokens are examples of what stays as it is
    others = counts.filter("clean >= 3").filter(~plain).orderBy(F.xxhash64("word")).limit(words).collect()
    rng = random.Random(7)
    cases: list[tuple[str, tuple[Edit, ...] | None]] = [(r["word"], None) for r in others]
    for r in sample:
        cases.append((r["word"], None))
        for _ in range(2):
            if m := _misread(r["word"], rng):
                cases.append((m[0], ((m[3], m[1], m[2]),)))
        if (m := _misread(r["word"], rng)) and (again := _misread(m[0][m[3] + len(m[1]) :], rng)):
            at = m[3] + len(m[1])
            cases.append((m[0][:at] + again[0], ((m[3], m[1], m[2]), (at + again[3], again[1], again[2]))))
    wanted = {w for w, _ in cases} | {c[3] for w, _ in cases for c in candidates(w)} | {c[2] for w, _ in cases for c in double_candidates(w)}
    halves = {}
    for r in sample:
        w = r["word"]
        if "-" in w:
            halves[w] = (w.replace("-", "", 1), w)
        elif len(w) > 4:
            k = rng.randrange(2, len(w) - 1)
            halves[w] = (w, f"{w[:k]}-{w[k:]}")
    wanted |= {x for pair in halves.values() for x in pair}
    examples = number_examples(rng, words)
    if wanted:
        asked = spark.createDataFrame(pd.DataFrame({"word": sorted(wanted)}))
        rows = counts.join(asked, "word").collect()
        known, clean = {r["word"]: r["n"] for r in rows}, {r["word"]: r["clean"] for r in rows}
        for w, gold in cases:
            before, seen_clean = known.get(w, 0), clean.get(w, 0)
            options, right = [], -1
            for edits, edited in proposals(w, seen_clean):
                if after := known.get(edited, 0):
                    if gold is not None and right < 0 and edits == gold:
                        right = len(options)
                    options.append(features(w, edits, before, after, seen_clean))
            if options and (gold is None or right >= 0):
                examples.append((options, right))
        for w, (joined, hyphenated) in halves.items():
            for marks in ("-",) if "-" in w else ("-", HYPHENS[1:]):
                gold = -1 if "-" in w else 0
                examples.append(([join_features(rng.choice(marks), known.get(joined, 0), known.get(hyphenated, 0))], gold))
                examples.append(([join_features(rng.choice(marks), 0, 0)], gold))  # as if the corpus had neither form
    return Perceptron().train(examples, epochs)


def proposals(word: str, clean: int) -> list[tuple[tuple[Edit, ...], str]]:
    """The options of a word: single edits, and two at once for a word that no text shows that was not scanned."""
    out = [((c[:3],), c[3]) for c in candidates(word)]
    if not clean:
        out += [((x, y), edited) for x, y, edited in double_candidates(word)]
    return out


def _units(weights: dict[str, float]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Perceptron(weights)
        for frame in frames:
            rows = []
            for ix, text in zip(frame["doc_ix"], frame["text"], strict=True):
                lines = text.split("\n")
                gone = furniture(lines)
                rows += [(ix, i + 1, d, None, None, 0, 0, 0) for i, d in gone.items()]
                units, joins = body_units(lines, gone)
                for u in units:
                    if misread_number(model, u.text, lines[u.line]):
                        rows.append((ix, u.line + 1, "misread", None, None, 0, 0, 0))
                    elif any(c.isalpha() for c in u.text):
                        rows.append((ix, u.line + 1, "word", u.text.lower(), None, u.cut, u.next + 1, 0))
                rows += [(ix, i + 1, "join", joined, hyphenated, 0, 0, int(mark == "-")) for i, mark, joined, hyphenated in joins]
            yield pd.DataFrame(rows, columns=["doc_ix", "line_no", "what", "word", "other", "cut", "next_no", "plain"])

    return run


def misread_number(model: Perceptron, text: str, line: str) -> bool:
    """Whether the editor replaces letters of a token by digits."""
    return _MIXED.match(text) is not None and model.best([number_features(text, line)]) == 0


_UNITS = "doc_ix bigint, line_no bigint, what string, word string, other string, cut int, next_no bigint, plain int"


_EDITS = "array<struct<at: int, seen: string, meant: string>>"


def _propose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(w, before, clean, [{"at": a, "seen": s, "meant": m} for a, s, m in edits], edited) for w, before, clean in zip(frame["word"], frame["before"], frame["clean"], strict=True) for edits, edited in proposals(w, clean)]
        yield pd.DataFrame(rows, columns=["word", "before", "clean", "edits", "edited"])


class Found:
    """What find_noise() gives: the defects, the misread words with their edits, and the decided line-joins."""

    def __init__(self, weights: dict[str, float], defects: DataFrame, edits: DataFrame, joins: DataFrame, pages: DataFrame):
        self.weights, self.defects, self.edits, self.joins, self.pages = weights, defects, edits, joins, pages


def find_noise(doc_text: DataFrame, source: str = "ocr") -> Found:
    """Defects ``(doc_ix, line_no, defect)`` of the texts whose ``source`` is ``source``, each row once.

    Null, empty and blank texts have none. Rows delivered twice count once, in the counts of words as well. Lines end at
    a line feed and count from 1.
    """
    texts = cut(doc_text.select("doc_ix", "source", "text").dropna().distinct())
    counts = cut(word_counts(texts, source))
    weights = train_editor(counts)
    model_of = lambda: Perceptron(weights)
    pages = spread(texts.filter((F.col("source") == source) & (F.length(F.trim("text")) > 0)).select("doc_ix", "text"), "doc_ix")
    units = cut(pages.mapInPandas(_units(weights), _UNITS))

    words = units.filter("what = 'word'")
    known = words.select("word").distinct().join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("before"), F.coalesce("clean", F.lit(0)).alias("clean"))
    proposed = known.mapInPandas(_propose, f"word string, before bigint, clean bigint, edits {_EDITS}, edited string")
    after = counts.select(F.col("word").alias("edited"), F.col("n").alias("after"))
    options = proposed.join(after, "edited").groupBy("word").agg(F.first("before").alias("before"), F.first("clean").alias("clean"), F.sort_array(F.collect_list(F.struct("edits", "after"))).alias("options"))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of()
        for frame in frames:
            rows = []
            for word, before, clean, opts in zip(frame["word"], frame["before"], frame["clean"], frame["options"], strict=True):
                edits = [[(e["at"], e["seen"], e["meant"]) for e in o["edits"]] for o in opts]
                k = model.best([features(word, e, before, o["after"], clean) for e, o in zip(edits, opts, strict=True)])
                if k >= 0:
                    rows += [(word, *e) for e in edits[k]]
            yield pd.DataFrame(rows, columns=["word", "at", "seen", "meant"])

    edits = cut(options.mapInPandas(choose, "word string, at int, seen string, meant string"))
    # the line that holds the misread character of a broken word is the one after the cut, if the character lies there
    line = F.when((F.col("cut") >= 0) & (F.col("at") >= F.col("cut")), F.col("next_no")).otherwise(F.col("line_no"))
    misread = words.join(edits, "word").select("doc_ix", line.alias("line_no"), F.lit("misread").alias("defect"))

    breaks = units.filter("what = 'join'").select("doc_ix", "line_no", "word", "other", "plain")
    one = counts.select("word", F.col("n").alias("joined"))
    two = counts.select(F.col("word").alias("other"), F.col("n").alias("hyphenated"))
    counted = breaks.join(one, "word", "left").join(two, "other", "left").fillna(0, ["joined", "hyphenated"])

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of()
        for frame in frames:
            keep = [model.best([join_features("-" if p else "­", j, h)]) == 0 for p, j, h in zip(frame["plain"], frame["joined"], frame["hyphenated"], strict=True)]
            yield frame.loc[keep, ["doc_ix", "line_no"]]

    joins = cut(counted.mapInPandas(decide, "doc_ix bigint, line_no bigint"))
    local = units.filter("what in ('header', 'page_number', 'misread')").select("doc_ix", "line_no", F.col("what").alias("defect"))
    defects = local.unionByName(misread).unionByName(joins.select("doc_ix", "line_no", F.lit("hyphen").alias("defect"))).distinct()
    return Found(weights, defects, edits.join(words.select("doc_ix", "word").distinct(), "word"), joins, pages)


def scan_defects(doc_text: DataFrame) -> DataFrame:
    """``(doc_ix, line_no, defect)`` of scanned texts."""
    return find_noise(doc_text).defects


def _rebuild(model: Perceptron, text: str, edits: dict[str, list[Edit]], joins: set[int]) -> str:
    """The text as paragraphs: furniture removed, broken words joined, misread characters replaced."""
    lines = text.split("\n")
    gone = furniture(lines)
    units, _ = body_units(lines, gone)
    fixes: dict[int, list[tuple[int, str, str]]] = defaultdict(list)
    for u in units:
        for at, seen, meant in edits.get(u.text.lower(), ()):
            if meant and u.text[at : at + 1].isupper():
                meant = meant.upper() if u.text.isupper() else meant[0].upper() + meant[1:]
            if u.cut < 0 or at + len(seen) <= u.cut:
                fixes[u.line].append((u.start + at, seen, meant))
            elif at >= u.cut:
                begin = len(lines[u.next]) - len(lines[u.next].lstrip())
                fixes[u.next].append((begin + at - u.cut, seen, meant))
        if misread_number(model, u.text, lines[u.line]):
            fixes[u.line].append((u.start, u.text, _digits(u.text)))
    out: list[str] = []
    glue = ""
    last_body = -1
    for i, line in enumerate(lines):
        if i in gone:
            continue
        if not line.strip():
            # a blank line at a page break is no end of a paragraph
            beside = {gone.get(k) for k in (i - 1, i + 1)}
            if last_body >= 0 and not beside & {"header", "page_number"}:
                glue = "\n\n"
            continue
        for at, seen, meant in sorted(fixes.get(i, ()), reverse=True):
            line = line[:at] + meant + line[at + len(seen) :]
        line = line.strip()
        if not out:
            out.append(line)
        elif last_body + 1 in joins:
            out[-1] = out[-1].rstrip(HYPHENS)
            out.append(line)
        elif glue == "\n\n":
            out += ["\n\n", line]
        else:
            structured = _LABEL.match(line) or _LABEL.match(lines[last_body]) or _TABLE.fullmatch(line) or _KIND.fullmatch(line) or _KIND.fullmatch(lines[last_body].strip()) or last_body < 3 and not line[:1].islower()
            ended = out[-1][-1:] in HYPHENS
            out += ["\n" if structured else "" if ended else " ", line]
        glue = ""
        last_body = i
    return "".join(out)


def repaired_texts(doc_text: DataFrame) -> DataFrame:
    """``(doc_ix, text)`` of scanned texts as continuous paragraphs; one row per distinct text of a document."""
    found = find_noise(doc_text)
    edits = found.edits.groupBy("doc_ix").agg(F.collect_list(F.struct("word", "at", "seen", "meant")).alias("edits"))
    joins = found.joins.groupBy("doc_ix").agg(F.collect_list("line_no").alias("joins"))

    weights = found.weights

    def of_word(edits) -> dict[str, list[Edit]]:
        out: dict[str, list[Edit]] = defaultdict(list)
        for e in edits if edits is not None else ():
            out[e["word"]].append((e["at"], e["seen"], e["meant"]))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Perceptron(weights)
        for frame in frames:
            texts = [_rebuild(model, t, of_word(es), set(js if js is not None else ())) for t, es, js in zip(frame["text"], frame["edits"], frame["joins"], strict=True)]
            yield pd.DataFrame({"doc_ix": frame["doc_ix"], "text": texts})

    return found.pages.join(edits, "doc_ix", "left").join(joins, "doc_ix", "left").mapInPandas(run, "doc_ix bigint, text string")
