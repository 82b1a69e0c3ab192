"""Finding personal information in free text and replacing it with typed placeholders.

Regular expressions propose spans; checksum validators and known forms confirm or reject them; words just before and
after adjust the score, upwards where they speak of a person, downwards where they speak of goods, orders or firms. A span
is taken from THRESHOLD on; overlaps go to the surer kind.

Kinds that carry a checksum (cards by Luhn, accounts by mod-97) stand and fall by it: a number that fails is rejected
whatever stands around it, one that passes needs no context, and only words that speak of something else outweigh it.
Kinds without one need context. Twelve-digit numbers of residents are such a kind, as only some countries' carry the
Verhoeff checksum; one that passes counts a little more.

A street address is a number, a street's name and a kind of street, in either order, with the parts that follow by the
grammar of addresses; a line that is an address as a whole may be in small letters. A name is a sequence of capitalised
words: known given names, titles and words before and after that speak of persons raise its score, words of trades, places
and documents end it. A single word is a name only where the words around it leave no other reading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.addresses import _KIND as STREET_WORDS
from docsift.llm.addresses import LANDMARKS, UNITS, Reader
from docsift.llm.name_parts import FULL, LEGAL, _given, read_name
from docsift.session import spread

THRESHOLD = 2.0
#: Characters beside a span in which context words are looked for.
CONTEXT = 48
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}
ORDER = ["email", "id_number", "phone", "street_address", "person_name"]


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# Forms of addresses, numbers and the words around them.
_EMAIL = re.compile(r"(?<![\w.+@-])[\w][\w.+'-]*\s?(?:@|\(at\)|\[at\]|\{at\}|<at>)\s?\w[\w-]*(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?)\w[\w-]*)+", re.I)
_NUMBER = re.compile(r"(?<![\w./+-])(?:\+|\()?\d[\d ().\-/]{6,20}\d(?!\w|[.-]\d)")
_IDS = [
    ("social", re.compile(r"(?<![\w-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])")),
    ("insurance", re.compile(r"\b[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b")),
    ("tax", re.compile(r"\b[A-Z]{5}\d{4}[A-Z]\b")),
    ("passport", re.compile(r"\b[A-Z]{1,2}\d{7,8}\b")),
    ("resident", re.compile(r"(?<![\w-])\d{4}([ -])\d{4}\1\d{4}(?![\w-])(?! \d)")),
    ("account", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("card", re.compile(r"(?<![\w-])(?:(?:4\d{3}|5[1-5]\d\d|2[2-7]\d\d|6011|65\d\d)([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d\d([ -]?)\d{6}\2\d{5}|3[068]\d\d([ -]?)\d{6}\3\d{4})(?![\w-])")),
]
_ID_BEFORE = re.compile(r"(?:social security(?: number| no\.?)?|(?<!transaction )\bid\b[^.;\n]{0,24}|passport[^.;\n]{0,16}|national id|bearer of|taxpayer(?: card| no\.?)?|proof of identity|identity (?:card|number|no\.?)|licen[cs]e(?: no\.?)?|visitor document no\.|tax (?:id|number|card))\s*(?:is|was|:|#)?\s*$", re.I)
_NOT_PERSONAL = re.compile(r"(?:account code|consignment|batch(?: code)?|order|part no\.?|tariff heading|bill of lading|meter reading|previous|version|reference|number|invoice(?: no\.?)?|receipt(?: no\.?)?|transaction(?: id)?|serial|room|lane|extension|code|date)\s*:?\s*$", re.I)
_PHONE_BEFORE = re.compile(r"(?:(?:\btel\.?|\bph\.?|\b(?:tele)?phone|\bmobile|\bcell|\bfax|\bcontact)(?: (?:number|no\.?))?(?: is| was)?|\breach(?: (?:me|us|him|her|them))?(?: (?:on|at|under))?|\btext(?: me| us)?(?: on| at)?|\bnumber is|call(?: (?:me|us|him|her|them))?(?: back)?(?: on| at)?|\bdial|reached (?:under|at|on)|\bring|whatsapp|telephone)\s*:?\s*$", re.I)
_PHONE_AFTER = re.compile(r"\s*(?:is answered|\((?:evenings|day|work|home)\)|after (?:lunch|noon|hours)|is out of service|- ask for|before noon|instead)", re.I)
_TITLE = r"(?:m/s|mr|mrs|ms|miss|dr|prof|herr|frau|mme)\b\.?"
_NAME_TOKEN = r"(?:[^\W\d_]\.|[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*)"
_TOKEN = re.compile(rf"{_NAME_TOKEN}[,.;:]?")
_LEAD = re.compile(rf"(?i:{_TITLE})\s+")
_NAME = rf"(?P<name>{_NAME_TOKEN}(?:,? {_NAME_TOKEN}){{0,3}}?)"
_NAMES_BETWEEN = [
    re.compile(rf"\b(?i:{before})\s+(?:(?i:{_TITLE})\s+)?{_NAME}(?={after})")
    for before, after in (
        ("dear", r"\s*,|\s*!"),
        ("according to", r"\s+the\b"),
        ("when", r"\s+(?:called|phoned|wrote|arrived)\b"),
        ("(?:we thank|thanks to)", r"\s+for\b"),
        ("(?:handed to|given to|passed to|shown to)", r"\s+at\b"),
        ("(?:nobody except|only)", r"\s+has\b"),
        ("it was", r"\s+who\b"),
        ("(?:seen by|checked by|opened by|received by)", r"\s+on\b"),
    )
]
_NAMES_AFTER = re.compile(r"\b(?i:signed by|regards,|sincerely,|faithfully,|attn:?|attention:|c/o|(?:checked|seen|noted) and found [a-z]+,)\s+")
#: Words that begin sentences and are no names (fixed value).
_NO_NAMES = set(
    "the a an call tel we both it its it's when home please fax mobile send cc you copies copy dear resident any this that delivery our under by for in on at as because until upon according payment kindly"
    " consumption replacement long-term interest unit goods bank temperature individual following after without with since social passport id proof taxpayer collected visitor nobody signed regards attn checked"
    " private forward moved order part version tariff meter room lane extension batch bill account consignment ph and of to is was has who all no not from total grand amount invoice receipt purchase terms".split()
)
_ADDRESS_BEFORE = re.compile(r"(?:resident of|lives at|living at|home address(?: on file)?:?|private delivery:?|goods at|returned from|parcel to|moved [a-z ]+, now|collect the [a-z ]+ from|deliver(?:ed)? to|address:)\s+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    a = account.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1


def verhoeff(digits: str) -> bool:
    """The dihedral checksum of twelve-digit resident numbers."""

    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 + (0 if b < 5 else 5) if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5

    turn = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    c = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        for _ in range(i % 8):
            n = turn[n]
        c = times(c, n)
    return c == 0


#: Score of an identity number: of a form that proves nothing by itself, and of a checksum that holds.
FORM, PROVEN = 1.0, 2.5


def _numbers(text: str) -> Iterator[Span]:
    for name, pattern in _IDS:
        for m in pattern.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if name in ("card", "account"):
                if not (luhn(digits) if name == "card" else mod97(m[0])):
                    continue
                score = PROVEN
            else:
                score = FORM + (0.25 if name == "resident" and verhoeff(digits) else 0.0)
            before = text[max(0, m.start() - CONTEXT) : m.start()]
            if _ID_BEFORE.search(before):
                score += 2.0
            elif _NOT_PERSONAL.search(before):
                score -= 2.0
            yield Span(m.start(), m.end(), "id_number", score)
    for m in _NUMBER.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        if not 8 <= len(digits) <= 15:
            continue
        before, after = text[max(0, m.start() - CONTEXT) : m.start()], text[m.end() : m.end() + CONTEXT]
        score = 1.0 if m[0][0] == "+" or m[0].startswith(("(", "0")) else 0.5
        if _PHONE_BEFORE.search(before) or _PHONE_AFTER.match(after):
            score += 1.75
        elif _NOT_PERSONAL.search(before) or _ID_BEFORE.search(before):
            score -= 2.0
        elif m[0][0] == "+":
            score += 1.0
        yield Span(m.start(), m.end(), "phone", score)


def _address_end(text: str, at: int) -> int:
    """Where an address that begins at ``at`` ends: at the end of the line or sentence, or before a new sentence."""
    line_end = next((k for k in (text.find("\n", at),) if k >= 0), len(text))
    part = text[at:line_end]
    stop = len(part)
    inner = set(LANDMARKS.split()) | set(UNITS.split()) | {"no", "next", "close", "and", "the", "to"}
    for m in re.finditer(r"\s+(?:instead|and|or|who|which|where|until|since|because|but|so)\b|\.\s*$|\.(?=\s+[A-Z\"])|(?<=[\w.])\s(?=[A-Z][a-z']+ [a-z]+)|(?<=\d)\s(?=\S+\s?(?:@|\(at\)|\[at\]))|(?<=\d)\s(?=[+(]\d)|(?<=\d)\s(?=(?:[A-Z][a-z]+ )?[A-Z][a-z]+,? (?:ID|No)\b)|\s(?=(?:E-mail|Cc|Tel|Fax|[Pp]h|Mobile|Passport|Social|ID|Proof|Signed|c/o|Attn|Dear)\b[.:]?\s)|\.?\s(?=\S+\s?(?:@|\(at\)|\[at\]))|\.(?=\s+(?:\d{3}[.-]|[+(]\d))", part):
        word = re.search(r"([^\W\d_]+)$", part[: m.start()])
        if m[0].startswith(".") and m.end() < len(part) and word and (word[1].lower() in STREET_WORDS or word[1].lower() in inner or word[1].lower() in ("ind", "indl")):
            continue  # an abbreviation
        if m[0].isspace():
            new = re.match(r"\s?([^\W\d_']+)[^\s]* ([^\W\d_]+)", part[m.start() :])
            if new and (new[2].lower() in inner or new[2].lower() in STREET_WORDS or new[1].lower() in STREET_WORDS or new[2].lower() in ("ind", "indl", "industrial")):
                continue
            if not re.search(r"\d", part[: m.start()]):
                continue
        stop = m.start()
        break
    return at + len(part[:stop].rstrip(" .,;-"))


# Words that an address never holds, and the words of its grammar.
_PROSE = set("a an of is are was were be been for with has have had by on in at we you he she they it this that these those our your his her their please not or if when until after before from as within will can may must take takes took into".split())
_GRAMMAR = set(UNITS.split()) | set(LANDMARKS.split()) | {"next", "close", "the", "ind", "indl", "industrial"}
_KINDS = "|".join(sorted(STREET_WORDS, key=len, reverse=True))
_CAP = r"(?:[A-Z][^\W\d_]*(?:['’-][^\W\d_]+)*)"
_NO = r"(?:(?:(?i:no\.?|number)\s?|\#)?\d{1,4}[A-Za-z]?)"
_IN_UNIT = rf"(?:(?i:{'|'.join(UNITS.split())})\b\.?\s?(?i:no\.?\s?|nr\.?\s?|\#)?\d+[A-Za-z]?)"
_STREET = rf"{_CAP}(?: {_CAP})?? (?:(?i:ind|indl|industrial)\.? )?(?:(?i:{_KINDS}))\b\.?"
_LAND = rf"(?:(?i:{'|'.join(LANDMARKS.split())}|next to|close to)\.? (?:the )?{_CAP}(?: {_CAP})?)"
_SEP = r"(?:\s?[,;]\s?|\s-\s|\s)"
_ANCHOR = re.compile(
    rf"(?<![\w#.-])(?:(?:{_IN_UNIT}{_SEP})?(?:\d{{1,4}}/)?{_NO},?\s{_STREET}|{_STREET},?\s(?i:no\.?\s?|\#)?\d{{1,4}}[A-Za-z]?\b(?!\s\d|[.,:/]\d|\s?%))"
    rf"(?:{_SEP}{_IN_UNIT}|{_SEP}{_LAND}|\s?[,;]\s?{_CAP}(?: {_CAP}){{0,2}}|\s{_CAP}(?=,| \d{{5,6}}\b)|{_SEP}(?:\d{{5,6}}|\d{{2,3}} \d{{3}})\b)*"
)
_HAS_DIGIT, _HAS_DIGIT_OR_COLON = re.compile(r"\d"), re.compile(r"[\d:]")
_LABELLED = re.compile(r"[^:]*:|[A-Z ]*(?:INVOICE|ORDER|RECEIPT|STATEMENT|MEMO)\b")


def _is_address(reader: Reader, text: str) -> bool:
    got = reader.read(text)
    return got is not None and bool(got[1]) and bool(got[3])


def _addresses(text: str, reader: Reader) -> Iterator[Span]:
    for m in _ADDRESS_BEFORE.finditer(text):
        end = _address_end(text, m.end())
        if end > m.end() and _is_address(reader, text[m.end() : end]):
            yield Span(m.end(), end, "street_address", 3.0)
    # lines that are an address as a whole
    for m in re.finditer(r"[^\r\n]+", text):
        line = m[0].strip()
        if not _HAS_DIGIT.search(line) or _LABELLED.match(line):
            continue
        words = re.findall(r"[^\W\d_]+", line)
        small = [] if line.islower() else [w for w in words if w.islower() and len(w) > 2 and w not in STREET_WORDS and w not in _GRAMMAR]
        if len(small) > 1 or any(w.lower() in _PROSE for w in words) or _ADDRESS_BEFORE.search(line):
            continue
        if _is_address(reader, line):
            at = m.start() + m[0].index(line)
            yield Span(at, at + len(line), "street_address", 3.0)
    for m in _ANCHOR.finditer(text):
        found = re.sub(rf"[,;]\s?(?:{_CAP} )?(?i:{_TITLE})$", "", m[0].rstrip())
        before = text[max(0, m.start() - CONTEXT) : m.start()]
        yield Span(m.start(), m.start() + len(found), "street_address", FORM if _NOT_PERSONAL.search(before) else 2.0)


def _take_name(text: str, at: int) -> tuple[int, int] | None:
    """The name that begins at ``at``, if one does."""
    if t := _LEAD.match(text, at):
        at = t.end()
    line_end = text.find("\n", at)
    line_end = line_end if line_end >= 0 else len(text)
    tokens = list(islice(_TOKEN.finditer(text, at, line_end), 5))
    if not tokens or tokens[0].start() > at:
        return None
    tokens = [t for k, t in enumerate(tokens) if k == 0 or text[tokens[k - 1].end() : t.start()] == " "][:4]

    def bare(k: int) -> str:
        return tokens[k][0].rstrip(",.;:")

    def initial(k: int) -> bool:
        return k < len(tokens) and len(bare(k)) == 1

    def named(k: int) -> bool:
        return k < len(tokens) and not initial(k) and bare(k).lower() not in _NO_NAMES

    def given(k: int) -> bool:
        return k < len(tokens) and _given(bare(k).lower()) is not None

    def closes(k: int) -> bool:
        return tokens[k][0][-1] in ",.;:" and not initial(k)

    def end(k: int) -> tuple[int, int]:
        return at, tokens[k].start() + len(bare(k) if not initial(k) else tokens[k][0].rstrip(",;:"))

    if not named(0) and not initial(0):
        return None
    if tokens[0][0][-1] == "," and not initial(0):
        if initial(1):
            return end(2 if initial(2) else 1)
        return end(1) if given(1) else end(0)
    k = 0
    while initial(k) and k + 1 < len(tokens):
        k += 1
    if k:
        return end(k) if named(k) else None
    if closes(0) or not given(0):
        if not closes(0) and named(1) and not text[tokens[1].end() : line_end].strip("\r ."):
            return end(1)  # a given name that isn't known, and the line ends
        if not closes(0) and named(1) and tokens[1][0][-1] == ".":
            return end(1)
        # SURNAME Given
        return end(1) if not closes(0) and tokens[0][0].isupper() and given(1) else end(0)
    if initial(1):
        return end(2) if named(2) else end(0)
    if not named(1):
        return end(0)
    if not closes(1) and len(bare(1)) <= 5 and named(2) and len(bare(2)) > 4:
        return end(2)
    return end(1)


def _names(text: str) -> Iterator[Span]:
    for pattern in _NAMES_BETWEEN:
        for m in pattern.finditer(text):
            words = re.findall(r"[^\W\d_]+", m["name"].lower())
            if not any(w in _NO_NAMES for w in words if len(w) > 1) and read_name(m["name"]) and read_name(m["name"]).kind == "person":
                yield Span(m.start("name"), m.end("name"), "person_name", 2.5)
    for m in _NAMES_AFTER.finditer(text):
        if (got := _take_name(text, m.end())) and (n := read_name(text[got[0] : got[1]])) and n.kind == "person":
            yield Span(*got, "person_name", 2.5)
    # a sole trader at the top, or a line that is nothing but a known name
    first = True
    for m in re.finditer(r"[^\r\n]+", text):
        line = m[0].strip()
        if not line:
            continue
        at = m.start() + m[0].index(line)
        top, first = first, False
        if _HAS_DIGIT_OR_COLON.search(line) or not 2 <= line.count(" ") + 1 <= 12:
            continue
        shown = _TRADER.sub("", line)
        lead = _LEAD.match(shown)
        skip = lead.end() if lead else 0
        if 1 < len(shown[skip:].split()) <= 4 and (n := read_name(shown)) and n.kind == "person":
            words = re.findall(r"[^\W\d_]+", shown[skip:])
            known = any(_given(w.lower()) for w in words) or any(len(w) == 1 for w in words) or bool(lead) or shown != line
            if known and not any(w.lower() in _NO_NAMES for w in words if len(w) > 1):
                yield Span(at + skip, at + len(shown), "person_name", 2.5 if top else 2.0)
    yield from _capitalised(text)


_TRADER = re.compile(r"[,\s(–-]*(?i:\(?prop\.?\)?|proprietor|proprietress|sole (?:trader|proprietor)|owner)\)?\.?$")
_SEQUENCE = re.compile(rf"(?<![\w.@'’-]){_CAP}(?: (?:[A-Z]\.|{_CAP})){{1,3}}(?![\w@]|\.\w)")
# Words before and after a name that speak of a person, and capitalised words that are none of a name.
_PERSON_BEFORE = re.compile(r"\b(?:met|meet|meeting|saw|with|by|from|to|for|thank|thanks|contact|ask(?:ed)?|tell|told|and|or|dear|hello|hi|regards|sincerely|signed|name is|am|called|was|is|(?:colleague|customer|tenant|employee|manager|visitor|neighbour|partner|mother|father|wife|husband|son|daughter|friend|driver|clerk)s?|that|when|while|since|but|let)[,:]?\s+$", re.I)
_PERSON_AFTER = re.compile(r",?\s+(?:said|says|wrote|writes|called|calls|phoned|asked|told|signed|confirmed|collected|paid|lives|lived|works|worked|visited|arrived|whose|and I|joined|left|returned|agreed|complained|reported|\(born)\b")
_ANY_AFTER = re.compile(r",?\s+(?:will|has|had|is|was|who|can|could|would|does|did|received)\b")
_ARTICLE = re.compile(r"\b(?:the|a|an|this|that|our|your|its|each|every)\s+$", re.I)
_NOT_IN_NAMES = set(
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday north south east west central upper lower old new"
    " town hall gate side row ward park quarter hill station bus school church market bank hospital hotel centre center house floor room desk department office court street road avenue lane square bridge"
    " invoice order receipt statement memo number account payment date total amount due page terms please kind best yours copy bill lading passport national identity".split()
)


def _capitalised(text: str) -> Iterator[Span]:
    """Sequences of capitalised words, scored by what is known of the words and by the words around them."""
    for m in _SEQUENCE.finditer(text):
        words = m[0].split()
        low = [w.strip(".").lower() for w in words]
        start = m.start()
        near = text[max(0, start - CONTEXT) : start].rstrip(" ")
        begins = not near or near[-1] in ".!?\n\r:;\""
        if begins and (low[0] in _NO_NAMES or low[0] in _PROSE or _PERSON_BEFORE.search(words[0] + " ")) or low[0] in _NO_NAMES and _given(low[0]) is None:
            start += len(words[0]) + 1
            words, low, begins = words[1:], low[1:], False
        titled = _LEAD.match(m[0], start - m.start()) is not None
        if titled:
            start += len(words[0]) + 1
            words, low, begins = words[1:], low[1:], False
        if len(words) < 2 or any(w in _NOT_IN_NAMES or w in FULL or w in STREET_WORDS or w in _NO_NAMES and len(w) > 1 for w in low):
            continue
        after = text[m.end() : m.end() + CONTEXT]
        if LEGAL.search(f" {' '.join(low)} ") or re.match(r",? (?:and|&|[A-Z(])", after) and re.match(r"(?:,? (?:and |& )?)[A-Z(]", after) and _firm_follows(after):
            continue
        before = text[max(0, start - CONTEXT) : start]
        titled = titled or re.search(rf"(?i:\b{_TITLE})\s+$", before) is not None
        score = 1.0 + (1.0 if any(_given(w) for w in low if len(w) > 2) else 0.0)
        score += 1.0 if titled else -0.5 if begins else -1.0 if _ARTICLE.search(before) else 0.0
        score += 1.0 if _PERSON_BEFORE.search(before) else 0.0
        score += 1.5 if _PERSON_AFTER.match(after) else 0.5 if _ANY_AFTER.match(after) else 0.0
        if not any(len(w) > 1 and not w.isupper() for w in words):
            score -= 1.0
        yield Span(start, m.end(), "person_name", score)


def _firm_follows(after: str) -> bool:
    word = re.match(r",? (?:and |& )?\(?([^\W\d_]+)", after)
    return word is not None and (word[1].lower() in FULL or LEGAL.fullmatch(word[1].lower()) is not None)


def spans(text: str | None, reader: Reader | None = None) -> list[Span]:
    """The personal items of a text in order, without overlaps; none for a null or empty text."""
    if not text:
        return []
    reader = reader or Reader([])
    found = [Span(m.start(), m.end(), "email", 3.0) for m in _EMAIL.finditer(text)]
    found += [*_numbers(text), *_addresses(text, reader), *_names(text)]
    taken: list[Span] = []
    for s in sorted((s for s in found if s.score >= THRESHOLD), key=lambda s: (ORDER.index(s.kind), -s.score, s.start, -s.end)):
        if all(s.end <= t.start or s.start >= t.end for t in taken):
            taken.append(s)
    return sorted(taken)


def redact(text: str, found: list[Span]) -> str:
    """The text with its items replaced by typed placeholders."""
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


def find_personal(doc_text: DataFrame, source: str = "text") -> DataFrame:
    """``(doc_ix, pii_type, pii_text)``: each distinct item of the texts whose ``source`` is ``source``.

    Rows delivered twice count once; null and empty texts have no item.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader([])
        for frame in frames:
            rows = [(ix, s.kind, t[s.start : s.end]) for ix, t in zip(frame["doc_ix"], frame["text"], strict=True) for s in spans(t, reader)]
            yield pd.DataFrame(rows, columns=["doc_ix", "pii_type", "pii_text"])

    texts = spread(doc_text.filter((F.col("source") == source) & (F.length("text") > 0)).select("doc_ix", "text").dropna())
    return texts.mapInPandas(run, "doc_ix bigint, pii_type string, pii_text string").distinct()


def redacted_texts(doc_text: DataFrame, source: str = "text") -> DataFrame:
    """``(doc_ix, text)`` with placeholders, one row per distinct text of a document; null and empty texts stay."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader([])
        for frame in frames:
            yield frame.assign(text=[redact(t, spans(t, reader)) if isinstance(t, str) else None for t in frame["text"]])

    return spread(doc_text.filter(F.col("source") == source).select("doc_ix", "text"), "doc_ix").distinct().mapInPandas(run, "doc_ix bigint, text string")
