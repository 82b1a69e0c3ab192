"""Reading a typed name into comparable parts: firms into trade and coined word, persons into given name and surname."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

# Words of trades with the ways they are shortened; the full word comes first.
TRADE_WORDS = """
associates assoc assocs|auto|automotive|bakery|bearings brgs|bottling|brothers bros|building bldg|cargo|catering catg|centre center ctr|ceramic ceram|ceramics|chemical chem
|chemicals chems|cleaning|clothing|components comps compts|construction constr|contractors contrs|cooperative coop|dairy|distributors distrs dist distr|electrical elec
|electronics|engineering engg engrg eng|equipment equip|exports exp expts|fabricators fab fabs|farms|fashion|foods fds|freight frt|furniture furn|garden gdn|garments|glass gls|group grp
|hardware hdwe hdw|holdings|imports imp|industries inds|instruments instr instrs|international intl|interiors|jewellers|laboratory lab|leather lthr|logistics|machinery|management mgmt|manufacturing mfg mfrg
|marine|materials matls mtls|medical med|merchants mchts mrchts|metals|mills mls|mirrors mirrs|motors|office off|packaging pkg pkgg|paper ppr|pharma|plastics|printing prtg ptg
|products prods prod|seals sls|security sec|seed sd|services svcs svc|shipping|solar slr|solutions|steel stl|stores strs|supplies supp supps|systems sys|technologies tech techs|textile tex
|textiles|tiles tls|timber tmbr|tool tl|tools|traders trdrs trd|trading|transport|travels|water wtr|works wks|workshop
"""
FULL = {w: ws.split()[0] for ws in TRADE_WORDS.replace("\n", "").split("|") for w in ws.split()}
LONG = sorted({w for w in FULL.values() if len(w) >= 5})
TYPED = sorted({w for w in FULL if len(w) >= 4})
# Legal forms, titles and additions that don't name anybody.
LEGAL = re.compile(
    r"(?:\b(?:private|pvt|p)\b\.?|\(p\))?\s*\b(?:limited|ltd|llp|llc|inc|incorporated|corp|corporation|gmbh|plc|l\.l\.p|l\.l\.c|g\.m\.b\.h|(?:&\s*|and\s+)?(?:co|company))\b\.?"
    r"|\b(?:private|pvt)\b\.?|\(p\)|\(pvt\)"
)
TITLES = re.compile(r"(?:^|\s)(?:m/s|mr|mrs|ms|miss|dr|prof|herr|frau|mme|shri|smt)\b\.?(?=\s)")
ROLES = re.compile(r"[,\-–(\s]*\b(?:sole trader|sole proprietor|proprietor|proprietress|prop|owner)\b\.?\)?")
# Given names and the short forms in use for them.
GIVEN = """
abigail abby gail abbie|alexander alex sandy alec xander sasha lex|anjali anju anj|anthony tony ant|benjamin ben benny benji|catherine cathy kate|charles charlie chuck chas|christopher chris kit topher
|daniel dan danny|david dave davy|deborah debbie deb debs|dmitri mitya dima|dorothy dolly dot dottie|edward ed eddie ted teddy ned|ekaterina katya katia|eleanor ellie nell nora nelly|elizabeth liz lizzie beth betty eliza lisa betsy libby
|emily em emmy|florence flo flora|frances fran frannie francie frankie|francisco paco pancho cisco fran|frederick fred freddie freddy|gabriella gabby ella gabi|george georgie|giuseppe beppe peppe pino
|gregory greg|guadalupe lupe lupita|henry harry hank hal|isabella bella izzy isa|james jim jimmy jamie|jennifer jenny jen jenn|john jack johnny|jonathan jon jonny nathan|joseph joe joey|josephine josie jo joey
|katherine kathy kate katie kat kitty kay|lawrence larry laurie lenny lars|leonard leo len lenny leon|louise lou|margaret maggie meg peggy madge marge greta|maria mary|matthew matt matty|maximilian max
|michael mike mick mickey mikey misha|mohan mo moni monu|natasha nat tasha|nathaniel nate nat nathan|nicholas nick nicky nico|olivia liv livvy ollie livia|patricia pat patty trish tricia|patrick pat paddy|penelope penny nell
|peter pete|philippa pippa pip|rajesh raj raju|raymond ray|rebecca becky becca bex|richard rick dick richie ricky rich|robert rob bob bobby bert robbie|samuel sam sammy|stephanie steph stevie|steven steve stevie
|susanna sue susie suzy sanna susan|theodore ted theo teddy|thomas tom tommy|timothy tim timmy|valentina val valya tina|venkatesh venky venkat|victoria vicky vic tori|vincent vince vinny vinnie vin|wilhelmina mina willa billie minnie
|william will bill billy liam|yusuf yuyu yus joe|zachary zach zack zac
"""
SHORT: dict[str, frozenset[str]] = {}
for _names in GIVEN.replace("\n", "").split("|"):
    for _w in _names.split():
        SHORT[_w] = SHORT.get(_w, frozenset()) | {_names.split()[0]}
GIVENS = sorted({g for s in SHORT.values() for g in s})


def distance(a: str, b: str) -> int:
    """The unrestricted Damerau-Levenshtein distance, which is a metric (a transposition is one edit)."""
    if a == b:
        return 0
    top = len(a) + len(b)
    last_row: dict[str, int] = {}
    d = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        last_col = 0
        for j, y in enumerate(b, 1):
            row, col = last_row.get(y, 0), last_col
            if x == y:
                last_col = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[row][col] + (i - row - 1) + 1 + (j - col - 1))
        last_row[x] = i
    return d[-1][-1]


def variants(word: str, radius: int) -> set[str]:
    """``word`` and what is left of it without up to ``radius`` letters: words within the radius share one of these."""
    every = {word}
    new = {word}
    for _ in range(radius):
        new = {w[:i] + w[i + 1 :] for w in new for i in range(len(w))}
        every |= new
    return every


class Lexicon:
    """Words that are found by the letters left of them: a look-up measures a few words, not all."""

    def __init__(self, words: Iterable[str], radius: int):
        self.at: dict[str, set[str]] = {}
        for w in words:
            for v in variants(w, radius):
                self.at.setdefault(v, set()).add(w)

    def near(self, word: str, most: int) -> set[str]:
        """The words at most ``most`` edits from ``word``."""
        met = set().union(*(self.at.get(v, ()) for v in variants(word, most)))
        return {w for w in met if distance(word, w) <= most}


_LONG, _TYPED, _GIVENS = Lexicon(LONG, 1), Lexicon(TYPED, 2), Lexicon(GIVENS, 1)


class Name(NamedTuple):
    kind: str  # 'firm' or 'person'
    sector: str  # the trade's words in order of the alphabet, or the initials of the possible given names, joined by '/'
    core: str  # what the edit metric compares: the coined word or the surname, folded
    given: str  # possible given names joined by '/', or an initial
    middle: str  # a middle name or initial
    typed: str = ""  # the core as it was typed, not folded


@lru_cache(maxsize=200_000)
def _trade_word(word: str) -> str | None:
    if word in FULL:
        return FULL[word]
    if len(word) >= 5:
        near = _LONG.near(word, 1)
        return near.pop() if len(near) == 1 else None
    return None


@lru_cache(maxsize=200_000)
def _typed_trade_word(word: str) -> str | None:
    """The trade word that a further word of a firm is with one typing error, two in long words."""
    most = 1 if len(word) < 8 else 2
    near = {FULL[w] for w in _TYPED.near(word, most)}
    return near.pop() if len(near) == 1 else None


def fold(word: str) -> str:
    """``word`` with spellings of one sound made equal, so that they cost no edit."""
    for a, b in (("kw", "qu"), ("ph", "f"), ("ck", "k"), ("oo", "u"), ("ie", "i"), ("ee", "i"), ("c", "k"), ("w", "v"), ("y", "i")):
        word = word.replace(a, b)
    return word


@lru_cache(maxsize=200_000)
def _given(word: str) -> frozenset[str] | None:
    if word in SHORT:
        return SHORT[word]
    if len(word) >= 5:
        return frozenset(_GIVENS.near(word, 1)) or None
    return None


def _flat(text: str) -> str:
    t = unicodedata.normalize("NFKD", text)
    return "".join(c for c in t if not unicodedata.combining(c))


def read_name(text: str | None) -> Name | None:
    """The parts of a name; None for a null, empty or letterless text."""
    t = " ".join(_flat(text or "").split())
    if not any(c.isalpha() for c in t):
        return None
    t = re.sub(r"\S{12,}", lambda m: re.sub(r"(?<=[a-z.])(?=[A-Z])", " ", m[0]), t)  # words run together
    low = re.sub(r"\bco-op\b", "coop", t.lower())
    role = ROLES.search(low)
    if role and role.end() >= len(low) - 1:
        low, t = low[: role.start()], t[: role.start()]
    bare = LEGAL.sub(" ", f" {low} ").strip(" ,.-&")
    words = re.findall(r"[^\W\d_]+|\d+", re.sub(r"\b(?:the|and)\b|&", " ", bare))
    trades: list[str] = []
    rest: list[str] = []
    for i, w in enumerate(words):
        if len(w) > 6 and w.endswith("and") and _trade_word(w[:-3]):
            w = w[:-3]
        full = _trade_word(w)
        if full and (len(w) > 3 or w in FULL and len(words) > 1):
            trades.append(full)
        else:
            rest.append(w)
    if trades and len(rest) > 1:
        longest = max(rest, key=len)
        typed = [(w, _typed_trade_word(w) if w != longest and len(w) >= 4 else None) for w in rest]
        trades += [f for _, f in typed if f]
        rest = [w for w, f in typed if not f]
    if trades or bare != low.strip(" ,.-&"):
        if not rest:
            rest, trades = words, []
        typed = "".join(rest)
        return Name("firm", " ".join(sorted(set(trades))), fold(typed), "", "", typed)
    p = ROLES.sub(" ", TITLES.sub(" ", f" {low} ")).strip(" ,.-")
    comma = p.split(",", 1)
    if len(comma) == 2 and comma[1].strip():
        surname, givens = comma[0].split(), re.findall(r"[^\W\d_]+", comma[1])
    else:
        parts = re.findall(r"[^\W\d_]+(?:[-'][^\W\d_]+)*", p)
        if len(parts) == 1:
            return Name("person", "", fold(parts[0]), "", "", parts[0])
        first_upper = re.match(r"^(?:\S+\s)??([^\W\d_]{2,}) [A-Z]?[a-z]", t) and re.findall(r"[^\W\d_]+", ROLES.sub("", TITLES.sub(" ", f" {t} ", 0)) or t)[:1]
        upper = [w for w in re.findall(r"[^\W\d_]{2,}", t) if w.isupper()]
        surname_first = _given(parts[0]) is None and len(parts[0]) > 1 and (_given(parts[1]) is not None or bool(upper and first_upper and upper[0] == first_upper[0] and len(upper) == 1))
        surname, givens = ([parts[0]], parts[1:]) if surname_first else ([parts[-1]], parts[:-1])
    typed = re.sub(r"[\W\d_]", "", "".join(surname))
    core = fold(typed)
    if not givens:
        return Name("person", "", core, "", "", typed)
    first, middle = givens[0], (givens[1] if len(givens) > 1 else "")
    if len(first) == 1:
        return Name("person", first, core, first, middle, typed)
    options = _given(first)
    given = "/".join(sorted(options)) if options else first
    return Name("person", "/".join(sorted({g[0] for g in given.split("/")})), core, given, middle, typed)
