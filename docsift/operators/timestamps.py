"""Normalising points in time written in mixed formats, precisions and zones to one instant in UTC.

A text is parsed under every format that is valid for it (day or month first, meanings of a zone abbreviation). Which
formats a source uses is a mixture: expectation-maximisation over the source's counts of candidate sets finds the
weights, and the posterior chooses each text's interpretation. What no posterior decides, or no zone locates, is
marked and gets no instant.

Parsing is one pass over the rows in Arrow batches. The mixtures are fitted on counts per (source, candidate set), a
table of as many rows as formats occur in sources, each source by itself, whatever the number of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import cut, spread

# Abbreviations of zones and their minutes east of UTC; where one is used twice, the meanings.
ZONES = {
    "UTC": (0,), "GMT": (0,), "Z": (0,), "UT": (0,), "WET": (0,), "WEST": (60,), "CET": (60,), "CEST": (120,), "MET": (60,), "MEST": (120,),
    "EET": (120,), "EEST": (180,), "MSK": (180,), "BST": (60, 360), "IST": (330, 60, 120), "EST": (-300,), "EDT": (-240,), "CST": (-360, 480),
    "CDT": (-300,), "MST": (-420,), "MDT": (-360,), "PST": (-480, 480), "PDT": (-420,), "AKST": (-540,), "AKDT": (-480,), "HST": (-600,),
    "WAT": (60,), "CAT": (120,), "EAT": (180,), "SAST": (120,), "GST": (240,), "PKT": (300,), "NPT": (345,), "SGT": (480,), "HKT": (480,),
    "JST": (540,), "KST": (540,), "AWST": (480,), "ACST": (570,), "ACDT": (630,), "AEST": (600,), "AEDT": (660,), "NZST": (720,), "NZDT": (780,),
}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

_MONTH = r"(?P<mon>(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)\.?"
_DAY = r"(?P<d>\d{1,2})(?:st|nd|rd|th)?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_DATES = [
    ("ymd", re.compile(r"(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})(?!\d)")),
    ("num", re.compile(r"(?P<a>\d{1,2})(?P<s>[-/.])(?P<b>\d{1,2})(?P=s)(?P<y>\d{4}|\d{2})(?!\d)")),
    ("dmony", re.compile(rf"{_WEEKDAY}{_DAY}[\s-]+(?:of\s+)?{_MONTH}[\s,-]+(?P<y>\d{{4}}|\d{{2}})(?!\d)", re.I)),
    ("mondy", re.compile(rf"{_WEEKDAY}{_MONTH}\s+{_DAY},?\s+(?P<y>\d{{4}})(?!\d)", re.I)),
]
_AT = re.compile(
    r"(?:(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<se>\d{2})(?:[.,](?P<f>\d+))?)?|(?P<hm>\d{4})\s*(?:hrs|hours|h))"
    r"(?:\s*(?P<ap>[ap])\.?m\b\.?)?(?P<z>.*)",
    re.I | re.S,
)
_OFFSET = re.compile(r"(?:(?:GMT|UTC)\s*)?(?P<sg>[+-])(?P<oh>\d{1,2})(?::?(?P<om>\d{2}))?(?:\s*\[[A-Za-z_]+(?:/[A-Za-z_+-]+)+\])?", re.I)
_REGION = re.compile(r"\[?(?P<r>[A-Za-z_]+(?:/[A-Za-z_+-]+)+)\]?")
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})?)?(?:[.,](\d+))?\s*(Z|[+-]\d{2}:?\d{2})?")
_EPOCH = {10: 1_000_000, 13: 1_000, 16: 1}
_ZERO = datetime(1970, 1, 1)


@lru_cache(maxsize=1_024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _local_to_utc(at: datetime, zone: ZoneInfo) -> datetime:
    """The earlier instant of a local time that occurs twice; one that was skipped moves forward by the gap."""
    return at.replace(tzinfo=zone, fold=0).astimezone(timezone.utc).replace(tzinfo=None)


def _zones_of(text: str) -> list[tuple[str, int | ZoneInfo | None]] | None:
    """The meanings of the zone part of a text, by name; [("site", None)] if there is none, None if it is no zone."""
    z = text.strip().strip("()").strip()
    if not z:
        return [("site", None)]
    if m := _OFFSET.fullmatch(z):
        minutes = int(m["oh"]) * 60 + int(m["om"] or 0)
        if len(m["oh"]) > 2 or minutes > 14 * 60:
            return None
        return [("offset", minutes if m["sg"] == "+" else -minutes)]
    if z.upper() in ZONES:
        of = ZONES[z.upper()]
        return [("abbreviation" if len(of) == 1 else f"{z.upper()}{k:+d}", k) for k in of]
    if m := _REGION.fullmatch(z):
        zone = _zone(m["r"])
        return [("region", zone)] if zone else None
    return None


def readings(text: str | None) -> list[tuple[str, datetime, int | ZoneInfo | None]]:
    """Every valid reading: (format, local time, zone: minutes, a region, or None for the site's)."""
    t = " ".join((text or "").split())
    if not t:
        return []
    if t.isdigit() and len(t) in _EPOCH:
        return [("epoch", _ZERO + timedelta(microseconds=int(t) * _EPOCH[len(t)]), 0)]
    days: list[tuple[str, int, int, int]] = []
    if (m := _COMPACT.fullmatch(t)) and (len(t) in (8, 14) or "T" in t):
        y, mo, d, h, mi, se, f, z = m.groups()
        days, rest = [("compact", int(y), int(mo), int(d))], (f"{h}:{mi}:{se or '00'}.{f or '0'} {z or ''}" if h else "")
    else:
        for kind, pattern in _DATES:
            if m := pattern.search(t):
                break
        else:
            return []
        year = int(m["y"]) + (2000 if len(m["y"]) == 2 else 0)
        if kind == "ymd":
            days = [("ymd", year, int(m["m"]), int(m["d"]))]
        elif kind == "num":
            a, b = int(m["a"]), int(m["b"])
            width = f"{m['s']}{len(m['y'])}"
            days = [(f"dmy{width}", year, b, a)] + ([(f"mdy{width}", year, a, b)])
        else:
            days = [(kind, year, MONTHS[m["mon"][:3].lower()], int(m["d"]))]
        before, after = t[: m.start()].strip(" ,"), t[m.end() :]
        if re.fullmatch(r"\S.*?\s+on", before, re.I):
            before = before[:-2].strip()
        after = re.sub(r"^(?:T(?=\d)|[\s,]+(?:at\s+)?)", "", after)
        if before and after.strip():
            return []
        rest = (before or after).strip(" ,")
    hour = minute = second = micro = 0
    zone = ""
    if rest:
        if m := _AT.fullmatch(rest):
            hour, minute = (int(m["hm"][:2]), int(m["hm"][2:])) if m["hm"] else (int(m["h"]), int(m["mi"]))
            second, micro, zone = int(m["se"] or 0), int(((m["f"] or "0") + "000000")[:6]), m["z"]
            if m["ap"]:
                if not 1 <= hour <= 12:
                    return []
                hour = hour % 12 + 12 * (m["ap"].lower() == "p")
        else:
            zone = rest
    zones = _zones_of(zone)
    if zones is None:
        return []
    out = []
    for name, y, mo, d in days:
        try:
            at = datetime(y, mo, d, hour, minute, second, micro)
        except ValueError:
            continue
        out += [(name if len(zones) == 1 else f"{name} {z}", at, k) for z, k in zones]
    return list({(at, k): (name, at, k) for name, at, k in reversed(out)}.values())[::-1]


def _candidates(text: str | None, zone_name: str | None, day_first: bool | None) -> tuple[list[str], list[float], list[str | None]]:
    """Formats, likelihoods given what is known of the site, and instants of a text's readings."""
    site = _zone(zone_name) if zone_name else None
    names, weights, instants = [], [], []
    for name, at, zone in readings(text):
        weight, utc = 1.0, None
        try:
            if isinstance(zone, int):
                utc = at - timedelta(minutes=zone)
                if name[-1].isdigit() and " " in name and site is not None:  # of several meanings, the one in use at the site
                    weight = 1.0 if site.utcoffset(at) == timedelta(minutes=zone) else 1e-3
            elif zone is not None:
                utc = _local_to_utc(at, zone)
            elif site is not None:
                utc = _local_to_utc(at, site)
        except OverflowError:
            continue
        if day_first is not None and name[:3] == ("mdy" if day_first else "dmy"):
            weight *= 1e-12  # what the site declares decides wherever both orders are possible
        names.append(name)
        weights.append(weight)
        instants.append(utc.strftime("%Y-%m-%dT%H:%M:%S.") + f"{utc.microsecond:06d}Z" if utc else None)
    return names, weights, instants


_PARSED = "doc_ix bigint, source string, formats array<string>, weights array<double>, instants array<string>"


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = lru_cache(maxsize=50_000)(_candidates)
    for frame in frames:
        of = [
            known(t if isinstance(t, str) else None, z if isinstance(z, str) else None, None if d is None or d != d else bool(d))
            for t, z, d in zip(frame["text"], frame["zone_name"], frame["day_first"], strict=True)
        ]
        yield pd.DataFrame({"doc_ix": frame["doc_ix"], "source": frame["source"], "formats": [x[0] for x in of], "weights": [x[1] for x in of], "instants": [x[2] for x in of]})


#: Pseudo-count of every format in a source's mixture, and rounds of expectation-maximisation.
PRIOR = 0.5
ROUNDS = 50


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """Expectation-maximisation over one source's counts of candidate sets; gives the best reading of each set."""
    sets = [list(f) for f in group["formats"]]
    likelihood = [list(w) for w in group["weights"]]
    counts = list(group["n"])
    formats = sorted({f for s in sets for f in s})
    pi = dict.fromkeys(formats, 1 / max(1, len(formats)))
    for _ in range(ROUNDS):
        got = dict.fromkeys(formats, PRIOR)
        for s, w, n in zip(sets, likelihood, counts, strict=True):
            p = [pi[f] * x for f, x in zip(s, w, strict=True)]
            whole = sum(p)
            for f, x in zip(s, p, strict=True):
                got[f] += n * x / whole
        total = sum(got.values())
        new = {f: x / total for f, x in got.items()}
        moved = max(abs(new[f] - pi[f]) for f in formats)
        pi = new
        if moved < 1e-9:
            break
    best, sure = [], []
    for s, w in zip(sets, likelihood, strict=True):
        p = [pi[f] * x for f, x in zip(s, w, strict=True)]
        k = max(range(len(p)), key=lambda i: (p[i], -i))
        best.append(k)
        sure.append(p[k] / sum(p))
    return group[["source", "formats", "weights"]].assign(best=best, posterior=sure)


def resolve_timestamps(analyzed: DataFrame, sites: DataFrame, certain: float = 0.9) -> DataFrame:
    """One row per ``doc_ix``: ``doc_ix, format, posterior, status, utc_text``.

    ``status`` is 'resolved', 'ambiguous' (no reading reaches the posterior ``certain`` and the readings differ),
    'no_zone' (a local time without a zone in the text or of the site) or 'no_date' (null, empty or impossible dates);
    ``utc_text`` is null for all but the first. Zone information in the text counts before the site's. A site that
    declares its order of day and month decides where both are possible; other sources, among them the rows without a
    site, by their mixture. Rows delivered again count once; a site listed twice counts by its smallest row.
    """
    rows = spread(analyzed.select("doc_ix", F.struct(F.col("doc_fields.doc_date").alias("text"), "site_id").alias("r")), "doc_ix").groupBy("doc_ix").agg(F.min("r").alias("r")).select("doc_ix", "r.*")
    rows = rows.filter("doc_ix is not null")
    at = sites.groupBy("site_id").agg(F.min(F.struct("zone_name", "day_first")).alias("s")).select("site_id", "s.*")
    joined = rows.join(at, "site_id", "left").select("doc_ix", "text", "zone_name", "day_first", F.col("site_id").alias("source"))
    parsed = cut(joined.mapInPandas(_parse, _PARSED))
    counts = parsed.filter(F.size("formats") > 1).groupBy("source", "formats", "weights").agg(F.count("*").alias("n"))
    # sure texts tell about the mixture as well
    sure = parsed.filter(F.size("formats") == 1).groupBy("source", "formats").agg(F.count("*").alias("n")).select("source", "formats", F.array(F.lit(1.0)).alias("weights"), "n")
    fitted = counts.unionByName(sure).groupBy("source").applyInPandas(_fit, "source string, formats array<string>, weights array<double>, best int, posterior double")
    fitted = cut(fitted).filter(F.size("formats") > 1)
    many = parsed.filter(F.size("formats") > 1).alias("p")
    chosen = many.join(fitted.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")) & (F.col("p.formats") == F.col("f.formats")) & (F.col("p.weights") == F.col("f.weights"))).select(
        "p.doc_ix", F.col("p.formats")[F.col("best")].alias("format"), "posterior", (F.size(F.array_distinct("p.instants")) > 1).alias("differ"), F.col("p.instants")[F.col("best")].alias("utc")
    )
    one = parsed.filter(F.size("formats") <= 1).select(
        "doc_ix", F.try_element_at("formats", F.lit(1)).alias("format"), F.when(F.size("formats") == 1, 1.0).alias("posterior"), F.lit(False).alias("differ"), F.try_element_at("instants", F.lit(1)).alias("utc")
    )
    every = one.unionByName(chosen)
    status = (
        F.when(F.col("format").isNull(), "no_date")
        .when(F.col("differ") & (F.col("posterior") < certain), "ambiguous")
        .when(F.col("utc").isNull(), "no_zone")
        .otherwise("resolved")
    )
    return every.withColumn("status", status).select("doc_ix", "format", "posterior", "status", F.when(F.col("status") == "resolved", F.col("utc")).alias("utc_text"))


def instants(analyzed: DataFrame, sites: DataFrame) -> DataFrame:
    """``(doc_ix, utc_text)`` of the documents whose date gives an instant."""
    return resolve_timestamps(analyzed, sites).filter("status = 'resolved'").select("doc_ix", "utc_text")
