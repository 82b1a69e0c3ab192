"""Field extractors as Column builders: (field, collapsed text, lines) -> value or null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.config import FieldSpec
from docsift.functions import regexes as R
from docsift.functions.text import empty_to_null, from_first, holds, let, utf16_length

Extractor = Callable[[FieldSpec, Column, Column], Column]


def _null() -> Column:
    return F.lit(None).cast("string")


def labeled_id(field: FieldSpec, text_c: Column, lines: Column, low: Column | None = None) -> Column:
    """The id after the first label, in the order of the configuration, that is followed by one; in upper case. ``low`` is
    the text in lower case, where a column has it already."""
    low = F.lower(text_c) if low is None else low
    # the first of all hits is null where there is none; a test for '' would match twice
    found = lambda label: F.try_element_at(F.regexp_extract_all(from_first(text_c, low, label), F.lit(R.labeled_id(label)), F.lit(1)), F.lit(1))
    hits = [F.when(holds(low, label), F.upper(found(label))) for label in field.labels]
    return F.coalesce(*hits) if hits else _null()


def amount_labeled(labels: tuple[str, ...], lines: Column) -> Column:
    """The amount after a label; the last line wins, and in a line the last label of the configuration."""
    if not labels:
        return _null()

    def hit(line: Column) -> Column:
        low = F.lower(line)
        return F.coalesce(*(F.when(holds(low, label), empty_to_null(F.regexp_extract(line, R.labeled_amount(label), 1))) for label in reversed(labels)))

    return F.try_element_at(F.filter(F.transform(lines, hit), lambda x: x.isNotNull()), F.lit(-1))


def amount_fallback(lines: Column) -> Column:
    """The largest amount-shaped number anywhere, as printed; the first of equals."""
    found = F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(R.any_amount()), F.lit(1))))
    ranked = F.transform(found, lambda m, i: F.struct(F.replace(m, F.lit(","), F.lit("")).cast("double").alias("v"), (-i).alias("i"), m.alias("m")))
    return F.array_max(ranked)["m"]


def amount(field: FieldSpec, text_c: Column, lines: Column) -> Column:
    return F.coalesce(amount_labeled(field.labels, lines), amount_fallback(lines))


def _any_date(text: Column) -> Column:
    return F.coalesce(*(empty_to_null(F.regexp_extract(text, p, 1)) for p in R.dates()))


def date_labeled(labels: tuple[str, ...], lines: Column) -> Column:
    """The date in the first line that holds any label and any date."""
    if not labels:
        return _null()
    label = "(?i)(?:" + "|".join(R.phrase(x) for x in labels) + ")"
    digit = lambda line: line.rlike("[0-9]")
    return F.try_element_at(F.filter(F.transform(lines, lambda line: F.when(digit(line) & line.rlike(label), _any_date(line))), lambda x: x.isNotNull()), F.lit(1))


def date_fallback(lines: Column) -> Column:
    """The first numeric date of the whole text, else the first with a month's name; these may go over a line end."""
    return _any_date(F.array_join(lines, "\n"))


def date(field: FieldSpec, text_c: Column, lines: Column) -> Column:
    return F.coalesce(date_labeled(field.labels, lines), date_fallback(lines))


def _clean_company(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[,;:]\s*\z", ""))


def company(field: FieldSpec, text_c: Column, lines: Column) -> Column:
    """Of the top 15 lines the first with a corporate suffix, else the first that could be a title."""
    top = F.slice(lines, 1, 15)
    never = R.words(R.NOT_COMPANY)
    by_suffix = F.filter(top, lambda line: line.rlike(R.words(R.COMPANY_SUFFIX)) & ~line.rlike(never))
    digits = lambda line: F.length(F.regexp_replace(line, "[^0-9]", ""))
    by_title = F.filter(
        top,
        lambda line: ~line.rlike(never) & (utf16_length(line) >= 4) & (utf16_length(line) <= 60) & (digits(line) / utf16_length(line) < 0.3) & line.rlike("[A-Za-z]"),
    )
    return F.coalesce(_clean_company(F.try_element_at(by_suffix, F.lit(1))), _clean_company(F.try_element_at(by_title, F.lit(1))))


def address_line_score(line: Column) -> Column:
    """How much a line looks like part of an address."""
    yes = lambda c, n: F.when(c, n).otherwise(0)
    return (
        yes(line.rlike(R.words(R.ADDRESS_HINT)), 2)
        + yes(line.rlike(R.POSTAL), 2)
        + yes(line.contains(","), 1)
        - yes(line.rlike(R.words(R.NOT_COMPANY)), 3)
        - yes(line.rlike(R.words(R.COMPANY_SUFFIX)), 3)
        - yes(line.rlike(R.KEY_VALUE), 4)
    )


def address(field: FieldSpec, text_c: Column, lines: Column) -> Column:
    """The window of one to four of the top 25 lines with the highest sum of scores, from 2 on; the earliest, then shortest, of equals."""

    def best_window(top: Column, scores: Column) -> Column:
        n = F.size(top)
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        sums = lambda s, k: F.aggregate(F.slice(scores, s, k), F.lit(0), lambda a, x: a + x)
        return F.array_max(
            F.flatten(
                F.transform(
                    starts,
                    lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), n - s + 1)), lambda k: F.struct(sums(s, k).alias("score"), (-s).alias("s"), (-k).alias("k"))),
                )
            )
        )

    def value(top: Column) -> Column:
        best = let(F.transform(top, address_line_score), lambda scores: best_window(top, scores))
        return let(best, lambda w: F.when(w["score"] >= 2, F.array_join(F.slice(top, -w["s"], -w["k"]), ", ")))

    return let(F.slice(lines, 1, 25), value)


EXTRACTORS: dict[str, Extractor] = {"labeledId": labeled_id, "amount": amount, "date": date, "company": company, "address": address}


def register_extractor(name: str, build: Extractor) -> None:
    """Makes a further extractor known to configurations; ``build`` may also wrap a pandas UDF."""
    EXTRACTORS[name] = build


def run_extractor(field: FieldSpec, text_c: Column, lines: Column, low: Column | None = None) -> Column:
    """The value of a field; null for an extractor that isn't known. ``low`` is as in labeled_id()."""
    build = EXTRACTORS.get(field.extractor)
    if build is labeled_id:
        return build(field, text_c, lines, low)
    return build(field, text_c, lines) if build else _null()
