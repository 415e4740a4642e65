"""Dates as text: every function takes and returns string columns, with UNKNOWN as a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery.fixed import MONTHS, UNKNOWN, UNKNOWN_DATE

MONTH_CLASS = "|".join(m.capitalize() for m in MONTHS)


def _date(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("date")


def _slash_date(text: Column) -> Column:
    """A failed parse costs far more than a look at the shape, so each text is parsed in one form only."""
    return F.when(text.rlike(r"/\d\d$"), _date(text, "M/d/yy")).when(text.rlike(r"/\d{4,}$"), _date(text, "M/d/yyyy"))


def us_date(text: Column) -> Column:
    """M/D/Y as ISO text; two-digit years are 20xx; anything else UNKNOWN."""
    return F.coalesce(F.date_format(_slash_date(text), "yyyy-MM-dd"), F.lit(UNKNOWN))


def month_number(name: Column) -> Column:
    """Number of a full month name in any case, else null."""
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(table, F.lower(name))


def date_cell(text: Column) -> Column:
    """A table cell: unknown or undated, M/D/Y, ISO as it stands, or a written month."""
    us = F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{2,4})", 1)
    iso = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    written = rf"(?i)({MONTH_CLASS})\s+(\d{{1,2}}),?\s+(\d{{4}})"
    parts = F.concat_ws("/", month_number(F.regexp_extract(text, written, 1)).cast("string"), F.regexp_extract(text, written, 2), F.regexp_extract(text, written, 3))
    return (
        F.when(text.rlike("(?i)unknown|undated"), UNKNOWN)
        .when(us != "", us_date(us))
        .when(iso != "", iso)
        .when(text.rlike(written), us_date(parts))
        .otherwise(UNKNOWN)
    )


def any_date(text: Column) -> Column:
    """A DATE from ISO, M/D/Y, or a month's full or short name with day and year; else null.

    The list of forms is closed; slash dates are always month first.
    """
    plain = F.regexp_replace(F.trim(text), r"[,.]", "")
    squeezed = F.regexp_replace(plain, r"\s+", " ")
    short = F.when(squeezed.rlike(r"^\pL{3} "), _date(squeezed, "MMM d yyyy"))
    return F.when(squeezed.rlike(r"^\d+/"), _slash_date(squeezed)).when(squeezed.rlike(r"^[+-]?\d+-"), _date(squeezed, "yyyy-MM-dd")).when(squeezed.rlike(r"^\pL"), F.coalesce(short, F.when(squeezed.rlike(r"^\pL{3,} "), _date(squeezed, "MMMM d yyyy"))))


def section_date(text: Column) -> Column:
    """ISO text of a section's date, or UNKNOWN."""
    return F.when(text == UNKNOWN_DATE, UNKNOWN).otherwise(F.coalesce(F.date_format(any_date(text), "yyyy-MM-dd"), F.lit(UNKNOWN)))


def plain_date(text: Column) -> Column:
    """A date's text as it is compared where it is no date: without commas and case."""
    return F.lower(F.trim(F.regexp_replace(text, ",", "")))


def same_day(a: Column, b: Column) -> Column:
    """Equal days or equal plain texts, of structs with day and plain."""
    return F.coalesce(a["day"] == b["day"], F.lit(False)) | F.coalesce(a["plain"] == b["plain"], F.lit(False))


def dates_match(a: Column, b: Column) -> Column:
    """Equal as dates, or, where either is no date, equal without commas and case."""
    return F.coalesce(any_date(a) == any_date(b), F.lit(False)) | F.coalesce(plain_date(a) == plain_date(b), F.lit(False))


def day_and_plain(text: Column) -> Column:
    """What ``same_day`` compares, read once."""
    return F.struct(any_date(text).alias("day"), plain_date(text).alias("plain"))
