"""Rubric checks of letters; each gives an array of at most one issue (check, severity, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery import fixed
from folioquery.functions import dates, names, text
from folioquery.functions.columns import once
from folioquery.operators.first_match import is_cover_letter, required_sections, rubric_name

ISSUES = "array<struct<check:string,severity:string,message:string>>"


def issue(condition: Column, check: str, severity: str, message: Column) -> Column:
    """[issue] where the condition holds, else []."""
    one = F.array(F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message")))
    return F.when(F.coalesce(condition, F.lit(False)), one).otherwise(F.array().cast(ISSUES))


def prepare(letters: DataFrame) -> DataFrame:
    """Adds header, body, rubric and what the header says, once for all checks."""
    content = F.col("content")
    rows = once(letters, header=F.when(~text.blank(content), text.first_line(content)), body=text.body(F.coalesce(content, F.lit(""))), rubric=rubric_name(F.coalesce("subcategory", F.array().cast("array<string>"))))
    rows = once(rows, header_date=text.header_date(F.col("header")), header_provider=text.header_provider(F.col("header")))
    same = dates.dates_match(F.col("date"), F.col("header_date"))
    return once(rows, same_date=same, name_expected=names.plain_name(names.without_recipient(F.col("provider"))), name_found=names.plain_name(F.col("header_provider")))


def header_format() -> Column:
    h = F.col("header")
    shown = F.substring(h, 1, 81)
    cover = is_cover_letter(F.col("rubric"))
    bad = F.when(cover, ~text.contains_any_case(h, "Cover Letter")).otherwise(~h.rlike(fixed.HEADER_SHAPE))
    what = (
        F.when(cover, "Cover letter header missing 'Cover Letter' label: ")
        .when(~h.startswith("#"), "Header missing # heading prefix: ")
        .when(~h.contains("{.underline}"), "Header missing {.underline} markup: ")
        .otherwise("Header missing bracket structure [...]{.underline}: ")
    )
    return issue(h.isNotNull() & bad, "header_format", "warning", F.concat(what, shown))


def date_consistency() -> Column:
    expected, found = F.col("date"), F.col("header_date")
    known = ~text.blank(expected) & (F.lower(text.strip(expected)) != "unknown") & (found != "Unknown")
    return issue(known & ~F.col("same_date"), "date_consistency", "error", F.concat(F.lit("Header date '"), found, F.lit("' does not match expected '"), expected, F.lit("'")))


def provider_consistency() -> Column:
    expected, found = F.col("provider"), F.col("header_provider")
    a, b = F.col("name_expected"), F.col("name_found")
    same = (a == b) | (names.last_name(a) == names.last_name(b))
    other_kind = names.likely_organisation(expected) & names.has_credential(found)
    return issue(~text.blank(expected) & found.isNotNull() & ~other_kind & ~same, "provider_consistency", "warning", F.concat(F.lit("Header provider '"), found, F.lit("' does not match expected '"), expected, F.lit("'")))


def empty_content() -> Column:
    n = F.coalesce("page_count", F.lit(0))
    return issue(text.blank(F.col("content")) & (n > 1), "empty_content", "error", F.concat(F.lit("Empty summary for "), n.cast("string"), F.lit("-page letter")))


def sections() -> Column:
    terms = F.create_map(*[x for name, words in fixed.SECTION_NAMES.items() for x in (F.lit(name), F.array(*map(F.lit, words)))])
    missing = F.filter(required_sections(F.col("rubric")), lambda s: ~F.exists(F.coalesce(F.try_element_at(terms, s), F.array(s)), lambda t: text.contains_any_case(F.col("body"), t)))
    return issue(~text.blank(F.col("content")) & (F.size(missing) > 0), "required_sections", "warning", F.concat(F.lit("Missing expected sections: "), F.array_join(missing, ", ")))


def content_length() -> Column:
    n, size = F.coalesce("page_count", F.lit(0)), F.length(text.strip(F.col("body")))
    least = n * fixed.CHARS_PER_PAGE
    message = F.concat(F.lit("Summary body is "), size.cast("string"), F.lit(" chars for "), n.cast("string"), F.lit(" pages (expected >= "), least.cast("string"), F.lit(")"))
    return issue((n > 2) & ~text.blank(F.col("content")) & (size < least), "content_length", "warning", message)


CHECKS = {
    "header_format": header_format,
    "date_consistency": date_consistency,
    "provider_consistency": provider_consistency,
    "empty_content": empty_content,
    "required_sections": sections,
    "content_length": content_length,
}


def score(letters: DataFrame) -> DataFrame:
    """Letters with issues (in the order of the checks), errors, warnings and passed (no error)."""
    out = once(prepare(letters), issues=F.concat(*[CHECKS[c]() for c in fixed.SCORE_CHECKS]))
    return counted(out).withColumn("passed", F.col("errors") == 0)


def counted(rows: DataFrame) -> DataFrame:
    """Adds errors and warnings from issues."""
    n = {name: F.size(F.filter("issues", _of(severity))).alias(name) for name, severity in (("errors", "error"), ("warnings", "warning"))}
    return rows.select("*", *n.values())


def _of(severity: str):
    return lambda i: i["severity"] == severity


def scorecard(scored: DataFrame) -> DataFrame:
    """One row: letters scored, passed (neither error nor warning), flagged, and all errors and warnings."""
    fine = (F.col("errors") == 0) & (F.col("warnings") == 0)
    return scored.agg(F.count("*").alias("letters_scored"), F.count_if(fine).alias("passed"), F.count_if(~fine).alias("flagged"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))


def by_check(scored: DataFrame) -> DataFrame:
    """Letters passed and failed per check; a letter counts once per check; no letters give no rows."""
    failed = F.array_distinct(F.transform("issues", lambda i: i["check"]))
    rows = scored.select(F.explode(F.array(*map(F.lit, fixed.SCORE_CHECKS))).alias("check"), failed.alias("failed"))
    bad = F.array_contains("failed", F.col("check"))
    return rows.groupBy("check").agg(F.count_if(~bad).alias("passed"), F.count_if(bad).alias("failed"))


def score_report(scored: DataFrame, errors_only: bool = False, short: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The scorecard and the flagged letters: those with errors only if asked, none in the short form."""
    flagged = scored.filter("errors > 0" if errors_only else "errors + warnings > 0")
    return scorecard(scored), None if short else flagged
