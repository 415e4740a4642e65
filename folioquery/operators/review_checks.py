"""Checks of letters against the extracts of their pages, as rows (index, check, severity, message).

Extracts meet the pages of their letters once; what they say is read there, and one
aggregation by letter gathers it, so that a letter's body, date and provider are read
once a letter and all checks are arrays of issues of one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery import fixed
from folioquery.functions import dates, text
from folioquery.functions.columns import once
from folioquery.functions.pages import page_ranges
from folioquery.functions.results import field_text, parse_result
from folioquery.operators.letter_checks import counted, issue
from folioquery.operators.token_join import redundant_letters

CHECKS = ("dos_verification", "content_coverage", "provider_availability")


def _rows(df: DataFrame, check: str, severity: str, message: Column) -> DataFrame:
    return df.select("index", F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message"))


def _quoted(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _issue(check: str, severity: str, *message) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), _quoted(*message).alias("message"))


def clinical(rows: DataFrame, result: str, source: str) -> DataFrame:
    """Adds ``clinical``: names and phrases of the clinical fields of a VARIANT whose value is a long text.

    ``source`` is the JSON text of the VARIANT. Most fields are absent or short, so the text must
    have the name (or an escape, which may write it), a value is read once and its length looked at first.
    """
    rows = once(rows, escaped=F.coalesce(F.contains(source, F.lit("\\")), F.lit(True)))
    named = lambda f: F.col("escaped") | F.contains(source, F.lit(f'"{f}"'))
    rows = once(rows, values=F.array(*[F.when(named(f), field_text(F.col(result), f)) for f in fixed.CLINICAL_FIELDS]))

    def long_text(i: int, name: str) -> Column:
        value = F.get("values", F.lit(i))
        is_text = F.schema_of_variant(F.try_variant_get(result, f"$.{name}", "variant")) == "STRING"
        said = F.when(is_text & (F.length(text.strip(value)) > fixed.CLINICAL_CHARS), F.struct(F.lit(name).alias("name"), F.lower(value).alias("said")))
        return F.when(F.coalesce(F.length(value), F.lit(0)) > fixed.CLINICAL_CHARS, said)

    rows = once(rows, texts=F.array(*[long_text(i, f) for i, f in enumerate(fixed.CLINICAL_FIELDS)]))
    read = F.transform(F.filter("texts", lambda t: t.isNotNull()), lambda t: F.struct(t["name"].alias("name"), text.phrases(t["said"]).alias("phrases")))
    return rows.withColumn("clinical", F.filter(read, lambda f: F.size(f["phrases"]) > 0)).drop("escaped", "values", "texts")


def page_facts(letters: DataFrame, extracts: DataFrame, checks: Sequence[str] = CHECKS) -> DataFrame:
    """What the extracts of a letter's pages say, a row a letter.

    Pages count from one, iterations from zero; run_id joins too where both have it. The
    join decides by size; what is read from results and prompts is read behind it, for
    the pages that letters have.
    """
    run = ["run_id"] if "run_id" in letters.columns and "run_id" in extracts.columns else []
    token = F.lower(F.get(F.split("provider", r"[,\s]+"), 0))
    pages = letters.select(*run, "index", token.alias("token"), F.explode(F.array_distinct("pages")).alias("page"))
    own = extracts.select(*run, (F.col("iteration") + 1).alias("page"), "result", "prompt")
    # parsing costs far more than the rows, which few small files may hold: they are dealt out by letter, as they are grouped below
    rows = pages.join(own, [*run, "page"]).repartition(*run, "index")
    rows = once(rows, r=parse_result(F.col("result")), source=text.tagged_or_all(F.coalesce("prompt", F.lit("")), "processed_content")).drop("prompt")
    said, of = [], [*run, "index"]
    if "dos_verification" in checks:
        rows = once(rows, found=text.strip(field_text(F.col("r"), "date")), label=text.labelled_date(F.col("source")))
        real = (F.col("found") != "") & (F.lower("found") != "unknown")
        rows = once(rows, found=F.when(real, F.col("found")), found_as=F.when(real, dates.day_and_plain(F.col("found"))), label_as=F.when(F.col("label").isNotNull(), dates.day_and_plain(F.col("label"))))
        said += ["found", "found_as", "label", "label_as"]
    if "content_coverage" in checks:
        rows = clinical(rows, "r", "result")
        said.append("clinical")
    flags = []
    if "provider_availability" in checks:
        rows = rows.withColumns({"names": F.coalesce(text.provider_present(field_text(F.col("r"), "provider")), F.lit(False)), "sees": F.coalesce(F.contains(F.lower("source"), F.col("token")), F.lit(False))})
        flags = [F.bool_or("names").alias("named"), F.bool_or("sees").alias("seen")]
    facts = F.sort_array(F.collect_list("facts")).alias("facts")
    return rows.select(*of, *[f for f in ("names", "sees") if flags], F.struct("page", *said).alias("facts")).groupBy(*of).agg(facts, *flags)


def _dates(check: str) -> Column:
    """Dates of extracts, and labelled dates of the source text, against the letter's date."""
    unknown, said, own = F.col("unknown"), F.col("said"), F.col("date_as")

    def of_page(f: Column) -> Column:
        at = f["page"].cast("string")
        differs = f["found"].isNotNull() & ~unknown & ~dates.same_day(own, f["found_as"])
        return F.when(f["found"].isNotNull() & unknown, _issue(check, "error", "Letter has unknown date but Extract Info found '", f["found"], "' on page ", at)).when(
            differs, _issue(check, "error", "Extract Info date '", f["found"], "' differs from letter date '", said, "' on page ", at)
        )

    def least(f: Column) -> Column:
        return F.array_min(F.transform(f, lambda x: F.struct(x["page"], x["label"], x["label_as"])))

    every = F.col("facts")
    labelled = F.get(F.transform(F.array(F.struct(least(F.filter(every, lambda f: f["label"].isNotNull())).alias("any"), least(every).alias("first"))), lambda x: F.when(unknown, x["any"]).otherwise(x["first"])), 0)
    none_found = ~F.exists(every, lambda f: f["found"].isNotNull())

    def of_label(x: Column) -> Column:
        at = x["page"].cast("string")
        return F.when(unknown & none_found & x["label"].isNotNull(), _issue(check, "error", "Letter has unknown date but source text contains '", x["label"], "' on page ", at)).when(
            ~unknown & x["label"].isNotNull() & ~dates.same_day(own, x["label_as"]), _issue(check, "warning", "Source text has DOS '", x["label"], "' that differs from letter date '", said, "' on page ", at)
        )

    return F.array_compact(F.concat(F.array_distinct(F.transform(every, of_page)), F.transform(F.array(labelled), of_label)))


def _coverage(check: str) -> Column:
    """Clinical fields of a page none of whose phrases stands in the letter's body, in the order of the fixed list."""
    body = F.col("body")

    def of_page(f: Column) -> Column:
        unsaid = F.transform(F.filter(f["clinical"], lambda c: ~F.exists(c["phrases"], lambda p: F.contains(body, p))), lambda c: c["name"])
        return F.struct(f["page"].cast("string").alias("at"), F.array_join(unsaid, ", ").alias("fields"))

    pages = F.filter(F.transform("facts", of_page), lambda p: p["fields"] != "")
    return F.when(body.isNotNull(), F.transform(pages, lambda p: _issue(check, "warning", "Content from page ", p["at"], " not reflected in summary: ", p["fields"])))


def _provider(check: str) -> Column:
    """A letter without provider whose pages have none either, or a provider that no page mentions."""
    named, seen = (F.coalesce(c, F.lit(False)) for c in ("named", "seen"))
    return F.concat(
        issue(~F.col("present") & ~named, check, "info", F.lit("No provider name available for review")),
        issue(F.col("present") & ~seen, check, "info", _quoted("Provider '", F.col("provider"), "' not found in source page text")),
    )


def checked(letters: DataFrame, extracts: DataFrame, checks: Sequence[str] = CHECKS) -> DataFrame:
    """Letters with ``issues``: those of the named checks, of one grouped pass over the extracts."""
    run = ["run_id"] if "run_id" in letters.columns and "run_id" in extracts.columns else []
    facts = page_facts(letters, extracts, checks)
    rows = letters.join(facts, [*run, "index"], "left")
    read, arrays = {}, []
    if "dos_verification" in checks:
        read |= {"unknown": F.lower(text.strip(F.coalesce("date", F.lit("")))).isin("unknown", ""), "said": text.strip(F.col("date")), "date_as": dates.day_and_plain(F.col("date"))}
        arrays.append(_dates("dos_verification"))
    if "content_coverage" in checks:
        read["body"] = F.when(~text.blank(F.col("content")), F.lower(text.body(F.col("content"))))
        arrays.append(_coverage("content_coverage"))
    if "provider_availability" in checks:
        read["present"] = F.coalesce(text.provider_present(F.col("provider")), F.lit(False))
        arrays.append(_provider("provider_availability"))
    none = F.array().cast("array<struct<check:string,severity:string,message:string>>")
    return once(once(rows, **read), issues=F.concat(*[F.coalesce(a, none) for a in arrays])).select(*letters.columns, "issues")


def issue_rows(letters: DataFrame, extracts: DataFrame, checks: Sequence[str] = CHECKS) -> DataFrame:
    """index, check, severity and message of every issue of the named checks."""
    return checked(letters, extracts, checks).select("index", F.inline("issues"))


def redundancy(letters: DataFrame) -> DataFrame:
    """A warning for each letter of a redundant pair, which names the other's pages and provider."""
    pairs = redundant_letters(letters)
    both = pairs.select(F.col("a").alias("index"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("index"), F.col("a").alias("other")))
    named = letters.select(F.col("index").alias("other"), page_ranges(F.array_distinct("pages")).alias("range"), F.coalesce("provider", F.lit("Unknown")).alias("who"))
    return _rows(both.join(named, "other"), "redundancy", "warning", _quoted("Similar to letter at pages ", F.col("range"), " (", F.col("who"), ")"))


def _category(letters: DataFrame) -> Column:
    """The first subcategory, else the first category, else nothing."""
    named = [F.get(c, 0) for c in ("subcategory", "category") if c in letters.columns]
    return F.coalesce(*named, F.lit(""))


def review(letters: DataFrame, extracts: DataFrame) -> DataFrame:
    """Findings: letters with issues, and what they count to.

    A letter flagged for redundancy only shows neither date, provider, pages
    nor category.
    """
    similar = redundancy(letters).groupBy("index").agg(F.collect_list(F.struct("check", "severity", "message")).alias("similar"))
    rows = checked(letters, extracts).join(similar, "index", "left").withColumn("own", F.size("issues") > 0)
    every = F.array_sort(F.concat("issues", F.coalesce("similar", F.array().cast("array<struct<check:string,severity:string,message:string>>"))))
    shown = {"date": F.col("date"), "provider": F.col("provider"), "category": _category(letters), "pages": page_ranges(F.array_distinct("pages")), "page_count": F.size(F.coalesce("pages", F.array()))}
    # sorted once a row: the filter, the counts and the result read them
    rows = once(rows.filter(F.col("own") | F.col("similar").isNotNull()), issues=every)
    return counted(rows.select("index", *[F.when(F.col("own"), c).alias(n) for n, c in shown.items()], "issues"))


def summary(findings: DataFrame, letters: DataFrame) -> DataFrame:
    """One row: letters, clean and flagged ones, errors and warnings."""
    n = findings.agg(F.count("*").alias("flagged"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))
    return letters.agg(F.count("*").alias("letters")).crossJoin(n).select("letters", (F.col("letters") - F.col("flagged")).alias("clean"), "flagged", "errors", "warnings")


def by_check(findings: DataFrame) -> DataFrame:
    """Issues, errors and warnings per check."""
    rows = findings.select(F.explode("issues").alias("i")).select("i.*")
    return rows.groupBy("check").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def qa_rows(findings: DataFrame, *more: str) -> DataFrame:
    """The seven report columns and ``more``: FAIL with an error, else WARN; the time stays blank."""
    notes = F.array_join(F.transform("issues", lambda i: i["message"]), "; ")
    return findings.select("provider", "pages", "category", F.col("date").alias("dos"), notes.alias("notes"), F.when(F.col("errors") > 0, "FAIL").otherwise("WARN").alias("status"), F.lit("").alias("minutes"), *more)
