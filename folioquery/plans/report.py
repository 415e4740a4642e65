"""Page matching and the discrepancy report (one declarative plan from maps, texts and a reconciliation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery import fixed
from folioquery.functions import similarity
from folioquery.functions.text import blank
from folioquery.operators import first_match

OTHER = {"yours": "theirs", "theirs": "yours"}


def fingerprints(mapping: DataFrame, texts: DataFrame) -> DataFrame:
    """side, logical and fingerprint (null without text) of every mapped page; each text is read once."""
    known = texts.filter(~blank(F.col("text"))).select("side", "physical", similarity.fingerprint(F.col("text")).alias("print"))
    return mapping.select("side", "logical", "physical").join(known, ["side", "physical"], "left").select("side", "logical", "print")


def match_states(entries: DataFrame, prints: DataFrame, side: str) -> DataFrame:
    """Each page of each entry with its state and score against the same logical page of the other side.

    States in order: not_in_document (unmapped), none (own page has no text),
    not_in_toc (the other side lacks the page or its text), scored.
    """
    pages = entries.select("entry_id", F.posexplode("pages").alias("at", "page"))
    own = prints.filter(F.col("side") == side).select(F.col("logical").alias("page"), F.lit(True).alias("mapped"), F.col("print").alias("a"))
    other = prints.filter(F.col("side") == OTHER[side]).select(F.col("logical").alias("page"), F.col("print").alias("b"))
    rows = pages.join(own, "page", "left").join(other, "page", "left")
    state = F.when(F.col("mapped").isNull(), "not_in_document").when(F.col("a").isNull(), "none").when(F.col("b").isNull(), "not_in_toc").otherwise("scored")
    return rows.select("entry_id", "at", "page", state.alias("state"), F.when(state == "scored", similarity.similarity(F.col("a"), F.col("b"))).alias("score"))


def best_pages(entries: DataFrame, prints: DataFrame, side: str) -> DataFrame:
    """Per entry the state of its first page, and the best page with its score, the first among equals."""
    states = match_states(entries, prints, side)
    best = F.max_by(F.struct("page", "score"), F.when(F.col("state") == "scored", F.struct(F.col("score"), -F.col("at")))).alias("m")
    return states.groupBy("entry_id").agg(F.min_by("state", "at").alias("first_state"), best).select("entry_id", "first_state", F.col("m.page").alias("match_page"), F.col("m.score").alias("score"))


def _listed(pages: Column) -> Column:
    return F.array_join(pages.cast("array<string>"), ", ")


def _order(rows: DataFrame, *columns: str) -> Column:
    """What decides which entry is the first: the parsers' ordinal, else the named columns."""
    return F.struct(*[c for c in (("ordinal",) if "ordinal" in rows.columns else columns)])


def _one_sided(entries: DataFrame, other: DataFrame, same: DataFrame, prints: DataFrame, side: str) -> DataFrame:
    """Report rows of the entries that only one side has, with what the other side says of the matched page."""
    yours = side == "yours"
    status = "YOURS ONLY" if yours else "THEIRS ONLY"
    rows = entries.join(best_pages(entries, prints, side), "entry_id")
    if yours:
        rows = rows.filter(~(_filtered(F.col("header")) & F.col("first_state").isin("none", "not_in_toc")))
    gated = F.col("first_state").isin("not_in_document", "not_in_toc")
    page = F.when(~gated, F.col("match_page"))
    other_side = "their" if yours else "your"
    same_pages = same.select(F.col("date"), F.col(f"{other_side}_pages").alias("pages"), F.col(f"{other_side}_header").alias("header"), _order(same, "your_pages", "their_pages", "date", "your_header", "their_header").alias("ordinal"))
    looked = first_match.look_up(rows.withColumn("match_page", page), "match_page", (other.select("date", "pages", "header", _order(other, "pages", "date", "header", "entry_id").alias("ordinal")), "header"), (same_pages, "header"))
    confidence = F.when(F.col("first_state") == "not_in_document", fixed.NOT_IN_DOCUMENT[side]).when(F.col("first_state") == "not_in_toc", fixed.NOT_IN_INDEX[side]).otherwise(F.coalesce(similarity.report_confidence(F.col("score")), F.lit(fixed.NO_MATCH)))
    act = F.when(F.col("first_state") == "not_in_document", fixed.NOT_IN_DOCUMENT_ACTION[side]).when(gated, fixed.REVIEW_ACTION).otherwise(similarity.action(F.lit(status), confidence, F.coalesce(F.col("match_page").cast("string"), F.lit(fixed.NO_VALUE))))
    mine = {"date": F.col("date"), "pages": _listed(F.col("pages")), "header": F.col("header")}
    found = {"date": F.col("entry_date"), "pages": F.coalesce(F.col("match_page").cast("string"), F.lit(fixed.NO_VALUE)), "header": F.col("entry_header")}
    y, t = (mine, found) if yours else (found, mine)
    return looked.select(
        "entry_id", F.lit(status).alias("status"), y["date"].alias("your_date"), t["date"].alias("their_date"), y["pages"].alias("your_pages"), t["pages"].alias("their_match_pages"),
        confidence.alias("match_confidence"), y["header"].alias("your_header"), t["header"].alias("their_header"), act.alias("action"), F.col("date").alias("date"), "pages", "header", "match_page",
        F.coalesce(F.array_min("pages"), F.lit(999_999)).alias("sort"),
    )


def _filtered(header: Column) -> Column:
    return F.coalesce(header.contains("[FILTERED]"), F.lit(False))


def discrepancies(same: DataFrame, yours_only: DataFrame, theirs_only: DataFrame, mapping: DataFrame, texts: DataFrame) -> DataFrame:
    """The nine report columns, in order of the first page.

    Entries that only one side has are matched by content; where yours points
    at a page of an entry of theirs, both become one row with differing dates.
    Where several entries hold a page the first counts, by ``ordinal`` if the
    entries have it, else by pages, date and header.
    """
    prints = fingerprints(mapping, texts)
    yours = _one_sided(yours_only, theirs_only, same, prints, "yours")
    theirs = _one_sided(theirs_only, yours_only, same, prints, "theirs")
    page = theirs.select(F.col("entry_id").alias("their_id"), F.col("date").alias("found_date"), F.col("header").alias("found_header"), _listed(F.col("pages")).alias("found_pages"), F.explode(F.array_distinct("pages")).alias("match_page"))
    pairs = yours.join(page, "match_page")
    mismatch = pairs.select(F.lit("DATE MISMATCH").alias("status"), "your_date", F.col("found_date").alias("their_date"), "your_pages", F.col("found_pages").alias("their_match_pages"), "match_confidence", "your_header", F.col("found_header").alias("their_header"), F.lit(fixed.MISMATCH_ACTION).alias("action"), "sort")
    rest_yours = yours.join(pairs.select("entry_id").distinct(), "entry_id", "left_anti")
    rest_theirs = theirs.join(pairs.select(F.col("their_id").alias("entry_id")).distinct(), "entry_id", "left_anti")
    equal = same.select(
        F.lit("SAME DATE").alias("status"), F.col("date").alias("your_date"), F.col("date").alias("their_date"), _listed(F.col("your_pages")).alias("your_pages"), _listed(F.col("their_pages")).alias("their_match_pages"),
        F.lit("EXACT DATE MATCH").alias("match_confidence"), "your_header", "their_header", F.lit("").alias("action"), F.coalesce(F.array_min("your_pages"), F.lit(999_999)).alias("sort"),
    )
    columns = [*fixed.REPORT_COLUMNS, "sort"]
    return mismatch.select(*columns).unionByName(rest_yours.select(*columns)).unionByName(rest_theirs.select(*columns)).unionByName(equal.select(*columns)).orderBy("sort", *fixed.REPORT_COLUMNS).select(*fixed.REPORT_COLUMNS)
