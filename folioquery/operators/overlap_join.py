"""Joins of index entries by date and shared pages, and what is left on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.functions.columns import once
from folioquery.functions.pages import page_runs


def with_pages(entries: DataFrame) -> DataFrame:
    return entries.filter(F.size("pages") > 0)


#: Entries of a date up to which it is one group; of a page of a larger date up to which the page is.
DATE_ENTRIES, PAGE_ENTRIES = 200, 20_000
#: Dates and pages treated as large, the largest first; they are broadcast.
LARGEST = 10_000


def _largest(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Keys with more than ``most`` rows and the number of parts to split them in."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > most)
    return F.broadcast(counted.orderBy(F.desc("rows")).limit(LARGEST).select(*keys, F.ceil(F.col("rows") / most).cast("int").alias("parts")))


def interval_rows(entries: DataFrame, large: DataFrame) -> DataFrame:
    """Entries (date, pages) with lo and hi: a row a run of pages in the date's one group, or a row a page, its group, for dates in ``large``.

    ``first`` marks the rows where a run begins; ``whole`` is the run of an entry that has one only.
    """
    rows = entries.join(large.select("date", F.lit(True).alias("large")), "date", "left")
    rows = once(rows, runs=page_runs(F.col("pages")))
    single = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["lo"], r["hi"]), lambda p: F.struct(p.alias("lo"), p.alias("hi"), (p == r["lo"]).alias("first")))))
    run = F.transform("runs", lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), F.lit(True).alias("first")))
    rows = rows.select(*entries.columns, "large", F.when(F.size("runs") == 1, F.get("runs", 0)).alias("whole"), F.inline(F.when(F.col("large"), single).otherwise(run)))
    return rows.withColumn("group", F.when(F.col("large"), F.col("lo").cast("long"))).drop("large")


def _side(entries: DataFrame, large: DataFrame) -> DataFrame:
    """Interval rows whose pages are left out where ``whole`` says them; group -1, which is no page, is that of a date that is not large."""
    rows = interval_rows(entries, large).withColumn("group", F.coalesce("group", F.lit(-1)))
    said = F.col("pages") == F.sequence(F.col("whole.lo"), F.col("whole.hi"))
    return rows.withColumn("pages", F.when(F.col("whole").isNull() | ~said, F.col("pages")))


def run_pairs(yours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs of runs of entries of equal date that overlap, one row each.

    Entries have entry_id, date, pages and header. Pages are intervals: an entry is a row
    for each run of its pages, and the entries of a date meet by overlap. A date of more
    than DATE_ENTRIES entries (UNKNOWN, say) is not one group: its entries meet page by page,
    and a page of very many entries is split, yours dealt, theirs copied. Two runs that overlap
    begin to do so where one of them begins, so a page of one meets only the beginnings of the
    other and two runs are one row, not one a page.
    """
    y = with_pages(yours).select("date", F.col("entry_id").alias("your_id"), "pages", F.col("header").alias("your_header"))
    t = with_pages(theirs).select("date", F.col("entry_id").alias("their_id"), "pages", F.col("header").alias("their_header"))
    large = _largest(y.select("date").unionByName(t.select("date")), ["date"], DATE_ENTRIES)
    # runs cost far more than the entries, which few small files may hold: they are dealt out first
    mine, other = _side(y.repartition("your_id"), large), _side(t.repartition("their_id"), large)
    split = _largest(mine.select("date", "group").filter("group <> -1"), ["date", "group"], PAGE_ENTRIES)
    parts = F.coalesce("parts", F.lit(1))
    # turn 0: every page of mine and the first ones of theirs; turn 1: the first ones of mine and the other pages of theirs
    mine = mine.withColumn("turn", F.explode(F.when(F.col("first") & (F.col("group") != -1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    other = other.withColumn("turn", F.when(F.col("first"), 0).otherwise(1))
    mine = mine.join(split, ["date", "group"], "left").withColumn("part", F.pmod(F.xxhash64("your_id"), parts).cast("int")).drop("parts", "first")
    other = other.join(split, ["date", "group"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts", "first")
    mine, other = mine.withColumnRenamed("pages", "your_pages"), other.withColumnsRenamed({"pages": "their_pages", "lo": "their_lo", "hi": "their_hi", "whole": "their_whole"})
    return mine.join(other, ["date", "group", "part", "turn"]).filter("lo <= their_hi and their_lo <= hi")


def same_dates(yours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs with equal date and a common page; a pair of entries of several runs is kept where its first common page lies."""
    met = run_pairs(yours, theirs)
    listed = {c: F.coalesce(c, F.sequence(F.col(w)["lo"], F.col(w)["hi"])) for c, w in (("your_pages", "whole"), ("their_pages", "their_whole"))}
    first = F.array_min(F.array_intersect(*listed.values()))
    kept = met.filter((F.col("whole").isNotNull() & F.col("their_whole").isNotNull()) | first.between(F.greatest("lo", "their_lo"), F.least("hi", "their_hi")))
    return kept.select("date", "your_id", listed["your_pages"].alias("your_pages"), "your_header", "their_id", listed["their_pages"].alias("their_pages"), "their_header")


def only(entries: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Entries with pages whose id is not among the matched pairs."""
    return with_pages(entries).join(matched.select(F.col(key).alias("entry_id")).distinct(), "entry_id", "left_anti")


def reconcile(yours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """same_dates, yours_only and theirs_only."""
    same = same_dates(yours, theirs)
    return same, only(yours, same, "your_id"), only(theirs, same, "their_id")


def date_mismatches(yours_only: DataFrame, theirs_only: DataFrame, matched_page: str = "match_page") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of yours whose matched page lies in an entry of theirs, and the rest of both sides."""
    pages = theirs_only.select(F.col("entry_id").alias("their_id"), F.col("date").alias("their_date"), F.col("pages").alias("their_pages"), F.col("header").alias("their_header"), F.explode(F.array_distinct("pages")).alias(matched_page))
    merged = yours_only.join(pages, matched_page)
    rest_yours = yours_only.join(merged.select("entry_id").distinct(), "entry_id", "left_anti")
    rest_theirs = theirs_only.join(merged.select(F.col("their_id").alias("entry_id")).distinct(), "entry_id", "left_anti")
    return merged, rest_yours, rest_theirs


def by_date(yours: DataFrame, theirs: DataFrame, date: str = "normalized_date") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All pairs with equal date, and the rows whose date the other side lacks."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(date).alias("date"), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != date])

    matched = side(yours, "your").join(side(theirs, "their"), "date")
    return matched, yours.join(theirs.select(date).distinct(), date, "left_anti"), theirs.join(yours.select(date).distinct(), date, "left_anti")
