"""Logical to physical pages, from links and from what lies between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquery.fixed import LINK_RANGE as RANGE


def link_pages(links: DataFrame) -> DataFrame:
    """doc_id, ordinal, logical, last (of a declared range) and physical of every readable link.

    A link names a page, a range, an open range, or a list; a list of several
    pages is left out.
    """
    t = F.regexp_replace("link_text", r"^\s+|\s+$", "")
    listed = F.filter(F.transform(F.split(t, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike(r"^\d+$"))
    one = F.when(t.rlike(r"^\d+$"), t).when(t.rlike(r"^\d+\s*[-,]$"), F.regexp_extract(t, r"^(\d+)", 1)).when(t.contains(",") & (F.size(listed) == 1), F.get(listed, 0))
    logical = F.when(t.rlike(RANGE), F.regexp_extract(t, RANGE, 1)).otherwise(one)
    last = F.when(t.rlike(RANGE), F.regexp_extract(t, RANGE, 2))
    rows = links.select("doc_id", "ordinal", logical.try_cast("int").alias("logical"), last.try_cast("int").alias("last"), F.col("dest_page").alias("physical"))
    return rows.filter("logical is not null and physical > 0")


def declared(pages: DataFrame) -> DataFrame:
    """Pages inside declared ranges whose end is linked at the same distance."""
    linked = pages.groupBy("doc_id", "logical").agg(F.max_by("physical", "ordinal").alias("physical"))
    start = pages.filter("last is not null").groupBy("doc_id", "logical").agg(F.max_by(F.struct("last", "physical"), "ordinal").alias("r")).select("doc_id", F.col("logical").alias("lo"), F.col("r.last").alias("hi"), F.col("r.physical").alias("at"))
    ends = linked.select("doc_id", F.col("logical").alias("hi"), F.col("physical").alias("to"))
    spans = start.join(ends, ["doc_id", "hi"]).filter("hi - lo = to - at and hi > lo")
    between = F.explode(F.sequence(F.col("lo"), F.col("hi")))
    return spans.select("doc_id", "lo", "at", between.alias("logical")).select("doc_id", "logical", (F.col("at") + F.col("logical") - F.col("lo")).alias("physical"), F.col("lo").alias("ordinal"))


def fill_gaps(mapping: DataFrame) -> DataFrame:
    """With the pages between neighbours that lie equally far apart in both countings."""
    w = Window.partitionBy("doc_id").orderBy("logical")
    near = mapping.select("doc_id", "logical", "physical", F.lead("logical").over(w).alias("l2"), F.lead("physical").over(w).alias("p2"))
    gaps = near.filter("l2 - logical > 1 and l2 - logical = p2 - physical")
    between = F.explode(F.sequence(F.col("logical") + 1, F.col("l2") - 1)).alias("page")
    filled = gaps.select("doc_id", between, "logical", "physical").select("doc_id", F.col("page").alias("logical"), (F.col("physical") + F.col("page") - F.col("logical")).alias("physical"))
    return mapping.select("doc_id", "logical", "physical").unionByName(filled)


def build_page_map(links: DataFrame) -> DataFrame:
    """doc_id, logical, physical: the last link of a page counts, declared ranges overwrite it, gaps are filled."""
    pages = link_pages(links)
    known = pages.select("doc_id", "logical", "physical", F.lit(0).alias("rank"), "ordinal").unionByName(declared(pages).select("doc_id", "logical", "physical", F.lit(1).alias("rank"), "ordinal"))
    return fill_gaps(known.groupBy("doc_id", "logical").agg(F.max_by("physical", F.struct("rank", "ordinal")).alias("physical")))


def to_physical(rows: DataFrame, mapping: DataFrame, page: str = "logical") -> DataFrame:
    """Rows (side, page) with their physical page, null where there is none."""
    return rows.join(mapping.select("side", F.col("logical").alias(page), "physical"), ["side", page], "left")


def stamped_page(texts: DataFrame, number: int) -> DataFrame:
    """The first physical page whose first stamp carries the number."""
    from folioquery.fixed import PAGE_STAMP

    stamp = F.regexp_extract("text", PAGE_STAMP, 1)
    return texts.filter(stamp == str(number)).agg(F.min("physical").alias("physical"))
