"""Pages of one side against all pages of a side, and pages with the entries that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery import fixed
from folioquery.functions import similarity
from folioquery.operators import first_match, page_search


def candidates(ones: DataFrame, texts: DataFrame) -> DataFrame:
    """physical (of ``texts``), score, verdict and rank of the best pages for every page of ``ones``, whose number is ``one``."""
    found = page_search.best_pages(ones, texts, "physical", fixed.SEARCH_SCORE, fixed.TOP_CANDIDATES)
    return found.withColumnRenamed("page", "physical").withColumn("verdict", similarity.pair_confidence(F.col("score"))).orderBy("one", "rank")


def duplicates(ones: DataFrame, texts: DataFrame) -> DataFrame:
    """Other pages (physical) of the same side that repeat a page of ``ones`` (one), with their score."""
    return page_search.pages_above(ones, texts, "physical", fixed.DUPLICATE_SCORE).withColumnRenamed("page", "physical").orderBy("one", "physical")


def indexed(pages: DataFrame, mapping: DataFrame, entries: DataFrame) -> DataFrame:
    """Physical pages with the first entry that holds their logical page, null where none does."""
    logical = mapping.select("physical", F.col("logical").alias("page"))
    found = first_match.entry_of_page(entries)
    return pages.join(logical, "physical", "left").join(found, "page", "left")
