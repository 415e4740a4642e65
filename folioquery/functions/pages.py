"""Page lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_pages(text: Column) -> Column:
    """'1, 3-5' as sorted distinct integers; tokens that are no page or range, and ranges that run backwards, give none."""
    tokens = F.split(F.regexp_replace(text, r"\s*-\s*", "-"), ",")

    def pages(token: Column) -> Column:
        t = F.regexp_replace(token, r"^\s+|\s+$", "")
        low = F.regexp_extract(t, r"^(\d+)(?:-(\d+))?$", 1).try_cast("int")
        high = F.coalesce(F.regexp_extract(t, r"^(\d+)-(\d+)$", 2).try_cast("int"), low)
        none = F.array().cast("array<int>")
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(none)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, pages))))


def page_runs(pages: Column) -> Column:
    """Runs of neighbouring pages as structs lo and hi, in order."""

    def run(p: Column) -> Column:
        lows = F.filter(p, lambda x, i: (i == 0) | (x - F.get(p, i - 1) > 1))
        highs = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) - x > 1))
        return F.arrays_zip(lows.alias("lo"), highs.alias("hi"))

    ordered = F.array_sort(F.array_distinct(F.filter(pages, lambda x: x.isNotNull())))
    return F.get(F.transform(F.array(ordered), run), 0)


def page_ranges(pages: Column) -> Column:
    """Sorted integers as '1-3, 5': runs of neighbours become ranges."""
    empty = F.array().cast("array<struct<lo:int,hi:int>>")

    def step(runs: Column, page: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        alone = F.array(F.struct(page.alias("lo"), page.alias("hi")))
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["lo"].alias("lo"), page.alias("hi"))))
        return F.when(F.size(runs) == 0, alone).when(last["hi"] == page, runs).when(last["hi"] + 1 == page, longer).otherwise(F.concat(runs, alone))

    def text(run: Column) -> Column:
        return F.when(run["lo"] == run["hi"], run["lo"].cast("string")).otherwise(F.concat_ws("-", run["lo"].cast("string"), run["hi"].cast("string")))

    ordered = F.array_sort(pages.cast("array<int>"))
    return F.array_join(F.transform(F.aggregate(ordered, empty, step), text), ", ")
