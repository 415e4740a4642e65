"""First matches: the entry that holds a page, the rubric of a subcategory, the best score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery import fixed


def entry_of_page(entries: DataFrame) -> DataFrame:
    """page and the fields of the first entry (by ``ordinal``) that holds it."""
    fields = [c for c in entries.columns if c not in ("pages", "ordinal")]
    rows = entries.select(F.explode(F.array_distinct("pages")).alias("page"), "ordinal", F.struct(*fields).alias("e"))
    return rows.groupBy("page").agg(F.min_by("e", "ordinal").alias("e")).select("page", "e.*")


def look_up(rows: DataFrame, page: str, *indexes: tuple[DataFrame, str]) -> DataFrame:
    """Adds entry_date and entry_header from the first index that holds the page, else the no-value mark."""
    out, dates, headers = rows, [], []
    for k, (entries, header) in enumerate(indexes):
        found = entry_of_page(entries).select(F.col("page").alias(page), F.col("date").alias(f"_date{k}"), F.col(header).alias(f"_header{k}"))
        out = out.join(found, page, "left")
        dates.append(F.col(f"_date{k}"))
        headers.append(F.col(f"_header{k}"))
    out = out.withColumn("entry_date", F.coalesce(*dates, F.lit(fixed.NO_VALUE))).withColumn("entry_header", F.coalesce(*headers, F.lit(fixed.NO_VALUE)))
    return out.drop(*[f"_date{k}" for k in range(len(indexes))], *[f"_header{k}" for k in range(len(indexes))])


def rubric_name(subcategories: Column) -> Column:
    """The rubric's subcategory: the first exact one, else by the first subcategory with an alias in it, aliases in order; null for the default."""
    exact = F.get(F.filter(subcategories, lambda s: s.isin(*fixed.RUBRICS)), 0)

    def alias(s: Column) -> Column:
        return reduce(lambda out, pair: out.when(s.contains(pair[0]), pair[1]), fixed.ALIASES[1:], F.when(s.contains(fixed.ALIASES[0][0]), fixed.ALIASES[0][1]))

    by_alias = F.get(F.filter(F.transform(subcategories, alias), lambda x: x.isNotNull()), 0)
    return F.coalesce(exact, by_alias)


def required_sections(rubric: Column) -> Column:
    table = F.create_map(*[x for name, (_, sections) in fixed.RUBRICS.items() for x in (F.lit(name), F.array(*map(F.lit, sections)).cast("array<string>"))])
    return F.coalesce(F.try_element_at(table, rubric), F.array(*map(F.lit, fixed.DEFAULT_RUBRIC[1])))


def is_cover_letter(rubric: Column) -> Column:
    covers = [name for name, (shape, _) in fixed.RUBRICS.items() if shape == "cover_letter"]
    return F.coalesce(rubric.isin(*covers), F.lit(False))


def best(rows: DataFrame, key: str, value: str, score: str, order: str) -> DataFrame:
    """Per key the value with the highest score, the first in order among equals, and that score."""
    top = F.max_by(F.struct(value, score), F.struct(F.col(score), -F.col(order))).alias("m")
    return rows.groupBy(key).agg(top).select(key, F.col(f"m.{value}").alias(value), F.col(f"m.{score}").alias(score))


def top(rows: DataFrame, key: str | None, score: str, order: str, k: int = fixed.TOP_CANDIDATES) -> DataFrame:
    """The k rows with the highest scores, of each key if there is one."""
    if key is None:
        return rows.orderBy(F.desc(score), order).limit(k)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def latest_success(runs: DataFrame, key: str) -> DataFrame:
    """Per key the succeeded run that finished last; a missing time is before all others."""
    done = runs.filter(F.col("status") == "SUCCEEDED")
    return done.groupBy(key).agg(F.max_by("id", F.struct(F.coalesce("finished", F.lit("")), "id")).alias("id"))
