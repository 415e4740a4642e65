"""Writers of reports. Ordered reports keep their order over the files; JSON documents are for bounded results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery import fixed

#: Rows that one JSON document may hold.
MOST_ROWS = 100_000


def write_csv(report: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header. An ordered report is written in ranges, file after file in its order; ``files=1`` makes it one file."""
    (report.coalesce(files) if files else report).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str, files: int | None = None) -> None:
    (rows.coalesce(files) if files else rows).write.mode("overwrite").json(path)


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for one JSON document; write_json takes any number")
    return rows


def one_json(rows: DataFrame, most: int = MOST_ROWS) -> str:
    """A bounded result (a scorecard, a summary) as pretty JSON text; an error beyond ``most`` rows."""
    packed = _bounded(rows, most).agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"pretty": "true"}).alias("j"))
    return packed.first()["j"]


def write_reconciliation(same: DataFrame, yours_only: DataFrame, theirs_only: DataFrame, path: str, most: int = MOST_ROWS) -> None:
    """The document of three lists that ``readers.reconciliation`` reads; an error beyond ``most`` entries of a list."""
    entry = ("date", "pages", "header")
    lists = {"yours_only": (yours_only, entry), "theirs_only": (theirs_only, entry), "same_dates": (same, ("date", "your_pages", "their_pages", "your_header", "their_header"))}
    out = None
    for name, (rows, columns) in lists.items():
        order = ["ordinal"] if "ordinal" in rows.columns else []
        entry_of = F.struct(*columns).alias("e")
        packed = F.sort_array(F.collect_list(F.struct(*order, entry_of)))
        part = _bounded(rows, most).agg(F.transform(packed, lambda x: x["e"]).alias(name))
        out = part if out is None else out.crossJoin(part)  # one row each
    out.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def page_map_json(mapping: DataFrame) -> DataFrame:
    """doc_id and its logical to physical pages as a JSON object."""
    entry = F.array_sort(F.collect_list(F.struct("logical", "physical")))
    pairs = F.map_from_entries(F.transform(entry, lambda e: F.struct(e["logical"].cast("string"), e["physical"])))
    return mapping.groupBy("doc_id").agg(F.to_json(pairs).alias("mapping"))


def write_page_texts(texts: DataFrame, path: str) -> None:
    """The page text cache, one folder a side."""
    texts.write.mode("overwrite").partitionBy("side").parquet(path)


def header_report(matched: DataFrame, yours: DataFrame, theirs: DataFrame) -> DataFrame:
    """MATCH, YOURS ONLY and THEIRS ONLY rows with date and both headers."""
    none = F.lit(None).cast("string")
    return (
        matched.select(F.lit("MATCH").alias("status"), "date", F.col("your_full_header").alias("your_header"), F.col("their_full_header").alias("their_header"))
        .unionByName(yours.select(F.lit("YOURS ONLY").alias("status"), F.col("normalized_date").alias("date"), F.col("full_header").alias("your_header"), none.alias("their_header")))
        .unionByName(theirs.select(F.lit("THEIRS ONLY").alias("status"), F.col("normalized_date").alias("date"), none.alias("your_header"), F.col("full_header").alias("their_header")))
        .orderBy("date", "status", "your_header", "their_header")
    )


def write_qa(findings: DataFrame, path: str) -> None:
    from folioquery.operators.review_checks import qa_rows

    write_csv(qa_rows(findings).select(*fixed.QA_COLUMNS), path, files=1)
