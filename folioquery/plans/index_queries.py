"""Contract queries of the index and section parsers, page maps, prompts and the report.

Lines, links and page texts are written from structured columns; the SQL says
from the same columns what must be read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators import index_parsers, page_map
from folioquery.plans import derived, report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def joined(pages: Column) -> Column:
    return F.array_join(pages.cast("array<string>"), ",")


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _clerk() -> Column:
    return _text("Clerk ", F.col("o_orderkey") % 1000)


def _documents(rows: DataFrame, key: str, order: str, lines: Column) -> DataFrame:
    """A text a key, the rows' lines in order."""
    packed = rows.groupBy(F.col(key).alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), lines.alias("t")))).alias("p"))
    return packed.select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))


_LONG = [f"part {w} of a long report by" for w in ("one", "two", "three", "four", "five", "six")]

_ORDERS = """o AS (SELECT o_orderkey AS k, o_custkey AS doc_id, o_orderkey % 6 AS v, CAST(o_orderkey % 97 + 1 AS INTEGER) AS a, CAST(o_orderdate AS DATE) AS d, 'Clerk ' || o_orderkey % 1000 AS clerk FROM orders)"""


@query(f"""WITH {_ORDERS}, e AS (SELECT *, CASE v WHEN 0 THEN 'Report of ' || clerk WHEN 1 THEN 'Visit, ' || clerk || ' 3/4 pages' WHEN 2 THEN 'No date given' WHEN 3 THEN 'Split pages' WHEN 4 THEN 'Smith glued report'
  ELSE '{" ".join(f"{p} " + "' || clerk || '" for p in _LONG[:5])}' END AS h FROM o)
SELECT doc_id, CASE v WHEN 2 THEN 'UNKNOWN' WHEN 1 THEN '20' || strftime(d, '%y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END AS date,
  CASE v WHEN 2 THEN 'Undated' WHEN 1 THEN strftime(d, '%-m/%-d/%y') ELSE strftime(d, '%-m/%-d/%Y') END AS date_str,
  CASE v WHEN 0 THEN a || ',' || (a + 1) || ',' || (a + 2) || ',' || (a + 200) WHEN 3 THEN a || ',' || (a + 5) WHEN 4 THEN a || ',' || (a + 3) ELSE CAST(a AS VARCHAR) END AS pages,
  CASE WHEN length(h) <= 150 THEN h ELSE regexp_extract(substr(h, 1, 150), '^(.*) ', 1) END AS header FROM e""")
def vendor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of six shapes, one text a customer."""
    k, clerk = F.col("o_orderkey"), _clerk()
    a, us, v = k % 97 + 1, F.date_format("o_orderdate", "M/d/yyyy"), k % 6
    lines = (
        F.when(v == 0, _lines(us, _text(a, "-", a + 2, ", ", a + 200, ", 777"), _text("Report of ", clerk)))
        .when(v == 1, _lines(F.date_format("o_orderdate", "M/d/yy"), a.cast("string"), "", _text("Visit, ", clerk, " 3/4 pages")))
        .when(v == 2, _lines("Undated", a.cast("string"), "No date given"))
        .when(v == 3, _lines(us, _text(a, ","), (a + 5).cast("string"), "Split pages"))
        .when(v == 4, _lines(us, _text(a, ",", a + 3, "Smith glued report")))
        .otherwise(_lines(us, a.cast("string"), *[_text(p, " ", clerk) for p in _LONG]))
    )
    texts = _documents(derived.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", lines)
    return index_parsers.vendor_index(texts).select("doc_id", "date", "date_str", joined(F.col("pages")).alias("pages"), "header")


@query(f"""WITH {_ORDERS} SELECT doc_id, CASE v WHEN 5 THEN 'UNKNOWN' ELSE strftime(d, '%Y-%m-%d') END AS date,
  CASE v WHEN 5 THEN 'Unknown' WHEN 2 THEN strftime(d, '%m/%d/%Y') ELSE strftime(d, '%-m/%-d/%Y') END AS date_str,
  CASE v WHEN 3 THEN a || ',' || (a + 7) ELSE a || ',' || (a + 1) END AS pages, 'Report of ' || clerk AS header FROM o""")
def own_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose dates stand in each of the six shapes."""
    k, d, rule = F.col("o_orderkey"), F.col("o_orderdate"), "+------+------+------+------+"
    a, v, month = k % 97 + 1, k % 6, F.date_format("o_orderdate", "MMMM")
    rest = _text(" | x | Report of ", _clerk(), " | ", a, "-", a + 1, " |")
    empty = " | | | |"
    short = F.length(month) < 6
    lines = (
        F.when(v == 0, _lines(_text("| ", F.date_format(d, "MMMM d, yyyy"), rest)))
        .when(v == 1, _lines(_text("| ", F.when(short, F.substring(month, 1, 5)).otherwise(F.substring(month, 1, 4)), rest), _text("| ", F.when(short, "").otherwise(F.substring(month, 5, 9)), empty), _text("| ", F.date_format(d, "d"), ",", empty), _text("| ", F.date_format(d, "yyyy"), empty)))
        .when(v == 2, _lines(_text("| ", F.date_format(d, "yyyy"), "-", rest), _text("| ", F.date_format(d, "MM-dd"), empty)))
        .when(v == 3, _lines(_text("| ", F.date_format(d, "M/d"), " | x | Report of ", _clerk(), " | ", a, " |"), _text("| /", F.date_format(d, "yyyy"), " | | | ", a + 7, " |")))
        .when(v == 4, _lines(_text("| ", F.date_format(d, "M"), "/", rest), _text("| ", F.date_format(d, "d"), empty), _text("| /", F.date_format(d, "yyyy"), empty)))
        .otherwise(_lines(_text("| unknown", rest)))
    )
    texts = _documents(derived.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", _lines(lines, rule))
    return index_parsers.own_index(texts).select("doc_id", "date", "date_str", joined(F.col("pages")).alias("pages"), "header")


@query(f"""WITH {_ORDERS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) * 2 AS line FROM o)
SELECT doc_id, CAST(line AS INTEGER) AS line_number, CASE v WHEN 0 THEN 'Unknown Date' WHEN 1 THEN strftime(d, '%B %-d, %Y') WHEN 2 THEN strftime(d, '%B %-d, %Y') WHEN 3 THEN strftime(d, '%-m/%-d/%Y') ELSE 'Undated note' END AS date_str,
  CASE v WHEN 4 THEN 'by ' || clerk ELSE 'Report, ' || clerk END AS title, CASE v WHEN 1 THEN strftime(d, '%Y-%m-%d') WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN strftime(d, '%Y-%m-%d') ELSE 'UNKNOWN' END AS normalized_date FROM n WHERE v < 5""")
def own_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked header lines in five forms, between lines that are none."""
    k, d, clerk = F.col("o_orderkey"), F.col("o_orderdate"), _clerk()
    v, title = k % 6, _text("Report, ", clerk)
    head = (
        F.when(v == 0, _text("Unknown Date, ", title)).when(v == 1, _text(F.date_format(d, "MMMM d, yyyy"), ", ", title)).when(v == 2, _text(F.date_format(d, "MMMM d, yyyy"), "  ", title))
        .when(v == 3, _text(F.date_format(d, "M/d/yyyy"), ", ", title)).when(v == 4, _text("Undated note, by ", clerk)).otherwise("Category: none")
    )
    texts = _documents(derived.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", _lines("text between", _text("§ ", head)))
    return index_parsers.own_sections(texts).select("doc_id", "line_number", "date_str", "title", "normalized_date")


@query(f"""WITH {_ORDERS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) * 3 - 2 AS line FROM o)
SELECT doc_id, CAST(line AS INTEGER) AS line_number, strftime(d, '%-m/%-d/%Y') AS date_str, CASE v % 3 WHEN 0 THEN 'Clinic ' || clerk || ', Smith, MD, Report' WHEN 1 THEN 'Cover letter to counsel' ELSE 'Report of ' || clerk END AS title,
  strftime(d, '%Y-%m-%d') AS normalized_date FROM n""")
def vendor_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with the date below, cover letters, and headers with the date in line."""
    k, us, clerk = F.col("o_orderkey"), F.date_format("o_orderdate", "M/d/yyyy"), _clerk()
    v = k % 6 % 3
    lines = F.when(v == 0, _lines(_text("Clinic ", clerk, ", Smith, MD, Report,"), us, "")).when(v == 1, _lines(_text("Cover letter to counsel, dated ", us, "."), "", "")).otherwise(_lines(_text("Report of ", clerk, ", ", us), "plain text", ""))
    texts = _documents(derived.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", lines)
    return index_parsers.vendor_sections(texts).select("doc_id", "line_number", "date_str", "title", "normalized_date")


@query("""WITH p AS (SELECT p_partkey AS doc_id, CAST(p_size AS INTEGER) AS lo, CAST(p_size + 4 + p_partkey % 5 AS INTEGER) AS hi, CAST(p_partkey % 11 + 1 AS INTEGER) AS off, p_partkey % 3 AS v FROM part)
SELECT doc_id, x AS logical, x + off AS physical FROM (SELECT *, CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS x FROM p WHERE v = 0)
UNION ALL SELECT doc_id, lo, lo + off FROM p WHERE v > 0 UNION ALL SELECT doc_id, hi, hi + off + 2 FROM p WHERE v > 0
UNION ALL SELECT doc_id, hi + 10, hi + 1 FROM p WHERE v = 2""")
def page_map_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared ranges whose end fits and whose end does not, an open range, and links that name no page."""
    k = F.col("p_partkey")
    lo, off, v = F.col("p_size"), k % 11 + 1, k % 3
    hi = lo + 4 + k % 5
    link = lambda n, text, dest: F.struct(F.lit(n).alias("ordinal"), text.alias("link_text"), dest.cast("int").alias("dest_page"))
    links = F.array(
        link(0, _text(lo, " - ", hi), lo + off), link(1, _text(" ", hi, F.when(v == 1, ",").otherwise("")), hi + off + F.when(v > 0, 2).otherwise(0)),
        link(2, _text(lo, ", ", hi), F.lit(1)), link(3, F.lit("see appendix"), F.lit(2)), link(4, F.when(v == 2, _text(hi + 10, " -")).otherwise("-"), hi + 1), link(5, _text(lo), F.lit(0)),
    )
    rows = derived.table(spark, sf_dir, "part").select(k.alias("doc_id"), F.inline(links))
    return page_map.build_page_map(rows).select("doc_id", F.col("logical").cast("int").alias("logical"), F.col("physical").cast("int").alias("physical"))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions of summary steps: labels indented, doubled, on a line of their own, in other order and in other case."""
    k, us = F.col("o_orderkey"), F.date_format("o_orderdate", "M/d/yyyy")
    dates = (
        F.when(k % 7 == 0, _text("Encounter Date: 1/1/1990\nDate: ", us, " ")).when(k % 7 == 1, _text("  Date: 1/1/1990\nLetter Date:\n ", us)).when(k % 7 == 2, _text("Letter Date: 1/1/1990\nEncounter Date: ", us))
        .when(k % 7 == 3, _text("Date:\n\n", us)).when(k % 7 == 4, _text("the Date: ", us)).otherwise(_text("Date: ", us, "\nDate: 1/1/1990"))
    )
    prompt = _lines(
        "Summarise. Date: none", dates, F.when(k % 3 > 0, _text("Provider: ", _clerk())).otherwise("no Provider: x"), "Sub-category: Letter ", "  Sub-category:Letter",
        F.when(k % 2 == 0, "Sub-category:\n Claims").otherwise(""), _text("- Page: ", k % 97), _text("-  PAGE:", k % 97 + 1), _text("- Page: ", k % 97), "see - Page: 5", F.when(k % 4 > 0, _text("Pages in document:\t", k % 7 + 1)).otherwise("pages in document: 3"),
    )
    output = F.when(k % 5 == 0, " raw output\n").when(k % 5 == 1, "<content>open").otherwise("x <content>\n the summary </content> y")
    return derived.table(spark, sf_dir, "orders").select(k.alias("iteration"), F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("SUCCEEDED").alias("status"), prompt.alias("prompt"), output.alias("output"))


_PROMPTS = """l AS (SELECT o_orderkey AS k, strftime(CAST(o_orderdate AS DATE), '%-m/%-d/%Y') AS us, CASE WHEN o_orderkey % 3 > 0 THEN 'Clerk ' || o_orderkey % 1000 END AS provider,
 'Letter' || CASE WHEN o_orderkey % 2 = 0 THEN ',Claims' ELSE '' END AS subcategory FROM orders WHERE o_orderstatus <> 'P')"""


@query(f"""WITH {_PROMPTS} SELECT k AS "index", CASE WHEN k % 7 <> 4 THEN us END AS date, provider, subcategory, (k % 97) || ',' || (k % 97 + 1) || ',' || (k % 97) AS pages,
 CASE k % 5 WHEN 0 THEN ' raw output' || chr(10) WHEN 1 THEN '<content>open' ELSE 'x <content>' || chr(10) || ' the summary </content> y' END AS content,
 CAST(3 AS INTEGER) AS page_count, CAST(CASE WHEN k % 4 > 0 THEN k % 7 + 1 ELSE 1 END AS INTEGER) AS pages_in_document FROM l""")
def legacy_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters for review, read back from the prompts of summary steps, with the number of their page lines and the one that they declare."""
    out = index_parsers.legacy_letters(_prompts(spark, sf_dir), index_parsers.pages_in_document(F.col("prompt")).alias("pages_in_document"))
    return out.select("index", "date", "provider", F.array_join("subcategory", ",").alias("subcategory"), joined(F.col("pages")).alias("pages"), "content", F.size("pages").alias("page_count"), "pages_in_document")


@query(f"""WITH {_PROMPTS} SELECT k AS "index", CASE WHEN k % 7 IN (0, 3, 5, 6) THEN us END AS date, provider, subcategory, CAST(CASE WHEN k % 4 > 0 THEN k % 7 + 1 ELSE 1 END AS INTEGER) AS page_count,
 CASE k % 5 WHEN 0 THEN ' raw output' || chr(10) WHEN 1 THEN '<content>open' ELSE 'the summary' END AS content FROM l""")
def legacy_scored_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same prompts as the scorer reads them."""
    out = index_parsers.legacy_scored_letters(_prompts(spark, sf_dir))
    return out.select("index", "date", "provider", F.array_join("subcategory", ",").alias("subcategory"), "page_count", "content")


@query("""WITH p AS (SELECT CAST(p_partkey AS INTEGER) AS p, p_partkey % 9 AS v, p_brand AS h, '2020-01-0' || (p_partkey % 9 + 1) AS d FROM part)
SELECT CASE WHEN v IN (0, 1, 3, 8) THEN 'YOURS ONLY' WHEN v = 2 THEN 'DATE MISMATCH' WHEN v = 6 THEN 'SAME DATE' ELSE 'THEIRS ONLY' END AS status,
 CASE WHEN v IN (4, 5, 7) THEN '—' ELSE d END AS your_date, CASE v WHEN 2 THEN '2021-12-31' WHEN 6 THEN d WHEN 4 THEN d WHEN 5 THEN d WHEN 7 THEN d ELSE '—' END AS their_date,
 CASE v WHEN 4 THEN '—' WHEN 5 THEN CAST(p AS VARCHAR) WHEN 7 THEN '—' ELSE CAST(p AS VARCHAR) END AS your_pages,
 CASE v WHEN 0 THEN '—' WHEN 1 THEN '—' WHEN 8 THEN '—' ELSE CAST(p AS VARCHAR) END AS their_match_pages,
 CASE v WHEN 0 THEN 'NOT IN YOUR DOCUMENT' WHEN 1 THEN 'NOT IN THEIR TOC' WHEN 2 THEN 'STRONG (150%)' WHEN 3 THEN 'STRONG (150%)' WHEN 4 THEN 'PAGE NOT FOUND IN THEIR PDF' WHEN 5 THEN 'NO MATCH' WHEN 6 THEN 'EXACT DATE MATCH' WHEN 7 THEN 'NOT IN YOUR TOC' ELSE 'NO MATCH' END AS match_confidence,
 CASE WHEN v IN (4, 5, 7) THEN '—' ELSE h END AS your_header, CASE WHEN v IN (0, 1, 3, 8) THEN '—' WHEN v = 2 THEN 'other ' || h ELSE h END AS their_header,
 CASE v WHEN 0 THEN 'Page not found in your PDF TOC' WHEN 1 THEN 'MANUAL REVIEW NEEDED' WHEN 2 THEN 'VERIFY CORRECT DATE - Check header text for actual date' WHEN 3 THEN 'VERIFY MATCH - CHECK THEIR PAGE ' || p
  WHEN 4 THEN 'Page listed in their TOC but doesn''t exist in their PDF file' WHEN 5 THEN 'MISSING FROM YOURS' WHEN 6 THEN '' WHEN 7 THEN 'MANUAL REVIEW NEEDED' ELSE 'MISSING FROM VENDOR' END AS action FROM p""")
def discrepancy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry a part, in each state that a page can be in."""
    k = F.col("p_partkey")
    parts = derived.table(spark, sf_dir, "part").select(
        k.cast("int").alias("page"), (k % 9).alias("v"), F.col("p_brand").alias("header"), _text("2020-01-0", k % 9 + 1).alias("date"), F.array(k.cast("int")).alias("pages"), _text(k).alias("entry_id"), k.alias("ordinal"),
    )
    entry = ("entry_id", "date", "pages", "header", "ordinal")
    yours = parts.filter("v in (0, 1, 2, 3, 8)").select(*entry)
    late = parts.withColumn("date", F.when(F.col("v") == 2, "2021-12-31").otherwise(F.col("date"))).withColumn("header", F.when(F.col("v") == 2, _text("other ", F.col("header"))).otherwise(F.col("header")))
    theirs = late.filter("v in (2, 4, 5, 7)").select(*entry)
    same = parts.filter("v = 6").select("date", F.col("pages").alias("your_pages"), F.col("pages").alias("their_pages"), F.col("header").alias("your_header"), F.col("header").alias("their_header"), "ordinal")
    sides = parts.withColumn("side", F.explode(F.array(F.lit("yours"), F.lit("theirs")))).withColumn("mine", F.col("side") == "yours")
    there = sides.filter("not (mine and v in (0, 7)) and not (not mine and v in (1, 4))")
    mapping = there.select("side", F.col("page").alias("logical"), (F.col("page") + 100).alias("physical"))
    said = F.when((F.col("v") == 8) & F.col("mine"), F.lit(" ")).when((F.col("v") == 5) & ~F.col("mine"), _text("other words here")).otherwise("alpha beta gamma")
    return report.discrepancies(same, yours, theirs, mapping, there.select("side", (F.col("page") + 100).alias("physical"), said.alias("text")))
