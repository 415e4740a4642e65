"""Executions, entries, page texts and letters derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    status = F.when(k % 5 == 0, "FAILED").when(k % 5 == 1, "RUNNING").otherwise("SUCCEEDED")
    date = F.when(k % 4 == 0, "Unknown").when(k % 4 == 1, "2024-01-02").when(k % 4 == 3, "pending")
    result = F.when(k % 7 == 6, "{broken").otherwise(F.to_json(F.struct(date.alias("date"), (k % 3 == 0).alias("continuation"))))
    return e.select("event_id", "user_id", F.col("event_type").alias("step_name"), status.alias("status"), result.alias("result"))


def yours(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(day("o_orderdate").alias("date"), "o_custkey").agg(F.array_sort(F.collect_set("o_orderkey")).alias("pages"))
    return o.select(F.concat(F.lit("o"), "date", F.lit("-"), "o_custkey").alias("entry_id"), "date", "pages", F.lit("").alias("header"))


def theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(day("l_shipdate").alias("date"), "l_suppkey").agg(F.array_sort(F.collect_set("l_orderkey")).alias("pages"))
    return li.select(F.concat(F.lit("l"), "date", F.lit("-"), "l_suppkey").alias("entry_id"), "date", "pages", F.lit("").alias("header"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_orderdate", "c_name", "o_orderpriority")
    k, us = F.col("o_orderkey"), F.date_format("o_orderdate", "M/d/yyyy")
    other = F.concat(
        F.when(k % 3 == 0, us).when(k % 3 == 1, F.date_format("o_orderdate", "M/yyyy")).otherwise("1/1/1990"), F.lit(" "), "c_name",
        F.when(k % 4 == 0, "").otherwise(", MD "), F.when(k % 2 == 0, " office visit ").otherwise(" therapy "), "o_orderpriority",
    )
    return rows.select("o_orderkey", F.concat(us, F.lit("  "), "c_name", F.lit(", MD Office Visit "), "o_orderpriority").alias("yours"), other.alias("theirs"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    # the checks cost far more than the rows, which one small file holds: they are dealt out first
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("letter"), "o_orderdate", "c_name").repartition("letter")
    k, said, name = F.col("letter"), F.date_format("o_orderdate", "MMMM d, yyyy"), F.col("c_name")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    v = k % 8
    header = (
        F.when(v == 0, text("# [", said, ", Report - ", name, ", MD - Clinic]{.underline}"))
        .when(v == 1, text("[", said, ", Report - ", name, ", MD - Clinic]{.underline}"))
        .when(v == 2, text("# [", said, ", Report - ", name, ", MD - Clinic]"))
        .when(v == 3, "# Report{.underline}")
        .when(v == 5, text("# [January 1, 1980, Report - ", name, " - Clinic]{.underline}"))
        .when(v == 6, text("# [", said, ", Report - Other Person, MD - Clinic]{.underline}"))
        .when(v == 7, text("Cover Letter - ", name, " to Someone"))
    )
    body = F.when(k % 2 == 0, "Subjective: well. Impression: fine.").otherwise("Nothing here")
    sub = F.when(k % 3 == 0, F.array(F.lit("Letter"))).when(k % 3 == 2, F.array(F.lit("Cover Letters and Position Statements"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "letter", F.when(k % 11 == 0, "Unknown").otherwise(day("o_orderdate")).alias("date"),
        F.when(k % 13 == 0, "City Hospital").otherwise(F.concat(name, F.lit(", MD"))).alias("provider"), sub.alias("subcategory"),
        (k % 5).cast("int").alias("page_count"), F.when(v == 4, "  ").otherwise(text(header, "\n", body)).alias("content"),
    )


LETTERS_SQL = """
letters AS (SELECT *, CASE v WHEN 0 THEN '# [' || said || ', Report - ' || c_name || ', MD - Clinic]{.underline}' WHEN 1 THEN '[' || said || ', Report - ' || c_name || ', MD - Clinic]{.underline}'
  WHEN 2 THEN '# [' || said || ', Report - ' || c_name || ', MD - Clinic]' WHEN 3 THEN '# Report{.underline}' WHEN 5 THEN '# [January 1, 1980, Report - ' || c_name || ' - Clinic]{.underline}'
  WHEN 6 THEN '# [' || said || ', Report - Other Person, MD - Clinic]{.underline}' WHEN 7 THEN 'Cover Letter - ' || c_name || ' to Someone' END AS header
 FROM (SELECT o_orderkey AS letter, c_name, o_orderkey % 8 AS v, o_orderkey % 5 AS n, o_orderkey % 3 AS kind, strftime(CAST(o_orderdate AS DATE), '%B %-d, %Y') AS said,
  CASE WHEN o_orderkey % 11 = 0 THEN 'Unknown' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS date,
  CASE WHEN o_orderkey % 13 = 0 THEN 'City Hospital' ELSE c_name || ', MD' END AS provider,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Subjective: well. Impression: fine.' ELSE 'Nothing here' END AS body FROM orders JOIN customer ON o_custkey = c_custkey))"""

ISSUES_SQL = """
headed AS (SELECT *, regexp_extract(header, '\\[([A-Z][a-z]+ \\d{1,2},? \\d{4})', 1) AS found_date,
  CASE WHEN regexp_matches(header, '\\[.+\\]\\{\\.underline\\}') AND len(string_split(header, ' - ')) > 1 THEN string_split(regexp_extract(header, '\\[(.+)\\]\\{\\.underline\\}', 1), ' - ')[2]
       WHEN v = 7 THEN regexp_extract(header, 'Cover Letter - (.+)$', 1) END AS found_provider FROM letters WHERE v <> 4),
plain AS (SELECT *, lower(replace(found_provider, ', MD', '')) AS p1, lower(replace(provider, ', MD', '')) AS p2 FROM headed),
issues AS (
 SELECT letter, 'header_format' AS "check", 'warning' AS severity, CASE WHEN kind = 2 THEN 'Cover letter header missing ''Cover Letter'' label: ' WHEN header[1] <> '#' THEN 'Header missing # heading prefix: '
   WHEN NOT contains(header, '{.underline}') THEN 'Header missing {.underline} markup: ' ELSE 'Header missing bracket structure [...]{.underline}: ' END || substr(header, 1, 81) AS message
  FROM headed WHERE CASE WHEN kind = 2 THEN NOT contains(lower(header), 'cover letter') ELSE NOT regexp_matches(header, '^#\\s*\\[.+\\]\\{\\.underline\\}') END
 UNION ALL SELECT letter, 'date_consistency', 'error', 'Header date ''' || found_date || ''' does not match expected ''' || date || '''' FROM headed WHERE date <> 'Unknown' AND found_date <> '' AND strptime(replace(found_date, ',', ''), '%B %d %Y') <> CAST(date AS TIMESTAMP)
 UNION ALL SELECT letter, 'provider_consistency', 'warning', 'Header provider ''' || found_provider || ''' does not match expected ''' || provider || '''' FROM plain
  WHERE found_provider IS NOT NULL AND NOT (provider = 'City Hospital' AND contains(found_provider, ', MD')) AND p1 <> p2 AND string_split(p1, ' ')[-1] <> string_split(p2, ' ')[-1]
 UNION ALL SELECT letter, 'empty_content', 'error', 'Empty summary for ' || n || '-page letter' FROM letters WHERE v = 4 AND n > 1
 UNION ALL SELECT letter, 'required_sections', 'warning', 'Missing expected sections: Subjective, Assessment' FROM headed WHERE kind = 1 AND NOT contains(lower(body), 'subjective')
 UNION ALL SELECT letter, 'content_length', 'warning', 'Summary body is ' || length(body) || ' chars for ' || n || ' pages (expected >= ' || n * 20 || ')' FROM headed WHERE n > 2 AND length(body) < n * 20)"""


REPEATED = ("gait", "neck", "hand", "knee", "hip", "back", "wrist", "elbow", "ankle", "thumb", "toe", "rib")


def reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Letters from orders and extracts from their lines; a page's number is unique over all.

    Some letters repeat the text of others of their block of numbers.
    """
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    page = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    pages = li.groupBy(F.col("l_orderkey").alias("index")).agg(F.array_sort(F.collect_set(page)).alias("pages"))
    k = F.col("index")
    letters_ = (
        o.select(F.col("o_orderkey").alias("index"), "o_orderdate").join(pages, "index")
        .select(
            "index", F.when(k % 5 == 0, "Unknown").otherwise(day("o_orderdate")).alias("date"), F.when(k % 4 == 1, "Smith, MD").when(k % 4 > 1, "Jones, MD").alias("provider"),
            F.array(F.lit("any")).alias("category"), "pages", F.size("pages").alias("page_count"),
            F.concat(F.lit("head\nThe lumbar spine shows changes"), F.when(k % 16 == 3, F.concat(*[F.concat(F.lit(f" {w}"), F.floor(k / 64).cast("string")) for w in REPEATED])).otherwise("")).alias("content"),
        )
    )
    n, key = F.col("l_linenumber"), F.col("l_orderkey")
    date = F.when(n % 3 == 0, day("l_shipdate")).when(n % 3 == 2, "Unknown")
    result = F.struct(
        date.alias("date"), F.when((n % 2 == 0) & (key % 8 == 0), "Someone").alias("provider"),
        F.when(key % 6 == 0, "The lumbar spine shows; nothing else").otherwise("A completely different statement here").alias("diagnosis"), F.lit("short").alias("findings"),
    )
    label = F.when((n == 1) & (key % 10).isin(0, 3), F.concat(F.lit(" Date of Service: "), F.date_format("l_shipdate", "M/d/yyyy"))).otherwise("")
    prompt = F.concat(F.lit("before <processed_content>Seen by Smith."), label, F.lit("</processed_content> after Jones"))
    return letters_, li.select((page - 1).alias("iteration"), F.to_json(result).alias("result"), prompt.alias("prompt"))


REVIEW_SQL = """
r AS (SELECT l_orderkey AS "index", l_linenumber AS n, l_orderkey * 8 + l_linenumber AS page, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS ship, strftime(CAST(l_shipdate AS DATE), '%-m/%-d/%Y') AS us,
  strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS ordered, l_orderkey % 5 = 0 AS unknown, l_linenumber % 3 = 0 AS has FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
dos AS (
 SELECT DISTINCT "index", 'error' AS severity, 'Letter has unknown date but Extract Info found ''' || ship || ''' on page ' || page AS message FROM r WHERE unknown AND has
 UNION ALL SELECT DISTINCT "index", 'error', 'Extract Info date ''' || ship || ''' differs from letter date ''' || ordered || ''' on page ' || page FROM r WHERE NOT unknown AND has AND ship <> ordered
 UNION ALL SELECT "index", 'error', 'Letter has unknown date but source text contains ''' || min(us) FILTER (n = 1) || ''' on page ' || min(page) FILTER (n = 1) FROM r WHERE unknown GROUP BY "index" HAVING count(*) FILTER (has) = 0 AND "index" % 10 IN (0, 3) AND count(*) FILTER (n = 1) > 0
 UNION ALL SELECT "index", 'warning', 'Source text has DOS ''' || us || ''' that differs from letter date ''' || ordered || ''' on page ' || page
  FROM (SELECT "index", min(us) AS us, arg_min(ship, us) AS ship, min(ordered) AS ordered, min(page) AS page FROM r WHERE NOT unknown AND n = 1 AND "index" % 10 IN (0, 3) GROUP BY 1) WHERE ship <> ordered),
coverage AS (SELECT "index", 'Content from page ' || page || ' not reflected in summary: diagnosis' AS message FROM r WHERE "index" % 6 <> 0),
providers AS (SELECT "index", 'No provider name available for review' AS message FROM r WHERE "index" % 4 = 0 GROUP BY 1 HAVING NOT ("index" % 8 = 0 AND count(*) FILTER (n % 2 = 0) > 0)
 UNION ALL SELECT DISTINCT "index", 'Provider ''Jones, MD'' not found in source page text' FROM r WHERE "index" % 4 > 1),
paged AS (SELECT DISTINCT "index", page, page - row_number() OVER (PARTITION BY "index" ORDER BY page) AS island FROM (SELECT DISTINCT "index", page FROM r)),
listed AS (SELECT "index", string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS pages, CAST(sum(k) AS INTEGER) AS n FROM (SELECT "index", island, min(page) AS lo, max(page) AS hi, count(*) AS k FROM paged GROUP BY 1, 2) GROUP BY 1),
own AS (SELECT "index", any_value(listed.pages) AS pages, any_value(listed.n) AS n, CASE WHEN "index" % 4 = 1 THEN 'Smith, MD' WHEN "index" % 4 > 1 THEN 'Jones, MD' END AS provider, any_value(ordered) AS ordered FROM r JOIN listed USING ("index") GROUP BY "index"),
redundancy AS (SELECT a."index", 'Similar to letter at pages ' || b.pages || ' (' || coalesce(b.provider, 'Unknown') || ')' AS message
  FROM own a JOIN own b ON a."index" % 16 = 3 AND b."index" % 16 = 3 AND a."index" // 64 = b."index" // 64 AND a."index" <> b."index"),
every AS (SELECT "index", 'dos_verification' AS "check", severity, message FROM dos UNION ALL SELECT "index", 'content_coverage', 'warning', message FROM coverage
 UNION ALL SELECT "index", 'provider_availability', 'info', message FROM providers UNION ALL SELECT "index", 'redundancy', 'warning', message FROM redundancy)"""
