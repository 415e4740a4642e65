"""Contract queries over the driver's tables, with the SQL each must equal.

The tables hold no letters or indexes, so each query derives rows of that shape
from structured columns, and its SQL derives the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions import similarity
from folioquery.functions.pages import expand_pages, page_ranges
from folioquery.operators import first_match, letter_checks, overlap_join, page_map, review_checks, run_inspection, token_join
from folioquery.plans import derived, investigate
from folioquery.shared import cut

FLAGSHIP = "reconcile_same"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def text(pages) -> F.Column:
    return F.array_join(pages.cast("array<string>"), ",")


# Run inspection.

_EXECUTIONS = """
executions AS (SELECT event_id, event_type, user_id,
  CASE event_id % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status,
  CASE event_id % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN '2024-01-02' WHEN 3 THEN 'pending' END AS date,
  event_id % 3 = 0 AS continuation, event_id % 7 = 6 AS broken FROM events)"""


@query(f"WITH {_EXECUTIONS} SELECT event_type AS value, count(*) AS n FROM executions GROUP BY 1")
def run_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_inspection.tally(derived.executions(spark, sf_dir), "step_name")


@query(f"""WITH {_EXECUTIONS}, r AS (SELECT * FROM executions WHERE status = 'SUCCEEDED' AND NOT broken),
s AS (SELECT count(*) AS pages, count(*) FILTER (date = '2024-01-02') AS dated, count(*) FILTER (date IS NULL OR date = 'Unknown') AS unknown,
  count(*) FILTER (NOT continuation) AS entries, count(*) FILTER (NOT continuation AND date = '2024-01-02') AS entries_dated,
  count(*) FILTER (NOT continuation AND (date IS NULL OR date = 'Unknown')) AS entries_unknown FROM r)
SELECT *, round(unknown / pages * 100, 1) AS unknown_pct, round(entries_unknown / entries * 100, 1) AS entries_unknown_pct FROM s""")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_inspection.date_stats(derived.executions(spark, sf_dir))


@query(f"""WITH {_EXECUTIONS} SELECT event_type AS name, CAST(length(event_type) AS INTEGER) AS priority,
count(*) FILTER (status = 'SUCCEEDED') AS succeeded, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'RUNNING') AS other
FROM executions GROUP BY 1, 2""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.executions(spark, sf_dir)
    steps = rows.select(F.col("step_name").alias("name")).distinct().withColumn("priority", F.length("name"))
    return run_inspection.step_counts(steps, rows)


@query("""SELECT event_id, event_type, user_id FROM events
WHERE json_extract_string(props, '$.k') = '7' AND user_id BETWEEN 3 AND 90""")
def run_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.table(spark, sf_dir, "events")
    rows = run_inspection.where(events, ["k=7"], result="props").filter(run_inspection.iterations("3-90", "user_id"))
    return rows.select("event_id", "event_type", "user_id")


@query(f"""WITH {_EXECUTIONS}, r AS (SELECT user_id, CAST(event_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n
FROM executions WHERE status = 'SUCCEEDED') SELECT user_id, id FROM r WHERE n = 1""")
def latest_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.executions(spark, sf_dir)
    runs = rows.select("user_id", F.col("event_id").cast("string").alias("id"), "status", F.format_string("%012d", "event_id").alias("finished"))
    return first_match.latest_success(runs, "user_id")


@query(f"""WITH {_EXECUTIONS} SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type || '.pdf' END AS filename, CASE WHEN NOT broken THEN date END AS date,
CASE WHEN NOT broken THEN CAST(continuation AS VARCHAR) END AS continuation FROM executions""")
def run_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("read <filename> "), "step_name", F.lit(".pdf</filename> now"))).otherwise("read it")
    rows = derived.executions(spark, sf_dir).withColumn("prompt", prompt).withColumn("iteration", F.col("event_id"))
    return run_inspection.compact(rows).select(F.col("iteration").alias("event_id"), "filename", "date", "continuation")


@query(f"""WITH {_EXECUTIONS} SELECT event_id AS page, coalesce(CASE WHEN NOT broken THEN date END, 'Unknown') AS date
FROM executions WHERE status = 'SUCCEEDED'""")
def run_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.executions(spark, sf_dir).withColumn("iteration", F.col("event_id")).withColumn("step_name", F.lit("Extract info"))
    return run_inspection.list_pages(rows).select("page", "date")


# Reconciliation.

_ENTRIES = """
yours AS (SELECT CAST(o_orderdate AS DATE) AS d, 'o' || CAST(o_orderdate AS DATE) || '-' || o_custkey AS id, list_sort(list(DISTINCT o_orderkey)) AS pages FROM orders GROUP BY o_orderdate, o_custkey),
theirs AS (SELECT CAST(l_shipdate AS DATE) AS d, 'l' || CAST(l_shipdate AS DATE) || '-' || l_suppkey AS id, list_sort(list(DISTINCT l_orderkey)) AS pages FROM lineitem GROUP BY l_shipdate, l_suppkey),
same AS (SELECT y.d, y.id AS your_id, t.id AS their_id, y.pages AS your_pages, t.pages AS their_pages FROM yours y JOIN theirs t ON y.d = t.d AND list_has_any(y.pages, t.pages)),
yours_only AS (SELECT * FROM yours WHERE id NOT IN (SELECT your_id FROM same)),
theirs_only AS (SELECT * FROM theirs WHERE id NOT IN (SELECT their_id FROM same))"""


@query(f"WITH {_ENTRIES} SELECT CAST(d AS VARCHAR) AS date, your_id, their_id, array_to_string(your_pages, ',') AS your_pages, array_to_string(their_pages, ',') AS their_pages FROM same")
def reconcile_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = overlap_join.same_dates(derived.yours(spark, sf_dir), derived.theirs(spark, sf_dir))
    return same.select("date", "your_id", "their_id", text(F.col("your_pages")).alias("your_pages"), text(F.col("their_pages")).alias("their_pages"))


@query("""WITH y AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'UNKNOWN' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS date, o_orderkey % 5000 AS lo FROM orders WHERE o_orderkey % 4 < 3),
t AS (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_orderkey % 20 < 10 THEN 'UNKNOWN' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS date, l_orderkey % 4999 AS lo FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 10 = 1)
SELECT date, y.id AS your_id, t.id AS their_id FROM y JOIN t USING (date) WHERE y.lo <= t.lo + 7 AND t.lo <= y.lo + 20""")
def reconcile_same_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of twenty-one and eight pages in a row, a third and half of them without a date."""
    k, date = F.col("o_orderkey"), derived.day("o_orderdate")
    entry = lambda d, width, mod: d.select(k.alias("entry_id"), "date", F.sequence(k % mod, k % mod + (width - 1)).cast("array<int>").alias("pages"), F.lit("").alias("header"))
    orders = derived.table(spark, sf_dir, "orders")
    lines = derived.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).filter(k % 10 == 1).distinct()
    yours = entry(orders.filter(k % 4 < 3).withColumn("date", F.when(k % 3 == 0, "UNKNOWN").otherwise(date)), 21, 5000)
    theirs = entry(orders.join(lines, "o_orderkey", "left_semi").withColumn("date", F.when(k % 20 < 10, "UNKNOWN").otherwise(date)), 8, 4999)
    return overlap_join.same_dates(yours, theirs).select("date", "your_id", "their_id")


@query(f"WITH {_ENTRIES} SELECT CAST(d AS VARCHAR) AS date, id AS entry_id, array_to_string(pages, ',') AS pages FROM yours_only")
def reconcile_yours_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, yours, _ = overlap_join.reconcile(derived.yours(spark, sf_dir), derived.theirs(spark, sf_dir))
    return yours.select("date", "entry_id", text(F.col("pages")).alias("pages"))


@query(f"WITH {_ENTRIES} SELECT CAST(d AS VARCHAR) AS date, id AS entry_id, array_to_string(pages, ',') AS pages FROM theirs_only")
def reconcile_theirs_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, theirs = overlap_join.reconcile(derived.yours(spark, sf_dir), derived.theirs(spark, sf_dir))
    return theirs.select("date", "entry_id", text(F.col("pages")).alias("pages"))


@query(f"""WITH {_ENTRIES}, p AS (SELECT id, d, unnest(pages) AS page FROM theirs_only)
SELECT y.id AS your_id, p.id AS their_id, CAST(y.d AS VARCHAR) AS date, CAST(p.d AS VARCHAR) AS their_date, p.page AS match_page
FROM yours_only y JOIN p ON y.pages[1] = p.page""")
def date_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, yours, theirs = overlap_join.reconcile(derived.yours(spark, sf_dir), derived.theirs(spark, sf_dir))
    merged, _, _ = overlap_join.date_mismatches(yours.withColumn("match_page", F.get("pages", 0)), theirs)
    return merged.select(F.col("entry_id").alias("your_id"), "their_id", "date", "their_date", "match_page")


@query("""WITH y AS (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderpriority AS title FROM orders),
t AS (SELECT DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, l_returnflag AS title FROM lineitem)
SELECT 'MATCH' AS status, date, y.title AS your_title, t.title AS their_title FROM y JOIN t USING (date)
UNION ALL SELECT 'YOURS ONLY', date, title, NULL FROM y WHERE date NOT IN (SELECT date FROM t)
UNION ALL SELECT 'THEIRS ONLY', date, NULL, title FROM t WHERE date NOT IN (SELECT date FROM y)""")
def header_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = derived.table(spark, sf_dir, "orders"), derived.table(spark, sf_dir, "lineitem")
    y = o.select(derived.day("o_orderdate").alias("normalized_date"), F.col("o_orderpriority").alias("title")).distinct()
    t = li.select(derived.day("l_shipdate").alias("normalized_date"), F.col("l_returnflag").alias("title")).distinct()
    matched, yours, theirs = overlap_join.by_date(y, t)
    none = F.lit(None).cast("string")
    return (
        matched.select(F.lit("MATCH").alias("status"), "date", "your_title", "their_title")
        .unionByName(yours.select(F.lit("YOURS ONLY").alias("status"), F.col("normalized_date").alias("date"), F.col("title").alias("your_title"), none.alias("their_title")))
        .unionByName(theirs.select(F.lit("THEIRS ONLY").alias("status"), F.col("normalized_date").alias("date"), none.alias("your_title"), F.col("title").alias("their_title")))
    )


# Pages.


@query("""WITH c AS (SELECT DISTINCT conv_id AS doc_id, CAST(turn + 1 + turn // 2 AS INTEGER) AS logical, CAST(turn + 1 + turn // 2 + conv_id % 5 + CASE WHEN conv_id % 3 = 0 THEN turn ELSE 0 END AS INTEGER) AS physical FROM conversations),
n AS (SELECT *, lead(logical) OVER w AS l2, lead(physical) OVER w AS p2 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY logical))
SELECT doc_id, logical, physical FROM c UNION ALL
SELECT doc_id, CAST(x AS INTEGER), CAST(physical + x - logical AS INTEGER) FROM (SELECT *, unnest(generate_series(logical + 1, l2 - 1)) AS x FROM n WHERE l2 - logical > 1 AND l2 - logical = p2 - physical)""")
def page_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second step skips a page; in a third of the documents the physical pages lie further apart, and the gap stays."""
    turn, doc = F.col("turn").cast("int"), F.col("conv_id")
    page = turn + 1 + F.floor(turn / 2).cast("int")
    links = derived.table(spark, sf_dir, "conversations").select(doc.alias("doc_id"), turn.alias("ordinal"), page.cast("string").alias("link_text"), (page + doc % 5 + F.when(doc % 3 == 0, turn).otherwise(0)).cast("int").alias("dest_page"))
    return page_map.build_page_map(links)


@query("""WITH o AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders),
i AS (SELECT o_custkey, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM o),
r AS (SELECT o_custkey, island, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM i GROUP BY 1, 2)
SELECT o_custkey, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS pages FROM r GROUP BY 1""")
def page_range_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("keys"))
    return o.select("o_custkey", page_ranges(F.col("keys")).alias("pages"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(generate_series(CAST(p_size AS BIGINT), p_size + p_partkey % 4), [CAST(p_partkey AS BIGINT)]))), ',') AS pages FROM part""")
def page_list_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.table(spark, sf_dir, "part")
    listed = F.concat(F.col("p_size").cast("string"), F.lit(" - "), (F.col("p_size") + F.col("p_partkey") % 4).cast("string"), F.lit(", x, "), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", text(expand_pages(listed)).alias("pages"))


@query("""WITH e AS (SELECT l_suppkey, unnest(list_distinct(list(l_orderkey))) AS page FROM lineitem GROUP BY 1)
SELECT page, min(l_suppkey) AS entry_id FROM e GROUP BY 1""")
def first_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entry_id")).agg(F.collect_set("l_orderkey").alias("pages"))
    return first_match.entry_of_page(e.withColumn("ordinal", F.col("entry_id")))


# Similarity.

_OVERLAP = "CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) ELSE 0 END"
_SHARED = "CASE WHEN len(a.{c}) > 0 AND len(b.{c}) > 0 THEN len(list_intersect(a.{c}, b.{c})) / greatest(len(a.{c}), len(b.{c})) * {w} END"
_PRINT = "CASE WHEN s > 0.7 THEN 'STRONG' || p WHEN s > 0.5 THEN 'LIKELY' || p WHEN s > 0.3 THEN 'WEAK' || p ELSE 'NO MATCH' END"


def _fingerprint_sql(pairs: str = "a.k = b.k AND ") -> str:
    words = "list_filter(string_split({t}, ' '), lambda w: w <> '')"
    return f"""
f AS (SELECT k, side, full_text, {words.format(t="substr(full_text, 1, 201)")} AS preview, {words.format(t="substr(full_text, 1, 501)")} AS head,
  list_distinct(regexp_extract_all(full_text, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}')) AS dates,
  list_distinct(regexp_extract_all(full_text, '\\w+(?:,?\\s+(?:md|do|pa|np|dc|dds|phd|psyd))')) AS providers,
  list_distinct(regexp_extract_all(full_text, '(?:office visit|x-ray|mri|therapy|report|encounter|consultation|examination|treatment)')) AS terms
  FROM (SELECT k, side, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS full_text FROM texts)),
p AS (SELECT a.k, b.k AS other, {_SHARED.format(c="dates", w="3.0")} AS s1, {_SHARED.format(c="providers", w="2.0")} AS s2, {_OVERLAP.format(x="a.preview", y="b.preview")} AS s3,
  {_SHARED.format(c="terms", w="1.0")} AS s4, {_OVERLAP.format(x="a.head", y="b.head")} * 2.0 AS s5 FROM f a JOIN f b ON {pairs}a.side = 'yours' AND b.side = 'theirs'),
scored AS (SELECT k, other, (coalesce(s1, 0) + coalesce(s2, 0) + s3 + coalesce(s4, 0) + s5) / (2 + (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT) AS s FROM p)"""


@query(f"""WITH base AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, c_name, o_orderpriority AS w FROM orders JOIN customer ON o_custkey = c_custkey),
texts AS (SELECT k, 'yours' AS side, month(d) || '/' || day(d) || '/' || year(d) || '  ' || c_name || ', MD Office Visit ' || w AS t FROM base
UNION ALL SELECT k, 'theirs', CASE k % 3 WHEN 0 THEN month(d) || '/' || day(d) || '/' || year(d) WHEN 1 THEN month(d) || '/' || year(d) ELSE '1/1/1990' END || ' ' || c_name || CASE k % 4 WHEN 0 THEN '' ELSE ', MD ' END || CASE k % 2 WHEN 0 THEN ' office visit ' ELSE ' therapy ' END || w FROM base),
{_fingerprint_sql()}, x AS (SELECT k, s, ' (' || CAST(round(s * 100) AS BIGINT) || '%)' AS p FROM scored)
SELECT k AS o_orderkey, round(s, 6) AS score, {_PRINT} AS confidence,
CASE WHEN s > 0.8 THEN 'SAME DOCUMENT' WHEN s > 0.5 THEN 'LIKELY SAME' WHEN s > 0.3 THEN 'WEAK MATCH' ELSE 'DIFFERENT DOCUMENTS' END AS verdict FROM x""")
def page_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.page_texts(spark, sf_dir).withColumns({"a": similarity.fingerprint(F.col("yours")), "b": similarity.fingerprint(F.col("theirs"))})
    rows = rows.withColumn("s", similarity.similarity(F.col("a"), F.col("b")))
    return rows.select("o_orderkey", F.round("s", 6).alias("score"), similarity.report_confidence(F.col("s")).alias("confidence"), similarity.pair_confidence(F.col("s")).alias("verdict"))


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber) % 100 / 100 AS s, CASE l_orderkey % 3 WHEN 0 THEN 'YOURS ONLY' WHEN 1 THEN 'THEIRS ONLY' ELSE 'SAME DATE' END AS status FROM lineitem),
y AS (SELECT *, ' (' || CAST(round(s * 100) AS BIGINT) || '%)' AS p FROM x),
z AS (SELECT *, {_PRINT} AS confidence, CASE WHEN status = 'YOURS ONLY' THEN 'THEIR' ELSE 'YOUR' END AS other FROM y)
SELECT l_orderkey, l_linenumber, status, confidence, CASE WHEN status = 'SAME DATE' THEN 'DATE DISCREPANCY' WHEN confidence LIKE 'STRONG%' THEN 'VERIFY MATCH - CHECK ' || other || ' PAGE ' || l_linenumber
WHEN confidence <> 'NO MATCH' THEN 'CHECK ' || other || ' PAGE ' || l_linenumber WHEN status = 'YOURS ONLY' THEN 'MISSING FROM VENDOR' ELSE 'MISSING FROM YOURS' END AS action FROM z""")
def confidence_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = derived.table(spark, sf_dir, "lineitem")
    s = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 100 / 100.0
    status = F.when(F.col("l_orderkey") % 3 == 0, "YOURS ONLY").when(F.col("l_orderkey") % 3 == 1, "THEIRS ONLY").otherwise("SAME DATE")
    rows = li.select("l_orderkey", "l_linenumber", status.alias("status"), similarity.report_confidence(s).alias("confidence"))
    return rows.withColumn("action", similarity.action(F.col("status"), F.col("confidence"), F.col("l_linenumber")))


_SIDES_SQL = """base AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, c_name, o_orderpriority AS w FROM orders JOIN customer ON o_custkey = c_custkey),
texts AS (SELECT k, 'yours' AS side, month(d) || '/' || day(d) || '/' || year(d) || '  ' || c_name || ', MD Office Visit ' || w AS t FROM base WHERE k % 50 = 0
UNION ALL SELECT k, 'theirs', CASE k % 3 WHEN 0 THEN month(d) || '/' || day(d) || '/' || year(d) WHEN 1 THEN month(d) || '/' || year(d) ELSE '1/1/1990' END || ' ' || c_name || CASE k % 4 WHEN 0 THEN '' ELSE ', MD ' END || CASE k % 2 WHEN 0 THEN ' office visit ' ELSE ' therapy ' END || w FROM base)"""


@query(f"""WITH {_SIDES_SQL}, {_fingerprint_sql("")},
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, other) AS n FROM scored WHERE s > 0.5)
SELECT k AS one, other AS physical, round(s, 6) AS score, CASE WHEN s > 0.8 THEN 'SAME DOCUMENT' ELSE 'LIKELY SAME' END AS verdict, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 3""")
def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of their pages for your pages whose order is divisible by 50, among all of theirs."""
    rows = derived.page_texts(spark, sf_dir).withColumnRenamed("o_orderkey", "physical")
    ones = rows.filter(F.col("physical") % 50 == 0).select("physical", F.col("yours").alias("text"))
    found = investigate.candidates(ones, rows.select("physical", F.col("theirs").alias("text")))
    return found.select("one", "physical", F.round("score", 6).alias("score"), "verdict", "rank")


@query(f"""WITH texts AS (SELECT doc_id AS k, 'theirs' AS side, text AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'yours', text FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL),
{_fingerprint_sql("a.k <> b.k AND ")} SELECT k AS one, other AS physical, round(s, 6) AS score FROM scored WHERE s > 0.98""")
def page_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, read as pages, that repeat one whose id is divisible by 50."""
    pages = derived.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("physical"), "text")
    return investigate.duplicates(pages.filter(F.col("physical") % 50 == 0), pages).select("one", "physical", F.round("score", 6).alias("score"))


@query("""WITH item AS (SELECT arg_min(text, item_id) AS t FROM benchmark),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS a, (SELECT list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> '') FROM item) AS b FROM documents),
s AS (SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END AS score FROM w)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 3""")
def top3_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = derived.table(spark, sf_dir, "benchmark").agg(F.min_by("text", "item_id").alias("item"))
    rows = derived.table(spark, sf_dir, "documents").select("doc_id", "text").crossJoin(F.broadcast(item))
    scored = rows.select("doc_id", similarity.word_overlap(F.lower("text"), F.lower("item")).alias("s"))
    return first_match.top(scored, None, "s", "doc_id").select("doc_id", F.round("s", 6).alias("score"))


@query("""WITH b AS (SELECT l_orderkey AS entry, l_linenumber AS page, (l_partkey + l_suppkey) % 97 / 97 AS s FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY s DESC, page) AS n FROM b) SELECT entry, page, round(s, 6) AS score FROM r WHERE n = 1""")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = derived.table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("entry"), F.col("l_linenumber").alias("page"), ((F.col("l_partkey") + F.col("l_suppkey")) % 97 / 97.0).alias("s"))
    return first_match.best(rows, "entry", "page", "s", "page").select("entry", "page", F.round("s", 6).alias("score"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z_]+')) AS token FROM documents WHERE length(text) > 50),
c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY 1, 2), m AS (SELECT doc_id, sqrt(sum(n * n)) AS m FROM c GROUP BY 1),
d AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.n * y.n) AS dot FROM c x JOIN c y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b FROM d JOIN m ma ON ma.doc_id = a JOIN m mb ON mb.doc_id = b WHERE dot / (ma.m * mb.m) > 0.9""")
def doc_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_join.similar_texts(derived.table(spark, sf_dir, "documents"), "doc_id", "text").select("a", "b")


# Letters.


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN ['QME follow-up'] WHEN 1 THEN ['Misc', 'Imaging study'] WHEN 2 THEN ['Lab panel', 'Radiology Reports'] WHEN 3 THEN ['Lab panel'] WHEN 4 THEN ['Letter'] WHEN 5 THEN ['Other'] ELSE [] END AS sub FROM part)
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Subjective,Assessment,Impairment' WHEN 1 THEN 'Findings,Impression' WHEN 2 THEN 'Findings,Impression' WHEN 3 THEN '' WHEN 4 THEN '' ELSE 'Subjective,Assessment' END AS sections,
CASE p_partkey % 7 WHEN 1 THEN 'Diagnostic Studies (X-rays/MRI)' WHEN 2 THEN 'Radiology Reports' WHEN 3 THEN 'Laboratory Report' WHEN 4 THEN 'Letter' WHEN 0 THEN 'evaluation' ELSE 'default' END AS rubric FROM s""")
def rubric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [["QME follow-up"], ["Misc", "Imaging study"], ["Lab panel", "Radiology Reports"], ["Lab panel"], ["Letter"], ["Other"]]
    sub = F.array().cast("array<string>")
    for k, names in enumerate(lists):
        sub = F.when(F.col("p_partkey") % 7 == k, F.array(*map(F.lit, names))).otherwise(sub)
    rows = derived.table(spark, sf_dir, "part").select("p_partkey", first_match.rubric_name(sub).alias("r"))
    name = F.when(F.col("r").startswith("QME"), "evaluation").otherwise(F.coalesce("r", F.lit("default")))
    return rows.select("p_partkey", F.array_join(first_match.required_sections(F.col("r")), ",").alias("sections"), name.alias("rubric"))


@query(f"WITH {derived.LETTERS_SQL}, {derived.ISSUES_SQL} SELECT letter, \"check\", severity, message FROM issues")
def score_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = letter_checks.score(derived.letters(spark, sf_dir))
    return scored.select("letter", F.explode("issues").alias("i")).select("letter", "i.*")


@query(f"""WITH {derived.LETTERS_SQL}, {derived.ISSUES_SQL},
n AS (SELECT l.letter, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM letters l LEFT JOIN issues i ON i.letter = l.letter GROUP BY 1)
SELECT count(*) AS letters_scored, count(*) FILTER (e + w = 0) AS passed, count(*) FILTER (e + w > 0) AS flagged, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(w) AS BIGINT) AS warnings FROM n""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letter_checks.scorecard(letter_checks.score(derived.letters(spark, sf_dir)))


@query(f"""WITH {derived.LETTERS_SQL}, {derived.ISSUES_SQL}, c AS (SELECT unnest(['header_format', 'date_consistency', 'provider_consistency', 'empty_content', 'required_sections', 'content_length']) AS c)
SELECT c AS "check", (SELECT count(*) FROM letters) - (SELECT count(DISTINCT letter) FROM issues WHERE "check" = c) AS passed, (SELECT count(DISTINCT letter) FROM issues WHERE "check" = c) AS failed FROM c""")
def scorecard_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letter_checks.by_check(letter_checks.score(derived.letters(spark, sf_dir)))


@query(f"WITH {derived.REVIEW_SQL} SELECT \"index\", severity, message FROM dos")
def review_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters, extracts = derived.reviewed(spark, sf_dir)
    return review_checks.issue_rows(letters, extracts, ["dos_verification"]).select("index", "severity", "message")


@query(f"WITH {derived.REVIEW_SQL} SELECT \"index\", message FROM coverage")
def review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters, extracts = derived.reviewed(spark, sf_dir)
    return review_checks.issue_rows(letters, extracts, ["content_coverage"]).select("index", "message")


@query(f"WITH {derived.REVIEW_SQL} SELECT \"index\", message FROM providers")
def review_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters, extracts = derived.reviewed(spark, sf_dir)
    return review_checks.issue_rows(letters, extracts, ["provider_availability"]).select("index", "message")


@query(f"""WITH {derived.REVIEW_SQL} SELECT "check", count(*) AS n, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM every GROUP BY 1""")
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters, extracts = derived.reviewed(spark, sf_dir)
    return review_checks.by_check(review_checks.review(cut(letters), extracts))


@query(f"""WITH {derived.REVIEW_SQL}, f AS (SELECT "index", count(*) FILTER (severity = 'error') AS errors, bool_or("check" <> 'redundancy') AS mine, string_agg(message, '; ' ORDER BY "check", severity, message) AS notes FROM every GROUP BY 1)
SELECT "index", CASE WHEN mine THEN provider END AS provider, CASE WHEN mine THEN pages END AS pages, CASE WHEN mine THEN 'any' END AS category,
 CASE WHEN mine THEN CASE WHEN "index" % 5 = 0 THEN 'Unknown' ELSE ordered END END AS dos, CASE WHEN mine THEN n END AS page_count, notes, CASE WHEN errors > 0 THEN 'FAIL' ELSE 'WARN' END AS status FROM f JOIN own USING ("index")""")
def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding's report columns and its number of pages."""
    letters, extracts = derived.reviewed(spark, sf_dir)
    findings = review_checks.review(cut(letters), extracts)
    return review_checks.qa_rows(findings, "index", "page_count").select("index", "provider", "pages", "category", "dos", "page_count", "notes", "status")


from folioquery.plans import index_queries, source_queries  # noqa: E402

for _more in (index_queries, source_queries):
    QUERIES |= _more.QUERIES
    ORACLES |= _more.ORACLES
