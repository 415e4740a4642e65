"""Contract queries that go through sources: run snapshots, the typed run table and the page cache.

Each writes what it derives from the given tables to the shared folder and reads it
back as a user of the source would.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions.results import field_text, parse_result
from folioquery.operators import run_inspection
from folioquery.plans import derived
from folioquery.shared import shared_folder
from folioquery.sources import page_cache, run_api, runs
from folioquery.sources.readers import EXECUTIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as executions of four runs; an event's number is its iteration."""
    e = derived.executions(spark, sf_dir).withColumns({"iteration": F.col("event_id").cast("int"), "run_id": F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string"))})
    names = [part.split()[0] for part in EXECUTIONS.split(", ")]
    return e.select(*[(F.col(n) if n in e.columns else F.lit(None).cast("string")).alias(n) for n in names])


_RUNS = """
x AS (SELECT CAST(event_id AS INTEGER) AS iteration, 'r' || (user_id % 4) AS run_id, event_type AS step_name,
  CASE event_id % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status, event_id % 7 = 6 AS broken,
  CASE event_id % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN '2024-01-02' WHEN 3 THEN 'pending' END AS date, event_id % 3 = 0 AS continuation FROM events)"""


@query(f"WITH {_RUNS} SELECT run_id, step_name, iteration, CASE WHEN NOT broken THEN date END AS date FROM x WHERE run_id = 'r1' AND iteration BETWEEN 50 AND 5000 AND status = 'SUCCEEDED'")
def run_snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run's succeeded executions of a range, by filters that the snapshots' source meets itself."""
    root = folder(spark, "snapshot")
    run_api.write_snapshot(executions(spark, sf_dir), root, width=1000)
    rows = run_api.scan(spark, root, run_id="r1", spec="50-5000").filter("status = 'SUCCEEDED'")
    return rows.select("run_id", "step_name", "iteration", field_text(parse_result(F.col("result")), "date").alias("date"))


@query(f"WITH {_RUNS} SELECT step_name, count(*) AS n, CAST(sum(iteration) AS BIGINT) AS iterations FROM x WHERE NOT broken AND date = '2024-01-02' AND continuation AND iteration BETWEEN 10 AND 9000 GROUP BY 1")
def run_where_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``--where`` on two fields that stand in the run table's own columns."""
    path = folder(spark, "executions")
    runs.write_executions(executions(spark, sf_dir), path, fields=["date", "continuation"])
    rows = runs.read_executions(spark, path, spec="10-9000", filters=["date=2024-01-02", "continuation=true"])
    return rows.groupBy("step_name").agg(F.count("*").alias("n"), F.sum("iteration").cast("long").alias("iterations"))


@query(f"WITH {_RUNS} SELECT step_name, count(*) AS n FROM x WHERE NOT broken AND date IS NULL GROUP BY 1")
def run_where_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that is absent compares as the empty text; results that are no JSON meet nothing."""
    rows = run_inspection.where(executions(spark, sf_dir), ["date="])
    return rows.groupBy("step_name").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_orderkey AS page, 'd' || (o_orderkey % 50) AS document, o_orderkey % 2 = 0 AS early, o_orderkey % 50 % 5 = 0 AS changed, o_orderpriority AS t FROM orders),
s AS (SELECT *, unnest(['yours', 'theirs']) AS side FROM p)
SELECT side, document, CAST(page AS INTEGER) AS page, t || CASE WHEN early AND NOT (side = 'yours' AND changed) THEN ' first' ELSE ' second' END AS text FROM s""")
def page_cache_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the pages, then all, after the sources of some of our documents changed."""
    o = derived.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    pages = o.select(key.cast("int").alias("page"), F.concat(F.lit("d"), (key % 50).cast("string")).alias("document"), (key % 50 % 5 == 0).alias("changed"), "o_orderpriority")
    pages = pages.withColumn("side", F.explode(F.array(F.lit("yours"), F.lit("theirs"))))
    path = folder(spark, "pages")

    def turn(wanted: DataFrame, modified, now: str, word: str) -> DataFrame:
        texts = pages.select("side", "document", "page", F.concat_ws(" ", "o_orderpriority", F.lit(word)).alias("text"))
        asked = wanted.select(*page_cache.KEY, modified.cast("timestamp").alias("modified"))
        return page_cache.refresh(spark, path, asked, lambda keys: texts.join(keys.select(*page_cache.KEY), page_cache.KEY), buckets=8, now=F.lit(now).cast("timestamp"))

    turn(pages.filter("page % 2 = 0"), F.lit("2024-01-01"), "2024-01-02", "first")
    cache = turn(pages, F.when(F.col("changed"), "2024-02-01").otherwise("2024-01-01"), "2024-03-01", "second")
    return cache.select("side", "document", "page", "text")
