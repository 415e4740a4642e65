"""Texts of pages, kept between runs: only what is missing or out of date is extracted again.

A key is (side, document, page): our pages by logical number, theirs by physical. A
text of ours is out of date once its source was modified after the text was made; theirs
do not change. ``always`` takes every wanted page for out of date, as texts of a case are.
A text that is one document's whole is its page 0.

New keys are appended. Where a key is replaced, its folder (side and a bucket of
documents) is written anew beside the old one, which goes when all of it is there. A run
that is killed leaves files that no reader lists, so the cache stays readable and the
next run does what is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.shared import cut

KEY = ["side", "document", "page"]
CACHE = "document string, page int, text string, made timestamp, side string, bucket int"
BUCKETS = 64


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; none where there is no cache yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def outdated(wanted: DataFrame, cache: DataFrame, always: bool = False) -> DataFrame:
    """Keys of ``wanted`` (KEY, modified) that the cache lacks or holds out of date, each once."""
    asked = wanted.groupBy(*KEY).agg(F.max("modified").alias("modified"))
    if always:
        return asked
    held = asked.join(cache.select(*KEY, "made"), KEY)
    fresh = held.filter((F.col("side") != "yours") | F.col("modified").isNull() | (F.col("made") >= F.col("modified")))
    return asked.join(fresh.select(*KEY), KEY, "left_anti")


def refresh(spark: SparkSession, path: str, wanted: DataFrame, extract: Callable[[DataFrame], DataFrame], always: bool = False, buckets: int = BUCKETS, now: Column | None = None) -> DataFrame:
    """The cache after ``extract`` (keys to KEY and text) has supplied what ``wanted`` lacks.

    A page that ``extract`` does not return is not kept and is asked for again next time.
    All runs on a path use the same number of buckets. Nothing is written, and ``extract``
    is not called, when nothing is missing.
    """
    cache = cached(spark, path)
    todo = cut(outdated(wanted, cache, always).withColumn("bucket", F.pmod(F.xxhash64("document"), F.lit(buckets)).cast("int")))
    if todo.isEmpty():
        return cache
    folder = ["side", "bucket"]
    replaced = cut(cache.join(todo.select(*KEY), KEY, "left_semi").select(*folder).distinct())

    def made(keys: DataFrame) -> DataFrame:
        texts = extract(keys.drop("bucket")).select(*KEY, "text").dropDuplicates(KEY)
        return texts.join(keys.select(*KEY, "bucket"), KEY).withColumn("made", F.current_timestamp() if now is None else now)

    if not replaced.isEmpty():
        kept = cache.join(F.broadcast(replaced), folder, "left_semi").join(todo.select(*KEY), KEY, "left_anti")
        anew = made(todo.join(F.broadcast(replaced), folder, "left_semi")).unionByName(kept)
        anew.hint("rebalance", *folder).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folder).parquet(path)
    rest = todo.join(F.broadcast(replaced), folder, "left_anti")
    if not rest.isEmpty():
        made(rest).hint("rebalance", *folder).write.mode("append").partitionBy(*folder).parquet(path)
    spark.catalog.refreshByPath(path)
    return cached(spark, path)
