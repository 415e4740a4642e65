"""How the corpus operators deal documents to batches and hashes to buckets."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bucket_bits(spark: SparkSession) -> int:
    """Hash buckets: the power of two from twice the shuffle partitions on."""
    return max(3, (2 * parts(spark) - 1).bit_length())


def batched(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and batch number ``b``, dealt out by it.

    Twice as many batches as shuffle partitions: a batch's size is the input
    over that, which the session's ``spark.sql.shuffle.partitions`` bounds.
    The exchange has the same plan wherever it is used, so Spark runs it once.
    """
    n = parts(docs.sparkSession)
    key = F.pmod(F.xxhash64(*[docs[c] for c in columns]), F.lit(2 * n)).cast("int")
    return docs.select(*[docs[c] for c in columns], key.alias("b")).repartition(n, "b")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a single machine gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not have:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = tempfile.mkdtemp(prefix="folioquery-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(have)
    return have.rstrip("/")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``many`` joined (inner or left) with the one row that ``one`` has for a key.

    A key's rows are salted by the hash of ``by``, so that a key with a third of all rows
    is spread over the session's partitions; ``one`` is copied only to salts that a key has.
    """
    rows = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(parts(many.sparkSession))))
    return rows.join(rows.select(key, "salt").distinct().join(one, key), [key, "salt"], how).drop("salt")
