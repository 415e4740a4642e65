"""The folder that driver and executors share, and cutting lineage through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

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


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage through Parquet in the shared folder, where a checkpoint would hold the rows uncompressed."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    # a dictionary of 16 MB holds the hashes of a task's words, which plain pages would repeat
    df.write.option("parquet.dictionary.page.size", 16 << 20).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
