"""Run inspection over a stream of executions.

The reference semantics are batch only; these keep the same counts current
while a run is going on, with bounded state: windows close at the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.sources.readers import EXECUTIONS


def read_executions(spark: SparkSession, path: str) -> DataFrame:
    """New JSON Lines files of a folder, with ``finished`` as event time."""
    return spark.readStream.schema(EXECUTIONS).json(path).withColumn("at", F.try_to_timestamp("finished"))


def status_counts(executions: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Succeeded, failed and other executions per step and window."""
    state = F.lower("status")
    return (
        executions.withWatermark("at", late)
        .groupBy(F.window("at", window).alias("w"), "step_name")
        .agg(
            F.count_if(state == "succeeded").alias("succeeded"),
            F.count_if(state == "failed").alias("failed"),
            F.count_if(~F.coalesce(state.isin("succeeded", "failed"), F.lit(False))).alias("other"),
        )
        .select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "step_name", "succeeded", "failed", "other")
    )
