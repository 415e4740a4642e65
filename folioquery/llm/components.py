"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm._spark import cut


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """node and root (the least node reachable) of every node that has an edge.

    A round takes the least label among a node and its neighbours and then that
    label's label of the round before, so a component of diameter d needs about
    log d rounds. A node's own label travels with those of its neighbours, so a
    round is four exchanges, which is what its plan costs the driver. Every round
    is cut through the shared checkpoint folder; nothing but a flag reaches the
    driver. ``edges`` is read once.
    """
    one = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u is not null and v is not null")
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = cut(one.select(ways.alias("e")).select("e.u", "e.v").distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).withColumn("root", F.least("node", "root"))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").select(F.col("u").alias("node"), F.lit(None).alias("was"), "root")
        seen = labels.select("node", F.col("root").alias("was"), "root").unionByName(near)
        step = seen.groupBy("node").agg(F.max("was").alias("was"), F.min("root").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = cut(step.join(up, "root").select("node", "was", F.least("root", "far").alias("root")))
        labels = step.select("node", "root")
        if step.filter("was <> root").isEmpty():
            return labels
