"""Mixing sources to target weights by hash-threshold histograms (operator 10).

Sizes are summed by source and hash bucket. Per source a running sum over the
buckets finds the one in which the budget runs out; only that bucket is
histogrammed again by the next bits, until its cell holds the rows of about one
document. A document is then kept by comparing its hash with its source's
threshold. Two more turns, with other hashes, spend what is left below the
boundary document on documents that fit into it. Nothing is sorted, and every
pass is one partial aggregation, so a source with a third of all rows costs each
task at most one row a bucket.

Defined results: a null or blank text has size 0; null sources form one source,
last in order; rows with equal ids and texts share a hash and are taken or left
together, other rows (those without an id, say) are told apart by their text;
sources of size 0 have target 0; an empty table gives no rows; further columns
are not read. The hash depends on ``doc_id``, ``text`` and ``seed`` only, so reruns
agree. Only the table of sources, a row each, is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.llm._spark import cut

#: The weights, repeated over the sources in order.
WEIGHTS = (5, 2, 1)
LEVEL_BITS, LEVELS = 12, 3
BROADCAST_SOURCES = 100_000
TURNS = 3
WORD = r"[^\x20\x09-\x0D]+"


def _bits(h: Column, levels: int) -> Column:
    return F.shiftrightunsigned(h, 64 - LEVEL_BITS * levels)


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> with target: weight shares of ``share`` times all
    sizes, none above ``cap`` times its source, the excess shared again by weight.

    Sources by cap over weight: the first k are capped, where k is the least
    for which the level left for the others is below the next one's cap. This
    is what repeated resharing comes to, without iterating.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    every = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("total", share * F.sum("source_size").over(every)).withColumn("level", (F.col("total") - capped) / left)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(every)
    level = first["level"]
    return s.withColumn("at", level).select("source", "source_size", F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("at") * F.col("w"))).alias("target"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def plan_mix(sized: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """A row a source: its key, sizes, whole copies, and the threshold below which a hash brings one more.

    ``sized`` has source, size and h, and is read once a level.
    """
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", times.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = cut(plan.withColumn("key", _key(F.col("source"))))
    rows = sized.select(_key(F.col("source")).alias("key"), "size", "h")
    plan = plan.withColumn("left0", F.col("rest"))
    for turn in range(TURNS):
        open_ = rows if turn == 0 else _join_plan(rows, plan).filter(~_extra(turn, F.col("h"), last=False) & (F.col("size") <= F.col(f"left{turn}"))).select("key", "size", "h")
        edge = _edge(open_.withColumn("h", _turned(F.col("h"), turn)), plan.select("key", F.col(f"left{turn}").alias("rest")))
        plan = plan.join(edge, "key", "left")
        plan = plan.withColumn(f"path{turn}", F.coalesce("path", F.lit(1 << LEVEL_BITS * LEVELS))).withColumn(f"left{turn + 1}", F.col(f"left{turn}") - F.coalesce("below", F.lit(0.0)))
        plan = cut(plan.withColumn("over", F.coalesce(F.col("upto") - F.col(f"left{turn}") < F.col(f"left{turn}") - F.col("below"), F.lit(False))).drop("path", "below", "upto"))
    return plan.drop("source")


def _turned(h: Column, turn: int) -> Column:
    return h if turn == 0 else F.xxhash64(h, F.lit(turn))


def _edge(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the cell in which its budget runs out, and the sums below it and up to it; no row where all fit."""
    edge = budgets.select("key", "rest", F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("path"))
    for level in range(1, LEVELS + 1):
        # rows meet their source's boundary bucket only, of one document in 2**LEVEL_BITS, never the whole source
        inside = rows if level == 1 else rows.withColumn("path", _bits(F.col("h"), level - 1)).join(edge.select("key", "path"), ["key", "path"])
        cells = inside.groupBy("key", _bits(F.col("h"), level).alias("cell")).agg(F.sum("size").alias("in_cell")).join(edge.select("key", "rest", "below"), "key")
        run = F.sum("in_cell").over(Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("upto", F.col("below") + run).filter(F.col("upto") > F.col("rest"))
        edge = cells.groupBy("key").agg(F.min(F.struct("cell", "rest", (F.col("upto") - F.col("in_cell")).alias("below"), "upto")).alias("e"))
        edge = edge.select("key", "e.rest", "e.below", F.col("e.cell").alias("path"), "e.upto")
    return edge.select("key", "path", "below", "upto")


def _extra(turns: int, h: Column, last: bool = True) -> Column:
    """Whether one of the first turns takes a document."""
    out = F.lit(False)
    for turn in range(turns):
        cell = _bits(_turned(h, turn), LEVELS)
        under = cell < F.col(f"path{turn}")
        if last and turn == turns - 1:
            under = under | ((cell == F.col(f"path{turn}")) & F.col("over"))
        out = out | (under & (F.col("size") <= F.col(f"left{turn}")) if turn else under)
    return out


def _join_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Up to BROADCAST_SOURCES rows of the plan are broadcast, more are joined by key."""
    return rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan, "key")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (with key, size and mix_h) and their source's plan, with copies and taken."""
    extra = F.when((F.col("rest") > 0) & _extra(TURNS, F.col("mix_h")), 1).otherwise(0)
    out = _join_plan(rows, plan).withColumn("copies", (F.col("whole") + extra).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(docs["doc_id"], docs["source"], size.alias("size"), F.xxhash64(docs["doc_id"], docs["text"], F.lit(seed)).alias("h"))


def mix_sources(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies and taken."""
    sized = cut(_sized(docs, seed))
    rows = sized.withColumn("key", _key(F.col("source"))).withColumnRenamed("h", "mix_h")
    return _taken(rows, plan_mix(sized, share, cap, weights)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def take_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """The documents that the mix takes, with all their columns and mix_size, mix_copies and mix_taken.

    Columns of ``docs`` that have these names are replaced.
    """
    plan = plan_mix(cut(_sized(docs, seed)), share, cap, weights)
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), size.alias("size"), _key(docs["source"]).alias("key"), F.xxhash64(docs["doc_id"], docs["text"], F.lit(seed)).alias("mix_h"))
    own = [c for c in docs.columns if c.lower() not in ("mix_size", "mix_copies", "mix_taken")]
    out = _taken(rows, plan).filter("copies > 0")
    return out.select(*[F.col("doc").getField(c).alias(c) for c in own], F.col("size").alias("mix_size"), F.col("copies").alias("mix_copies"), F.col("taken").alias("mix_taken"))
