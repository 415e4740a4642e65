"""Line machines over documents of any length.

A document's lines are dealt in ranges, and a window holds one range, not one
document. What a machine has to know from elsewhere reaches a range in three ways: the
next few lines as copies (``ahead``); the state that earlier ranges leave behind, from
a summary of each range for every state it may be entered in; and the next line of a
kind, from the first such line of later ranges. Summaries are one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a range.
LINES = 50_000


def by_line(down: bool = False):
    """A range's lines, or its later lines first."""
    return Window.partitionBy("doc_id", "range").orderBy(F.desc("n") if down else "n")


def by_range(down: bool = False):
    """A document's ranges."""
    return Window.partitionBy("doc_id").orderBy(F.desc("range") if down else "range")


def ranged(lines: DataFrame, size: int = LINES, ahead: int = 0) -> DataFrame:
    """``lines`` (doc_id, n and more) with their range, and copies of the ``ahead`` lines that follow it."""
    first = F.floor(F.greatest(F.col("n") - ahead, F.lit(0)) / size).cast("int")
    mine = F.floor(F.col("n") / size).cast("int")
    rows = lines.withColumn("range", F.explode(F.sequence(first, mine)))
    return rows.withColumn("copied", F.col("range") < mine)


def next_lines(rows: DataFrame, size: int, ahead: int, **kinds: Column) -> DataFrame:
    """For each kind the number of the first such line from this one on; ``last`` is the document's last range.

    ``rows`` come from ``ranged`` with the same ``ahead``, at most ``size``.
    """
    rows = rows.withColumns({f"is_{k}": F.when(c, F.col("n")) for k, c in kinds.items()})
    own, late = ~F.col("copied"), F.col("n") % size >= ahead
    firsts = [F.min(F.when(own & c, F.col(f"is_{k}"))).alias(f"{a}_{k}") for k in kinds for a, c in (("any", F.lit(True)), ("late", late))]
    ranges = rows.groupBy("doc_id", "range").agg(*firsts)
    # behind the copies: the next range from where they end, then any later range
    later = by_range(True).rowsBetween(Window.unboundedPreceding, -2)
    beyond = {f"beyond_{k}": F.coalesce(F.lead(f"late_{k}").over(by_range()), F.min(f"any_{k}").over(later)) for k in kinds}
    carried = ranges.withColumns(beyond | {"last": F.max("range").over(Window.partitionBy("doc_id"))}).select("doc_id", "range", "last", *beyond)
    down = by_line(True).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({k: F.min(f"is_{k}").over(down) for k in kinds}).drop(*[f"is_{k}" for k in kinds])
    met = found.join(carried, ["doc_id", "range"])
    return met.withColumns({k: F.coalesce(k, f"beyond_{k}") for k in kinds}).drop(*beyond)
