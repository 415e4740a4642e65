"""How five document filters interact: what each removes at every place of every order.

A document's failures are a mask of five bits. A table of 32 masks by 120 orders
names the step that removes it, so one pass over the masks tells every order.

Defined results: a null text is empty; a null part is the empty string; words
are maximal runs of anything but the six ASCII blanks. A row without an id is no
copy of another and has no label. Rows that share an id and a text are not copies
of each other (no id is smaller). Where labels repeat an id, a mark in any row
counts. An empty table has no parts and gives no rows. Columns besides those
named are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm._spark import cut, spread_join

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts that a task counts before it hands on what it has.
HELD_PARTS = 512

SUMS = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in COUNTS]])
SUMS_DDL = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def orders(n: int = len(FILTERS)) -> np.ndarray:
    """Every order of n filters, one a row."""
    return np.array(list(permutations(range(n))))


def first_failures(n: int = len(FILTERS)) -> np.ndarray:
    """masks by orders: the step (from 0) whose filter removes a document, n where none does."""
    fails = (np.arange(1 << n)[:, None, None] >> orders(n)[None]) & 1
    return np.where(fails.any(2), fails.argmax(2), n)


def text_failures(text) -> F.Column:
    """Bits 0 to 3: under 200 words, few distinct words, many capitals, marks of code or tables."""
    blank = "\t\n\x0b\x0c\r"
    words = F.array_remove(F.split(F.translate(text, blank, " " * len(blank)), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum(t.cast("int") * (1 << i) for i, t in enumerate(tests))


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask and reading task of every document; bit 4 marks copies of a smaller id's text.

    Texts are read once and leave the scan as 32 bytes of digest. Least ids are taken
    before the shuffle, and only texts under several ids are joined back, salted by task.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = cut(docs.select("doc_id", F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"), F.spark_partition_id().alias("task")))
    shared = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    return spread_join(rows, shared, "digest", "task", "left").select("doc_id", "part", (F.col("mask") + copy * 16).alias("mask"), "task")


def _removals(seen: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """COUNTS for one part, orders by steps, of ``seen``: labels (0, good, toxic, both) by masks."""
    masks, n = len(table), len(FILTERS)
    order = orders()
    place = np.arange(len(order)) * (n + 1) + table

    def at_steps(weights: np.ndarray) -> np.ndarray:
        spread = np.broadcast_to(weights[:, None], table.shape)
        return np.bincount(place.ravel(), spread.ravel(), len(order) * (n + 1)).astype(np.int64).reshape(-1, n + 1)

    everyone, good, toxic = at_steps(seen.sum(0)), at_steps(seen[1] + seen[3]), at_steps(seen[2] + seen[3])
    removed, bits = everyone[:, :n], (np.arange(masks)[:, None] >> np.arange(n)) & 1
    fails = (seen.sum(0)[:, None] * bits).sum(0)
    alone = seen.sum(0)[1 << np.arange(n)]
    total = np.zeros(n, np.int64)
    np.add.at(total, order.ravel(), removed.ravel())
    kept = seen.sum() - removed.cumsum(1)
    return [kept, removed, fails[order] - removed, alone[order], good[:, :n], toxic[:, :n], total[order]]


def _audit(batches):
    table, held = first_failures(), {}
    names = ["".join(FILTERS[i] for i in o) for o in orders()]
    n, masks = len(FILTERS), len(table)

    def handed():
        for part, seen in held.items():
            columns = [pa.array(c.ravel(), pa.int64()) for c in _removals(seen, table)]
            steps = pa.array(np.tile(np.arange(1, n + 1), len(names)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps)), pa.array(np.repeat(names, n)), steps, *columns], schema=SUMS)
        held.clear()

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        label = np.asarray(batch.column("good")).astype(np.int64) + 2 * np.asarray(batch.column("toxic"))
        code = (np.asarray(parts.indices) * 4 + label) * masks + np.asarray(batch.column("mask"))
        counts = np.bincount(code, minlength=len(parts.dictionary) * 4 * masks).reshape(-1, 4, masks)
        for part, seen in zip(parts.dictionary.to_pylist(), counts):
            held[part] = held.get(part, 0) + seen
        if len(held) > HELD_PARTS:
            yield from handed()
    yield from handed()


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step and COUNTS of every part, order of the filters and step.

    Tasks count masks by part and label and look all orders up in one table; what is
    shuffled is 600 sums a part and task.
    """
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = spread_join(failures(docs, part), marks, "doc_id", "task", "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    sums = marked.mapInArrow(_audit, SUMS_DDL).groupBy("part", "filter_order", "step")
    return sums.agg(*[F.sum(c).alias(c) for c in COUNTS])
