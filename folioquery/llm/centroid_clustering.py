"""Exact k-means in whole numbers, with the sort-means bound.

Every round orders, for each centroid, the others by their distance from it. A
vector starts at the centroid it was assigned to and tries the others in that
order; beyond twice its distance none can be nearer or as near, so it stops there.

Defined results: vectors are kept that have ``dims`` components, none null or
non-finite; repeated rows and rows that share an id each count; a row without an
id is assigned, but is no first centroid. Equal seeds are ordered by their
vectors. With fewer kept vectors than ``k`` there are fewer centroids; with none
the result is empty. A component whose whole number would let a squared distance
leave a long (``limit``) is an error, not a wrong result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm._spark import cut

STATE = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("scanned", pa.int64())])
STATE_DDL = "vec_id long, v array<int>, cluster int, distance long, scanned long"
#: Rounds after which lineage is cut.
CUT_EVERY = 8


def limit(dims: int) -> int:
    """Components below it keep four squared distances of ``dims`` components within a long."""
    return 1 << (59 - max(0, dims - 1).bit_length()) // 2


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and the whole numbers ``floor(scale * x)`` of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(F.size("embedding") == dims).filter(finite)

    def whole(x):
        y = F.floor(scale * x.cast("double"))
        return F.when(F.abs(scale * x.cast("double")) < limit(dims), y).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below {limit(dims)}"))).cast("int")

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten()).reshape(-1, dims).astype(np.int64)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, start: np.ndarray, centroids: np.ndarray, gaps: np.ndarray, turns: np.ndarray):
    """Of each row the nearest centroid (of equals the first), its squared distance and the distances computed."""
    cluster, distance, scanned = start.copy(), np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
    for c in np.unique(start):
        at = np.flatnonzero(start == c)
        rows, first = x[at], _far(x[at], centroids[c])
        best, who, live = first.copy(), np.full(len(at), c), np.arange(len(at))
        for j in turns[c]:
            live = live[gaps[c, j] <= 4 * first[live]]
            if not len(live):
                break
            far = _far(rows[live], centroids[j])
            better = (far < best[live]) | ((far == best[live]) & (j < who[live]))
            best[live[better]], who[live[better]] = far[better], j
            scanned[at[live]] += 1
        cluster[at], distance[at] = who, best
    return cluster, distance, scanned


def _assign(centroids: np.ndarray):
    """A task's part of a round: new assignments from the present ones."""

    def run(batches):
        gaps = np.stack([_far(centroids, c) for c in centroids])
        apart = gaps.copy()
        np.fill_diagonal(apart, -1)
        turns = np.argsort(apart, 1, kind="stable")[:, 1:]
        for batch in batches:
            if batch.num_rows:
                start = np.asarray(batch.column("cluster")).astype(np.int64)
                cluster, distance, scanned = nearest(_matrix(batch, centroids.shape[1]), start, centroids, gaps, turns)
                scanned = scanned + np.asarray(batch.column("scanned"))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v").cast(pa.list_(pa.int32())), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(scanned)], schema=STATE)

    return run


def _sums(k: int, dims: int):
    """A task's number of vectors and sums of components by cluster."""

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            cluster = np.asarray(batch.column("cluster"))
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, _matrix(batch, dims))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.column_stack([count, total])[at].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    return run


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids as the floors of their vectors' means; those without vectors stay. k times dims sums reach the driver."""
    k, dims = centroids.shape
    parts = state.select("v", "cluster").mapInArrow(_sums(k, dims), "cluster int, sums array<long>")
    sums = parts.select("cluster", F.posexplode("sums").alias("at", "sum")).groupBy("cluster", "at").agg(F.sum(F.col("sum").cast("decimal(28,0)")).alias("sum"))
    found = {(r["cluster"], r["at"]): int(r["sum"]) for r in sums.collect()}
    out = centroids.copy()
    for c in {c for c, _ in found}:
        out[c] = [found[c, i + 1] // found[c, 0] for i in range(dims)]
    return out


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid and scanned of every kept vector.

    ``scanned`` counts the distances computed for a vector over all rounds. Vectors never
    move: a round is a map over the last one's state, which is kept on the executors
    with its lineage, so that lost ones are computed again. The result rests on a
    checkpoint of four numbers a vector.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, dims, scale)
    named = rows.filter("vec_id is not null").withColumn("turn", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    centroids = np.array([r["v"] for r in named.orderBy("turn", "v").limit(k).collect()], np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, scanned long")
    state, before = rows.select("*", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("scanned")), None
    for i in range(rounds):
        state = state.mapInArrow(_assign(centroids), STATE_DDL)
        state = (cut(state) if i % CUT_EVERY == CUT_EVERY - 1 else state).persist()
        centroids = moved(state, centroids)
        if before is not None:
            before.unpersist()
        before = state
    last = cut(state.mapInArrow(_assign(centroids), STATE_DDL).drop("v"))
    if before is not None:
        before.unpersist()
    own = {r["cluster"]: int(r["s"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}
    table = [(c, s, sum(own.values()), centroids[c].tolist()) for c, s in own.items()]
    found = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    out = last.join(F.broadcast(found), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "scanned")
