"""Exact top-k search by multi-resolution segment statistics (operator 6).

Vectors are scaled to integers. Cut into segments of length l with means m and
deviations s, two vectors obey  q.x <= sum l * (mq*mx + sq*sx),  that is, their
distance is at least sum l * ((mq-mx)^2 + (sq-sx)^2). The bound is computed on
1, 4, 16, ... segments; after each level only what can still beat a query's
k-th best score goes on, and the survivors get exact products.

Both sides are packed into blocks and dealt to a grid of cells, query shares by
candidate shares, by an equality join on the cell. The grid's sides follow the
two tables' counts, so that what is sent is least. Within a cell

* candidates are split at medians of their segment means into short blocks of
  alike vectors; a block's box (least and greatest mean, greatest deviation of
  each segment) bounds all its vectors at once, and a query leaves blocks whole;
* the rest are refined level by level with matrix products over the queries and
  candidates that still have an open pair, best blocks first;
* survivors' products are one matrix product, of which a partial sort keeps k.

Floors come before the cells: every query is compared exactly with one seed
block of at most ``seed_rows`` candidates (broadcast, a bounded sample that
decides nothing but how early pairs are dropped). No pair leaves its task; a cell
returns at most k rows and the query's own copies, and one aggregation takes
the k best of all cells.

Defined results: vectors that are null or empty or hold null or non-finite
components, rows with a null id, and pairs of different length take no part.
Rows are told apart by id and vector: rows that share an id but not the vector
are queries and candidates of their own; of a query's rows with equal id and
vector one is its own and no candidate, the others are. A query row that occurs
m times is returned m times. Ties go to the smaller id; empty tables give no
rows; further columns are not read. Products are exact: in doubles while they
stay below 2**53, else as Python integers; a score beyond 64 bits is an error.
Vectors under one id are told apart by a 64-bit hash of theirs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquery.llm._spark import parts

FOUND = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("copies", pa.int64()), ("own", pa.bool_()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "query_id long, query_key long, copies long, own boolean, vec_id long, score long"
PACK_DDL = "dim int, ids binary, keys binary, copies binary, floors binary, vectors binary"
BLOCK, SHORT = 2048, 128


def _valid(batch: pa.RecordBatch, scale: int):
    """Row numbers of valid vectors and their scaled integers, by length."""
    col = batch.column("embedding").cast(pa.large_list(pa.float64()))
    ids = batch.column("vec_id").cast(pa.int64())
    length = np.array(col.value_lengths().fill_null(0), np.int64)
    ok = (length > 0) & np.array(ids.is_valid())
    flat = col.flatten()
    good = np.array(flat.is_valid())
    x = np.array(flat.fill_null(0.0))
    good &= np.isfinite(x)
    at = np.concatenate(([0], np.cumsum(length)))
    bad = np.concatenate(([0], np.cumsum(~good)))
    ok &= bad[at[1:]] == bad[at[:-1]]
    for dim in np.unique(length[ok]):
        rows = np.flatnonzero(ok & (length == dim))
        yield int(dim), rows, np.floor(x[at[rows][:, None] + np.arange(dim)] * scale) + 0.0


def _packed(scale: int, width: int, k: int, seeds: list[tuple[int, bytes, bytes, bytes]] | None = None):
    """Blocks of at most ``width`` valid vectors of one length; with seeds, each query's floor."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            ids = np.array(batch.column("vec_id").cast(pa.int64()).fill_null(0))
            keys = np.array(batch.column("key").cast(pa.int64()))
            copies = np.array(batch.column("copies").cast(pa.int64())) if "copies" in names else np.ones(len(ids), np.int64)
            for dim, rows, x in _valid(batch, scale):
                for s in range(0, len(rows), width):
                    r, v = rows[s : s + width], x[s : s + width]
                    floor = _floors(ids[r], keys[r], v, seeds, k) if seeds is not None else np.zeros(0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (ids[r], keys[r], copies[r], floor, v))],
                        names=["dim", "ids", "keys", "copies", "floors", "vectors"],
                    )

    return run


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b; of Python integers where doubles are too short."""
    if _short(a, b):
        return a @ b.T
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T


def _short(a: np.ndarray, b: np.ndarray) -> bool:
    return max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0))) * a.shape[1] < 2**53


def _floors(ids, keys, q, seeds, k) -> np.ndarray:
    """The k-th best score of each query among the seeds, its own row left out."""
    floor = np.full(len(q), -np.inf)
    for dim, s_ids, s_keys, s_x in seeds:
        if dim != q.shape[1]:
            continue
        x = np.frombuffer(s_x, np.float64).reshape(-1, dim)
        own = (ids[:, None] == np.frombuffer(s_ids, np.int64)) & (keys[:, None] == np.frombuffer(s_keys, np.int64))
        score = np.where(own, -np.inf, _exact(q, x).astype(float))
        if score.shape[1] >= k:
            best = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
            floor = np.maximum(floor, best if _short(q, x) else best - np.abs(best) * 1e-9)
    return floor


def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weighted means and deviations for 1, 4, 16, ... segments, as rows ready for products."""
    out, n, dim = [], 1, x.shape[1]
    while n <= max(1, dim // 4):
        edges = np.linspace(0, dim, n + 1).astype(int)
        size = np.diff(edges)
        mean = np.add.reduceat(x, edges[:-1], axis=1) / size
        square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
        root = np.sqrt(size)
        out.append((mean * root, np.sqrt(np.maximum(square - mean * mean, 0)) * root))
        n *= 4
    return out


def _room(bound: np.ndarray) -> np.ndarray:
    """A bound that rounding cannot bring below the true one."""
    return bound + np.abs(bound) * 1e-9 + 1e-3


def box_bounds(q: list, x: list, level: int) -> np.ndarray:
    """Bound of each query with every vector of a block, from the block's box."""
    (qm, qs), (xm, xs) = q[level], x[level]
    return _room(np.maximum(qm, 0) @ xm.max(0) + np.minimum(qm, 0) @ xm.min(0) + qs @ xs.max(0))


class Search:
    """One block of queries against the blocks of a cell; counts what each step leaves."""

    def __init__(self, ids, keys, q, floor, k):
        self.ids, self.keys, self.q, self.k, self.levels = ids, keys, q, k, _levels(q)
        self.floor = floor.copy()
        self.score = np.full((len(q), k), -np.inf)
        self.whole = None  # exact scores where doubles are too short
        self.at = np.zeros((len(q), k), np.int64)
        self.own: list[tuple[int, int, int]] = []
        self.seen = {"pairs": 0, "boxed": 0, "exact": 0}

    def add(self, ids, keys, x, levels) -> None:
        self.seen["pairs"] += len(self.q) * len(x)
        rows = np.arange(len(self.q))
        for i in range(len(self.levels)):
            rows = rows[box_bounds([(m[rows], s[rows]) for m, s in self.levels], levels, i) >= self.floor[rows]]
        self.seen["boxed"] += (len(self.q) - len(rows)) * len(x)
        if not len(rows):
            return
        cols = np.arange(len(x))
        for (qm, qs), (xm, xs) in zip(self.levels, levels):
            open_ = _room(qm[rows] @ xm[cols].T + qs[rows] @ xs[cols].T) >= self.floor[rows, None]
            r, c = open_.any(1), open_.any(0)
            rows, cols, open_ = rows[r], cols[c], open_[np.ix_(r, c)]
            if not len(rows):
                return
        self.seen["exact"] += int(open_.sum())
        score = _exact(self.q[rows], x[cols])
        same = (self.ids[rows, None] == ids[cols]) & (self.keys[rows, None] == keys[cols])
        for a, b in zip(*np.nonzero(same)):
            self.own.append((int(rows[a]), int(ids[cols[b]]), int(score[a, b])))
        if score.dtype == object:
            self._long(rows, ids[cols], score, open_ & ~same)
        else:
            self._merge(rows, ids[cols], np.where(open_ & ~same, score, -np.inf))

    def _merge(self, rows, ids, score) -> None:
        """Keeps the k best of what is held and a block's scores, ties to the smaller id."""
        k = self.k
        better = (score >= self.score[rows, -1][:, None]).any(1) & np.isfinite(score).any(1)
        rows, score = rows[better], score[better]
        if not len(rows):
            return
        score, ids = np.concatenate([self.score[rows], score], 1), np.concatenate([self.at[rows], np.broadcast_to(ids, score.shape)], 1)
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        few = (score >= edge[:, None]) & np.isfinite(score)
        r, c = np.nonzero(few)
        s, i = score[r, c], ids[r, c]
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        r, s, i, rank = r[rank < k], s[rank < k], i[rank < k], rank[rank < k]
        held, at = np.full((len(rows), k), -np.inf), np.zeros((len(rows), k), np.int64)
        held[r, rank], at[r, rank] = s, i
        self.score[rows], self.at[rows] = held, at
        self.floor[rows] = np.maximum(self.floor[rows], held[:, -1])

    def _long(self, rows, ids, score, open_) -> None:
        if self.whole is None:
            self.whole = [[] for _ in self.q]
        for a, r in enumerate(rows):
            have = self.whole[r] + [(-int(score[a, b]), int(ids[b])) for b in np.flatnonzero(open_[a])]
            self.whole[r] = sorted(have)[: self.k]
            if len(self.whole[r]) == self.k:
                worst = float(-self.whole[r][-1][0])
                self.floor[r] = max(self.floor[r], worst - abs(worst) * 1e-9)

    def found(self) -> list[tuple[int, bool, int, int]]:
        """(query row, own copy, vec_id, score); of own copies k + 1 at most, as one is the query's."""
        out = [(int(r), False, int(self.at[r, j]), int(self.score[r, j])) for r, j in zip(*np.nonzero(np.isfinite(self.score)))]
        out += [(r, False, i, -s) for r, have in enumerate(self.whole or ()) for s, i in have]
        many: dict[int, int] = {}
        for r, i, s in self.own:
            many[r] = many.get(r, 0) + 1
            if many[r] <= self.k + 1:
                out.append((r, True, i, s))
        return out


def _alike(means: np.ndarray) -> list[np.ndarray]:
    """Rows split at the median of the widest segment until ``SHORT`` are left."""
    todo, out = [np.arange(len(means))], []
    while todo:
        at = todo.pop()
        if len(at) <= SHORT:
            out.append(at)
            continue
        half = len(at) // 2
        cut = np.argpartition(means[at, np.argmax(means[at].var(0))], half)
        todo += [at[cut[:half]], at[cut[half:]]]
    return out


def _blocks(candidates: pa.Table) -> list[tuple]:
    """Short blocks of a cell's candidates, alike vectors together, longest vectors first."""
    out = []
    dims = np.array(candidates["dim"].to_pylist(), np.int64)
    for dim in np.unique(dims):
        part = candidates.filter(pa.array(dims == dim))
        ids, keys = (np.concatenate([np.frombuffer(b, np.int64) for b in part[c].to_pylist()]) for c in ("ids", "keys"))
        x = np.concatenate([np.frombuffer(b, np.float64) for b in part["vectors"].to_pylist()]).reshape(-1, dim)
        for at in _alike(_levels(x)[-1][0]):
            out.append((int(dim), ids[at], keys[at], x[at], _levels(x[at])))
    return sorted(out, key=lambda b: -float((b[3] * b[3]).sum(1).max()))


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return FOUND.empty_table()
        blocks, out = _blocks(candidates), []
        for dim, *raw in zip(*(queries[c].to_pylist() for c in ("dim", "ids", "keys", "copies", "floors", "vectors"))):
            ids, keys, copies = (np.frombuffer(b, np.int64) for b in raw[:3])
            one = Search(ids, keys, np.frombuffer(raw[4], np.float64).reshape(-1, dim), np.frombuffer(raw[3], np.float64), k)
            for d, *block in blocks:
                if d == dim:
                    one.add(*block)
            out += [(int(ids[r]), int(keys[r]), int(copies[r]), own, i, s) for r, own, i, s in one.found()]
        columns = list(zip(*out)) if out else [[]] * len(FOUND)
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, FOUND)], schema=FOUND)

    return run


def _grid(queries: int, candidates: int, cells: int) -> tuple[int, int]:
    """Sides of the grid, queries by candidates, for which the copies that are sent are fewest."""
    wide = min(cells, max(1, round(math.sqrt(cells * candidates / max(1, queries)))))
    return max(1, cells // wide), wide


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, scale: int = 256, seed_rows: int = 4096, seed_bytes: int = 8 << 20) -> DataFrame:
    """query_id, rank, vec_id and score of each query row's k best inner products.

    Floors are seeded by the first ``seed_rows`` candidates, of at most ``seed_bytes`` together.
    """
    n = parts(vectors.sparkSession)
    key = F.xxhash64("vec_id", "embedding").alias("key")
    cand = vectors.select("vec_id", "embedding", key)
    asked = queries.filter("vec_id is not null and embedding is not null").groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")).select("vec_id", "embedding", "copies", key)
    seeds, room = [], seed_bytes
    for r in cand.limit(seed_rows).mapInArrow(_packed(scale, BLOCK // 4, k), PACK_DDL).toLocalIterator():
        room -= len(r["vectors"])
        if room < 0:
            break
        seeds.append((r["dim"], bytes(r["ids"]), bytes(r["keys"]), bytes(r["vectors"])))
    tall, wide = _grid(queries.count(), vectors.count(), 2 * n)
    packed = cand.mapInArrow(_packed(scale, BLOCK, k), PACK_DDL)
    packed = packed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(tall - 1)))).withColumn("j", F.pmod(F.xxhash64("ids", "keys"), F.lit(wide)).cast("int"))
    blocks = asked.mapInArrow(_packed(scale, 256, k, seeds), PACK_DDL)
    blocks = blocks.withColumn("i", F.pmod(F.xxhash64("ids", "keys"), F.lit(tall)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    cell = (F.col("i") * wide + F.col("j")).alias("cell")
    left, right = (d.select("*", cell).repartition(n, "cell").groupBy("cell") for d in (blocks, packed))
    found = left.cogroup(right).applyInArrow(_search(k), FOUND_DDL)
    # of a query's own copies one is the row itself; the limit by group cuts each cell's rows before the shuffle
    row = Window.partitionBy("query_id", "query_key")
    first = F.row_number().over(row.orderBy(F.desc("own"), F.desc("score"), "vec_id"))
    found = found.withColumn("n", first).filter("not own or n > 1")
    found = found.withColumn("rank", F.row_number().over(row.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
