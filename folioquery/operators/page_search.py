"""Pages against all pages of the other side, scored by fingerprint, without scoring every pair.

Pages with equal fingerprints are one class, so copies are scored once. Query
classes meet page classes block by block. Within a block each score is bounded
from above by its parts: dates, providers and terms are counted first, and the
two word overlaps are at most the smaller over the larger number of words. Only
pages whose bound can still reach the least score, or the k-th best so far, have
the words of their full text counted, and of these only the ones that can still
reach it their preview's. Bounds are never below the score, so the result is that
of scoring every pair. Words are compared by 64-bit hashes.

The best pages are not sought among all pages. Values that few pages hold, and those
that no query holds, are replaced by fillers that match nothing; pages that are equal
then are one signature, and only signatures meet in blocks. A signature's score is that of its
pages that share no rare value with the query, and at most that of the others; these are found
by a join on the rare values and scored one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery import fixed
from folioquery.functions import similarity
from folioquery.functions.columns import once
from folioquery.functions.text import blank
from folioquery.shared import cut, stored

LISTS = ("dates", "providers", "terms")
WORDS = ("preview", "head")
#: Pages whose words are counted together at first; the number doubles twice with each turn.
CHUNK = 256
#: List entries of a block of pages, and pages of it, at most on average.
BLOCK_ENTRIES, BLOCK_PAGES = 2_000_000, 100_000
#: Steps to count a page's own entries for each step that counts the holders of a value.
STEPS = 6
#: Pages that hold a rare value at most, frequent values at most (further ones count as rare), and query values up to which pages are looked up in them first.
RARE, FREQUENT, ASKED = 64, 1_000_000, 4_000_000
#: Tasks of one search.
MOST_TASKS = 20_000
#: Room for rounding between a bound and the score it bounds.
SLACK = 1e-9
FOUND = "query string, page string, score double, compared long, counted long"
PACKED = ", ".join(["p int, names string", *[f"{c}_{k} binary" for c in (*LISTS, *WORDS) for k in ("sizes", "values", "codes", "holders", "first")]])
FOUND_SCHEMA = pa.schema([("query", pa.string()), ("page", pa.string()), ("score", pa.float64()), ("compared", pa.int64()), ("counted", pa.int64())])


def _parts(text: Column) -> Column:
    """What a score reads of a page: five lists without repeats, in one order for equal sets."""
    f = similarity.fingerprint(text)

    def words(t: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != "")))

    def parts(p: Column) -> Column:
        return F.struct(*[F.array_sort(p[c]).alias(c) for c in LISTS], words(p["preview"]).alias("preview"), words(F.substring(p["full"], 1, fixed.FULL_CHARS)).alias("head"))

    return F.get(F.transform(F.array(f), parts), 0)


def _hashed(pages: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    # fingerprints cost far more than the rows, which few small files may hold: they are dealt out first
    rows = pages.filter(~blank(F.col(text))).select(F.col(key).alias("key"), F.col(text).alias("text")).repartition("key")
    rows = once(rows, parts=_parts(F.col("text")))
    hashed = F.struct(*[F.transform(F.col(f"parts.{c}"), lambda w: F.xxhash64(w)).alias(c) for c in (*LISTS, *WORDS)])
    return rows.select("key", *more, hashed.alias("parts"))


def classed(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, class and parts, as hashes, of the pages that have text."""
    return _hashed(pages, key, text, F.sha2(F.to_json("parts"), 256).alias("class")).select("key", "class", "parts")


class _Lists:
    """One part of a block's pages as numbers, with the bounds of every page's list and the pages of every value."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray, codes: np.ndarray, holders: np.ndarray, first: np.ndarray):
        self.sizes, self.values, self.codes, self.holders, self.first = self.columns = (sizes, values, codes, holders, first)
        self.ends = sizes.cumsum()
        self.starts = self.ends - sizes

    @classmethod
    def read(cls, column) -> _Lists:
        """The lists of an Arrow column."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
        values, codes = np.unique(np.asarray(column.flatten()).astype(np.int64), return_inverse=True)
        holders = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[np.argsort(codes, kind="stable")]
        return cls(sizes, values, codes.astype(np.int32), holders, np.concatenate([[0], np.bincount(codes, minlength=len(values)).cumsum()]).astype(np.int64))

    def of(self, row: int) -> np.ndarray:
        """The values of a row."""
        return self.values[self.codes[self.starts[row] : self.ends[row]]]

    def known(self, wanted: np.ndarray) -> np.ndarray:
        """The numbers of the wanted values that some row holds."""
        at = np.searchsorted(self.values, wanted)
        inside = at < len(self.values)
        at, wanted = at[inside], wanted[inside]
        return at[self.values[at] == wanted]

    def shared_by_all(self, known: np.ndarray) -> np.ndarray:
        """How many of the values each row holds, from the rows of each value."""
        held = [self.holders[self.first[i] : self.first[i + 1]] for i in known]
        return np.bincount(np.concatenate(held), minlength=len(self.sizes)) if held else np.zeros(len(self.sizes), np.int64)

    def shared(self, known: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many of the values each of the rows holds, from whichever of rows and values has fewer entries."""
        sizes = self.sizes[rows]
        last = np.cumsum(sizes)
        entries = last[-1] if len(last) else 0
        if len(self.sizes) + (self.first[known + 1] - self.first[known]).sum() < STEPS * entries:
            return self.shared_by_all(known)[rows]
        hit = np.zeros(len(self.values) + 1, np.int64)
        hit[known] = 1
        places = np.repeat(self.starts[rows] - (last - sizes), sizes) + np.arange(entries)
        sums = np.concatenate([[0], np.cumsum(hit[self.codes[places]])])
        return sums[last] - sums[last - sizes]


class _Block:
    """A block's pages: their classes, their lists, and their shapes, which say what of a score depends on sizes only."""

    def __init__(self, names: list[str], parts: dict[str, _Lists]):
        self.names, self.parts = names, parts
        sizes = np.stack([parts[c].sizes > 0 for c in LISTS] + [parts[c].sizes for c in WORDS], 1).astype(np.int64)
        self.shapes, shape = np.unique(sizes @ (1 << np.array([0, 1, 2, 3, 33])), return_index=True, return_inverse=True)[1:]
        self.shapes, self.shape = sizes[self.shapes], shape

    def __len__(self) -> int:
        return len(self.names)


KINDS = {"sizes": np.int64, "values": np.int64, "codes": np.int32, "holders": np.int32, "first": np.int64}


def _packed(block: pa.Table) -> pa.Table:
    """A block's pages as one row, so that it is copied to the blocks of queries as bytes."""
    columns = {"p": block.column("p").slice(0, 1), "names": pa.array(["".join(block.column("class").to_pylist())])}
    for c in (*LISTS, *WORDS):
        columns |= {f"{c}_{k}": pa.array([v.astype(KINDS[k]).tobytes()]) for k, v in zip(KINDS, _Lists.read(block.column(c)).columns)}
    return pa.table(columns)


def _unpacked(row: pa.Table) -> _Block:
    names = row.column("names")[0].as_py()
    parts = {c: _Lists(*[np.frombuffer(row.column(f"{c}_{k}")[0].as_py(), kind) for k, kind in KINDS.items()]) for c in (*LISTS, *WORDS)}
    return _Block([names[i : i + 64] for i in range(0, len(names), 64)], parts)


def _overlap(shared: np.ndarray, mine: int, sizes: np.ndarray) -> np.ndarray:
    """Shared over united words, 0 where a page has none."""
    return np.divide(shared, mine + sizes - shared, out=np.zeros(len(sizes)), where=(sizes > 0) & (mine > 0))


def _turns(rows: np.ndarray, bound: np.ndarray, k: int | None):
    """The rows to count next, those of the greatest bounds first where there is a ``k``; the least score that still counts is sent back."""
    size = CHUNK if k is not None else len(bound)
    while len(rows):
        if len(rows) > size:
            order = np.argpartition(-bound[rows], size)
            rows, rest = rows[order[:size]], rows[order[size:]]
        else:
            rest = rows[:0]
        floor = yield rows
        rows, size = rest[bound[rest] >= floor - SLACK], 4 * size


def _search(query: dict[str, np.ndarray], block: _Block, least: float, k: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of a block that may be among the query's results, their scores, and how many were scored in full."""
    weights, n, parts = fixed.WEIGHTS, len(block), block.parts
    known = {c: parts[c].known(v) for c, v in query.items()}
    asked = np.array([len(query[c]) > 0 for c in LISTS])
    present = (2 + (block.shapes[:, : len(LISTS)] * asked).sum(1))[block.shape]
    most = {c: _overlap(np.minimum(len(query[c]), sizes), len(query[c]), sizes)[block.shape] for c, sizes in zip(WORDS, block.shapes[:, len(LISTS) :].T)}
    before = {c: np.zeros(n) for c in LISTS}
    for c in LISTS:
        shared = parts[c].shared_by_all(known[c])
        rows = np.flatnonzero(shared)
        before[c][rows] = shared[rows] / np.maximum(parts[c].sizes[rows], len(query[c])) * weights[c]

    def score(rows, preview: np.ndarray, head: np.ndarray) -> np.ndarray:
        return (before["dates"][rows] + before["providers"][rows] + preview * weights["preview"] + before["terms"][rows] + head * weights["full"]) / present[rows]

    def overlap(c: str, rows: np.ndarray) -> np.ndarray:
        return _overlap(parts[c].shared(known[c], rows), len(query[c]), parts[c].sizes[rows])

    bound = score(slice(None), most["preview"], most["head"])
    found, scores, floor, counted = [np.empty(0, np.int64)], [np.empty(0)], least, 0
    turns = _turns(np.flatnonzero(bound > least - SLACK), bound, k)
    rows = next(turns, None)
    while rows is not None:
        head = overlap("head", rows)
        open_ = score(rows, most["preview"][rows], head) >= floor - SLACK
        rows, head = rows[open_], head[open_]
        exact = score(rows, overlap("preview", rows), head)
        counted += len(rows)
        found.append(rows[exact > least])
        scores.append(exact[exact > least])
        if k is not None:
            so_far = np.concatenate(scores)
            if len(so_far) >= k:
                floor = max(least, np.partition(so_far, len(so_far) - k)[len(so_far) - k])
        try:
            rows = turns.send(floor)
        except StopIteration:
            rows = None
    rows, exact = np.concatenate(found), np.concatenate(scores)
    reached = exact >= floor
    return rows[reached], exact[reached], counted


def search(ones: DataFrame, pages: DataFrame, least: float, k: int | None, query_rows: int = 4096, page_rows: int | None = None) -> DataFrame:
    """query, page (classes) and score above ``least`` of two tables from ``classed``.

    With ``k`` a query keeps all page classes that score no less than the k-th best of
    a block, so ties are never cut. ``compared`` and ``counted`` are the pages of the
    block and how many of them were scored in full. Blocks hold about ``query_rows`` and
    ``page_rows`` classes (by default what BLOCK_ENTRIES and BLOCK_PAGES allow); a query goes to
    every block of pages and a page to every block of queries. Work grows with the product of
    the *different* texts.
    """
    entries = sum(F.size(f"parts.{c}") for c in (*LISTS, *WORDS))
    (n_q, _), (n_p, held) = (rows.agg(F.count("*"), F.coalesce(F.sum(entries), F.lit(0))).first() for rows in (ones, pages))
    p = max(1, math.ceil(n_p / page_rows) if page_rows else math.ceil(max(held / BLOCK_ENTRIES, n_p / BLOCK_PAGES)))
    # small blocks of queries where there are few of pages, so that all cores have work
    few = math.ceil(4 * ones.sparkSession.sparkContext.defaultParallelism / p)
    q = max(1, math.ceil(n_q / query_rows), min(few, n_q // 32))
    queries, texts = (rows.groupBy("class").agg(F.any_value("parts").alias("parts")) for rows in (ones, pages))
    tasks = min(2 * q * p, MOST_TASKS)  # by number, as blocks are small in bytes and long in work
    own_q, own_p = (F.pmod(F.xxhash64("class"), F.lit(n)).cast("int") for n in (q, p))
    every_q, every_p = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (q, p))
    left = queries.select("class", "parts.*", own_q.alias("q")).withColumn("p", every_p)
    packed = texts.select("class", "parts.*", own_p.alias("p")).repartition(p, "p").groupBy("p").applyInArrow(_packed, PACKED)
    right = packed.withColumn("q", every_q)

    def block(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return FOUND_SCHEMA.empty_table()
        asked, pages_ = {c: _Lists.read(mine.column(c)) for c in (*LISTS, *WORDS)}, _unpacked(theirs)
        results = [_search({c: v.of(i) for c, v in asked.items()}, pages_, least, k) for i in range(mine.num_rows)]
        sizes = np.array([len(rows) for rows, _, _ in results])
        rows, scores = (np.concatenate([r[i] for r in results]) for i in (0, 1))
        of = np.repeat(np.arange(len(sizes)), sizes)
        columns = [mine.column("class").take(of), [pages_.names[i] for i in rows], scores, np.full(len(rows), len(pages_)), np.array([c for _, _, c in results])[of]]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, FOUND_SCHEMA)], schema=FOUND_SCHEMA)

    left, right = (side.repartition(tasks, "q", "p") for side in (left, right))
    return left.groupBy("q", "p").cogroup(right.groupBy("q", "p")).applyInArrow(block, FOUND)


def _every(prefix: str = "parts.") -> Column:
    return F.array_distinct(F.concat(*[f"{prefix}{c}" for c in (*LISTS, *WORDS)]))


def _held(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, values)
    inside = at < len(sorted_)
    inside[inside] = sorted_[at[inside]] == values[inside]
    return inside


def _signed(frequent, asked, filler: int):
    """Lists whose values other than the frequent ones are 1, 2, ... times the filler, and the rare values that are asked for (all, without ``asked``)."""

    def run(batches):
        for batch in batches:
            lists, rare, own = [], [], []
            for c in (*LISTS, *WORDS):
                column = batch.column(c)
                bounds = np.asarray(column.offsets).astype(np.int64)
                values, row = np.asarray(column.flatten()), np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                bounds = bounds - bounds[0]
                known = _held(frequent.value, values)
                # frequent ones first, in their order: equal sets stay equal lists
                order = np.lexsort((values, ~known, row))
                values, known = values[order], known[order]
                wanted = ~known if asked is None else ~known & _held(asked.value, values)
                rare.append(values[wanted])
                own.append(row[wanted])
                lists.append(pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(np.where(known, values, filler * (1 + np.arange(len(values)) - bounds[row])))))
            pairs = np.unique(np.stack([np.concatenate(own), np.concatenate(rare)], 1), axis=0)
            bounds = np.concatenate([[0], np.bincount(pairs[:, 0], minlength=batch.num_rows).cumsum()]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), pa.StructArray.from_arrays(lists, [*LISTS, *WORDS]), pa.ListArray.from_arrays(bounds, pa.array(pairs[:, 1]))], names=["key", "row", "parts", "rare"])

    return run


def _sharing(frequent, asked):
    """The pages that hold a rare value that is asked for."""

    def run(batches):
        for batch in batches:
            signed = next(_signed(frequent, asked, 1)([batch]))
            yield batch.filter(pa.array(np.diff(np.asarray(signed.column("rare").offsets)) > 0))

    return run


def _scored(least: float):
    """Scores above ``least`` of pairs whose lists stand side by side."""
    weights = fixed.WEIGHTS

    def shared(a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, size_ = (np.diff(np.asarray(c.offsets)).astype(np.int64) for c in (a, b))
        values, code = np.unique(np.concatenate([np.asarray(a.flatten()), np.asarray(b.flatten())]), return_inverse=True)
        row, row_ = np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(size)), size_)
        both = np.intersect1d(row * len(values) + code[: len(row)], row_ * len(values) + code[len(row) :], assume_unique=True)
        return np.bincount(both // max(1, len(values)), minlength=len(size)), size, size_

    def run(batches):
        for batch in batches:
            part = {c: shared(batch.column(f"a_{c}"), batch.column(f"b_{c}")) for c in (*LISTS, *WORDS)}
            of = {c: np.where((m > 0) & (n > 0), k / np.maximum(np.maximum(m, n), 1), 0) * weights[c] for c, (k, m, n) in part.items() if c in LISTS}
            words = {c: np.divide(k, m + n - k, out=np.zeros(len(k)), where=(m > 0) & (n > 0)) for c, (k, m, n) in part.items() if c in WORDS}
            present = 2 + sum(((part[c][1] > 0) & (part[c][2] > 0)).astype(np.int64) for c in LISTS)
            score = (of["dates"] + of["providers"] + words["preview"] * weights["preview"] + of["terms"] + words["head"] * weights["full"]) / present
            keep = pa.array(np.flatnonzero(score > least))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(keep) for c in ("one_row", "row", "page")], pa.array(score).take(keep)], names=["one_row", "row", "page", "score"])

    return run


def best_pages(ones: DataFrame, pages: DataFrame, key: str, least: float, k: int) -> DataFrame:
    """key, page, score and rank of the k best pages of every row of ``ones``, ties by page.

    Pages without text are in no result.
    """
    spark = ones.sparkSession
    mine, theirs = (stored(_hashed(rows, key, "text").select("key", F.monotonically_increasing_id().alias("row"), "parts.*")) for rows in (ones, pages))
    words = mine.select(F.explode(_every("")).alias("v")).distinct()
    held = theirs.select(F.explode(_every("")).alias("v")).groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > RARE)
    common = spark.sparkContext.broadcast(np.sort(held.join(words, "v", "left_semi").orderBy(F.desc("n"), "v").limit(FREQUENT).select("v").toArrow().column("v").to_numpy()))
    asked = words.limit(ASKED + 1).select("v").toArrow().column("v").to_numpy()
    asked = spark.sparkContext.broadcast(np.sort(asked)) if len(asked) <= ASKED else None
    lists = ", ".join(f"{c}: array<bigint>" for c in (*LISTS, *WORDS))
    signed, signed_ = (
        rows.mapInArrow(_signed(common, only, filler), f"key {rows.schema['key'].dataType.simpleString()}, row long, parts struct<{lists}>, rare array<bigint>").withColumn("class", F.xxhash64("parts"))
        for rows, only, filler in ((mine, None, -1), (theirs, asked, 1))
    )

    # signatures: the first pages of each in the order of their keys
    first = Window.partitionBy("class").orderBy("key", "row")
    few = cut(signed_.select("class", "key", "row", "parts").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k))
    name = F.sha2(F.col("class").cast("string"), 256).alias("class")
    kinds = cut(signed.groupBy("class").agg(F.any_value("parts").alias("parts")))
    found = search(kinds.select(name, "parts"), few.filter("n = 1").select(name, "parts"), least, k).select("query", "page", "score")
    by_kind = Window.partitionBy("query").orderBy(F.desc("score"), "key", "row")
    far = found.join(few.select(name, "key", "row").withColumnRenamed("class", "page"), "page").withColumn("n", F.row_number().over(by_kind)).filter(F.col("n") <= k)
    far = signed.select(name.alias("query"), F.col("row").alias("one_row")).join(far, "query").select("one_row", "row", F.col("key").alias("page"), "score")

    # pages that share a rare value with the query
    pairs = signed.select(F.col("row").alias("one_row"), F.explode("rare").alias("v")).join(signed_.select("row", F.explode("rare").alias("v")), "v").select("one_row", "row").distinct()
    a = mine.select(F.col("row").alias("one_row"), *[F.col(c).alias(f"a_{c}") for c in (*LISTS, *WORDS)])
    b = theirs.mapInArrow(_sharing(common, asked), theirs.schema).select("row", F.col("key").alias("page"), *[F.col(c).alias(f"b_{c}") for c in (*LISTS, *WORDS)])
    near = pairs.join(a, "one_row").join(b, "row").mapInArrow(_scored(least), far.select("one_row", "row", "page", "score").schema)

    both = far.unionByName(near).groupBy("one_row", "row").agg(F.any_value("page").alias("page"), F.max("score").alias("score"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("one_row").orderBy(F.desc("score"), "page", "row"))).filter(F.col("rank") <= k)
    return ranked.join(mine.select(F.col("row").alias("one_row"), F.col("key").alias("one")), "one_row").select("one", "page", "score", "rank")


def pages_above(ones: DataFrame, pages: DataFrame, key: str, least: float) -> DataFrame:
    """key, page and score of every other page above ``least``, for every row of ``ones``; copies are expanded, as each is an answer."""
    mine, theirs = cut(classed(ones, key)), cut(classed(pages, key))
    found = search(mine, theirs, least, None).select("query", "page", "score")
    members = theirs.select(F.col("class").alias("page"), F.col("key").alias("physical"))
    own = mine.select(F.col("class").alias("query"), F.col("key").alias("one"))
    return found.join(own, "query").join(members, "page").filter(F.col("physical") != F.col("one")).select("one", F.col("physical").alias("page"), "score")

