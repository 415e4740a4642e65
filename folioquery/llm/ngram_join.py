"""N-gram Jaccard join by a blocked sparse product (operator 5).

Documents are rows, word n-grams columns; an entry of the product of this
matrix with its transpose is the overlap of two documents, and two documents
link when 100 * overlap >= threshold * union. Only entries that can reach the
bound are formed:

1. Documents with equal n-gram sets are one row (a class), named by a 128-bit
   hash of the set.
2. n-gram frequencies are counted over all documents and sent back to the
   batches. With columns in order of frequency, two classes that link share a
   column among the first ``size - ceil(threshold * size) + 1`` of either; a
   class whose first columns nobody else has is finished here.
3. Columns with up to ``SMALL`` classes yield all their pairs, larger ones the
   pairs with their most central class only. Pairs outside the size bound go.
   The rest are entries of the product that are formed block by block: a block
   of rows meets each class that one of them is paired with once.
4. Components of these links are formed. A large column all of whose classes
   are in one component needs no more. The others' classes form families, cut
   into blocks; every block of classes outside the family's largest component
   is multiplied with every block of the family, and only pairs of components
   that link are returned, each once. They are the edges of a smaller graph, whose
   components are the whole ones. So a group of near copies is never expanded
   into pairs, no component is lost, and a task holds two blocks.
5. Links lie within components. The blocks of each component are multiplied
   with one another, and a block returns for each class the number of documents
   it links to, never the pairs. This step is quadratic in the different texts
   of one component, as their links are; copies of a text count once.

Blocks are cut by weight (n-grams and a constant a row), so that long texts make
smaller ones. Columns, families and components that hold many classes are joined
with their facts in salted parts, by a hash of the class; the rounds that find
components leave a skewed join to adaptive execution.

Defined results: a document without words (or a null text) has size 0, no links
and its own id as component; shorter than ``n`` words, its whole sequence is its
one n-gram; rows with equal ids are separate documents; a null id takes the least
id of its component, or null; an empty table gives no rows; further
columns are not read. Sets are compared by 64-bit n-gram hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm._arrays import SLICE_BYTES, SPACED, U64, each_slice, mix, planes, prefix_hash, rolling, run_hash, unplanes, utf8
from folioquery.llm._spark import batched, bucket_bits, cut, parts, spread_join
from folioquery.llm.components import components

SMALL = 8
GRAM_BITS = 24
ROW_WEIGHT = 8192
BLOCK_WEIGHT = 512 * ROW_WEIGHT


def _sets(words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes in order by document, with the documents' offsets; and their number of words."""
    values = words.hashes()
    prefix = prefix_hash(values)
    h = rolling(prefix, n)
    ok = words.whole(n, len(h))
    owner = np.repeat(np.arange(len(words.doc) - 1), np.diff(words.doc))
    doc, h = owner[: len(h)][ok], h[ok]
    count = np.diff(words.doc)
    short = np.flatnonzero((count > 0) & (count < n))
    h = np.concatenate([h, run_hash(prefix, words.doc[short], words.doc[short + 1])])
    doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
        doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(count) + 1)), count


def _names(h: np.ndarray, edge: np.ndarray) -> list[bytes | None]:
    """128-bit hash of each set; None for an empty one."""
    one, two = np.zeros(len(h) + 1, U64), np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h ^ U64(0x2545F4914F6CDD1D)), out=one[1:])
    np.cumsum(mix(h ^ U64(0x9E6C63D0876A9A47)), out=two[1:])
    size = np.diff(edge).astype(U64)
    pair = np.column_stack([mix(one[edge[1:]] - one[edge[:-1]] ^ size), mix(two[edge[1:]] - two[edge[:-1]] + size)])
    return [p.tobytes() if n else None for p, n in zip(pair, size)]


def _first(size: np.ndarray, threshold: int) -> np.ndarray:
    return size - (threshold * size + 99) // 100 + 1


def _batch_classes(batch: pa.Table, n: int, limit: int):
    """Each slice's documents, and each distinct set of the batch once."""
    data, offsets = utf8(batch["text"])
    seen: set[bytes] = set()
    for a, z, words in each_slice(data, offsets, SPACED, fold=True, limit=limit):
        h, edge, _ = _sets(words, n)
        names = _names(h, edge)
        new = []
        for i, name in enumerate(names):
            if name is not None and name not in seen:
                seen.add(name)
                new.append(i)
        yield a, h, edge, names, new


COUNTS = pa.schema([("bucket", pa.int32()), ("b", pa.int32()), ("gram", pa.binary()), ("n", pa.binary())])
KNOWN = pa.schema([("b", pa.int32()), ("bucket", pa.int32()), ("gram", pa.binary()), ("rank", pa.binary())])


def _key(h: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and the next GRAM_BITS of a hash: equal for different n-grams now and then, which only makes them look more frequent."""
    return h >> U64(64 - bits - GRAM_BITS)


def _table(schema: pa.Schema, rows: list) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def send_counts(n: int, bits: int, limit: int = SLICE_BYTES):
    def run(batch: pa.Table) -> pa.Table:
        found = [h[np.concatenate([np.arange(edge[i], edge[i + 1]) for i in new])] if new else h[:0] for _, h, edge, _, new in _batch_classes(batch, n, limit)]
        key = _key(np.sort(np.concatenate(found)), bits)
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count, key = np.diff(np.append(at, len(key))), key[at]
        edge = np.searchsorted(key, np.arange((1 << bits) + 1, dtype=U64) << U64(GRAM_BITS))
        b, rows = batch["b"][0].as_py(), []
        for i, (s, e) in enumerate(zip(edge[:-1], edge[1:])):
            if s < e:
                rows.append((i, b, planes((key[s:e] & U64((1 << GRAM_BITS) - 1)).astype(np.uint32)), np.minimum(count[s:e], 255).astype(np.uint8).tobytes()))
        return _table(COUNTS, rows)

    return run


def sum_counts(bucket: pa.Table) -> pa.Table:
    """Ranks by frequency, of n-grams that several classes have, for each batch that has them."""
    i, bs = bucket["bucket"][0].as_py(), bucket["b"].to_pylist()
    grams = [unplanes(x, np.uint32) for x in bucket["gram"].to_pylist()]
    counts = [np.frombuffer(x, np.uint8) for x in bucket["n"].to_pylist()]
    values, where = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
    rank = np.where(total > 1, 1 + np.minimum(250, (8 * np.log2(np.maximum(total, 1))).astype(np.int64)), 0).astype(np.uint8)
    rows, at = [], 0
    for b, g in zip(bs, grams):
        r = rank[where[at : at + len(g)]]
        at += len(g)
        if r.any():
            rows.append((b, i, planes(g[r > 0]), r[r > 0].tobytes()))
    return _table(KNOWN, rows)


CLASSES = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("name", pa.binary()), ("central", pa.float64()), ("first", pa.list_(pa.int64())), ("body", pa.binary())])


def find_classes(n: int, threshold: int, bits: int, limit: int = SLICE_BYTES):
    """A row for each document; and one with ``first`` and ``body`` for each set that may have a partner."""

    def run(batch: pa.Table, known: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return CLASSES.empty_table()
        keys = [(U64(i) << U64(GRAM_BITS)) | unplanes(g, np.uint32).astype(U64) for i, g in zip(known["bucket"].to_pylist(), known["gram"].to_pylist())]
        key = np.concatenate(keys) if keys else np.zeros(0, U64)
        rank = np.concatenate([np.frombuffer(r, np.uint8) for r in known["rank"].to_pylist()]) if keys else np.zeros(0, np.uint8)
        order = np.argsort(key)
        key, rank = key[order], rank[order]
        ids = batch["doc_id"].cast(pa.int64()).to_pylist()
        rows = []
        for a, h, edge, names, new in _batch_classes(batch, n, limit):
            size = np.diff(edge)
            rows += [(ids[a + i], int(size[i]), names[i], None, None, None) for i in range(len(names))]
            if not len(key) or not len(h):
                continue
            mine = _key(h, bits)
            at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            r = np.where(key[at] == mine, rank[at], 0)
            shared = np.concatenate(([0], np.cumsum(r > 0)))
            first = _first(size, threshold)
            for i in new:
                s, e = edge[i], edge[i + 1]
                if size[i] - (shared[e] - shared[s]) >= first[i]:
                    continue  # the first columns are this class's alone
                pick = np.lexsort((h[s:e], r[s:e]))[: first[i]]
                pick = pick[r[s:e][pick] > 0]
                rows.append((None, int(size[i]), names[i], float(r[s:e].mean()), h[s:e][pick].view(np.int64).tolist(), h[s:e].tobytes()))
        return _table(CLASSES, rows)

    return run


LINKS = pa.schema([("x", pa.binary()), ("y", pa.binary())])
COUNTED = pa.schema([("name", pa.binary()), ("links", pa.int64())])


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray]):
    """Each row of the product of two blocks of n-gram sets: its overlap with every column."""
    gram = np.concatenate(cols)
    doc = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    for x in rows:
        low, high = np.searchsorted(gram, x, "left"), np.searchsorted(gram, x, "right")
        many = high - low
        place = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        yield np.bincount(doc[place], minlength=len(cols))


def bound(x, y, threshold: int):
    """The least overlap with which sets of these sizes link."""
    return -(-threshold * (x + y) // (100 + threshold))


def _sets_of(block: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, U64) for x in block["body"].to_pylist()]


def _paired(threshold: int):
    """Links among a block's pairs; its columns are the classes that its rows are paired with."""

    def run(pairs: pa.Table, block: pa.Table) -> pa.Table:
        side, names, sets = block["side"].to_pylist(), block["name"].to_pylist(), _sets_of(block)
        row = [i for i, s in enumerate(side) if s == 0]
        col = [i for i, s in enumerate(side) if s == 1]
        if not row or not col:
            return LINKS.empty_table()
        place = {names[i]: k for k, i in enumerate(col)}
        size = np.array([len(sets[i]) for i in col])
        wanted: dict[bytes, list[int]] = {}
        for x, y in zip(pairs["x"].to_pylist(), pairs["y"].to_pylist()):
            wanted.setdefault(x, []).append(place[y])
        out = []
        for i, have in zip(row, overlaps([sets[i] for i in row], [sets[i] for i in col])):
            ask = np.array(wanted[names[i]])
            good = ask[have[ask] >= bound(len(sets[i]), size[ask], threshold)]
            out += [(names[i], names[col[k]]) for k in good]
        return _table(LINKS, out)

    return run


def _between(threshold: int):
    """Links between a block of rows and a block of columns of one family, as pairs of their components' roots, each once."""

    def run(block: pa.Table) -> pa.Table:
        side, names, roots, sets = block["side"].to_pylist(), block["name"].to_pylist(), block["root"].to_pylist(), _sets_of(block)
        rows, cols = [i for i, s in enumerate(side) if s == 0], [i for i, s in enumerate(side) if s == 1]
        if not rows or not cols:
            return LINKS.empty_table()
        size = np.array([len(sets[i]) for i in cols])
        number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        root = np.array([number[roots[i]] for i in cols])
        named, out = list(number), set()
        for i, have in zip(rows, overlaps([sets[i] for i in rows], [sets[i] for i in cols])):
            hit = np.flatnonzero((have >= bound(len(sets[i]), size, threshold)) & (root != number[roots[i]]))
            out |= {(roots[i], named[r]) for r in np.unique(root[hit])}
        return _table(LINKS, sorted(out))

    return run


def _within(threshold: int):
    """For the classes of one or two blocks of a component: how many documents of the other classes they link to."""

    def run(block: pa.Table) -> pa.Table:
        names, at, docs, sets = block["name"].to_pylist(), block["at"].to_numpy(), block["docs"].to_numpy(), _sets_of(block)
        one = block["i"][0].as_py() == block["j"][0].as_py()
        rows = np.flatnonzero(at == block["i"][0].as_py())
        cols = rows if one else np.flatnonzero(at == block["j"][0].as_py())
        if not len(rows) or not len(cols):
            return COUNTED.empty_table()
        size = np.array([len(sets[j]) for j in cols])
        links = np.zeros(len(names), np.int64)
        for i, have in zip(rows, overlaps([sets[i] for i in rows], [sets[j] for j in cols])):
            good = cols[have >= bound(len(sets[i]), size, threshold)]
            good = good[good != i]
            links[i] += docs[good].sum()
            if not one:
                links[good] += docs[i]
        return pa.Table.from_arrays([block["name"], pa.array(links)], schema=COUNTED)

    return run


def _blocks(weight: Column) -> Column:
    """The number of blocks that hold a weight."""
    return F.ceil(weight / F.lit(BLOCK_WEIGHT)).cast("int")


def _links_of_pairs(pairs: DataFrame, bodies: DataFrame, threshold: int) -> DataFrame:
    """The pairs x, y that link; rows are dealt to blocks by x, so that a y of many pairs is sent once a block."""
    n = 2 * parts(pairs.sparkSession)
    block = F.pmod(F.xxhash64("x"), F.lit(n)).alias("block")
    pairs = cut(pairs.select("x", "y", block).distinct())
    rows = pairs.select("block", F.col("x").alias("name"), F.lit(0).alias("side")).distinct().join(bodies, "name")
    cols = pairs.select("block", F.col("y").alias("name"), F.lit(1).alias("side")).distinct().join(bodies, "name")
    columns = ["block", "side", "name", "body"]
    sets = rows.select(*columns).unionByName(cols.select(*columns))
    return pairs.select(F.col("block").alias("b"), "x", "y").groupBy("b").cogroup(sets.groupBy("block")).applyInArrow(_paired(threshold), "x binary, y binary")


def _families(posts: DataFrame, roots: DataFrame, bodies: DataFrame, threshold: int) -> DataFrame | None:
    """Pairs x, y of roots whose components link, among those that share a large column."""
    own = posts.join(roots.select(F.col("node").alias("name"), "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    open_ = own.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("name").alias("head")).filter("lo <> hi").select("gram", "head")
    members = cut(spread_join(own, open_, "gram", "name").select("name", "root", "head", "size").distinct())
    if members.isEmpty():
        return None
    family = components(members.select(F.col("name").alias("u"), F.col("head").alias("v")))
    members = members.select("name", "root", (F.col("size") + ROW_WEIGHT).alias("w")).distinct().join(family.select(F.col("node").alias("name"), F.col("root").alias("family")), "name")
    part = members.groupBy("family", "root").agg(F.sum("w").alias("w"))
    whole = part.groupBy("family").agg(F.sum("w").alias("w"), F.max(F.struct("w", "root")).alias("m"))
    cuts = whole.select("family", F.col("m.root").alias("main"), _blocks(F.col("w")).alias("k"), _blocks(F.col("w") - F.col("m.w")).alias("r"))
    placed = cut(spread_join(members, cuts, "family", "name"))
    spread = F.xxhash64("name")
    minor = placed.filter("root <> main").withColumn("i", F.pmod(spread, "r")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("side", F.lit(0))
    every = placed.withColumn("j", F.pmod(spread, "k")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("r") - 1))).withColumn("side", F.lit(1))
    columns = ["family", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "side", "name", "root"]
    blocks = minor.select(*columns).unionByName(every.select(*columns)).join(bodies, "name")
    return blocks.groupBy("family", "i", "j").applyInArrow(_between(threshold), "x binary, y binary")


def _link_counts(classes: DataFrame, bodies: DataFrame, threshold: int) -> DataFrame:
    """name and links of the classes (name, root, size, docs) of components of several classes."""
    weights = classes.groupBy("root").agg(F.sum(F.col("size") + ROW_WEIGHT).alias("w"), F.count("*").alias("n"))
    cuts = weights.filter("n > 1").select("root", _blocks(F.col("w")).alias("k"))
    placed = spread_join(classes, cuts, "root", "name").withColumn("at", F.pmod(F.xxhash64("name"), "k").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    blocks = placed.select("root", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "name", "docs").join(bodies, "name")
    counted = blocks.groupBy("root", "i", "j").applyInArrow(_within(threshold), "name binary, links long")
    return counted.groupBy("name").agg(F.sum("links").alias("links"))


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: int = 80, links: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_shingles, class (the set's name), component_id and n_links of every row; ``threshold`` in hundredths.

    ``n_links`` counts the other documents that a row links to, copies of its text included. Without
    ``links`` the column is left out and with it step 5; classes and components are the same.
    """
    bits = bucket_bits(docs.sparkSession)
    rows = batched(docs, "doc_id", "text")
    counts = rows.groupBy("b").applyInArrow(send_counts(n, bits, slice_bytes), "bucket int, b int, gram binary, n binary")
    known = counts.groupBy("bucket").applyInArrow(sum_counts, "b int, bucket int, gram binary, rank binary")
    found = cut(rows.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(find_classes(n, threshold, bits, slice_bytes), "doc_id long, size long, name binary, central double, first array<long>, body binary"))
    member = found.filter("first is null").select("doc_id", "size", "name")
    open_ = found.filter("first is not null")
    # a class of several batches has the same size, rank and first columns in each
    once = open_.groupBy("name").agg(F.first("size").alias("size"), F.first("central").alias("central"), F.first("first").alias("first"))
    posts = once.select("name", "size", "central", F.explode("first").alias("gram"))
    per_gram = posts.groupBy("gram").agg(F.count("*").alias("n"), F.max(F.struct("central", "name", "size")).alias("lead")).filter("n > 1")
    posts = cut(spread_join(posts, per_gram, "gram", "name").select("gram", "name", "size", "n", F.col("lead.name").alias("lead"), F.col("lead.size").alias("lead_size")))
    fits = "100 * least(x_size, y_size) >= {t} * greatest(x_size, y_size)".format(t=threshold)
    star = posts.filter(F.col("n") > SMALL).select(F.col("name").alias("x"), F.col("lead").alias("y"), F.col("size").alias("x_size"), F.col("lead_size").alias("y_size")).filter("x <> y").filter(fits)
    few = posts.filter(F.col("n") <= SMALL).select("gram", "name", "size")
    twos = few.select("gram", F.col("name").alias("x"), F.col("size").alias("x_size")).join(few.select("gram", F.col("name").alias("y"), F.col("size").alias("y_size")), "gram").filter("x < y").filter(fits)
    pairs = star.select("x", "y").unionByName(twos.select("x", "y"))
    partners = posts.select("name").distinct()
    bodies = cut(open_.select("name", "body").join(partners, "name", "left_semi").groupBy("name").agg(F.first("body").alias("body")))
    roots = components(_links_of_pairs(pairs, bodies, threshold), "x", "y")
    more = _families(posts.filter(F.col("n") > SMALL), roots, bodies, threshold)
    more = more if more is None else cut(more.distinct())
    least = member.filter("name is not null").groupBy("name").agg(F.min("doc_id").alias("least_id"), F.first("size").alias("size"), F.count("*").alias("docs"))
    least = least.join(roots.select(F.col("node").alias("name"), "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    if more is not None and not more.isEmpty():
        # components that turned out to link are nodes of a graph of their own; links inside them are not read again
        top = components(more, "x", "y").select(F.col("node").alias("root"), F.col("root").alias("top"))
        least = spread_join(least, top, "root", "name", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    least = cut(least)
    whole = least.groupBy("root").agg(F.min("least_id").alias("component_id"))
    label = least.join(whole, "root")
    if links:
        label = label.join(_link_counts(least, bodies, threshold), "name", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("docs") - 1)
    shown = ["component_id", "n_links"] if links else ["component_id"]
    out = member.join(label.select("name", *shown), "name", "left")
    columns = [F.col("size").alias("n_shingles"), F.col("name").alias("class"), F.coalesce("component_id", "doc_id").alias("component_id")]
    return out.select("doc_id", *columns, *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []))
