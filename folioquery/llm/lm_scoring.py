"""Cross-entropy difference of matched n-gram models (operator 7).

Two word-bigram models are estimated over all documents: a background model from
every document and a target model from those that ``target`` names. They share
one vocabulary (words the whole corpus has ``min_count`` times or more; the rest
are one unknown word), the order and the smoothing, so their losses differ only
by what they were trained on. A document's score is the mean difference of its
tokens' losses, target less background, in bits; lower is nearer the target.

    p(w)   = (c(w) + ALPHA) / (N + ALPHA * (V + 1))
    p(w|u) = (c(u, w) + MU * p(w)) / (c(u) + MU)

A document is scored without its own counts, in whichever models it is.

Counts travel by hash bucket: every batch of documents sends each of its words
(then of its word pairs) once with its two counts, the bucket adds up and returns
the sums in the order sent. A word that a third of all tokens are is one entry a
batch. The tables grow with the corpus and live nowhere as a whole; only three
totals are copied to all batches.

Defined results: a null or blank text has no tokens and losses of 0; ids that
``target`` repeats count once, null ids never; rows with equal ids are separate
documents, all target if one is; an empty table gives no rows; further columns
are not read. Words and word pairs are told apart by 64-bit hashes, whatever the
number of buckets; counts have 64 bits (sums are exact below 2**53).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm._arrays import SPACED, U64, by_bucket, each_slice, mix, pack, planes, unpack, unplanes, utf8
from folioquery.llm._spark import bucket_bits, parts

ALPHA, MU = 0.5, 4.0
START = 0x9D39247E33776D41
UNKNOWN = 0
SENT = pa.schema([("bucket", pa.int32()), ("b", pa.int32()), ("keys", pa.binary()), ("every", pa.binary()), ("target", pa.binary())])
BACK = pa.schema([("b", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("id", pa.int64()), ("every", pa.binary()), ("target", pa.binary()), ("totals", pa.list_(pa.float64()))])
SENT_DDL = "bucket int, b int, keys binary, every binary, target binary"
BACK_DDL = "b int, kind int, bucket int, id long, every binary, target binary, totals array<double>"
OUT = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("loss_target", pa.float64()), ("loss_background", pa.float64()), ("score", pa.float64())])
#: Kinds of rows that come back to a batch.
WORDS, PAIRS, TOTALS, TARGET = 1, 2, 3, 4


class Batch:
    """Tokens of a batch: a start mark and then the words of each document."""

    def __init__(self, batch: pa.Table, back: pa.Table, bits: int):
        self.bits, self.ids = bits, batch["doc_id"].combine_chunks().cast(pa.int64())
        data, offsets = utf8(batch["text"])
        words, count = [], []
        for _, _, w in each_slice(data, offsets, SPACED, fold=True):
            words.append(w.hashes())
            count.append(np.diff(w.doc))
        words, self.count = np.concatenate(words), np.concatenate(count)
        full = np.flatnonzero(self.count)
        first = np.cumsum(self.count[full] + 1) - self.count[full] - 1
        n = len(words) + len(full)
        self.first = np.zeros(n, bool)
        self.first[first] = True
        self.word = np.full(n, U64(START))
        self.word[~self.first] = words
        self.doc = np.repeat(full, self.count[full] + 1)
        ids = [i for i, k in zip(back["id"].to_pylist(), back["kind"].to_pylist()) if k == TARGET]
        self.mine = np.isin(np.array(self.ids.fill_null(0)), np.array(ids, np.int64)) & np.array(self.ids.is_valid())

    def counts(self, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, each token's place among them, and their two counts."""
        keys, at = np.unique(key, return_inverse=True)
        return keys, at, np.bincount(at, minlength=len(keys)), np.bincount(at, weights=self.mine[doc].astype(float), minlength=len(keys)).astype(np.int64)

    def send(self, b: int, keys: np.ndarray, every: np.ndarray, target: np.ndarray) -> pa.Table:
        rows, edge = [], by_bucket(keys, self.bits)
        for i, (s, e) in enumerate(zip(edge[:-1], edge[1:])):
            if s < e:
                rows.append((i, b, planes(keys[s:e]), pack(every[s:e]), pack(target[s:e])))
        return _table(SENT, rows)

    def sums(self, keys: np.ndarray, back: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """The corpus counts of the batch's keys."""
        edge, every, target = by_bucket(keys, self.bits), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k, i, x, y in zip(*(back[c].to_pylist() for c in ("kind", "bucket", "every", "target"))):
            if k == kind:
                every[edge[i] : edge[i + 1]] = unpack(x)
                target[edge[i] : edge[i + 1]] = unpack(y)
        return every, target

    def mapped(self, back: pa.Table, min_count: int):
        """Each token's vocabulary word, and the words' keys, places and sums."""
        keys, at, _, _ = self.counts(self.word, self.doc)
        every, target = self.sums(keys, back, WORDS)
        known = every >= min_count
        return np.where(known[at], keys[at], U64(UNKNOWN)), known[at], every[at], target[at]

    def pairs(self, word: np.ndarray) -> np.ndarray:
        """Keys of (previous word, word) of every token but the start marks."""
        on = np.flatnonzero(~self.first)
        return mix(mix(word[on - 1] + U64(0x5BD1E9955BD1E995)) ^ word[on] * U64(0xC2B2AE3D27D4EB4F))


def _table(schema: pa.Schema, rows: list) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def send_words(bits: int):
    def run(batch: pa.Table, back: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return SENT.empty_table()
        own = Batch(batch, back, bits)
        keys, _, every, target = own.counts(own.word, own.doc)
        return own.send(batch["b"][0].as_py(), keys, every, target)

    return run


def add_up(kind: int, min_count: int):
    """Sums by key, to every batch that sent it; and once a bucket what the totals need."""

    def run(bucket: pa.Table) -> pa.Table:
        i, bs = bucket["bucket"][0].as_py(), bucket["b"].to_pylist()
        keys = [unplanes(x, U64) for x in bucket["keys"].to_pylist()]
        every, target = ([unpack(x) for x in bucket[c].to_pylist()] for c in ("every", "target"))
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        e = np.bincount(at, weights=np.concatenate(every), minlength=len(distinct)).astype(np.int64)
        t = np.bincount(at, weights=np.concatenate(target), minlength=len(distinct)).astype(np.int64)
        rare = e < min_count
        rows, s = [], 0
        for n, (b, k) in enumerate(zip(bs, keys)):
            own = at[s : s + len(k)]
            s += len(k)
            totals = [float(e.sum()), float(t.sum()), float(e[rare].sum()), float(t[rare].sum()), float((~rare).sum())] if n == 0 else [0.0] * 5
            rows.append((b, kind, i, None, pack(e[own]), pack(t[own]), totals))
        return _table(BACK, rows)

    return run


def send_pairs(bits: int, min_count: int):
    def run(batch: pa.Table, back: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return SENT.empty_table()
        own = Batch(batch, back, bits)
        word, *_ = own.mapped(back, min_count)
        keys, _, every, target = own.counts(own.pairs(word), own.doc[~own.first])
        return own.send(batch["b"][0].as_py(), keys, every, target)

    return run


def _own(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each token's key stands in its own document."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]))) if len(d) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    out = np.empty(len(doc), np.int64)
    out[order] = np.bincount(group)[group] if len(d) else 0
    return out


def score(bits: int, min_count: int):
    def run(batch: pa.Table, back: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return RESULT.empty_table()
        own = Batch(batch, back, bits)
        totals = np.zeros(5)
        for k, x in zip(back["kind"].to_pylist(), back["totals"].to_pylist()):
            if k == TOTALS and x is not None:
                totals += np.array(x, float)
        word, known, *of_word = own.mapped(back, min_count)
        pair = own.pairs(word)
        keys, at, _, _ = own.counts(pair, own.doc[~own.first])
        of_pair = [x[at] for x in own.sums(keys, back, PAIRS)]
        on = np.flatnonzero(~own.first)
        doc, in_doc = own.doc[on], own.count + 1
        own_word, own_pair = _own(own.doc, word), _own(doc, pair)
        losses = []
        for model in (0, 1):
            # without the document itself: always from the background, from the target if it is in it
            less = np.ones(len(own.mine)) if model == 0 else own.mine.astype(float)
            c_word = np.where(known, of_word[model], totals[2 + model]) - own_word * less[own.doc]
            c_pair = of_pair[model] - own_pair * less[doc]
            n = totals[model] - (in_doc * less)[doc]
            p_word = (c_word[on] + ALPHA) / (n + ALPHA * (totals[4] + 1))
            p = (c_pair + MU * p_word) / (c_word[on - 1] + MU)
            losses.append(np.bincount(doc, weights=-np.log2(p), minlength=len(own.count)) / np.maximum(own.count, 1))
        columns = [own.ids, pa.array(own.count, pa.int64()), pa.array(losses[1]), pa.array(losses[0]), pa.array(losses[1] - losses[0])]
        return pa.Table.from_arrays(columns, schema=RESULT)

    return run


def lm_scores(docs: DataFrame, target: DataFrame, min_count: int = 3) -> DataFrame:
    """doc_id, n_tokens, mean losses under both models in bits, and score.

    ``target`` has the ids of the target's documents as doc_id.
    """
    # a bucket answers every batch, and the words' sums are read three times: a quarter of the buckets of the other operators,
    # which decides how counts travel and nothing else
    n, bits = parts(docs.sparkSession), bucket_bits(docs.sparkSession) - 2
    rows = docs.select(docs["doc_id"], docs["text"], F.pmod(F.xxhash64(F.coalesce(docs["doc_id"], F.xxhash64(docs["text"]))), F.lit(2 * n)).cast("int").alias("b")).repartition(n, "b")
    blank = {"kind": "int", "bucket": "int", "id": "long", "every": "binary", "target": "binary", "totals": "array<double>"}

    def returned(df: DataFrame, **columns) -> DataFrame:
        return df.select("b", *[(columns[c] if c in columns else F.lit(None)).cast(t).alias(c) for c, t in blank.items()])

    ids = target.filter("doc_id is not null").select("doc_id").distinct()
    named = returned(ids.withColumn("b", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2 * n)).cast("int")), kind=F.lit(TARGET), id=F.col("doc_id"))
    words = rows.groupBy("b").cogroup(named.groupBy("b")).applyInArrow(send_words(bits), SENT_DDL).groupBy("bucket").applyInArrow(add_up(WORDS, min_count), BACK_DDL)
    sums = words.agg(F.array(*[F.sum(F.get("totals", k)) for k in range(5)]).alias("totals")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(2 * n - 1))))
    totals = returned(sums, kind=F.lit(TOTALS), totals=F.col("totals"))
    known = words.unionByName(named)
    pairs = rows.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(send_pairs(bits, min_count), SENT_DDL).groupBy("bucket").applyInArrow(add_up(PAIRS, 0), BACK_DDL)
    every = known.unionByName(pairs).unionByName(totals)
    return rows.groupBy("b").cogroup(every.groupBy("b")).applyInArrow(score(bits, min_count), OUT)
