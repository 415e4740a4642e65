"""Benchmark decontamination by a prefix-filtered set join (operator 9).

Every benchmark item gives its windows of ``width`` consecutive words (a shorter
item is one window). A window occurs in a document only if all its shingles do,
so one necessary token is enough to find it: its rarest shingle, by counts over
the whole corpus. Documents look up each of their shingles among these prefix
tokens; a hit fixes where the window would begin, the document's bounds drop
those that would not fit, and the rest are verified word by word, by 64-bit
hashes of the words.

The benchmark is held in memory by ``limit_bytes`` of text at most: a larger one
is split by item and the documents pass through one lookup for each part.
Documents are never shuffled. Counts that reach the driver number one for each
shingle of that bounded part.

Defined results: null or wordless texts have no words and no hits; an item
without words has no window; an item whose id is null marks words but is not
listed; equal items count once by id; rows with equal ids are separate
documents; empty tables give no rows or no hits; further columns are not read.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm._arrays import ALNUM, PIECE_BYTES, SLICE_BYTES, U64, contains, covered, each_slice, pieces, prefix_hash, rolling, runs, utf8

SHINGLE = 4
#: Fixed value: words of items, whatever their case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OUT = "doc_id long, n_words long, n_hit long, hits array<struct<start:long,end:long>>, items array<string>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Part:
    """The windows of a part of the benchmark and their shingles."""

    def __init__(self, ids: list, texts: list, width: int):
        found: dict[bytes, list[int]] = {}
        data, offsets = utf8(pa.array(texts, pa.string()))
        for a, z, words in each_slice(data, offsets, ALNUM, fold=True):
            h = words.hashes()
            for i in range(z - a):
                s, e = words.doc[i], words.doc[i + 1]
                length = min(width, e - s)
                for j in range(s, e - length + 1) if length else ():
                    found.setdefault(h[j : j + length].tobytes(), []).append(a + i)
        self.ids = [None if x is None else str(x) for x in ids]
        self.words = [np.frombuffer(w, U64) for w in found]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.items = [sorted({self.ids[i] for i in v if self.ids[i] is not None}) for v in found.values()]
        self.matrix = np.zeros((len(found), width), U64)
        shingles: dict[int, list] = {}
        for n, w in enumerate(self.words):
            self.matrix[n, : len(w)] = w
            k = min(SHINGLE, len(w))
            for at, x in enumerate(rolling(prefix_hash(w), k)):
                shingles.setdefault(k, []).append((int(x), n, at))
        self.shingles = {k: (np.array([x[0] for x in v], U64), np.array([x[1] for x in v], np.int64), np.array([x[2] for x in v], np.int64)) for k, v in shingles.items()}
        self.known = {k: np.unique(v[0]) for k, v in self.shingles.items()}

    def shared(self) -> SimpleNamespace:
        """Its arrays, without the class, for a broadcast."""
        return SimpleNamespace(**{k: v for k, v in vars(self).items() if k not in ("words", "ids")})

    def prefix(self, counts: dict[int, np.ndarray]) -> None:
        """Keeps of each window its rarest shingle, the first by hash and place among equals."""
        self.lookup = {}
        for k, (h, window, at) in self.shingles.items():
            rarity = counts[k][np.searchsorted(self.known[k], h)]
            order = np.lexsort((at, h, rarity, window))
            first = order[np.concatenate(([True], window[order][1:] != window[order][:-1]))]
            first = first[np.argsort(h[first], kind="stable")]
            self.lookup[k] = h[first], window[first], at[first]


def _count(part, limit: int):
    """Rows (k, place among known shingles, count) for the rows of a task."""

    def run(batches):
        known = part.value.known
        total = {k: np.zeros(len(v), np.int64) for k, v in known.items()}
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for _, _, words in each_slice(data, offsets, ALNUM, fold=True, limit=limit):
                prefix = prefix_hash(words.hashes())
                for k, v in known.items():
                    h = rolling(prefix, k)
                    h = h[words.whole(k, len(h))]
                    total[k] += np.bincount(np.searchsorted(v, h[contains(v, h)]), minlength=len(v))
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at, pa.int64()), pa.array(v[at], pa.int64())], names=["k", "place", "n"])

    return run


def _matches(part, words) -> tuple[np.ndarray, np.ndarray]:
    """Start and window of every verified occurrence in a slice."""
    values = words.hashes()
    prefix = prefix_hash(values)
    owner_end = np.repeat(words.doc[1:], np.diff(words.doc))
    owner_start = np.repeat(words.doc[:-1], np.diff(words.doc))
    starts, windows = [], []
    for k, (h, window, at) in part.lookup.items():
        have = rolling(prefix, k)
        place = np.flatnonzero(words.whole(k, len(have)))
        place = place[contains(h, have[place])]
        low = np.searchsorted(h, have[place], "left")
        many = np.searchsorted(h, have[place], "right") - low
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])) if len(many) else low, many) + np.arange(many.sum())
        place = np.repeat(place, many)
        w, start = window[entry], place - at[entry]
        ok = (start >= owner_start[place]) & (start + part.length[w] <= owner_end[place])
        w, start = w[ok], start[ok]
        for j in range(part.matrix.shape[1]):
            ok = (part.length[w] <= j) | (values[np.minimum(start + j, len(values) - 1)] == part.matrix[w, j])
            w, start = w[ok], start[ok]
        starts.append(start)
        windows.append(w)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(windows)


def _mark(part, last: bool):
    def run(batches):
        p = part.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            before = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            n_words, n_hit, hits, items = [], [], [], []
            for a, z, words in each_slice(data, offsets, ALNUM, fold=True):
                start, window = _matches(p, words)
                gone = covered(len(words.start), start, p.length[window])
                doc = np.searchsorted(words.doc, start, "right") - 1
                mine: dict[int, set] = {}
                for d, w in set(zip(doc.tolist(), window.tolist())):
                    mine.setdefault(d, set()).update(p.items[w])
                for i in range(z - a):
                    mask = gone[words.doc[i] : words.doc[i + 1]].copy()
                    for old in before[0][a + i]:
                        mask[old["start"] : old["end"]] = True
                    n_words.append(len(mask))
                    n_hit.append(int(mask.sum()))
                    hits.append([{"start": int(x), "end": int(y)} for x, y in runs(mask)] if n_hit[-1] else [])
                    items.append(sorted(mine.get(i, set()) | set(before[1][a + i])))
            arrays = [batch.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, SPAN), pa.array(items, pa.list_(pa.string()))]
            names = ["doc_id", "n_words", "n_hit", "hits", "items"]
            if not last:
                arrays.append(batch.column("text"))
                names.append("text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _clean(part):
    """Rows of the input, all columns, without those in which a window occurs."""

    def run(batches):
        for batch in pieces(batches):
            data, offsets = utf8(batch.column("text"))
            keep = np.ones(batch.num_rows, bool)
            for a, _, words in each_slice(data, offsets, ALNUM, fold=True):
                start, _ = _matches(part.value, words)
                keep[a + np.searchsorted(words.doc, start, "right") - 1] = False
            yield batch.filter(pa.array(keep))

    return run


def _parts(docs: DataFrame, benchmark: DataFrame, width: int, limit_bytes: int, slice_bytes: int = SLICE_BYTES):
    """The benchmark in broadcast parts, each with the prefix tokens of its windows."""
    context = docs.sparkSession.sparkContext
    total = benchmark.select(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, math.ceil(total / limit_bytes))
    for i in range(many):
        some = benchmark.select("item_id", "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == i).toArrow()
        part = Part(some["item_id"].to_pylist(), some["text"].to_pylist(), width)
        known = context.broadcast(SimpleNamespace(known=part.known))
        seen = docs.select(docs["text"]).mapInArrow(_count(known, slice_bytes), "k int, place long, n long").groupBy("k", "place").agg(F.sum("n").alias("n")).toArrow()
        counts = {k: np.zeros(len(v), np.int64) for k, v in part.known.items()}
        for k in counts:
            own = seen.filter(pa.compute.equal(seen["k"], k))
            counts[k][own["place"].to_numpy()] = own["n"].to_numpy()
        part.prefix(counts)
        yield context.broadcast(part.shared()), i == many - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, limit_bytes: int = 8 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, hits (word runs inside occurrences) and items (ids, as strings in order)."""
    out = docs.select(docs["doc_id"], docs["text"])
    out = out.withColumns({"hits": F.expr("cast(array() as array<struct<start:long,end:long>>)"), "items": F.expr("cast(array() as array<string>)")})
    for part, last in _parts(docs, benchmark, width, limit_bytes):
        out = out.mapInArrow(_mark(part, last), OUT + ("" if last else ", text string"))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, limit_bytes: int = 8 << 20, shortest: int = 5) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs.

    Items of fewer than ``shortest`` words drop nothing: a single common word would
    take the corpus with it. ``decontaminate`` marks these too.
    """
    out = docs
    benchmark = benchmark.filter(F.regexp_count("text", F.lit(WORD)) >= shortest)
    for part, _ in _parts(docs, benchmark, width, limit_bytes, PIECE_BYTES):
        out = out.mapInArrow(_clean(part), docs.schema)
    return out
