"""Substring dedup by fixed-block anchors (operator 1).

A repeat of ``width`` words holds one whole block of ``width // 2 + 1`` words
(rounded so that 2 * block - 1 <= width) that starts at a multiple of the block
length in its own document. So:

1. every batch of documents sends, by hash bucket, its rolling block-long
   windows (probes) and which of them are aligned blocks (the index);
2. a bucket keeps block hashes that more than one window has, and returns to
   each batch those it holds;
3. around each such block a batch extends: all ``width``-word windows that hold
   it are hashed in full and sent by bucket;
4. a bucket returns the windows that start in more than one place; the union
   of the runs they cover is the union of the maximal exact repeats.

Within a batch equal hashes are sent once with a flag, so a text that a third
of the rows share costs one entry a batch, not one a row; no pairs are formed
and nothing is capped. Hashes have 32 bits within one of 2**b buckets in steps 1
and 2, where a chance hit only costs an extension, and 128 bits in 3 and 4.

Defined results: a null or blank text has no words and an empty ``kept_text``;
rows with equal ids are separate documents; an empty table gives no rows;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioquery.llm._arrays import SPACED, U64, by_bucket, contains, covered, each_slice, mix, planes, prefix_hash, repeated, rolling, run_hash, runs, unplanes, utf8
from folioquery.llm._spark import batched, bucket_bits

OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


def _block(width: int) -> int:
    return (width + 1) // 2


def _table(schema: pa.Schema, *columns) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


PROBES = pa.schema([("bucket", pa.int32()), ("b", pa.int32()), ("one", pa.binary()), ("more", pa.binary()), ("block", pa.binary())])
HITS = pa.schema([("b", pa.int32()), ("bucket", pa.int32()), ("hit", pa.binary())])


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(32 - bits)).astype(np.uint32)


def send_probes(width: int, bits: int):
    k = _block(width)

    def run(batch: pa.Table) -> pa.Table:
        data, offsets = utf8(batch["text"])
        all_h, block_h = [], []
        for _, _, words in each_slice(data, offsets, SPACED):
            h = rolling(prefix_hash(words.hashes()), k)
            ok = words.whole(k, len(h))
            place = np.arange(len(h)) - np.repeat(words.doc[:-1], np.diff(words.doc))[: len(h)]
            all_h.append(h[ok])
            block_h.append(h[ok & (place % k == 0)])
        h, many = repeated(np.concatenate(all_h) if all_h else np.zeros(0, U64))
        blocks = np.unique(np.concatenate(block_h)) if block_h else h[:0]
        b = batch["b"][0].as_py()
        one, more, edge, edge_m, edge_b = h[~many], h[many], by_bucket(h[~many], bits), by_bucket(h[many], bits), by_bucket(blocks, bits)
        rows = [
            (i, b, planes(_short(one[edge[i] : edge[i + 1]], bits)), planes(_short(more[edge_m[i] : edge_m[i + 1]], bits)), planes(_short(blocks[edge_b[i] : edge_b[i + 1]], bits)))
            for i in range(1 << bits)
            if edge[i] < edge[i + 1] or edge_m[i] < edge_m[i + 1]
        ]
        return _table(PROBES, *(zip(*rows) if rows else [[]] * 5))

    return run


def find_blocks(bucket: pa.Table) -> pa.Table:
    """Blocks that several windows equal; each batch gets those it has."""
    bs, i = bucket["b"].to_pylist(), bucket["bucket"][0].as_py()
    each = [(unplanes(o, np.uint32), unplanes(m, np.uint32)) for o, m in zip(bucket["one"].to_pylist(), bucket["more"].to_pylist())]
    blocks = np.unique(np.concatenate([unplanes(x, np.uint32) for x in bucket["block"].to_pylist()]))
    values, many = repeated(np.concatenate([x for pair in each for x in (pair[0], np.repeat(np.unique(pair[1]), 2))]))
    hits = np.intersect1d(values[many], blocks, assume_unique=True)
    rows = [(b, i, planes(found)) for b, pair in zip(bs, each) if len(found := hits[contains(np.unique(np.concatenate(pair)), hits)])]
    return _table(HITS, *(zip(*rows) if rows else [[]] * 3))


def _received(hits: pa.Table, bits: int) -> np.ndarray:
    """The hashes a batch got back, as bucket and low part in one sorted array."""
    found = [(np.uint64(i) << U64(32)) | unplanes(x, np.uint32).astype(U64) for i, x in zip(hits["bucket"].to_pylist(), hits["hit"].to_pylist())]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, U64)


WINDOWS = pa.schema([("bucket", pa.int32()), ("b", pa.int32()), ("one", pa.binary()), ("more", pa.binary())])
Pairs = tuple[np.ndarray, np.ndarray]


def _windows(words, width: int, hit: np.ndarray, bits: int) -> Pairs:
    """128-bit hashes, in two halves, of the windows that hold a found block of their own."""
    k = _block(width)
    values = words.hashes()
    prefix = prefix_hash(values)
    h = rolling(prefix, k)
    place = np.arange(len(h)) - np.repeat(words.doc[:-1], np.diff(words.doc))[: len(h)]
    aligned = np.flatnonzero(words.whole(k, len(h)) & (place % k == 0))
    key = (h[aligned] >> U64(64 - bits) << U64(32)) | _short(h[aligned], bits).astype(U64)
    blocks = aligned[contains(hit, key)]
    start = (blocks[:, None] - np.arange(k)[None, :]).ravel()
    n = max(0, len(values) - width + 1)
    start = np.unique(start[(start >= 0) & (start < n)])
    start = start[words.whole(width, n)[start]] if len(start) else start
    return run_hash(prefix, start, start + width), run_hash(prefix_hash(_other(values)), start, start + width)


def _other(values: np.ndarray) -> np.ndarray:
    return mix(values ^ U64(0x5851F42D4C957F2D))


def _join(found: list[Pairs]) -> Pairs:
    if not found:
        return np.zeros(0, U64), np.zeros(0, U64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _repeated(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and whether each stands there more than once."""
    if not len(h):
        return h, g, np.zeros(0, bool)
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
    return h[at], g[at], np.diff(np.append(at, len(h))) > 1


def _among(h: np.ndarray, g: np.ndarray, of: Pairs) -> np.ndarray:
    """Membership of pairs in ordered distinct pairs."""
    out = contains(of[0], h)
    todo = np.flatnonzero(out)
    out[todo] = False
    at = np.searchsorted(of[0], h[todo])
    while len(todo):
        good = of[1][at] == g[todo]
        out[todo[good]] = True
        on = ~good & (at + 1 < len(of[0]))
        todo, at = todo[on], at[on] + 1
        on = of[0][at] == h[todo]
        todo, at = todo[on], at[on]
    return out


def _pack(h: np.ndarray, g: np.ndarray) -> bytes:
    return planes(h) + g.tobytes()


def _unpack(blob: bytes) -> Pairs:
    half = len(blob) // 2
    return unplanes(blob[:half], U64), np.frombuffer(blob[half:], U64)


def send_windows(width: int, bits: int):
    def run(batch: pa.Table, hits: pa.Table) -> pa.Table:
        if not batch.num_rows or not hits.num_rows:
            return WINDOWS.empty_table()
        hit, found = _received(hits, bits), []
        data, offsets = utf8(batch["text"])
        for _, _, words in each_slice(data, offsets, SPACED):
            found.append(_windows(words, width, hit, bits))
        h, g, many = _repeated(*_join(found))
        edge, b = by_bucket(h, bits), batch["b"][0].as_py()
        rows = []
        for i, (s, e) in enumerate(zip(edge[:-1], edge[1:])):
            if s < e:
                m = many[s:e]
                rows.append((i, b, _pack(h[s:e][~m], g[s:e][~m]), _pack(h[s:e][m], g[s:e][m])))
        return _table(WINDOWS, *(zip(*rows) if rows else [[]] * 4))

    return run


def find_windows(bucket: pa.Table) -> pa.Table:
    """Windows that start in several places; each batch gets those it has."""
    bs, i = bucket["b"].to_pylist(), bucket["bucket"][0].as_py()
    each = [(_unpack(o), _unpack(m)) for o, m in zip(bucket["one"].to_pylist(), bucket["more"].to_pylist())]
    h, g, many = _repeated(*_join([x for o, m in each for x in (o, m, m)]))
    hits, rows = (h[many], g[many]), []
    for b, (o, m) in zip(bs, each):
        got = _among(*o, hits)
        x, y = _join([(o[0][got], o[1][got]), m])
        if len(x):
            order = np.argsort(x)
            rows.append((b, i, _pack(x[order], y[order])))
    return _table(HITS, *(zip(*rows) if rows else [[]] * 3))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def remove(width: int):
    def run(batch: pa.Table, windows: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return RESULT.empty_table()
        data, offsets = utf8(batch["text"])
        h, g, _ = _repeated(*_join([_unpack(x) for x in windows["hit"].to_pylist()]))
        n_words, n_removed, kept, spans = [], [], [], []
        for a, z, words in each_slice(data, offsets, SPACED):
            gone = np.zeros(len(words.start), bool)
            n = max(0, len(gone) - width + 1)
            if len(h) and n:
                values = words.hashes()
                full = rolling(prefix_hash(values), width)
                start = np.flatnonzero(words.whole(width, n))
                start = start[contains(h, full[start])]
                other = run_hash(prefix_hash(_other(values)), start, start + width)
                gone = covered(len(gone), start[_among(full[start], other, (h, g))], width)
            for i in range(z - a):
                mask = gone[words.doc[i] : words.doc[i + 1]]
                text = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
                n_words.append(len(mask))
                n_removed.append(int(mask.sum()))
                if n_removed[-1]:
                    text = [text[j] for j in np.flatnonzero(~mask)]
                kept.append(b" ".join(text).decode())
                spans.append([{"start": int(x), "end": int(y)} for x, y in runs(mask)] if n_removed[-1] else [])
        ids = batch["doc_id"].combine_chunks().cast(pa.int64())
        return pa.Table.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, RESULT.field("removed").type)], schema=RESULT)

    return run


def substring_dedup(docs: DataFrame, width: int = 35) -> DataFrame:
    """Every document with the words outside repeated ``width``-word windows.

    Reads ``doc_id`` and ``text``. Returns doc_id, n_words, n_removed,
    kept_text (kept words joined by one space) and removed ([start, end) word
    runs, the maximal repeats of the document).
    """
    if width < 2:
        raise ValueError("width must be 2 words or more")
    bits = bucket_bits(docs.sparkSession)
    rows = batched(docs, "doc_id", "text")
    probes = rows.groupBy("b").applyInArrow(send_probes(width, bits), "bucket int, b int, one binary, more binary, block binary")
    blocks = probes.groupBy("bucket").applyInArrow(find_blocks, "b int, bucket int, hit binary")
    windows = rows.groupBy("b").cogroup(blocks.groupBy("b")).applyInArrow(send_windows(width, bits), "bucket int, b int, one binary, more binary")
    repeats = windows.groupBy("bucket").applyInArrow(find_windows, "b int, bucket int, hit binary")
    return rows.groupBy("b").cogroup(repeats.groupBy("b")).applyInArrow(remove(width), OUT)
