"""Suffix-array dedup by a logarithmic index family (operator 3).

Removes every byte covered by a ``length``-byte string that also starts
elsewhere. Suffix arrays over all positions would sort the whole corpus on text
that almost never repeats, so positions are grouped first in a way that no
repeat can cross:

1. Every window of ``length`` bytes has one anchor, the place in it whose
   ``GRAM``-byte hash is least (leftmost among equals). Equal windows have equal
   anchors at equal offsets. An anchor's own windows are consecutive; their
   union is its context. Batches send (anchor hash, context hash) by bucket.
2. A bucket returns two lists to each batch: contexts that occur more than once
   as a whole, all of whose windows repeat; and one holder for each distinct
   context of an anchor that stands in several contexts.
3. Holders send the bytes of these contexts, by bucket of the anchor.
4. Each bucket keeps the index family: new contexts come in batches, a batch
   gets its suffix array by prefix doubling, is merge-scanned against every
   level, with common prefixes that grow as both orders are read, for matches of
   ``length`` bytes, and then becomes a level itself, merging with levels of its
   size, so that sizes grow geometrically. The windows found to repeat go back
   to their holder.
5. Batches mark the windows of both lists and cut the covered bytes.

What a bucket holds are distinct contexts only: a passage that a third of the
rows share is one context inside, one entry a batch in step 1, and costs more
than that only at its ends, where contexts differ. Nothing is capped.

Context hashes have 64 bits besides the anchor's 32 in one of 2**b buckets;
step 4 compares bytes. Defined results: a null or empty text has no bytes and
an empty ``kept``; rows with equal ids are separate documents; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm._arrays import BYTE_VALUES, U64, by_bucket, covered, mix, planes, prefix_hash, rolling, run_hash, runs, slices, sliding_min, unplanes, utf8
from folioquery.llm._spark import batched, bucket_bits

GRAM_SHARE = 0.64
ADD = 1 << 14
OUT = "doc_id long, n_bytes long, n_removed long, kept binary, removed array<struct<start:long,end:long>>"


def _gram(length: int) -> int:
    return max(1, int(length * GRAM_SHARE))


class Contexts:
    """Anchors of a slice of documents with their own windows' first and last start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        k = _gram(length)
        width = length - k + 1
        self.n = n = max(0, len(data) - length + 1)
        empty = np.zeros(0, np.int64)
        self.first = self.last = empty
        self.a = self.c = np.zeros(0, U64)
        if not n:
            return
        prefix = prefix_hash(BYTE_VALUES[data])
        h = rolling(prefix, k)
        key = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
        anchor = (sliding_min(key, width) & U64(0xFFFFFFFF)).astype(np.int64)
        size = np.diff(offsets)
        start, count = offsets[:-1], np.maximum(0, size - length + 1)
        ok = np.zeros(n + 1, np.int64)
        ok[: n + 1] = np.bincount(start[count > 0], minlength=n + 1)[: n + 1] - np.bincount((start + count)[count > 0], minlength=n + 1)[: n + 1]
        place = np.flatnonzero(np.cumsum(ok[:n]) > 0)
        if not len(place):
            return
        anchor = anchor[place]
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1))))
        self.first, self.last, at = place[new], place[np.append(new[1:], len(place)) - 1], anchor[new]
        self.a = mix(h[at] ^ U64(0x632BE59BD9B4E019))  # least hashes begin with zeros: their buckets come from another one
        self.c = mix(run_hash(prefix, self.first, self.last + length) ^ (at - self.first).astype(U64) * U64(0x9FB21C651E98DF25))


def _each(data, offsets, length):
    for a, z in slices(offsets):
        yield a, z, Contexts(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], length)


def _low(a: np.ndarray, bits: int) -> np.ndarray:
    return (a >> U64(32 - bits)).astype(np.uint32)


def _pack(a: np.ndarray, c: np.ndarray) -> bytes:
    return planes(a) + c.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return unplanes(blob[: 4 * n], np.uint32), np.frombuffer(blob[4 * n :], U64)


def _group(a: np.ndarray, c: np.ndarray, *more: np.ndarray) -> tuple:
    """In order of (a, c), then of ``more``; with the offsets of distinct pairs."""
    order = np.lexsort((*more[::-1], c, a))
    a, c = a[order], c[order]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))) if len(a) else np.zeros(0, np.int64)
    return a, c, at, *(m[order] for m in more)


SENT = pa.schema([("bucket", pa.int32()), ("b", pa.int32()), ("one", pa.binary()), ("more", pa.binary())])
STATUS = pa.schema([("b", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("pairs", pa.binary()), ("bits", pa.binary())])


def _table(schema: pa.Schema, rows: list) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def send_contexts(length: int, bits: int):
    def run(batch: pa.Table) -> pa.Table:
        data, offsets = utf8(batch["text"])
        found = [x for _, _, x in _each(data, offsets, length)]
        a, c, at = _group(np.concatenate([x.a for x in found]), np.concatenate([x.c for x in found]))
        many = np.diff(np.append(at, len(a))) > 1
        a, c, b = a[at], c[at], batch["b"][0].as_py()
        edge, low, rows = by_bucket(a, bits), _low(a, bits), []
        for i, (s, e) in enumerate(zip(edge[:-1], edge[1:])):
            if s < e:
                m = many[s:e]
                rows.append((i, b, _pack(low[s:e][~m], c[s:e][~m]), _pack(low[s:e][m], c[s:e][m])))
        return _table(SENT, rows)

    return run


def sort_out(bucket: pa.Table) -> pa.Table:
    """Kind 0: contexts that occur more than once; kind 1: those the batch must send."""
    i, a, c, b, n = bucket["bucket"][0].as_py(), [], [], [], []
    for batch, one, more in zip(bucket["b"].to_pylist(), bucket["one"].to_pylist(), bucket["more"].to_pylist()):
        for blob, times in ((one, 1), (more, 2)):
            x, y = _unpack(blob)
            a.append(x)
            c.append(y)
            b.append(np.full(len(x), batch, np.int32))
            n.append(np.full(len(x), times, np.int8))
    a, c, at, b, n = _group(np.concatenate(a), np.concatenate(c), np.concatenate(b), np.concatenate(n))
    if not len(at):
        return STATUS.empty_table()
    size = np.diff(np.append(at, len(a)))
    full = np.repeat(np.add.reduceat(n.astype(np.int64), at) > 1, size)
    lone = np.concatenate(([True], a[at][1:] != a[at][:-1])) & np.concatenate((a[at][1:] != a[at][:-1], [True]))
    send = np.zeros(len(a), bool)
    send[at[~lone]] = True  # the least batch that holds it
    rows = []
    for kind, mask in ((0, full), (1, send)):
        x, y, z = a[mask], c[mask], b[mask]
        order = np.argsort(z, kind="stable")
        x, y, z = x[order], y[order], z[order]
        edge = np.flatnonzero(np.concatenate(([True], z[1:] != z[:-1]))) if len(z) else []
        for s, e in zip(edge, np.append(edge[1:], len(z)) if len(z) else []):
            rows.append((int(z[s]), i, kind, _pack(x[s:e], y[s:e]), None))
    return _table(STATUS, rows)


def _known(status: pa.Table, kind: int, bits: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Pairs of one kind, in order of their context hash, and the blobs of their bits."""
    a, c, blobs = [np.zeros(0, U64)], [np.zeros(0, U64)], []
    for i, k, pairs, body in zip(status["bucket"].to_pylist(), status["kind"].to_pylist(), status["pairs"].to_pylist(), status["bits"].to_pylist()):
        if k == kind:
            x, y = _unpack(pairs)
            a.append((U64(i) << U64(32)) | x.astype(U64))
            c.append(y)
            blobs.append(body)
    a, c = np.concatenate(a), np.concatenate(c)
    order = np.lexsort((a, c))
    return a[order], c[order], [order, blobs]


def _find(have: Contexts, a: np.ndarray, c: np.ndarray, bits: int) -> np.ndarray:
    """Place of each context among the known pairs, or -1."""
    out = np.full(len(have.c), -1)
    if len(c) and len(out):
        key = (have.a >> U64(64 - bits) << U64(32)) | _low(have.a, bits).astype(U64)
        at = np.searchsorted(c, have.c)
        todo = np.flatnonzero(at < len(c))
        while len(todo):
            todo = todo[c[at[todo]] == have.c[todo]]
            good = a[at[todo]] == key[todo]
            out[todo[good]] = at[todo[good]]
            todo = todo[~good]
            at[todo] += 1
            todo = todo[at[todo] < len(c)]
    return out


BODIES = pa.schema([("bucket", pa.int32()), ("b", pa.int32()), ("pairs", pa.binary()), ("size", pa.binary()), ("body", pa.binary())])


def send_bodies(length: int, bits: int):
    def run(batch: pa.Table, status: pa.Table) -> pa.Table:
        if not batch.num_rows or not status.num_rows:
            return BODIES.empty_table()
        a, c, _ = _known(status, 1, bits)
        if not len(c):
            return BODIES.empty_table()
        data, offsets = utf8(batch["text"])
        done, out = np.zeros(len(c), bool), {}
        for s, z, have in _each(data, offsets, length):
            at = _find(have, a, c, bits)
            for j in np.flatnonzero(at >= 0):
                if not done[at[j]]:
                    done[at[j]] = True
                    x = have.first[j] + offsets[s]
                    out.setdefault(int(a[at[j]] >> U64(32)), []).append((int(a[at[j]] & U64(0xFFFFFFFF)), int(c[at[j]]), data[x : x + have.last[j] - have.first[j] + length].tobytes()))
        b = batch["b"][0].as_py()
        rows = [(i, b, _pack(np.array([x[0] for x in v], np.uint32), np.array([x[1] for x in v], U64)), np.array([len(x[2]) for x in v], np.int32).tobytes(), b"".join(x[2] for x in v)) for i, v in sorted(out.items())]
        return _table(BODIES, rows)

    return run


def heads(text: np.ndarray, at: np.ndarray, size: int = 8) -> np.ndarray:
    """The ``size`` (8 at most) bytes at each place as one integer that orders like them."""
    raw = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)[at])
    return raw.view(">u8").ravel().astype(U64) >> U64(8 * (8 - size))


def suffix_array(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at ``starts`` by their first ``length`` bytes, and their ranks, by prefix doubling.

    All suffixes of the text are ranked by 8 bytes, then 16, 32 and so on; ranks
    by ``length`` bytes are those of two overlapping halves. A text ends with 8
    zero bytes that belong to no window.
    """
    n = len(text) - 8
    rank = np.unique(heads(text, np.arange(n)), return_inverse=True)[1]
    have = 8
    while have < length:
        step = min(have, length - have)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * np.int64(n + 2) + after, return_inverse=True)[1]
        have += step
    mine = rank[starts]
    order = np.argsort(mine, kind="stable")
    return order, mine[order]


class Level:
    """A text and the starts of its distinct windows in order of their bytes."""

    def __init__(self, text: np.ndarray, order: np.ndarray, owner: np.ndarray):
        self.text, self.order, self.owner = text, order, owner  # owner: number of each window, for marking
        self.head = heads(text, order)

    def some(self, mask: np.ndarray) -> Level:
        return Level(self.text, self.order[mask], self.owner[mask])


def merge_scan(older: Level, newer: Level, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of two levels' windows (numbered on from older to newer), and the pairs that are equal.

    Windows of both sides stand in groups of one common prefix. A round reads the
    next 8 bytes, which the common prefix grows by, and merges each group's two
    runs; groups left with one side are in order already and go no further.
    """
    n = len(older.order)
    order, side = np.arange(n + len(newer.order)), np.repeat([0, 1], [n, len(newer.order)])
    group, open_, prefix = np.zeros(len(order), np.int64), np.arange(len(order)), 0
    while prefix < length and len(open_):
        at, of = order[open_], min(8, length - prefix)
        key, mine = np.empty(len(at), U64), at < n
        key[mine] = heads(older.text, older.order[at[mine]] + prefix, of)
        key[~mine] = heads(newer.text, newer.order[at[~mine] - n] + prefix, of)
        merged = np.lexsort((key, group[open_]))
        at, key = at[merged], key[merged]
        order[open_] = at
        first = np.flatnonzero(np.concatenate(([True], (group[open_][1:] != group[open_][:-1]) | (key[1:] != key[:-1]))))
        size = np.diff(np.append(first, len(at)))
        group[open_] = np.repeat(open_[first], size)
        both = np.minimum.reduceat(side[at], first) != np.maximum.reduceat(side[at], first)
        open_ = open_[np.repeat(both, size)]
        prefix += of
    # windows are distinct within a level, so what is still together are pairs
    return order, order[open_].reshape(-1, 2) - [0, n]


class Family:
    """Levels of geometrically growing size.

    ``add`` takes a batch of texts and the starts of its windows; ``repeats``
    marks the windows, numbered in the order added, that equal another one.
    """

    def __init__(self, length: int):
        self.length, self.levels, self.repeats = length, [], np.zeros(0, bool)

    def add(self, text: np.ndarray, starts: np.ndarray) -> None:
        number = len(self.repeats) + np.arange(len(starts))
        self.repeats = np.append(self.repeats, np.zeros(len(starts), bool))
        text = np.concatenate([text, np.zeros(8, np.uint8)])
        order, rank = suffix_array(text, starts, self.length)
        same = rank[1:] == rank[:-1]
        self.repeats[number[order[1:][same]]] = True
        self.repeats[number[order[:-1][same]]] = True
        order = order[np.concatenate(([True], ~same))]
        new = Level(text, starts[order], number[order])
        for level in self.levels:
            if not len(new.order):
                return
            # of a level only windows that begin like one of the new ones are read
            near = np.minimum(np.searchsorted(new.head, level.head), len(new.head) - 1)
            part = level.some(new.head[near] == level.head)
            _, pairs = merge_scan(part, new, self.length)
            self.repeats[part.owner[pairs[:, 0]]] = True
            self.repeats[new.owner[pairs[:, 1]]] = True
            left = np.ones(len(new.order), bool)
            left[pairs[:, 1]] = False  # the level's own entry stands for later copies
            new = new.some(left)
        if len(new.order):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2].order) <= 2 * len(self.levels[-1].order):
            newer, older = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merge(older, newer))

    def _merge(self, older: Level, newer: Level) -> Level:
        order, _ = merge_scan(older, newer, self.length)
        start = np.concatenate([older.order, newer.order + len(older.text)])
        return Level(np.concatenate([older.text, newer.text]), start[order], np.concatenate([older.owner, newer.owner])[order])


def index_bucket(length: int):
    def run(bucket: pa.Table) -> pa.Table:
        family, held = Family(length), []
        text, starts, at, waiting = [], [], 0, 0

        def flush():
            nonlocal text, starts, at, waiting
            if waiting:
                family.add(np.concatenate(text), np.concatenate(starts))
            text, starts, at, waiting = [], [], 0, 0

        for b, pairs, size, body in zip(*(bucket[x].to_pylist() for x in ("b", "pairs", "size", "body"))):
            a, c = _unpack(pairs)
            raw, to = np.frombuffer(body, np.uint8), np.cumsum(np.frombuffer(size, np.int32))
            for x, y, s, e in zip(a, c, np.concatenate(([0], to[:-1])), to):
                n = e - s - length + 1
                held.append((b, x, y, n))
                text.append(raw[s:e])
                starts.append(at + np.arange(n))
                at += e - s
                waiting += n
                if waiting >= ADD:
                    flush()
        flush()
        rows: dict[int, list] = {}
        done, i = 0, bucket["bucket"][0].as_py()
        for b, x, y, n in held:
            mine = family.repeats[done : done + n]
            done += n
            if mine.any():
                rows.setdefault(b, []).append((x, y, mine))
        out = []
        for b, v in sorted(rows.items()):
            ends = np.cumsum([len(m) for _, _, m in v]).astype(np.int32)
            flags = np.packbits(np.concatenate([m for _, _, m in v])).tobytes()
            out.append((b, i, 2, _pack(np.array([x for x, _, _ in v], np.uint32), np.array([y for _, y, _ in v], U64)), ends.tobytes() + flags))
        return _table(STATUS, out)

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def remove(length: int, bits: int):
    def run(batch: pa.Table, status: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return RESULT.empty_table()
        data, offsets = utf8(batch["text"])
        full_a, full_c, _ = _known(status, 0, bits)
        part_a, part_c, (order, blobs) = _known(status, 2, bits)
        masks = []
        for blob, pairs in zip(blobs, [p for p, k in zip(status["pairs"].to_pylist(), status["kind"].to_pylist()) if k == 2]):
            n = len(pairs) // 12
            ends = np.frombuffer(blob[: 4 * n], np.int32)
            flags = np.unpackbits(np.frombuffer(blob[4 * n :], np.uint8)).astype(bool)
            masks += [flags[s:e] for s, e in zip(np.concatenate(([0], ends[:-1])), ends)]
        n_removed, kept, spans = [], [], []
        for s, z, have in _each(data, offsets, length):
            part = data[offsets[s] : offsets[z]]
            starts = np.zeros(have.n, bool)
            if len(full_c):
                for j in np.flatnonzero(_find(have, full_a, full_c, bits) >= 0):
                    starts[have.first[j] : have.last[j] + 1] = True
            if len(part_c):
                at = _find(have, part_a, part_c, bits)
                for j in np.flatnonzero(at >= 0):
                    starts[have.first[j] : have.last[j] + 1] |= masks[order[at[j]]]
            gone = covered(len(part), np.flatnonzero(starts), length)
            for i in range(s, z):
                x, y = offsets[i] - offsets[s], offsets[i + 1] - offsets[s]
                mask = gone[x:y]
                n_removed.append(int(mask.sum()))
                kept.append(part[x:y][~mask].tobytes() if n_removed[-1] else part[x:y].tobytes())
                spans.append([{"start": int(u), "end": int(v)} for u, v in runs(mask)] if n_removed[-1] else [])
        ids = batch["doc_id"].combine_chunks().cast(pa.int64())
        return pa.Table.from_arrays([ids, pa.array(np.diff(offsets), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, RESULT.field("removed").type)], schema=RESULT)

    return run


def suffix_dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """Every document without the bytes that repeated ``length``-byte strings cover.

    Reads ``doc_id`` and ``text``. Returns doc_id, n_bytes, n_removed, kept (the
    remaining UTF-8 bytes) and removed (maximal [start, end) byte runs).
    """
    if length < 8:
        raise ValueError("length must be 8 bytes or more")
    bits = bucket_bits(docs.sparkSession)
    rows = batched(docs, "doc_id", "text")
    state = "b int, bucket int, kind int, pairs binary, bits binary"
    sent = rows.groupBy("b").applyInArrow(send_contexts(length, bits), "bucket int, b int, one binary, more binary")
    status = sent.groupBy("bucket").applyInArrow(sort_out, state)
    bodies = rows.groupBy("b").cogroup(status.filter("kind = 1").groupBy("b")).applyInArrow(send_bodies(length, bits), "bucket int, b int, pairs binary, size binary, body binary")
    found = bodies.groupBy("bucket").applyInArrow(index_bucket(length), state)
    marks = status.filter(F.col("kind") == 0).unionByName(found)
    return rows.groupBy("b").cogroup(marks.groupBy("b")).applyInArrow(remove(length, bits), OUT)
