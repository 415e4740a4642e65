"""Vectorised text primitives shared by the corpus operators.

Texts are handled as one UTF-8 byte buffer with document offsets, taken from
Arrow without copying. Words, rolling n-gram hashes and sliding minima are
computed with whole-array numpy calls over slices of about ``SLICE_BYTES``, so
the working set stays in cache and memory does not follow the batch size.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Of the pipeline's stages, whose workers live on from one to the next.
PIECE_BYTES = 1 << 18
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # combine_chunks of several large chunks
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer one stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def release() -> None:
    """Gives free memory back to the system, for processes that live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterable[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of about ``limit`` bytes of text, so that what a worker makes of one does not follow the batch's size."""
    for batch in batches:
        _, offsets = utf8(batch.column("text"))
        for a, z in slices(offsets, limit):
            yield batch.slice(a, z - a)
    release()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


BYTE_VALUES = _byte_values()
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and extended by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, U64)
        have[1] = U64(base % (1 << 64))
        done = 2
        while done < size:
            step = U64(pow(base, done, 1 << 64))
            more = min(done, size - done)
            have[done : done + more] = have[:more] * step
            done += more
        _POWERS[base] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any run of values is read."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values), _BASE), out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the run stands."""
    inverse = powers(len(prefix), _BASE_INV)
    return mix((prefix[end] - prefix[start]) * inverse[start] ^ (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def rolling(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values, boundaries of documents not regarded."""
    n = len(prefix) - 1 - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    inverse = powers(len(prefix), _BASE_INV)[:n]
    return mix((prefix[k:] - prefix[:n]) * inverse ^ U64(k * 0xA24BAED4963EE407 % (1 << 64)))


def table(allowed: bytes) -> np.ndarray:
    """A 256-entry membership table."""
    out = np.zeros(256, bool)
    out[list(allowed)] = True
    return out


#: Every byte but space and \t \n \v \f \r stands in a word.
SPACED = table(bytes(b for b in range(256) if b not in b" \t\n\x0b\x0c\r"))
#: ASCII digits and letters and all bytes from 0x80 stand in a word.
ALNUM = table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of a slice of documents: byte bounds, hashes and document offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: bool = False):
        self.data, self.offsets = (LOWER[data] if fold else data), offsets
        inside = member[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = offsets[1:] > offsets[:-1]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.start, offsets)  # word offsets of documents

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        return run_hash(prefix_hash(BYTE_VALUES[self.data]), self.start, self.end)

    def whole(self, k: int, n: int) -> np.ndarray:
        """For each of the first n runs of k words: whether one document holds it."""
        ok = np.zeros(n, bool)
        if n:
            owner = np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))
            ok[:] = owner[:n] == owner[k - 1 : k - 1 + n]
        return ok


def each_slice(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    for a, b in slices(offsets, limit):
        part = data[offsets[a] : offsets[b]]
        yield a, b, Words(part, offsets[a : b + 1] - offsets[a], member, fold)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def covered(n: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the runs that begin at ``starts``."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def runs(mask: np.ndarray) -> np.ndarray:
    """[start, end) of the maximal true runs."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge.reshape(-1, 2)


def contains(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Membership of values in a sorted array, with a bitmap before the search."""
    out = np.zeros(len(values), bool)
    if not len(ordered) or not len(values):
        return out
    bits = min(22, max(12, int(len(ordered)).bit_length() + 4))
    seen = np.zeros(1 << bits, bool)
    low = values.dtype.type((1 << bits) - 1)
    seen[(ordered & low).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(values & low).astype(np.int64)])
    at = np.searchsorted(ordered, values[maybe])
    at[at == len(ordered)] = 0
    out[maybe] = ordered[at] == values[maybe]
    return out


def repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and whether each stands there more than once."""
    if not len(values):
        return values, np.zeros(0, bool)
    values = np.sort(values)
    first = np.concatenate(([True], values[1:] != values[:-1]))
    at = np.flatnonzero(first)
    return values[at], np.diff(np.append(at, len(values))) > 1


def by_bucket(ordered: np.ndarray, bits: int) -> np.ndarray:
    """Offsets of the 2**bits equal ranges of sorted 64-bit hashes."""
    edges = (np.arange(1 << bits, dtype=U64) << U64(64 - bits)) if bits else np.zeros(1, U64)
    return np.append(np.searchsorted(ordered, edges), len(ordered))


def planes(values: np.ndarray) -> bytes:
    """Sorted integers byte plane by byte plane, so that shuffle compression bites on the high ones."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplanes(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not blob:
        return np.zeros(0, dtype)
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers of any size in the narrowest width that holds them: that width, then byte planes."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + planes(values.astype(f"u{width}"))


def unpack(blob: bytes) -> np.ndarray:
    return unplanes(blob[1:], np.dtype(f"u{blob[0]}")).astype(np.int64)
