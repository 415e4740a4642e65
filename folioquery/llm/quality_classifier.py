"""Compression classifier for text quality (operator 4).

Zstandard dictionaries are built from texts labelled good and bad, a pair for
each of at most ``groups`` groups of texts that use alike pairs of letters (so that
a language or script with few rows has dictionaries of its own; nothing but the
text decides the group; a class with few texts in a group has its dictionary from
all of the class). A text is compressed, piece by piece and whole, under
either dictionary of its group; the difference of the two sizes over the text's
length (and ``DAMP`` bytes, so that a few words say little) is small or negative
for junk, which costs less under the bad dictionary. A logistic curve fitted on
labelled texts that no dictionary has seen calibrates that difference; its shift
is moved from the sample's share of either class to the labels' own.

Only the fit is bounded: at most ``sample_rows`` labelled texts of each class,
those with the least hash of their id, of at most ``sample_bytes`` together and
none over a 64th of that. Sizes are summed first, so that no more than these
bytes reach the driver. Scoring reads every whole text and never shuffles.

Defined results: a null or empty text gets the score of its difference 0 (the
curve's value there); labels that are null or contradict one another for an id
are not learnt from; of different texts under one id the shortest is learnt
from; equal rows get equal scores, ties included; without labels of both
classes every score is the share of label 1 (0.5 without any); an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm._arrays import pieces, release

PIECE, SAMPLE = 4096, 512
FEATURES, FEW = 1024, 12
DAMP = 200
LEVEL = 3
DICTIONARY = 112_640
OUT = "doc_id long, difference double, score double"


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


class Model:
    """The groups' centres, a pair of dictionaries for each, and a curve."""

    def __init__(self, centres: np.ndarray, pairs: list[tuple[bytes, bytes]], slope: float, shift: float):
        self.centres, self.pairs, self.slope, self.shift = centres, pairs, slope, shift

    def scorer(self):
        """difference(text) over all of a text; compressors are made once."""
        pairs = [_compressors(*p) for p in self.pairs]
        return lambda text: _difference(pairs[int(np.argmax(self.centres @ _grams(text)))], text)


def _grams(text: bytes) -> np.ndarray:
    """Unit vector of the roots of hashed counts of letter pairs; case and all else, which junk is full of, left out."""
    a = np.frombuffer(text.decode().lower().encode(), np.uint8).astype(np.int64)
    a = a[(a >= 0x80) | ((a >= 0x61) & (a <= 0x7A))]
    v = np.sqrt(np.bincount((a[:-1] * 31 + a[1:]) % FEATURES, minlength=FEATURES)) if len(a) > 1 else np.zeros(FEATURES)
    n = np.linalg.norm(v)
    return v / n if n else v


def _centres(v: np.ndarray, groups: int) -> np.ndarray:
    """Centres of groups of ``FEW`` texts or more, by cosine; the start is the farthest text each time."""
    centre = [v[np.argmax(v @ v.mean(0))]]
    while len(centre) < min(groups, len(v)):
        centre.append(v[np.argmin((v @ np.array(centre).T).max(1))])
    centre = np.array(centre)
    while True:
        for _ in range(10):
            own = np.argmax(v @ centre.T, 1)
            centre = np.array([v[own == j].mean(0) if (own == j).any() else c for j, c in enumerate(centre)])
            centre /= np.maximum(np.linalg.norm(centre, axis=1), 1e-12)[:, None]
        own = np.argmax(v @ centre.T, 1)
        size = np.bincount(own, minlength=len(centre))
        if len(centre) == 1 or size.min() >= FEW:
            return centre
        centre = np.delete(centre, int(np.argmin(size)), 0)


def _compressors(good: bytes, bad: bytes):
    out = []
    for raw in (good, bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def _difference(compressors, text: bytes) -> float:
    """(size under bad - size under good) / (length + DAMP), over pieces of the whole text."""
    if not text:
        return 0.0
    good, bad = compressors
    total = 0
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        total += len(bad.compress(piece)) - len(good.compress(piece))
    return total / (len(text) + DAMP)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's steps with a slight pull to 0."""
    scale = float(np.std(x)) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = 1e-2 * np.array([1.0, 0.0])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9), a.T @ (p - y) + pull * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _dictionary(texts: list[bytes]) -> bytes:
    samples = [t[at : at + SAMPLE] for t in texts for at in range(0, len(t), SAMPLE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their plain text serves
        return b"\n".join(samples)[-DICTIONARY:] or b"........"


def _sample(docs: DataFrame, known: DataFrame, sample_rows: int, sample_bytes: int) -> dict[int, list[bytes]]:
    """The labelled texts to learn from, by class and then hash of their id."""
    least = [known.filter(F.col("q") == q).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample_rows) for q in (0, 1)]
    # ids and sizes first: 2 * sample_rows rows bound the broadcast and what is collected
    texts = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text"), F.octet_length(docs["text"]).alias("n"), F.xxhash64(docs["text"]).alias("t")).filter("n > 0")
    rows = texts.filter(F.col("n") <= sample_bytes // 64).select("id", "n", "t").join(F.broadcast(least[0].unionByName(least[1])), "id")
    rows = sorted((r["q"], r["h"], r["id"], r["e"]["n"], r["e"]["t"]) for r in rows.groupBy("q", "h", "id").agg(F.min(F.struct("n", "t")).alias("e")).collect())
    total, chosen = {0: 0, 1: 0}, []
    for q, h, i, n, t in rows:
        total[q] += n
        if total[q] <= sample_bytes // 2:
            chosen.append((len(chosen), q, i, n, t))
    got: dict[int, list[bytes]] = {0: [], 1: []}
    if chosen:
        # an Arrow table, for which no executor starts Python as it does for a list of rows
        chosen = pa.table(dict(zip(("k", "q", "id", "n", "t"), zip(*chosen))))
        chosen = docs.sparkSession.createDataFrame(chosen, "k int, q int, id long, n int, t long")
        found = texts.join(F.broadcast(chosen), ["id", "n", "t"]).groupBy("k", "q").agg(F.min("text").alias("text"))
        for batch in found.toArrow().sort_by("k").to_batches(max_chunksize=256):
            for q, text in zip(batch["q"].to_pylist(), batch["text"].to_pylist()):
                got[q].append(text.encode())
    return got


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, sample_bytes: int = 32 << 20, groups: int = 8) -> Model:
    """Learns from labelled rows that are not held out."""
    known = labels.select(labels["doc_id"].alias("id"), labels["quality"].alias("q")).filter("q in (0, 1)")
    known = known.groupBy("id").agg(F.min("q").alias("q"), F.max("q").alias("most")).filter("q = most and id is not null").drop("most")
    known = known.filter(~held_out(F.col("id")))
    share = known.agg(F.avg("q")).first()[0]
    got = _sample(docs, known, sample_rows, sample_bytes)
    if len(got[0]) < 4 or len(got[1]) < 4:
        p = min(0.99, max(0.01, 0.5 if share is None else float(share)))
        return Model(np.zeros((1, FEATURES)), [(b"........", b"........")], 0.0, float(np.log(p / (1 - p))))
    seen = [(t, q) for q in (0, 1) for t in got[q][::2]]
    rest = [(t, q) for q in (0, 1) for t in got[q][1::2]]
    v = np.array([_grams(t) for t, _ in seen])
    centres = _centres(v, groups)
    own = np.argmax(v @ centres.T, 1)
    whole = {q: _dictionary([t for t, c in seen if c == q]) for q in (1, 0)}
    pairs = []
    for j in range(len(centres)):
        part = {q: [t for (t, c), g in zip(seen, own) if c == q and g == j] for q in (1, 0)}
        pairs.append(tuple(_dictionary(part[q]) if len(part[q]) >= FEW else whole[q] for q in (1, 0)))
    difference = Model(centres, pairs, 0.0, 0.0).scorer()
    slope, shift = _curve(np.array([difference(t) for t, _ in rest]), np.array([float(q) for _, q in rest]))
    p = min(0.999, max(0.001, float(share)))
    shift += float(np.log(p / (1 - p)) - np.log(len(got[1][1::2]) / len(got[0][1::2])))
    del got, rest, seen, v, difference
    release()
    return Model(centres, pairs, slope, shift)


def _scores(model: Model):
    """Differences and scores of a column of texts."""
    difference = model.scorer()

    def of(column):
        d = np.array([difference(t.encode()) if t else 0.0 for t in column.to_pylist()], float)
        return d, 1 / (1 + np.exp(-np.clip(model.slope * d + model.shift, -30, 30)))

    return of


def _score(model: Model):
    def run(batches):
        scores = _scores(model)
        for batch in batches:
            d, score = scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(d), pa.array(score)], names=["doc_id", "difference", "score"])

    return run


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, difference and score of every row."""
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(_score(model), OUT)


def _keep(model: Model, least: float):
    def run(batches):
        scores = _scores(model)
        for batch in pieces(batches):
            yield batch.filter(pa.array(scores(batch.column("text"))[1] >= least))

    return run


def keep_good(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The documents, with all their columns, whose score is ``least`` or more."""
    return docs.mapInArrow(_keep(model, least), docs.schema)
