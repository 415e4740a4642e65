"""Cross-entropy differences against plain counting."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from folioquery.llm.lm_scoring import ALPHA, MU, lm_scores
from tests.llm.brute import SPACED, fold

SCHEMA = "doc_id long, text string, b int, kind string, score double"


def plain(rows, target, min_count):
    docs = [["<s>", *w] if (w := SPACED.findall(fold(t))) else [] for _, t in rows]
    mine = [i in target for i, _ in rows]
    count = Counter(w for d in docs for w in d)
    docs = [[w if count[w] >= min_count else "<unk>" for w in d] for d in docs]
    size = sum(c >= min_count for c in count.values())
    out = []
    for i, d in enumerate(docs):
        loss = []
        for use in ([True] * len(docs), mine):
            others = [x for j, x in enumerate(docs) if j != i and use[j]]
            one, two = Counter(w for x in others for w in x), Counter(p for x in others for p in zip(x, x[1:]))
            n = sum(one.values())
            bits = 0.0
            for u, w in zip(d, d[1:]):
                p = (one[w] + ALPHA) / (n + ALPHA * (size + 1))
                bits -= math.log2((two[u, w] + MU * p) / (one[u] + MU))
            loss.append(bits / max(1, len(d) - 1))
        out.append((rows[i][0], max(0, len(d) - 1), loss[1], loss[0]))
    return out


@pytest.mark.parametrize("min_count", [1, 3])
def test_scores(spark, min_count):
    r = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(words[: 10 if i % 2 else 30]) for _ in range(r.randint(1, 60)))) for i in range(60)]
    rows += [(5, "W1 w2 w3"), (None, "w1 w1 w1"), (70, None), (71, " "), (72, "only here"), (None, "w2")]
    target = {i for i in range(60) if i % 2}
    ids = spark.createDataFrame([(i, "x") for i in target] + [(1, "x"), (None, "x"), (999, "x")], "doc_id long, b string")
    got = sorted(((x.doc_id, x.n_tokens, x.loss_target, x.loss_background) for x in lm_scores(spark.createDataFrame([(i, t, 1, "k", 0.0) for i, t in rows], SCHEMA), ids, min_count).collect()), key=repr)
    for g, e in zip(got, sorted(plain(rows, target, min_count), key=repr)):
        assert g[:2] == e[:2] and g[2:] == pytest.approx(e[2:], abs=1e-9)
    assert len(got) == len(rows)


def test_target_like_documents_score_lower(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("a b c d e f".split() if i % 2 else "u v w x y z".split()) for _ in range(80))) for i in range(200)]
    ids = spark.createDataFrame([(i,) for i in range(1, 100, 2)], "doc_id long")
    got = {x.doc_id: x.score for x in lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), ids).collect()}
    assert max(got[i] for i in range(1, 200, 2)) < min(got[i] for i in range(0, 200, 2))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scores(none, none).count() == 0
    assert [x.score for x in lm_scores(spark.createDataFrame([(1, None)], none.schema), none).collect()] == [0.0]


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_session_settings_change_nothing(spark, partitions):
    """A large vocabulary, so that short keys would meet; a very long text; repeated rows."""
    r = random.Random(11)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(n))) for i, n in enumerate([40_000, 3000, 3000, 500, 1])]
    rows += [rows[1], (9, None)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        ids = spark.createDataFrame([(0,), (3,)], "doc_id long")
        got = sorted(((x.doc_id, x.n_tokens, x.loss_target, x.loss_background) for x in lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), ids, 2).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    for g, e in zip(got, sorted(plain(rows, {0, 3}, 2), key=repr), strict=True):
        assert g[:2] == e[:2] and g[2:] == pytest.approx(e[2:], abs=1e-9)


def test_counts_keep_64_bits():
    from folioquery.llm._arrays import pack, unpack

    for values in ([], [0, 255], [256, 3], [1 << 31, 1 << 33, 7]):
        assert unpack(pack(np.array(values, np.int64))).tolist() == values
