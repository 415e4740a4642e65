"""Substring dedup, suffix-array dedup and the n-gram join against brute force."""

import random

import numpy as np
import pytest

from folioquery.llm import ngram_join
from folioquery.llm.components import components
from folioquery.llm.ngram_join import ngram_jaccard_join
from folioquery.llm.substring_dedup import substring_dedup
from folioquery.llm.suffix_dedup import Family, suffix_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string, b int, bucket string, size int, name string, n_words int, kind int"


def corpus(seed=5):
    """Texts with shared passages, copies, near copies, periods, nulls and a long one."""
    r = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = text(60), text(80)
    out = [text(r.randint(0, 120)) for _ in range(40)]
    out += [text(9) + "\n" + passage + "\t " + text(7) for _ in range(6)]
    for _ in range(25):
        w = base.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    out += [out[3]] * 4 + ["", None, " \n ", "one", "one", "One two", "same " * 90, "same " * 50, text(3000) + " " + passage, "a\x00b " * 200]
    return [(i if i % 17 else None, t) for i, t in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 3, 4) for i, t in rows], SCHEMA)


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("width", [35, 6])
def test_substring_dedup(spark, width):
    rows = corpus()
    got = key((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame(spark, rows), width).collect())
    assert got == key((i, *e) for (i, _), e in zip(rows, brute.kept_words([t for _, t in rows], width)))


@pytest.mark.parametrize("length", [400, 50])
def test_suffix_dedup(spark, length):
    rows = corpus(6)
    got = key((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in suffix_dedup(frame(spark, rows), length).collect())
    assert got == key((i, *e) for (i, _), e in zip(rows, brute.kept_bytes([t for _, t in rows], length)))


def test_index_family_levels_grow_geometrically():
    r = np.random.RandomState(1)
    length, family, seen, numbers = 8, Family(8), {}, []
    for _ in range(13):
        text = r.randint(97, 99, 60).astype(np.uint8)
        starts = np.arange(len(text) - length + 1)
        family.add(text, starts)
        for s in starts:
            seen.setdefault(text[s : s + length].tobytes(), []).append(len(numbers))
            numbers.append(0)
    expected = np.zeros(len(numbers), bool)
    for v in seen.values():
        if len(v) > 1:
            expected[v] = True
    assert (family.repeats == expected).all()
    sizes = [len(x.order) for x in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)


@pytest.mark.parametrize("n, threshold", [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(spark, n, threshold):
    rows = corpus(7)
    got = key((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard_join(frame(spark, rows), n, threshold).collect())
    assert got == key((i, *e) for (i, _), e in zip(rows, brute.components(rows, n, threshold)))


def near_copies(seed=11):
    """Groups of 7, 8, 9 and 60 near copies with copies among them, and texts that share a passage but do not link."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    out, passage = [], text(30)
    for size in (7, 8, 9, 60):
        base = text(90)
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
    out += [" ".join(passage + text(r.randint(3, 25))) for _ in range(40)] + out[:5] + out[30:40] + ["one two"] * 3
    return list(enumerate(out, 1))


@pytest.mark.parametrize("weight", [ngram_join.BLOCK_WEIGHT, 5 * ngram_join.ROW_WEIGHT])
def test_groups_of_any_size(spark, monkeypatch, weight):
    monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", weight)
    rows = near_copies()
    got = key((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard_join(frame(spark, rows), 4, 85).collect())
    assert got == key((i, *e) for (i, _), e in zip(rows, brute.components(rows, 4, 85)))


def test_without_links(spark):
    rows = near_copies(12)
    got = ngram_jaccard_join(frame(spark, rows), 5, 80, links=False)
    assert got.columns == ["doc_id", "n_shingles", "class", "component_id"]
    assert key((r.doc_id, r.component_id) for r in got.collect()) == key((i, e[1]) for (i, _), e in zip(rows, brute.components(rows, 5, 80)))


def test_products_and_bounds():
    r = random.Random(3)
    sets = [{r.getrandbits(4) for _ in range(r.randint(1, 12))} for _ in range(60)]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    for x, row in zip(sets, ngram_join.overlaps(arrays, arrays)):
        assert row.tolist() == [len(x & y) for y in sets]
        assert [have >= ngram_join.bound(len(x), len(y), 85) for have, y in zip(row, sets)] == [100 * len(x & y) >= 85 * len(x | y) for y in sets]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40, 50), (50, 60), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40, 60: 40}


def test_components_read_edges_once_in_few_jobs(spark):
    """Before, both directions read the edges and a round ran its exchanges again for a self-join: 82 reads and 18 jobs here, now 41 and 16."""
    pairs, sc = [(0, i) for i in range(1, 40)] + [(50, 60), (60, 70)], spark.sparkContext
    reads = sc.accumulator(0)

    def read(edge):
        reads.add(1)
        return edge

    edges = spark.createDataFrame(sc.parallelize(pairs, 2).map(read), "u long, v long")
    jobs, limit = sc._jsc.sc().dagScheduler().numTotalJobs, "spark.sql.autoBroadcastJoinThreshold"
    usual, before = spark.conf.get(limit), jobs()
    spark.conf.set(limit, "-1")
    try:
        roots = components(edges)
        assert jobs() - before <= 17
    finally:
        spark.conf.set(limit, usual)
    assert reads.value == len(pairs)
    assert dict(roots.collect()) == {**{i: 0 for i in range(40)}, 50: 50, 60: 50, 70: 50}


def test_components_that_families_join(spark, monkeypatch):
    """Columns of two classes count as large here, so that links come from families; their roots form a graph of their own."""
    linked = []
    families = ngram_join._families

    def seen(*args):
        linked.append(families(*args))
        return linked[-1]

    monkeypatch.setattr(ngram_join, "SMALL", 1)
    monkeypatch.setattr(ngram_join, "_families", seen)
    often = " ".join(f"f{i}" for i in range(900))
    x = [f"x{i}" for i in range(100)]
    # the whole of x is in a long text that is the most central one of all its columns and too long to link
    texts = [" ".join(x), " ".join(x[:90] + ["y"] + x[91:]), " ".join(x) + " " + often]
    texts += [often + " " + " ".join(f"t{k}_{i}" for i in range(300)) for k in range(5)]
    rows = near_copies(12) + list(enumerate(texts, 1000))
    got = key((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard_join(frame(spark, rows), 4, 85).collect())
    assert got == key((i, *e) for (i, _), e in zip(rows, brute.components(rows, 4, 85)))
    found = [tuple(r) for r in linked[0].collect()]
    assert found and all(u != v for u, v in found) and len(found) == len(set(found))


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup, ngram_jaccard_join])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [])).count() == 0
    assert operator(frame(spark, [(1, None), (2, ""), (2, "")])).count() == 3


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op5_ngram_jaccard_join", "op6_exact_topk", "op9_benchmark_decontamination"])
def test_queries_equal_sql(spark, name):
    from pathlib import Path

    import duckdb

    from folioquery.llm import registry

    if not Path(SF).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, rel = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(con.sql(f"SELECT {', '.join(sorted(rel.columns))} FROM ({registry.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("length", [8, 13, 20, 50])
def test_index_family(length):
    """Windows of small batches against plain counting; levels merge many times."""
    from collections import Counter

    from folioquery.llm.suffix_dedup import Family, suffix_array

    r = np.random.RandomState(length)
    pieces = [bytes(r.randint(97, 99, 60).tolist()) for _ in range(6)]
    family, every = Family(length), []
    for _ in range(40):
        texts = [bytes(r.randint(97, 99, r.randint(0, 30)).tolist()) + pieces[r.randint(6)][r.randint(20) :] + bytes([r.randint(256)] * 3) for _ in range(r.randint(1, 5))]
        texts = [t + b"\0" * max(0, length - len(t)) for t in texts]
        text = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
        starts = np.concatenate([s + np.arange(len(t) - length + 1) for s, t in zip(at, texts)])
        order, _ = suffix_array(np.concatenate([text, np.zeros(8, np.uint8)]), starts, length)
        windows = [text[s : s + length].tobytes() for s in starts]
        assert [windows[i] for i in order] == sorted(windows)
        family.add(text, starts)
        every += windows
    count = Counter(every)
    assert family.repeats.tolist() == [count[w] > 1 for w in every]
    sizes = [len(level.order) for level in family.levels]
    assert sum(sizes) == len(count) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    for level in family.levels:
        held = [level.text[s : s + length].tobytes() for s in level.order]
        assert held == sorted(held)
