"""The other corpus operators: brute force, held-out accuracy and defined edge cases."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folioquery.llm.decontamination import decontaminate, drop_contaminated
from folioquery.llm.exact_topk import Search, _blocks, _floors, exact_topk
from folioquery.llm.html_extraction import extract_main_text, main_text
from folioquery.llm.quality_classifier import fit, held_out, keep_good, quality_scores
from folioquery.llm.source_mixing import mix_sources, take_mix
from tests.llm import brute

ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again today"), (2, "Short one here"), (10, None), (11, "..."), (None, "null item words that nobody lists anywhere at all ok"), (3, "short ONE here")]


@pytest.mark.parametrize("limit", [8 << 20, 40])
def test_decontamination(spark, limit):
    rows = [
        (1, "see: The QUICK brown fox, jumps over the lazy dog again and again today!"), (2, "a short-one here."), (3, None), (4, ""), (5, "... ---"), (5, "quick brown fox jumps over the lazy dog again and"),
        (6, "null item words that nobody lists anywhere at all ok"), (None, "x short one here y"), (8, "the quick brown fox jumps over a lazy dog"), (9, "word " * 5000 + "short one here " * 3),
    ]
    docs = spark.createDataFrame([(i, t, ["h"], 1) for i, t in rows], "doc_id long, text string, hits array<string>, items int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, n string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate(docs, bench, 10, limit).collect()), key=repr)
    expected = [(i, *brute.hits(t, ITEMS, 10)) for i, t in rows]
    assert got == sorted(expected, key=repr)
    kept = drop_contaminated(docs, bench, 10, limit, shortest=1)
    assert kept.columns == docs.columns and kept.count() == sum(e[2] == 0 for e in expected)
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate(docs, bench.limit(0)).collect()} == {0}


def top_k(rows, k, scale):
    """Plain search over (id, vector) rows: every row whose id 50 divides against every other row."""
    valid = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, (i, x) in enumerate(valid):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), j) for c, (j, y) in enumerate(valid) if c != q and len(y) == len(x))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [256, 10**7])
def test_top_k(spark, scale):
    r = np.random.RandomState(0)
    rows = [(int(i), r.randn(16).round(2).tolist()) for i in range(300)]
    rows += [(300, None), (350, [float("nan")] * 16), (301, [1.0, None] * 8), (302, [1.0] * 3), (303, [1.0, 2.0, 0.0]), (None, [1.0] * 16), (400, [2.0] * 16), (401, [2.0] * 16), (401, [2.0] * 16), (450, [])]
    # rows that share an id, with one vector and with another; ties; an invalid row under a query's id
    rows += [(500, [1.5] * 16)] * 3 + [(500, [-1.5] * 16), (500, None), (450, [1.0] * 3), (7, [2.0] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, g int, score double")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in exact_topk(df.filter("vec_id % 50 = 0"), df, 5, scale).collect())
    assert got == top_k(rows, 5, scale)
    assert exact_topk(df.limit(0), df).count() == 0 and exact_topk(df, df.limit(0)).count() == 0
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in exact_topk(df.filter("vec_id % 50 = 0"), df, 5, scale, seed_rows=2).collect()) == got


def test_top_k_leaves_blocks():
    """Alike vectors stand together, so that most blocks are never multiplied."""
    r = np.random.RandomState(3)
    centre = r.randn(40, 16) * 100
    x = np.floor(centre[r.randint(0, 40, 8000)] + r.randn(8000, 16) * 4)
    ids = np.arange(8000)
    cell = pa.table({"dim": pa.array([16], pa.int32()), "ids": [ids.tobytes()], "keys": [ids.tobytes()], "vectors": [x.tobytes()]})
    seeds = [(16, ids[20:1044].tobytes(), ids[20:1044].tobytes(), x[20:1044].tobytes())]
    one = Search(ids[:20], ids[:20], x[:20], _floors(ids[:20], ids[:20], x[:20], seeds, 5), 5)
    for _, *block in _blocks(cell):
        one.add(*block)
    full = x[:20] @ x.T
    full[np.arange(20), ids[:20]] = -np.inf
    assert np.array_equal(np.sort(one.score, 1), np.sort(full, 1)[:, -5:])
    assert one.seen["pairs"] == 20 * 8000 and one.seen["boxed"] > 0.5 * one.seen["pairs"] and one.seen["exact"] < 0.2 * one.seen["pairs"], one.seen


def test_main_text():
    page = "<html><head><title>t</title></head><body><nav><p>Menu, menu, menu and more of it here</p></nav>{}<footer>foot</footer></body></html>"
    body = "<div id='content'><h1>Head</h1><p>First, long enough paragraph with commas, and words.<p>Second &amp; last&nbsp;one.<br>line</p><div class='comments'><p>Great, post, really nice, one two three four five</p></div></div>"
    assert main_text(page.format(body + "<div class='sidebar'><p>Side, bar, text that is long enough to score well</p></div>")) == "Head\n\nFirst, long enough paragraph with commas, and words.\n\nSecond & last one. line"
    assert main_text(page.format("<article><h1>T</h1><p><b>T<br><p>x</article>")) == "T\n\nT\n\nx"
    assert main_text(None) == main_text("") == main_text("<nav>only menu</nav>") == main_text("<script>var x='<p>no</p>'</script>") == ""
    assert main_text("<article><p>cut of") == "cut of" and main_text("<article><p>cut</p><p cla") == "cut"
    assert main_text("<div>" * 3000 + "<p>deep, deep text that goes on for a while</p>") == "deep, deep text that goes on for a while"


def test_extraction_keeps_rows(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "x"), (1, "u", "<article><p>a</p></article>", "x"), (None, None, None, None)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.text for r in got) == ["", "a", "a"]
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality(spark):
    r = random.Random(2)
    good = [" ".join(r.choice("the of and river stone house winter summer garden morning".split()) for _ in range(r.randint(20, 200))) for _ in range(200)]
    bad = [" | ".join(r.choice("XX!! $$$ %%% ### BUY!! NOW!!".split()) for _ in range(r.randint(20, 200))) for _ in range(100)]
    texts = good + bad + [None, "", "x" * 300_000]
    docs = spark.createDataFrame([(i, t, 0.0, "m") for i, t in enumerate(texts)] + [(None, "a", 0.0, "m")], "doc_id long, text string, score double, difference string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)] + [(None, 1, 0), (0, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = fit(docs, labels, sample_rows=100)
    got = {x.doc_id: x.score for x in quality_scores(docs, model).collect()}
    held = [x.doc_id for x in docs.filter(held_out(docs["doc_id"])).select("doc_id").collect() if x.doc_id is not None and x.doc_id < 300]
    assert np.mean([(got[i] >= 0.7) == (i < 200) for i in held]) > 0.95
    assert got[300] == got[301] and all(0 <= s <= 1 for s in got.values())
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.7 for s in got.values())
    none = fit(docs, labels.limit(0))
    assert {x.score for x in quality_scores(docs, none).collect()} == {0.5}
    assert quality_scores(docs.limit(0), model).count() == 0


def water(sizes, share=1.5, cap=2.0):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight, open_, out = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(names), {}
    while open_:
        left = share * sum(sizes.values()) - sum(out.values())
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        out |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return out


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, None if i % 50 == 0 else "w " * r.randint(0, 40), r.choice(["a", "b", "é", None, "", "hot", "hot", "hot"])) for i in range(3000)] + [(7, "x y", "a")] * 3 + [(None, "z", "b"), (9000, None, "zero")]
    docs = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id long, text string, source string, size int, key string")
    got = mix_sources(docs).collect()
    sizes, taken = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for x in got:
        taken[x.source] = taken.get(x.source, 0) + x.taken
        assert x.source_size == sizes[x.source] and 0 <= x.taken <= 2 * x["size"] and x.taken == x.copies * x["size"]
    target = water(sizes)
    assert {x.source: round(x.target, 6) for x in got} == {s: round(t, 6) for s, t in target.items()}
    assert all(abs(taken[s] - t) <= 40 for s, t in target.items()) and len(got) == len(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, mix_sources(docs.repartition(7)).collect()))
    mix = take_mix(docs)
    assert mix.columns == [*docs.columns, "mix_size", "mix_copies", "mix_taken"]
    assert mix.count() == sum(x.copies > 0 for x in got)
    assert mix_sources(docs.limit(0)).count() == 0


def test_mixing_tells_rows_without_an_id_apart(spark):
    rows = [(None, " ".join(f"w{i}" for _ in range(1 + i % 7)), "a") for i in range(2000)] + [(None, "x " * 50_000, "b"), (None, "y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs, share=0.5).collect()
    for source in "ab":
        mine = [x for x in got if x.source == source]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= (8 if source == "a" else 50_001)


def test_quality_of_a_rare_script(spark):
    """Texts of a script with few rows have dictionaries of their own; ties and repeated rows score alike."""
    r = random.Random(6)
    words = {"latin": "the of and river stone house winter summer garden morning".split(), "greek": "και το ποτάμι πέτρα σπίτι χειμώνας κήπος πρωί νησί άνεμος".split()}
    junk = {"latin": "XX!! $$$ %%% ### BUY!! NOW!!".split(), "greek": "ΠΩΛΗΣΗ!! ΤΩΡΑ!! ((( ))) ΔΩΡΟ!!".split()}
    rows = []
    for i in range(600):
        script = "greek" if i % 8 == 0 else "latin"
        rows.append((i, " ".join(r.choice((junk if i % 3 == 0 else words)[script]) for _ in range(r.randint(20, 120)))))
    docs = spark.createDataFrame(rows + [rows[2]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    model = fit(docs, labels)
    got = [(x.doc_id, x.score) for x in quality_scores(docs, model).collect()]
    held = {x.doc_id for x in docs.filter(held_out(docs["doc_id"])).select("doc_id").collect()}
    assert len(model.pairs) > 1
    for mark in (0, 1):
        assert np.mean([(s >= 0.7) == (i % 3 > 0) for i, s in got if i in held and (i % 8 == 0) == mark]) > 0.95
    assert len({s for i, s in got if i == 2}) == 1 and len(got) == 601
    few = fit(docs, labels, sample_rows=50, sample_bytes=20_000)
    assert {round(x.score, 9) for x in quality_scores(docs.limit(0), few).collect()} == set()
