"""Searches of pages against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from folioquery import fixed
from folioquery.functions import similarity
from folioquery.operators import page_search
from folioquery.plans import investigate


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(3)
    words, rows = [f"w{i}" for i in range(60)], []
    for k in range(240):
        text = " ".join(rnd.choices(words, k=rnd.choice([0, 1, 4, 30, 150])))
        if k % 2:
            text = f"{rnd.randrange(1, 4)}/{rnd.randrange(1, 5)}/2020 " + text
        if k % 3 == 0:
            text += f" Person{rnd.randrange(4)}, MD " + rnd.choice(["MRI", "therapy report", "Office  Visit"])
        rows.append((k, text))
    rows += [(1000 + k, rows[k % 7 + 20][1]) for k in range(90)]  # a third are copies
    rows += [(2000, None), (2001, ""), (2002, " \n\t ")]
    return spark.createDataFrame(rows, "physical int, text string").cache()


def every_pair(pages, least):
    prints = pages.filter("trim(regexp_replace(coalesce(text, ''), '\\\\s+', ' ')) <> ''").select("physical", similarity.fingerprint(F.col("text")).alias("f"))
    a, b = prints.toDF("one", "x"), prints.toDF("physical", "y")
    return a.crossJoin(b).select("one", "physical", similarity.similarity(F.col("x"), F.col("y")).alias("score")).filter(F.col("score") > least).collect()


def test_candidates_equal_every_pair(spark, pages):
    best = {}
    for r in every_pair(pages, fixed.SEARCH_SCORE):
        best.setdefault(r.one, []).append((-r.score, r.physical))
    expected = {k: [(p, -s, i + 1) for i, (s, p) in enumerate(sorted(v)[:3])] for k, v in best.items()}
    got = {}
    for r in investigate.candidates(pages, pages).collect():
        got.setdefault(r.one, []).append((r.physical, r.score, r["rank"]))
    assert got == expected and len(got) > 300


def test_duplicates_equal_every_pair(pages):
    expected = sorted((r.one, r.physical, r.score) for r in every_pair(pages, fixed.DUPLICATE_SCORE) if r.one != r.physical)
    got = [(r.one, r.physical, r.score) for r in investigate.duplicates(pages, pages).collect()]
    assert got == expected and any(b >= 1000 for _, b, _ in got)


def test_blocks_change_nothing_and_bounds_spare_work(pages):
    rows = page_search.classed(pages, "physical")
    whole = page_search.search(rows, rows, 0.5, None).collect()
    small = page_search.search(rows, rows, 0.5, None, query_rows=40, page_rows=25).collect()
    assert sorted((r.query, r.page, r.score) for r in whole) == sorted((r.query, r.page, r.score) for r in small)
    by_query = {r.query: (r.compared, r.counted) for r in page_search.search(rows, rows, 0.5, 3).collect()}
    compared, counted = (sum(x) for x in zip(*by_query.values()))
    print(f"scored in full: {counted} of {compared}")
    assert counted < 0.6 * compared


def test_copies_are_one_class(pages):
    rows = page_search.classed(pages, "physical")
    assert rows.select("class").distinct().count() < rows.count() - 80


def test_pages_alike_in_their_preview_only_are_not_scored_in_full(spark):
    start = " ".join(f"s{i}" for i in range(50))
    rows = [(k, start + " " + " ".join(f"p{k}x{i}" for i in range(200))) for k in range(12)]
    prints = page_search.classed(spark.createDataFrame(rows, "physical int, text string"), "physical")
    found = page_search.search(prints, prints, fixed.DUPLICATE_SCORE, None).collect()
    assert len(found) == 12 and all(r.query == r.page and r.compared == 12 and r.counted == 1 for r in found)


def test_shared_values_are_counted_alike_from_rows_and_from_holders():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(5)
    rows = [rnd.sample(range(40), rnd.randrange(12)) for _ in range(300)]
    block = page_search._Lists.read(pa.array(rows, pa.list_(pa.int64())))
    wanted = np.array([3, 8, 21, 39, 77])
    expected = [len({*r} & {*wanted.tolist()}) for r in rows]
    every, known = np.arange(300), block.known(wanted)
    assert block.shared_by_all(known).tolist() == block.shared(known, every).tolist() == expected
    assert block.shared(known, every[:3]).tolist() == expected[:3] and sorted(block.of(7)) == sorted(rows[7])


def test_nothing_to_search(spark, pages):
    none = spark.createDataFrame([], "physical int, text string")
    assert investigate.candidates(none, pages).count() == 0 and investigate.candidates(pages, none).count() == 0 and investigate.duplicates(none, none).count() == 0
    extra = pages.selectExpr("*", "1 as score", "'x' as page", "2 as class", "3 as key").filter("physical = 21")
    assert [r["rank"] for r in investigate.candidates(extra, extra).collect()] == [1]


@pytest.mark.parametrize("rare, asked", [(0, 4_000_000), (3, 4_000_000), (20, 5), (10_000, 4_000_000)])
def test_signatures_and_rare_values_give_what_every_pair_gives(spark, pages, monkeypatch, rare, asked):
    monkeypatch.setattr(page_search, "RARE", rare)
    monkeypatch.setattr(page_search, "ASKED", asked)
    best = {}
    for r in every_pair(pages, fixed.SEARCH_SCORE):
        best.setdefault(r.one, []).append((-r.score, r.physical))
    expected = sorted((k, p, -s, i + 1) for k, v in best.items() for i, (s, p) in enumerate(sorted(v)[:3]))
    assert sorted((r.one, r.page, r.score, r["rank"]) for r in page_search.best_pages(pages, pages, "physical", fixed.SEARCH_SCORE, 3).collect()) == expected


def test_few_signatures_meet_where_pages_differ_in_rare_values_only(spark, monkeypatch):
    rows = [(k, f"{k % 12 + 1}/{k % 28 + 1}/2020  Customer#{k:05d}, MD Office Visit for number{k}") for k in range(3000)]
    df, met, search = spark.createDataFrame(rows, "physical int, text string"), [], page_search.search
    monkeypatch.setattr(page_search, "search", lambda a, b, *more: (met.append((a.count(), b.count())), search(a, b, *more))[1])
    found = page_search.best_pages(df.filter("physical % 50 = 0"), df, "physical", fixed.SEARCH_SCORE, 1).collect()
    assert len(found) == 60 and all(r.one == r.page for r in found)
    assert met[0][0] < 60 and met[0][1] < 200
