"""The page cache: what is extracted again, what is written, and what a killed run leaves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioquery.sources import page_cache

WANTED = "side string, document string, page int, modified timestamp"


def at(day):
    return dt.datetime(2024, 1, day)


def wanted(spark, *rows):
    return spark.createDataFrame([(s, d, p, m and at(m)) for s, d, p, m in rows], WANTED)


def run(spark, path, rows, day, fail=None, **more):
    asked = []

    def extract(keys):
        asked.extend(sorted((r.side, r.document, r.page) for r in keys.collect()))
        text = F.concat_ws(":", "document", "page", F.lit(str(day)))
        if fail is not None:
            text = F.when(F.col("page") == fail, F.raise_error(F.lit("killed"))).otherwise(text)
        return keys.withColumn("text", text).filter("page <> 99")

    cache = page_cache.refresh(spark, path, wanted(spark, *rows), extract, now=F.lit(at(day)).cast("timestamp"), **more)
    return asked, {(r.side, r.document, r.page): r.text for r in cache.collect()}


def files(path):
    return sorted(str(p) for p in path.rglob("*.parquet"))


def test_only_what_is_missing_or_out_of_date(spark, tmp_path):
    path = tmp_path / "cache"
    rows = [("yours", "a", 1, 1), ("yours", "a", 2, 1), ("theirs", "b", 1, 1), ("yours", "a", 1, 1), ("theirs", "c", 5, None)]
    asked, cache = run(spark, str(path), rows, 3, buckets=2)
    assert len(asked) == 4 and cache["yours", "a", 1] == "a:1:3" and len(cache) == 4
    before = files(path)
    assert run(spark, str(path), rows, 4, buckets=2) == ([], cache) and files(path) == before
    # a new page, a failed one, a source of ours and one of theirs that changed
    more = [("yours", "a", 1, 5), ("yours", "a", 3, 1), ("yours", "a", 99, 1), ("theirs", "b", 1, 5), ("theirs", "b", 2, 5)]
    asked, cache = run(spark, str(path), more, 6, buckets=2)
    assert asked.count(("yours", "a", 1)) == 1 and set(asked) == {("yours", "a", 1), ("yours", "a", 3), ("yours", "a", 99), ("theirs", "b", 2)}
    assert cache == {("yours", "a", 1): "a:1:6", ("yours", "a", 2): "a:2:3", ("yours", "a", 3): "a:3:6", ("theirs", "b", 1): "b:1:3", ("theirs", "b", 2): "b:2:6", ("theirs", "c", 5): "c:5:3"}
    assert run(spark, str(path), more, 7, buckets=2)[0] == [("yours", "a", 99)]
    asked, cache = run(spark, str(path), [("theirs", "b", 1, None), ("yours", "z", 0, None)], 8, always=True, buckets=2)
    assert len(asked) == 2 and cache["theirs", "b", 1] == "b:1:8" and cache["theirs", "b", 2] == "b:2:6" and len(cache) == 7


@pytest.mark.parametrize("again", [("yours", "a", 7, 1), ("yours", "a", 1, 9)])
def test_a_killed_run_leaves_a_readable_cache(spark, tmp_path, again):
    path = str(tmp_path / "cache")
    _, cache = run(spark, path, [("yours", "a", p, 1) for p in range(5)], 2)
    todo = [again, ("yours", "a", 8, 1), ("theirs", "q", 8, 1)]
    with pytest.raises(Exception, match="killed"):
        run(spark, path, todo, 9, fail=8)
    left = {(r.side, r.document, r.page): r.text for r in page_cache.cached(spark, path).collect()}
    assert cache.items() <= left.items()
    asked, after = run(spark, path, todo, 9)
    assert again[:3] in asked and len(after) == 5 + 2 + (again[2] == 7)
    assert page_cache.cached(spark, path).count() == len(after)


def test_nothing_wanted(spark, tmp_path):
    path = tmp_path / "none"
    assert run(spark, str(path), [], 1) == ([], {}) and not path.exists()
