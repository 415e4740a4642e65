"""Every stage of the pipeline against brute force, on rows with nulls, copies and benchmark passages."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import brute  # noqa: E402
from tests.llm.test_pii import base_spans  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    folder = tmp_path_factory.mktemp("sf")
    words = "river stone house winter summer garden morning bridge field tower".split()
    text = lambda n: " ".join(r.choice(words) + str(r.randint(0, 50)) for _ in range(n))
    item = text(14)
    docs = [text(60) for _ in range(120)]
    docs += [docs[0]] * 3 + [docs[1] + " tail", item + " " + text(30), text(40) + " call +1 555 010 9999 or a@b.co", None, ""]
    docs += [" | ".join(r.choice(["XX!!", "$$$", "###"]) for _ in range(60)) for _ in range(40)]
    rows = [(i if i != 30 else None, t, "en", f"s{i % 3}" if i % 11 else None, None if t is None else len(t)) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(len(docs)) if i % 2 or i > 127], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), item


def test_stages(spark, tables):
    folder, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    columns = docs.columns

    good = pipeline.quality(spark, docs, folder)
    kept = {r.text for r in good.collect()}
    assert good.columns == columns and not any("$$$" in (t or "") for t in kept)
    assert sum(r.text in kept for r in docs.filter("doc_id < 120").collect()) >= 115

    one = pipeline.near_duplicates(spark, docs, folder)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = [i for (i, _), (_, c, _) in zip(rows, brute.components(rows, 5, 80)) if i is not None and i == c]
    assert one.columns == columns
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == sorted(expected)
    assert one.filter("doc_id is null").count() == 1

    clean = pipeline.decontamination(spark, docs, folder)
    assert clean.columns == columns
    assert clean.count() == sum(brute.hits(t, [(1, item)], 10)[1] == 0 for _, t in rows)

    masked = pipeline.pii(spark, docs, folder)
    assert masked.columns == columns and masked.count() == docs.count()
    assert not any(base_spans(r.text) for r in masked.collect())
    assert all((r.text is None) == (r.n_chars is None) and len(r.text or "") == (r.n_chars or 0) for r in masked.collect())

    mix = pipeline.mixing(spark, docs, folder)
    assert mix.columns[: len(columns)] == columns and mix.filter("mix_copies < 1").count() == 0


def test_near_duplicates_with_repeated_ids(spark):
    r = random.Random(5)
    one, two, three, four, five, six, seven = (" ".join(f"{r.choice('abcdef')}{r.randint(0, 400)}" for _ in range(60)) for _ in range(7))
    rows = [(1, one), (1, two), (1, None), (2, one + " tail"), (2, three), (3, four), (3, four), (3, four + " tail"), (None, five), (9, five + " tail"), (None, six), (None, six), (None, seven), (4, None), (5, ""), (5, " ")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = [(x.doc_id, x.text) for x in pipeline.near_duplicates(spark, docs, "").collect()]
    assert sum(x in ((3, four), (3, four + " tail")) for x in got) == 1
    expected = [(1, one), (1, two), (1, None), (2, three), (9, five + " tail"), (None, six), (None, seven), (4, None), (5, ""), (5, " ")]
    assert sorted((x for x in got if x[0] != 3), key=repr) == sorted(expected, key=repr)


def test_run(spark, tables):
    folder, item = tables
    out = pipeline.run(spark, folder).collect()
    assert out and not any(item in (r.text or "") or "$$$" in (r.text or "") for r in out)
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "mixing"]


def test_empty_documents_and_extra_columns(spark, tables, tmp_path):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.selectExpr("*", "map('k', doc_id) as node", "array(text) as least", "doc_id as `group`", "0.5D as score", "named_struct('a', map(1, 2)) as doc")
    for name, stage in pipeline.STAGES:
        none = stage(spark, docs.limit(0), folder)
        assert none.count() == 0 and none.columns[: len(docs.columns)] == docs.columns, name
        got = stage(spark, odd, folder)
        assert got.columns[: len(odd.columns)] == odd.columns, name
        assert got.select(docs.columns).exceptAll(docs if name != "pii" else got.select(docs.columns)).count() == 0, name
        assert got.count() == stage(spark, docs, folder).count() > 0, name


def test_short_items_drop_nothing(spark):
    docs = spark.createDataFrame([(1, "the first of words and then some more"), (2, "five short words stand here now")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the"), (2, "Five short words stand here"), (3, None)], "item_id long, text string")
    from folioquery.llm.decontamination import drop_contaminated

    assert [r.doc_id for r in drop_contaminated(docs, bench).collect()] == [1]
    assert drop_contaminated(docs, bench, shortest=1).count() == 0


def test_stages_work_on_small_parts_of_a_batch():
    """A worker holds a whole batch of Arrow as it comes, but makes results of a part of it at a time."""
    import types

    import numpy as np
    import pyarrow as pa

    from folioquery.llm._arrays import PIECE_BYTES
    from folioquery.llm.decontamination import Part, _clean
    from folioquery.llm.pii import _redacted
    from folioquery.llm.quality_classifier import FEATURES, Model, _keep

    item = "one two three four five six"
    texts = [(f"row {i} " + "river stone house " * 40 + (item if i % 5 == 0 else "") + (" a@b.co" if i % 7 == 0 else "")) if i % 50 else None for i in range(3000)]
    texts[17] = "long " * PIECE_BYTES
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": texts})
    part = Part([1], [item], 10)
    part.prefix({k: v * 0 for k, v in part.known.items()})
    model = Model(np.zeros((1, FEATURES)), [(b"........", b"........")], 0.0, 0.0)
    for run, kept in (
        (_clean(types.SimpleNamespace(value=part.shared())), [i for i, t in enumerate(texts) if item not in (t or "")]),
        (_keep(model, 0.5), list(range(3000))),
        (_redacted({}, 0.9, ["doc_id", "text"]), list(range(3000))),
    ):
        out = list(run(iter([batch, batch.slice(0, 0), batch.slice(0, 3)])))
        assert [i for b in out for i in b.column("doc_id").to_pylist()] == kept + [i for i in kept if i < 3]
        assert len(out) > 8 and max(sum(len(t or "") for t in b.column("text").to_pylist()) for b in out if 17 not in b.column("doc_id").to_pylist()) <= 1.1 * PIECE_BYTES
        cleaned = {i: t for b in out for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())}
        masked = run.__qualname__.startswith("_redacted")
        assert all(cleaned[i] == (t.replace("a@b.co", "[EMAIL]") if masked and t else t) for i, t in enumerate(texts) if i in cleaned)


def test_fit_starts_no_python_for_its_sample(spark, tables, monkeypatch):
    from pyspark import SparkContext

    from folioquery.llm.quality_classifier import fit

    folder, _ = tables
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    before = fit(docs, labels)
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("a list of rows goes through Python on the executors"))
    assert fit(docs, labels).pairs == before.pairs and before.slope
