"""Round trips and plans of sources and sinks, and listings of runs."""

import pytest

from folioquery.functions.text import project_case_name
from folioquery.operators import letter_checks, page_map, run_inspection
from folioquery.sources import readers, runs, sinks

ENTRY = "ordinal int, date string, pages array<int>, header string"


def test_reconciliation_document(spark, tmp_path):
    yours = spark.createDataFrame([(1, "2024-01-02", [3], "B"), (0, "2024-01-01", [1, 2], "A")], ENTRY)
    theirs = spark.createDataFrame([], ENTRY)
    same = spark.createDataFrame([(0, "2024-02-01", [7], [8, 9], "S", None)], "ordinal int, date string, your_pages array<int>, their_pages array<int>, your_header string, their_header string")
    sinks.write_reconciliation(same, yours, theirs, str(tmp_path / "doc"))
    back_same, back_yours, back_theirs = readers.reconciliation(spark, str(tmp_path / "doc"))
    assert [tuple(r)[2:] for r in back_yours.orderBy("ordinal").collect()] == [("2024-01-01", [1, 2], "A"), ("2024-01-02", [3], "B")]
    assert [tuple(r)[2:] for r in back_same.collect()] == [("2024-02-01", [7], [8, 9], "S", None)] and back_theirs.count() == 0
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.write_reconciliation(same, yours, theirs, str(tmp_path / "more"), most=1)
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.one_json(yours, most=1)


def test_csv_keeps_order_over_files(spark, tmp_path):
    rows = spark.range(1000).repartition(3).orderBy("id")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    files = sorted((tmp_path / "csv").glob("part-*"))
    assert [int(x) for f in files for x in f.read_text().split()[1:]] == list(range(1000))


def test_executions_reach_the_scan(spark, tmp_path):
    rows = [(f"r{i % 2}", i, "SUCCEEDED", None, "{}", None, "Extract info" if i % 3 else "Other", None, None) for i in range(60)]
    path = str(tmp_path / "executions")
    runs.write_executions(spark.createDataFrame(rows, readers.EXECUTIONS), path)
    got = runs.read_executions(spark, path, run_id="r1", step="Extract info", spec="5-20")
    assert sorted(r.iteration for r in got.collect()) == [i for i in range(5, 21) if i % 2 and i % 3]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "GreaterThanOrEqual(iteration,5)" in plan and "LessThanOrEqual(iteration,20)" in plan
    some = runs.read_executions(spark, path, spec="7,40,8")
    assert sorted(r.iteration for r in some.collect()) == [7, 8, 40]
    assert "GreaterThanOrEqual(iteration,7)" in some._jdf.queryExecution().executedPlan().toString()
    assert runs.read_executions(spark, path).count() == 60


def scanned(df) -> int:
    """Rows that the scan of a plan handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_where_skips_row_groups(spark, tmp_path):
    n = 20_000
    result = "case when id % 7 = 0 then '{broken' when id % 5 = 0 then '{}' else to_json(named_struct('kind', concat('k', id div 1000), 'deep', concat('v', hash(id)), 'n', id % 3, 'flag', id % 2 = 0)) end"
    rows = spark.range(n).selectExpr("'r' as run_id", "cast(id as int) as iteration", "'SUCCEEDED' as status", "repeat(cast(hash(id) as string), 20) as output", f"{result} as result", "null as prompt", "'s' as step_name", "null as started", "null as finished")
    rows = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], readers.EXECUTIONS).schema])
    path = str(tmp_path / "typed")
    runs.write_executions(rows.coalesce(1), path, fields=["kind", "deep", "n", "flag"], row_group_bytes=64 << 10)
    deep = rows.filter("iteration = 4444").selectExpr("concat('v', hash(cast(iteration as long)))").first()[0]
    for filters in (["kind=k3"], [f"deep={deep}"], ["kind=k3", "n=1"], ["flag=true", "kind=k11"], ["kind="], ["kind"], ["n=1", "absent="], ["kind=k3", "kind=k4"]):
        expected = sorted(r.iteration for r in run_inspection.where(rows, filters).collect())
        got = runs.read_executions(spark, path, "r", "s", filters=filters)
        assert set(got.columns) == set(rows.columns) and sorted(r.iteration for r in got.collect()) == expected, filters
        if filters[0] in ("kind=k3", f"deep={deep}"):
            assert expected and scanned(got) < n / 2 or filters[-1] == "kind=k4"
    # bounds alone tell nothing of hashed texts: the bloom filter does
    assert scanned(runs.read_executions(spark, path, filters=[f"deep={deep}"])) < n / 4


def test_steps_and_letters(spark):
    steps = spark.createDataFrame([(0, "Extract info"), (1, "Summary")], "ordinal int, name string")
    with pytest.raises(LookupError, match="Extract info, Summary"):
        run_inspection.resolve_step(steps, "nothing")
    with pytest.raises(LookupError, match="none"):
        run_inspection.resolve_step(steps.limit(0), "x")
    letters = spark.createDataFrame([("b", 1, None, "P", ["c"], 2, [4, 5]), ("a", 0, "2024-01-01", None, None, 1, [3])], "id string, index int, date string, provider string, category array<string>, page_count int, pages array<int>")
    assert [(r["row"], r.id, r.pages) for r in run_inspection.list_letters(letters).collect()] == [(1, "a", [3]), (2, "b", [4, 5])]
    scored = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 0, 2)], "index int, errors int, warnings int")
    assert letter_checks.score_report(scored, short=True)[1] is None
    assert [r["index"] for r in letter_checks.score_report(scored)[1].collect()] == [2, 3]
    card, errors = letter_checks.score_report(scored, errors_only=True)
    assert [r["index"] for r in errors.collect()] == [2] and card.first().flagged == 2


def test_compact_keeps_rows_without_json(spark):
    rows = [(1, "S", "<filename> a.pdf </filename>", '{"date": "x", "doc_category": "c", "continuation": false}'), (2, "S", None, "{broken"), (3, "S", "none", None)]
    got = run_inspection.compact(spark.createDataFrame(rows, "iteration int, status string, prompt string, result string")).collect()
    assert got[0].asDict() == {"iteration": 1, "filename": "a.pdf", "date": "x", "date_label": None, "continuation": "false", "category": "c", "subcategory": None, "provider": None}
    assert [r.iteration for r in got] == [1, 2, 3] and got[1].date is None


def test_pages(spark):
    pages = spark.createDataFrame([(1, p, f"line {p}") for p in (2, 1, 25, 26)], "doc_id long, page int, text string")
    assert readers.index_texts(pages).first().text == "line 1\nline 2\nline 25"
    texts = spark.createDataFrame([(3, "x Actual Page No. 12 y"), (4, "Actual Page No.12"), (5, None)], "physical int, text string")
    assert page_map.stamped_page(texts, 12).first().physical == 3 and page_map.stamped_page(texts, 13).first().physical is None
    mapping = spark.createDataFrame([("yours", 1, 11)], "side string, logical int, physical int")
    rows = spark.createDataFrame([("yours", 1), ("theirs", 1), ("yours", 2)], "side string, logical int")
    assert sorted((r.side, r.logical, r.physical) for r in page_map.to_physical(rows, mapping).collect()) == [("theirs", 1, None), ("yours", 1, 11), ("yours", 2, None)]
    names = spark.createDataFrame([(" Jane  Q Doe ",), ("One",), (" ",), (None,)], "n string")
    assert [r.c for r in names.select(project_case_name(names["n"]).alias("c")).collect()] == ["Doe_Q_Jane", "One", None, None]
