"""The run snapshots' data source: filters, folders, batches and errors."""

import json

import pytest
from pyspark.sql import datasource as api
from pyspark.sql.types import StructType

from folioquery.sources import readers, run_api

ROWS = [(f"r{i % 3}", i, "SUCCEEDED" if i % 4 else "FAILED", f"out {i}", json.dumps({"k": i % 5}), "p", None if i % 50 == 0 else "Extract info" if i % 2 else "a/b: c", None, None) for i in range(300)]
ROWS += [("r1", None, "SUCCEEDED", None, None, None, "Extract info", None, None), ("r1", -3, "SUCCEEDED", None, None, None, "Extract info", None, None), (None, 7, "x", None, "{broken", None, "Extract info", None, None)]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("api") / "snap")
    run_api.write_snapshot(spark.createDataFrame(ROWS, readers.EXECUTIONS), path, width=50)
    return path


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_whole_table(spark, root):
    assert plain(run_api.scan(spark, root).collect()) == plain(ROWS)
    assert run_api.scan(spark, root + "/none").count() == 0


@pytest.mark.parametrize("asked", [
    {"run_id": "r1"}, {"run_id": "r1", "step": "Extract info"}, {"step": "a/b: c", "spec": "40-120"}, {"spec": "7"}, {"spec": "7,299,12"}, {"run_id": "none"},
    {"more": lambda d: d.filter("status = 'FAILED' and iteration > 100 and iteration <= 200 and iteration is not null")}, {"more": lambda d: d.filter("step_name is null")},
    {"more": lambda d: d.filter("output like '%7%' and (iteration < 20 or run_id = 'r2')")}, {"more": lambda d: d.filter("run_id <> 'r1'")}, {"more": lambda d: d.filter("run_id <=> null")}, {"more": lambda d: d.filter("iteration in (3, 250) and status in ('SUCCEEDED')").select("output")},
])
def test_same_rows_as_spark_filters(spark, root, asked):
    table = spark.createDataFrame(ROWS, readers.EXECUTIONS)
    expected = table
    for c, k in (("run_id", "run_id"), ("step_name", "step")):
        if k in asked:
            expected = expected.filter(table[c] == asked[k])
    if "spec" in asked:
        expected = expected.filter(run_api.iterations(asked["spec"]))
    if "more" in asked:
        expected = asked["more"](expected)
    assert plain(run_api.scan(spark, root, **asked).collect()) == plain(expected.collect())


def reader(root, *tests, **options):
    out = run_api.RunReader(StructType.fromDDL(readers.EXECUTIONS), {"path": root, **options})
    assert not list(out.pushFilters(list(tests)))
    return out


def test_files_outside_are_not_opened(spark, root):
    every = [p for part in reader(root).partitions() for p in part.paths]
    tests = (api.EqualTo(("run_id",), "r1"), api.EqualTo(("step_name",), "Extract info"), api.GreaterThanOrEqual(("iteration",), 60), api.LessThan(("iteration",), 120))
    some = [p for part in reader(root, *tests).partitions() for p in part.paths]
    # ranges 50-99 and 100-149, and rows that are in no range
    assert len(every) == len(set(every)) > 40 and len(some) == 3 and all("run_id=r1/step_name=Extract info" in p for p in some)
    assert len(reader(root, partitionbytes="1").partitions()) == len(every) and len(reader(root).partitions()) == 1
    got = run_api.scan(spark, root, run_id="r1", step="Extract info", spec="60-119")
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "EqualTo(run_id,r1), EqualTo(step_name,Extract info), GreaterThanOrEqual(iteration,60), LessThanOrEqual(iteration,119)" in plan and "Filter" not in plan.replace("PushedFilters", "")
    assert got.count() == sum(r[0] == "r1" and r[6] == "Extract info" and r[1] is not None and 60 <= r[1] < 120 for r in ROWS)


def test_broken_files_are_only_read_if_asked_for(spark, root, tmp_path):
    path = str(tmp_path / "snap")
    run_api.write_snapshot(spark.createDataFrame(ROWS[:200], readers.EXECUTIONS), path, width=50)
    for f in (tmp_path / "snap" / "executions" / "run_id=r2").rglob("part-*"):
        f.write_text("[1]\n")
    assert run_api.scan(spark, path, run_id="r1").count() == sum(r[0] == "r1" for r in ROWS[:200])
    with pytest.raises(Exception, match="line 1: no JSON object"):
        run_api.scan(spark, path).count()


def test_other_tables_and_results_that_are_objects(spark, tmp_path):
    for table, lines in (
        ("workflows", [{"id": "1", "name": "Night Index"}, {"id": "2", "name": "other"}]),
        ("letters", [{"id": "a", "index": 0, "pages": [{"pageNumber": 3}], "category": ["c"], "unknown": 1}]),
    ):
        (tmp_path / table).mkdir()
        (tmp_path / table / "x.json").write_text("".join(json.dumps(x) + "\n" for x in lines) + "\n")
    folder = tmp_path / "executions" / "run_id=r" / "step_name=s" / "iterations=0-9"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"run_id": "r", "iteration": 1, "result": {"date": "é"}}\n{"run_id": "r", "iteration": 2, "result": "{}"}\n')
    assert [r.id for r in run_api.workflows(spark, str(tmp_path), "index").collect()] == ["1"] and run_api.workflows(spark, f"file://{tmp_path}").count() == 2
    letter = run_api.scan(spark, str(tmp_path), "letters").first()
    assert letter.pages[0].pageNumber == 3 and letter.content is None
    assert [r.result for r in run_api.scan(spark, str(tmp_path)).orderBy("iteration").collect()] == ['{"date": "é"}', "{}"]
