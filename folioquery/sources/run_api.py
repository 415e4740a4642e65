"""Snapshots of the run service as a data source that takes filters.

    write_snapshot(executions, root)
    register(spark)
    spark.read.format("folio_runs").option("table", "executions").load(root)

A table is a folder of JSON Lines. Executions lie in folders by run, step and range of
iterations, as one would ask the service for them; filters on the three choose
folders before any file is opened, level by level, and every simple filter on a
plain column is met by the reader, so that only rows asked for become batches.
Files of neighbouring ranges are read together up to ``partitionBytes``. A result
may be JSON text or an object; it is handed on as text. Storage is whatever
``pyarrow.fs`` reaches; a line that is no JSON object is an error that names its file.
"""

from __future__ import annotations

import io
import json
import operator
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as api
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioquery.operators.run_inspection import iterations
from folioquery.sources.readers import EXECUTIONS, LETTERS, PROJECTS, STEPS

TABLES = {"executions": EXECUTIONS, "letters": LETTERS, "steps": STEPS, "projects": PROJECTS, "workflows": "id string, name string, description string"}
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
COMPARED = {
    api.EqualTo: operator.eq, api.GreaterThan: operator.gt, api.GreaterThanOrEqual: operator.ge, api.LessThan: operator.lt, api.LessThanOrEqual: operator.le,
    api.In: lambda x, values: x in values, api.StringContains: lambda x, part: part in x, api.StringStartsWith: str.startswith, api.StringEndsWith: str.endswith,
}


def write_snapshot(executions: DataFrame, root: str, width: int = 10_000, mode: str = "overwrite") -> None:
    """Executions as JSON Lines in folders of ``width`` iterations, each written by one task."""
    low = (F.floor(F.col("iteration") / width) * width).cast("long")
    span = F.coalesce(F.concat_ws("-", F.nullif(low.cast("string"), F.lit("")), (low + (width - 1)).cast("string")), F.lit("none"))
    span = F.when(F.col("iteration").isNull(), "none").when(F.col("iteration") < 0, "none").otherwise(span)
    rows = executions.select("run_id", "step_name", span.alias("iterations"), F.to_json(F.struct(*[c for c in executions.columns])).alias("value"))
    rows.repartition("run_id", "step_name", "iterations").write.mode(mode).partitionBy("run_id", "step_name", "iterations").text(f"{root}/executions")


def meets(test: api.Filter, value) -> bool:
    """SQL's answer with null as false."""
    if isinstance(test, api.IsNotNull):
        return value is not None
    if isinstance(test, api.IsNull):
        return value is None
    return value is not None and COMPARED[type(test)](value, test.value)


def overlaps(test: api.Filter, low: int, high: int) -> bool:
    """May a number of the range meet the test?"""
    if isinstance(test, api.EqualTo):
        return low <= test.value <= high
    if isinstance(test, api.In):
        return any(low <= v <= high for v in test.value)
    if isinstance(test, (api.GreaterThan, api.GreaterThanOrEqual)):
        return meets(test, high)
    if isinstance(test, (api.LessThan, api.LessThanOrEqual)):
        return meets(test, low)
    return not isinstance(test, api.IsNull)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RunSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_runs"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "executions")]

    def reader(self, schema) -> DataSourceReader:
        return RunReader(schema, dict(self.options))


class RunReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.table = schema, options.get("table", "executions")
        self.root, self.bytes = options["path"], int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        self.tests: list[tuple[str, api.Filter]] = []

    def pushFilters(self, filters: list[api.Filter]) -> Iterable[api.Filter]:
        plain = {f.name for f in self.schema.fields if f.dataType.typeName() in ("string", "integer", "long", "boolean", "double")}
        for test in filters:
            if len(getattr(test, "attribute", ())) == 1 and test.attribute[0] in plain and (type(test) in COMPARED or isinstance(test, (api.IsNotNull, api.IsNull))):
                self.tests.append((test.attribute[0], test))
            else:
                yield test

    def _admits(self, column: str, folder: str) -> bool:
        name = unquote(folder.partition("=")[2])
        mine = [t for c, t in self.tests if c == ("iteration" if column == "iterations" else column)]
        if column != "iterations":
            return all(meets(t, None if name == NO_NAME else name) for t in mine)
        if "-" not in name:
            return True
        low, high = map(int, name.split("-"))
        return all(overlaps(t, low, high) for t in mine)

    def _files(self) -> list[fs.FileInfo]:
        store, root = fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")
        at, levels = [f"{root}/{self.table}"], ["run_id", "step_name", "iterations"] if self.table == "executions" else []
        for column in levels:
            below = [x for folder in at for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
            at = [x.path for x in sorted(below, key=lambda x: x.path) if x.type == fs.FileType.Directory and x.base_name.startswith(f"{column}=") and self._admits(column, x.base_name)]
        found = [x for folder in at for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
        return [x for x in found if x.is_file and not x.base_name.startswith(("_", "."))]

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for x in self._files():
            if held and size + x.size > self.bytes:
                out, held, size = [*out, Files(held)], [], 0
            held, size = [*held, x.path], size + x.size
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        store, _ = fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")
        schema = to_arrow_schema(self.schema)
        rows: list[dict] = []
        for path in partition.paths:
            with store.open_input_stream(path) as raw:
                for n, line in enumerate(io.TextIOWrapper(io.BufferedReader(raw, 1 << 20), "utf-8", "replace"), 1):
                    if not line.strip():
                        continue
                    row = _object(line, path, n)
                    if all(meets(t, row.get(c)) for c, t in self.tests):
                        rows.append(row)
                    if len(rows) == 2048:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _object(line: str, path: str, n: int) -> dict:
    try:
        row = json.loads(line)
    except ValueError:
        row = None
    if not isinstance(row, dict):
        raise ValueError(f"{path}, line {n}: no JSON object")
    if "result" in row and not isinstance(row["result"], str | None):
        row["result"] = json.dumps(row["result"], ensure_ascii=False)
    return row


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunSource)


def scan(spark: SparkSession, root: str, table: str = "executions", run_id: str | None = None, step: str | None = None, spec: str | None = None, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A table of a snapshot; executions of a run and step and of iterations 'N', 'N-M' or 'N,M,...'."""
    register(spark)
    rows = spark.read.format("folio_runs").option("table", table).load(root)
    for column, value in (("run_id", run_id), ("step_name", step)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if spec is not None:
        rows = rows.filter(iterations(spec))
    return more(rows) if more else rows


def workflows(spark: SparkSession, root: str, query: str | None = None) -> DataFrame:
    """Workflows, or those whose name holds the query in any case."""
    from folioquery.operators.run_inspection import search

    return search(scan(spark, root, "workflows"), query)
