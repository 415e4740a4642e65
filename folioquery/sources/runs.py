"""A run's executions as a table laid out by run and step, so that a reader's filters reach the files.

Fields of the results that are often asked for stand in columns of their own, as
the text that ``where`` compares: null where the result is no JSON, empty where the
field is absent. Their bounds and bloom filters let a reader of ``field=value`` leave
row groups out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions.results import field_text, parse_result
from folioquery.operators.run_inspection import iterations, where
from folioquery.sources.readers import EXECUTIONS

FIELD = "field_"


def write_executions(executions: DataFrame, path: str, fields: Sequence[str] = (), row_group_bytes: int = 128 << 20) -> None:
    """Parquet, a folder a run and step; iterations lie in ranges, so that their bounds tell files and row groups apart.

    ``fields`` of the result get a column each; all writes to a path name the same ones.
    """
    parsed = parse_result(F.col("result"))
    own = {f"{FIELD}{f}": F.when(parsed.isNotNull(), F.coalesce(field_text(parsed, f), F.lit(""))) for f in fields}
    rows = executions.withColumns(own) if own else executions
    rows = rows.repartitionByRange("run_id", "step_name", "iteration").sortWithinPartitions("run_id", "step_name", "iteration")
    out = rows.write.mode("append").option("parquet.block.size", row_group_bytes)
    for name in own:
        out = out.option(f"parquet.bloom.filter.enabled#{name}", "true")
    out.partitionBy("run_id", "step_name").parquet(path)


def where_fields(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """``where`` of run_inspection, met by the fields' own columns as far as the table has them."""
    rest = []
    for f in filters:
        name, equals, value = f.partition("=")
        if equals and f"{FIELD}{name}" in rows.columns:
            rows = rows.filter(F.col(f"`{FIELD}{name}`") == value)
        else:
            rest.append(f)
    return where(rows, rest)


def read_executions(spark: SparkSession, path: str, run_id: str | None = None, step: str | None = None, spec: str | None = None, filters: Sequence[str] = ()) -> DataFrame:
    """Executions of a run and step, of the iterations 'N', 'N-M' or 'N,M,...', and whose results meet every ``field=value``.

    Run and step prune folders; iterations go to the scan with their least and
    greatest number, fields that have a column with their text.
    """
    own = [f for f in spark.read.parquet(path).schema.fields if f.name.startswith(FIELD)] if filters else []
    rows = spark.read.schema(", ".join([EXECUTIONS, *[f"`{f.name}` string" for f in own]])).parquet(path)
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    if step is not None:
        rows = rows.filter(F.col("step_name") == step)
    if spec is not None:
        if "-" not in spec:
            numbers = [int(x) for x in spec.split(",")]
            rows = rows.filter(F.col("iteration").between(min(numbers), max(numbers)))
        rows = rows.filter(iterations(spec))
    return where_fields(rows, filters).drop(*[f"{f.name}" for f in own])
