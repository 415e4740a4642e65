"""The driver's contract: every query with SQL agrees with it on the smallest tables."""

import importlib.util
from pathlib import Path

import pytest

from folioquery.plans import registry

SF = "/root/testdata/sf0.001"


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df, rel = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert shown(df.collect(), df.columns) == shown(rel.fetchall(), rel.columns)


def test_entry_names():
    spec = importlib.util.spec_from_file_location("entry_file", Path(__file__).parents[1] / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
