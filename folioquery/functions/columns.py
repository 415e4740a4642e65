"""Columns that are computed once a row, however often they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds the columns behind a generator of one row, which the optimiser does not inline into their readers."""
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
