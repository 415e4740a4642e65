"""Step results: JSON text as VARIANT, and tests on its fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_result(result: Column) -> Column:
    """VARIANT of a JSON text; null where it is null, empty or not JSON."""
    return F.try_parse_json(result)


def field_text(result: Column, field: str) -> Column:
    return F.try_variant_get(result, f"$.{field}", "string")


def field_is(result: Column, field: str, value: str) -> Column:
    """The field's text equals value; an absent field is the empty text, an unparsable result equals nothing."""
    return result.isNotNull() & (F.coalesce(field_text(result, field), F.lit("")) == value)


def truthy(result: Column, field: str) -> Column:
    """False only for an absent field, null and the boolean false."""
    value = F.try_variant_get(result, f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    no = value.isNull() | F.is_variant_null(value) | ((kind == "BOOLEAN") & (F.try_variant_get(result, f"$.{field}", "string") == "false"))
    return ~F.coalesce(no, F.lit(True))


def percent(part: Column, whole: Column) -> Column:
    """Hundredths with one decimal; 0 of nothing is 0."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100, 1)


def document_first(run: Column, document: Column) -> Column:
    return F.coalesce(run, F.lit(False)) | document.isNotNull()
