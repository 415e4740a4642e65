"""Person and organisation names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery import fixed
from folioquery.functions.text import strip


def plain_name(name: Column) -> Column:
    """Without credentials, first name first, lower case, single spaces; null if nothing is left."""
    bare = strip(F.regexp_replace(name, fixed.CREDENTIALS, ""))
    halves = F.split(bare, r",\s*", 2)
    turned = F.when(F.size(halves) == 2, F.concat_ws(" ", F.get(halves, 1), F.get(halves, 0))).otherwise(bare)
    return F.nullif(F.regexp_replace(F.lower(strip(turned)), " +", " "), F.lit(""))


def last_name(name: Column) -> Column:
    return F.try_element_at(F.split(name, r"\s+"), F.lit(-1))


def has_credential(name: Column) -> Column:
    return name.rlike(fixed.CREDENTIALS)


def likely_organisation(name: Column) -> Column:
    return F.coalesce(name.rlike(fixed.ORGANISATIONS), F.lit(False))


def without_recipient(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\s+to\s+.+$", "")
