"""Helpers for the expressions that rules read their fields with."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Operator(IntEnum):
    """What a stored CompareBy value asks of the probe's: probe <operator> stored."""

    EQ = 0
    LT = 1
    LTE = 2
    GT = 3
    GTE = 4
    NE = 5


#: An expression of a row: SQL text (a column's name, say, or a nested field's path) or a Column.
Getter = str | Column


def column(getter: Getter) -> Column:
    return F.expr(getter) if isinstance(getter, str) else getter


def version(major: Getter, minor: Getter, patch: Getter) -> Column:
    """A version that compares part by part; missing if its major part is."""
    parts = F.struct(column(major).alias("major"), F.coalesce(column(minor), F.lit(0)).alias("minor"), F.coalesce(column(patch), F.lit(0)).alias("patch"))
    return F.when(column(major).isNotNull(), parts)


def truncated(time: Getter, unit: str = "second") -> Column:
    return F.date_trunc(unit, column(time))
