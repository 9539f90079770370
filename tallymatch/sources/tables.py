"""Where rules come from and where built indexes go; files of any kind are Spark's own readers' and writers' business."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.index import RuleIndex
from ..operators.schema import RuleSchema


def zip_rules(spark: SparkSession, constraints: Iterable[tuple | dict], ids: Iterable[Any], schema: str | T.StructType, id_type: str = "long") -> DataFrame:
    """Constraints paired with IDs, numbered in order; the two must be of one length. schema names the constraints' fields."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = []
    for pos, (c, i) in enumerate(zip(constraints, ids, strict=True)):
        rows.append((pos, i, *([c.get(n) for n in fields.fieldNames()] if isinstance(c, dict) else c)))
    full = T.StructType([T.StructField("pos", T.LongType()), *T.StructType.fromDDL(f"rule_id {id_type}").fields, *fields.fields])
    return spark.createDataFrame(rows, full)


def numbered(rules: DataFrame, *by: str | Column) -> DataFrame:
    """rules with pos by an explicit order; rows of a table have none of their own.

    by: columns of any sortable types, ascending with nulls last unless they say otherwise. pos is an order of the rows: ties are
    ordered by the other columns.
    """
    from ..plans.tables import row_order

    return row_order(rules, [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in by], "pos")


def save_index(index: RuleIndex, path: str) -> None:
    """Write a built index as Parquet tables; the rule tree itself is code and is given again to load it."""
    index.ids.write.parquet(f"{path}/ids")
    index.entries.write.parquet(f"{path}/entries")
    for n, values in index.wide.items():
        values.write.parquet(f"{path}/values-{n}")
    about = {"masks": index.masks, "keys": index.keys, "dropped": sorted(index.dropped), "wide": sorted(index.wide), "single": sorted(index.single)}
    index.ids.sparkSession.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{path}/about")


def load_index(spark: SparkSession, schema: RuleSchema, path: str) -> RuleIndex:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    wide = {n: spark.read.parquet(f"{path}/values-{n}") for n in about["wide"]}
    keys = [(n, tuple(i) if i else None) for n, i in about["keys"]]
    return RuleIndex(schema.compiled, spark.read.parquet(f"{path}/ids"), spark.read.parquet(f"{path}/entries"), about["masks"], keys, frozenset(about["dropped"]), wide, frozenset(about["single"]))
