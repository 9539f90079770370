"""What the operators of this subpackage share: tables in shared storage, checked broadcasts, skew-proof numbering."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import forget
from ..plans.tables import snapshot as table

#: Rows of a few longs that a broadcast may hold (about 30 MB as a hash table); beyond it the same join shuffles.
BROADCAST_ROWS = 250_000


class Scratch:
    """Tables that nothing reads any more once the operator's result, or the table that it reads, is written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(table(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        for df in self.tables:
            forget(df)
        self.tables = []


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves that it has at most so many (narrow) rows; else df as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns; those that df lacks are null strings."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names])


def add(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def sums_before(df: DataFrame, group: list[str], order: str, values: list[str], per: int = 4096) -> DataFrame:
    """df (one row for each group and whole number order) with before_<value>: the sum over the group's rows of smaller order.

    In two steps, over runs of per orders and then within each run, so that no window holds more than per rows, or a row a run.
    """
    run = F.expr(f"`{order}` div {per}")
    mine = lambda names: [F.col(n).alias(f"__g{i}") for i, n in enumerate(names)]
    runs = df.groupBy(*group, run.alias("__run")).agg(*[F.sum(v).alias(f"__sum_{v}") for v in values])
    earlier = Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*mine(group), F.col("__run").alias("__r"), *[F.coalesce(F.sum(f"__sum_{v}").over(earlier), F.lit(0)).alias(f"__base_{v}") for v in values])
    within = Window.partitionBy(*group, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("__run", run).withColumns({f"__in_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] + [F.col("__run") == F.col("__r")])
    return inner.join(runs, on).select(*df.columns, *[(F.col(f"__base_{v}") + F.col(f"__in_{v}")).alias(f"before_{v}") for v in values])


def summed(df: DataFrame, by: str, total: Callable[[pa.Table], pa.Table], rows: int = 256) -> DataFrame:
    """df (a table with a row of fixed size for each task and value of by) with one row a value, by total, which turns rows into one.

    In as many steps as the number of tasks asks for, so that no group that is gathered holds more than about rows rows.
    """
    while (most := df.groupBy(by).count().agg(F.max("count")).first()[0] or 0) > rows:
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-most // rows)))
        df = table(df.withColumn("__salt", salt).groupBy(by, "__salt").applyInArrow(lambda t: total(t.drop_columns("__salt")), df.schema), "sums")
    return df.groupBy(by).applyInArrow(total, df.schema)


def running_sums(df: DataFrame, group: list[str], key: Column, values: list[str], rows_per_bucket: int = 4096) -> DataFrame:
    """df with, for each of values, the column before_<value>: the sum over the rows that precede in the group.

    The order in a group is by bucket of key's hash, then key. Buckets are numbered by their own sums first, so no window
    holds more than about rows_per_bucket rows however large a group is. Rows with equal keys keep to one bucket.
    """
    n = max(1, -(-df.count() // rows_per_bucket))
    df = df.withColumn("__key", key).withColumn("__bucket", F.pmod(F.xxhash64("__key", F.lit(17)), F.lit(n)).cast("int"))
    sums = sums_before(df.groupBy(*group, "__bucket").agg(*[F.sum(v).alias(v) for v in values]), group, "__bucket", values)
    sums = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__bucket").alias("__b"), *[F.col(f"before_{v}").alias(f"__base_{v}") for v in values])
    on = reduce(lambda a, b: a & b, [df[g].eqNullSafe(sums[f"__g{i}"]) for i, g in enumerate(group)] + [df["__bucket"] == sums["__b"]])
    within = Window.partitionBy(*group, "__bucket").orderBy("__key", *values).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.withColumns({f"__in_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).join(sums, on, "left")
    keep = [c for c in df.columns if c not in ("__key", "__bucket")]
    return joined.select(*keep, *[(F.col(f"__base_{v}") + F.col(f"__in_{v}")).alias(f"before_{v}") for v in values])


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back to the system when a task ends: idle Python workers share an executor with the next stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped
