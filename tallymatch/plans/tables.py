"""Snapshots in shared storage, checked broadcasts, and ranks that need no single task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Index rows that may be broadcast; more are shuffled. Rows that one task may rank; more are ranked in ranges.
BROADCAST_ROWS, FEW = 250_000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (a local run) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallymatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """df written to shared storage and read back: later changes of its source do not show, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/tallymatch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the snapshot that df reads (df must be a snapshot as it was returned)."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if re.search(r"/tallymatch/[a-z]+-[0-9a-f]{32}$", path.toString()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_order(df: DataFrame, by: list[Column], out: str, rows: int | None = None) -> DataFrame:
    """df with each row's place from 0 in the order by (any sortable types); ties by the other columns, so equal rows only are dealt at will.

    Rows are dealt by ranges of the order, and the ranges numbered on by their counts (one long a range reaches the driver); so no
    window spans the table, unless it has few rows.
    """
    plain = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    order = [*by, F.xxhash64(*plain)]
    if rows is not None and rows <= FEW:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # numbered from a snapshot, so that a task that is run again numbers alike
    first = snapshot(df, "unordered")
    dealt = first.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *order, "__tie").withColumn("__range", F.spark_partition_id())
    dealt = snapshot(dealt, "ordered")
    forget(first)
    sizes = dict(map(tuple, dealt.groupBy("__range").count().collect()))
    before = [sum(sizes.get(k, 0) for k in range(r)) for r in range(n)]
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order, "__tie")) - 1
    return dealt.withColumn(out, (F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("__range")) + place).cast("long")).drop("__range", "__tie")


def dense_rank(df: DataFrame, by: str, out: str, rows: int | None = None) -> DataFrame:
    """df with the dense rank of a column of any sortable type from 0, nulls last: its distinct values are put in row order."""
    if rows is not None and rows <= FEW:
        return df.withColumn(out, (F.dense_rank().over(Window.orderBy(F.col(by).asc_nulls_last())) - 1).cast("long"))
    values = df.select(F.col(by).alias("__value")).distinct()
    ordered = row_order(values, [F.col("__value").asc_nulls_last()], out)
    ranks = snapshot(ordered, "ranks")
    forget(ordered)
    if ranks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ranks = F.broadcast(ranks)
    return df.join(ranks, F.col(by).eqNullSafe(F.col("__value"))).drop("__value")
