"""Connected components of an edge table by alternating large-star and small-star steps, each a shuffle over the edges.

Every step is a grouped minimum (combined before the shuffle) and an equi-join whose hub side adaptive execution may split;
the edges are written to shared storage after each round, and those of the round before deleted. Nothing is gathered on the driver but two counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, table


def components(edges: DataFrame) -> DataFrame:
    """(src, dst) in, (id, component) out, as a table: for each id that has an edge to another one, the smallest id it reaches.

    Loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    now = table(
        edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("src is not null and dst is not null and a <> b").distinct(),
        "edges",
    )
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        pairs = large.join(least, F.col("a") == F.col("u"))
        before, now = now, table(pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).distinct(), "edges")
        forget(before)
        # done when every node has one parent and no parent has one
        parents = now.groupBy("a").agg(F.count("*").alias("n"))
        inner = now.select(F.col("b").alias("a")).distinct().join(now.select("a"), "a", "left_semi")
        if parents.where("n > 1").isEmpty() and inner.isEmpty():
            break
    roots = now.select("b").distinct()
    out = table(now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("b", "b")), "labels")
    forget(now)
    return out
