"""Results by rank: every stored row matches on its own, and an ID stands where its best-ranked matching row stands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Rule
from ..plans.tables import BROADCAST_ROWS, row_order, snapshot
from .schema import RuleSchema


class RankedIndex:
    """Built from rows with a rank (higher first, none last; equal ranks by insertion order; without a rank column, insertion order alone)."""

    def __init__(self, tree: Rule, rules: DataFrame, id_col: str = "rule_id", pos_col: str = "pos", rank_col: str | None = None):
        by = [F.col(rank_col).desc_nulls_last()] if rank_col else []
        self.rows = rules.count()
        rows = snapshot(row_order(rules, [*by, F.col(pos_col).asc_nulls_last()], "__row", self.rows), "ranked")
        self.owner = rows.select(F.col("__row").alias("__key"), F.col(id_col).alias("__id"))
        self.index = RuleSchema(tree).build(rows.withColumn("__pos", F.col("__row")), "__row", "__pos")

    def match(self, probes: DataFrame, key: str, first: bool = False) -> DataFrame:
        """Per probe key the IDs that match and the place of their best row (rank_ord); with first, the best ID alone."""
        index = self.index
        reads = [p.q for p in index.compiled.parts]
        there = {p.q: F.when(F.col(p.q).isNotNull(), True) for p in index.compiled.parts if p.kind == "presence"}  # of any type, also maps
        asked = index._asked(probes).withColumns(there).select(F.col(key), *reads)
        # probes that read alike are matched once, and a kind's pairs are reduced where they arise
        kinds = asked.select(*reads).distinct().repartition(2 * probes.sparkSession.sparkContext.defaultParallelism)
        pairs = index._pairs(kinds).select(*[F.col(q).alias(f"{q}_") for q in reads], F.col("rule_id").alias("__row_id"), F.col("rule_ord").alias("rank_ord"))
        of = [f"{q}_" for q in reads]
        owner = F.col("__row_id") == F.col("__key")
        if first:
            best = pairs.groupBy(*of).agg(F.min(F.struct("rank_ord", "__row_id")).alias("b")).select(*of, "b.*").join(self._small(self.owner), owner)
        else:
            best = pairs.join(self._small(self.owner), owner).groupBy(*of, "__id").agg(F.min("rank_ord").alias("rank_ord"))
        met = asked.join(best, reduce(lambda a, b: a & b, [F.col(q).eqNullSafe(F.col(f"{q}_")) for q in reads], F.lit(True)))
        if first:
            best = met.groupBy(key).agg(F.min(F.struct("rank_ord", "__id")).alias("b"))
            return best.select(key, F.col("b.__id").alias("rule_id"), F.col("b.rank_ord").alias("rank_ord"))
        return met.groupBy(key, F.col("__id").alias("rule_id")).agg(F.min("rank_ord").alias("rank_ord"))

    def _small(self, df: DataFrame) -> DataFrame:
        """The rows' IDs, broadcast if the index's own rows are few enough for that."""
        return F.broadcast(df) if self.rows <= BROADCAST_ROWS else df
