"""Registered queries: rule matching over whole tables, each with plain SQL that states what must come out.

The SQL is the definition (every rule row against every probe, one bool_or per leaf and ID); the engine never runs it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions.getters import version
from .operators.ranked import RankedIndex
from .operators.schema import RuleSchema
from .plans import rules as R
from .sources.tables import numbered

Query = Callable[[SparkSession, str], DataFrame]


def views(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The DataFrame of a fixture's SQL over the tables of sf_dir."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "customer", "part", "orders") if t in sql}
    names = {t: "{" + t + "}" for t in frames}
    for t, name in names.items():
        for word in (f"FROM {t}", f"JOIN {t}"):
            sql = sql.replace(word, word.replace(t, name))
    return spark.sql(sql, **frames)


class Case(NamedTuple):
    tree: Callable[[], R.Rule]
    having: list[str]  # what the definition asks of an ID's rows r and a probe p
    rules: str = X.SUPPLIER_RULES.format(id="s_suppkey")
    probes: str = X.CUSTOMER_PROBES

    def index(self, spark: SparkSession, sf_dir: str):
        return RuleSchema(self.tree()).build(views(spark, sf_dir, self.rules))

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        probes = views(spark, sf_dir, self.probes)
        return self.index(spark, sf_dir).match(probes, columns=["probe_id"])

    def sql(self, select: str = "SELECT probe_id, rule_id, rule_ord FROM matches") -> str:
        return f"""
WITH rules AS ({self.rules}), probes AS ({self.probes}),
ranked AS (SELECT *, CAST(dense_rank() OVER (ORDER BY first_pos) - 1 AS BIGINT) AS rule_ord FROM (SELECT *, min(pos) OVER (PARTITION BY rule_id) AS first_pos FROM rules) t),
matches AS (SELECT p.probe_id, r.rule_id, r.rule_ord FROM probes p CROSS JOIN ranked r GROUP BY p.probe_id, r.rule_id, r.rule_ord
 HAVING {' AND '.join(self.having) or 'false'})
{select}"""


class RowCase(Case):
    """With one row per ID the definition needs no grouping."""

    def sql(self, select: str = "SELECT probe_id, rule_id, rule_ord FROM matches") -> str:
        having = [h.replace("bool_or", "") for h in self.having]
        return f"""
WITH rules AS ({self.rules}), probes AS ({self.probes}),
ranked AS (SELECT *, CAST(dense_rank() OVER (ORDER BY pos) - 1 AS BIGINT) AS rule_ord FROM rules),
matches AS (SELECT p.probe_id, r.rule_id, r.rule_ord FROM probes p JOIN ranked r ON {' AND '.join(having)})
{select}"""


def eq(name: str) -> str:
    return f"bool_or(r.{name} IS NULL OR p.{name} = r.{name})"


def cmp(name: str, op: str, probe: str | None = None) -> str:
    return f"bool_or(r.{name} IS NULL OR p.{probe or name} {op} r.{name})"


def veto(name: str, probe: str) -> str:
    return f"NOT coalesce(bool_or(p.{probe} = r.{name}), false)"


def by(value: str, op: str) -> str:
    tests = " ".join(f"WHEN {i} THEN p.{value} {o} r.{value}" for i, o in enumerate(("=", "<", "<=", ">", ">=", "<>")))
    return f"bool_or(r.{value} IS NULL OR CASE r.{op} {tests} END)"


VERSION = "(p.major > r.major OR (p.major = r.major AND p.minor >= r.minor))"
SHARED = X.SUPPLIER_RULES.format(id="s_suppkey % 30")
PART = X.PART_RULES.format(id="p_partkey")
PART_SHARED = X.PART_RULES.format(id="p_partkey % 300")

#: Narrow intervals, of two kinds, and probes that are inverted in both, one or none of them.
TWO_RULES = lambda n: f"""SELECT pos, pos % {n} AS rule_id, segment, nation, low, high, CASE WHEN pos % 7 <> 1 THEN CAST(pos % 13 AS INT) END AS low2, CASE WHEN pos % 5 <> 1 THEN CAST(pos % 13 + 2 AS INT) END AS high2 FROM ({X.SUPPLIER_RULES.format(id='s_suppkey')}) s"""
TWO_PROBES = f"""SELECT probe_id, segment, nation, low, CAST(low + probe_id % 4 - 2 AS INT) AS high, CAST(probe_id % 11 AS INT) AS low2, CAST(probe_id % 11 + probe_id % 3 - 1 AS INT) AS high2 FROM ({X.CUSTOMER_PROBES}) c"""
TWO_SQL = [cmp("low", ">="), cmp("high", "<="), cmp("low2", ">="), cmp("high2", "<=")]

SEVEN = lambda: R.All(R.Include("segment"), R.Include("nation"), R.GreaterOrEqual("min_total"), R.Between("from_mi", "until_mi"), R.CompareBy("cmp_value", "cmp_op"), R.Exclude("priority"))
SEVEN_NESTED = lambda: R.All(R.All(R.Include("segment"), R.All(R.Include("nation"))), R.GreaterOrEqual("min_total"), R.All(R.Between("from_mi", "until_mi"), R.All(R.CompareBy("cmp_value", "cmp_op"), R.Exclude("priority"))))
SEVEN_SQL = [eq("segment"), eq("nation"), cmp("min_total", ">="), cmp("from_mi", ">="), cmp("until_mi", "<="), by("cmp_value", "cmp_op"), veto("priority", "priority")]

_SHAPE_EQUAL = ["customer", "segment", "fraud", "store", "area", "region", "retailer", "vertical", "slot_type", "day_of_week", "platform", "dbs", "market", "ab_label"]
SHAPE = lambda: R.All(R.Between("since", "until"), R.GreaterOrEqual("orders"), R.Between("slot_since", "slot_until"), R.GreaterOrEqual(version("major", "minor", "0")), *[R.Include(n) for n in _SHAPE_EQUAL])
SHAPE_SQL = [cmp("since", ">="), cmp("until", "<="), cmp("orders", ">="), cmp("slot_since", ">="), cmp("slot_until", "<="), f"bool_or(r.major IS NULL OR {VERSION})", *map(eq, _SHAPE_EQUAL)]

CASES: dict[str, Case] = {
    "include": RowCase(lambda: R.Include("nation"), [eq("nation")]),
    "exclude": Case(lambda: R.All(R.Include("nation"), R.Exclude("forbidden", "segment")), [eq("nation"), veto("forbidden", "segment")]),
    "exclude_only_schema": Case(lambda: R.Exclude("forbidden", "segment"), [veto("forbidden", "segment")]),
    "exclude_ineffective": Case(lambda: R.All(R.Include("nation"), R.Exclude("CAST(NULL AS STRING)", "segment")), [eq("nation")]),
    "greater_or_equal": RowCase(lambda: R.GreaterOrEqual("balance"), [cmp("balance", ">=")]),
    "less_or_equal": RowCase(lambda: R.LessOrEqual("balance"), [cmp("balance", "<=")]),
    "greater": RowCase(lambda: R.Greater("value"), [cmp("value", ">")]),
    "less": RowCase(lambda: R.Less("value"), [cmp("value", "<")]),
    "between_covering": RowCase(lambda: R.All(R.Include("segment"), R.Between("low", "high")), [eq("segment"), cmp("low", ">="), cmp("high", "<=")]),
    "between_open_bounds": RowCase(lambda: R.Between("low", "high"), [cmp("low", ">="), cmp("high", "<=")]),
    "between_repeated_id": Case(lambda: R.Between("low", "high"), [cmp("low", ">="), cmp("high", "<=")], SHARED),
    "between_inverted_repeated_id": Case(lambda: R.All(R.Include("segment"), R.Between("low", "high")), [eq("segment"), cmp("low", ">="), cmp("high", "<=")], TWO_RULES(70), TWO_PROBES),
    "between_two": RowCase(lambda: R.All(R.Between("low", "high"), R.Between("low2", "high2")), TWO_SQL, TWO_RULES(1_000_000), TWO_PROBES),
    "between_two_repeated_id": Case(lambda: R.All(R.Include("nation"), R.Between("low", "high"), R.Between("low2", "high2")), [eq("nation"), *TWO_SQL], TWO_RULES(70), TWO_PROBES),
    "compare_by_not_equal": Case(lambda: R.CompareBy("value", "op"), [by("value", "op")], SHARED.replace("% 5 AS INT) AS op", "% 6 AS INT) AS op")),
    "compare_by": RowCase(lambda: R.CompareBy("value", "op"), [by("value", "op")]),
    "all_flat": RowCase(SEVEN, SEVEN_SQL, PART, X.ORDER_PROBES),
    "all_nested": RowCase(SEVEN_NESTED, SEVEN_SQL, PART, X.ORDER_PROBES),
    "all_empty": Case(lambda: R.All(R.Include("nation"), R.All()), ["false"]),
    "repeated_id_mixing": Case(SEVEN, SEVEN_SQL, PART_SHARED, X.ORDER_PROBES),
    "exclude_repeated_id": Case(lambda: R.All(R.Include("nation"), R.Exclude("forbidden", "segment")), [eq("nation"), veto("forbidden", "segment")], SHARED),
    "missing_probe_fields": RowCase(lambda: R.All(R.Include("segment"), R.Include("nation"), R.Greater("value")), [eq("segment"), eq("nation"), cmp("value", ">")], probes=X.CUSTOMER_PROBES.replace("c_custkey % 17 <> 0", "c_custkey % 2 = 0").replace("c_custkey % 31 <> 0", "c_custkey % 3 = 0")),
    "composite_key_include": RowCase(lambda: R.Include("CASE WHEN segment IS NOT NULL THEN struct(segment, nation % 2 AS side) END"), ["bool_or(r.segment IS NULL OR (p.segment = r.segment AND p.nation % 2 IS NOT DISTINCT FROM r.nation % 2))"]),
    "version_compare": RowCase(lambda: R.GreaterOrEqual(version("major", "minor", "0")), [f"bool_or(r.major IS NULL OR {VERSION})"]),
    "in_list": RowCase(lambda: R.In("CASE WHEN value IS NOT NULL THEN array(value, low) END", "value"), ["bool_or(r.value IS NULL OR p.value = r.value OR p.value = r.low)"]),
    "not_in_list": Case(lambda: R.All(R.Include("nation"), R.NotIn("CASE WHEN value IS NOT NULL THEN array(value, low) END", "value")), [eq("nation"), "NOT coalesce(bool_or(p.value = r.value OR (r.value IS NOT NULL AND p.value = r.low)), false)"], SHARED),
    "overlaps": Case(lambda: R.All(R.Include("nation"), R.Overlaps("low", "high")), [eq("nation"), cmp("low", ">=", "high"), cmp("high", "<=", "low")], SHARED),
    "any_of": Case(lambda: R.All(R.Include("segment"), R.AnyOf(R.Include("nation"), R.Greater("value"))), [eq("segment"), f"({eq('nation')} OR {cmp('value', '>')})"], SHARED),
    "presence": RowCase(lambda: R.All(R.Include("nation"), R.Exists("segment"), R.Missing("value")), [eq("nation"), "(p.segment IS NOT NULL)", "(p.value IS NULL)"]),
    "production_shape": RowCase(SHAPE, SHAPE_SQL, X.SHAPE_RULES, X.SHAPE_PROBES),
}

_ORDERED = Case(lambda: R.All(R.Include("segment"), R.LessOrEqual("balance")), [eq("segment"), cmp("balance", "<=")], SHARED)
_FEW = Case(lambda: R.All(R.Include("segment"), R.Include("nation"), R.Between("low", "high"), R.CompareBy("value", "op")), [eq("segment"), eq("nation"), cmp("low", ">="), cmp("high", "<="), by("value", "op")], SHARED)


def ordered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in each probe's insertion order, with their place in it."""
    found = _ORDERED.run(spark, sf_dir)
    from pyspark.sql import Window

    return found.withColumn("place", F.row_number().over(Window.partitionBy("probe_id").orderBy("rule_ord")).cast("long")).orderBy("probe_id", "rule_ord")


def first_match_per_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = views(spark, sf_dir, _ORDERED.probes)
    return _ORDERED.index(spark, sf_dir).first_k(probes, "probe_id").select("probe_id", "rule_id", "rule_ord")


def first_three_per_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = views(spark, sf_dir, _ORDERED.probes)
    return _ORDERED.index(spark, sf_dir).first_k(probes, "probe_id", 3).select("probe_id", "rule_id", "rule_ord")


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FEW.index(spark, sf_dir).match_counts(views(spark, sf_dir, _FEW.probes), "probe_id")


def any_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FEW.index(spark, sf_dir).any_match(views(spark, sf_dir, _FEW.probes), "probe_id").select("probe_id")


def no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FEW.index(spark, sf_dir).no_match(views(spark, sf_dir, _FEW.probes), "probe_id").select("probe_id")


def single_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probe of literals: a filter over the IDs."""
    index = _FEW.index(spark, sf_dir)
    return index._matching({"segment": "BUILDING", "nation": 3, "low": 9, "high": 10, "value": 4})


def local_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes that read alike are matched once."""
    index = _FEW.index(spark, sf_dir)
    return index.local().match(views(spark, sf_dir, _FEW.probes)).select("probe_id", "rule_id", "rule_ord")


_RANKED_TREE = lambda: R.All(R.Include("segment"), R.Include("nation"))
_RANKED_SQL = f"""
WITH rules AS ({SHARED}), probes AS ({X.CUSTOMER_PROBES}),
placed AS (SELECT *, row_number() OVER (ORDER BY coalesce(value, -1) DESC, pos) - 1 AS rank_ord FROM rules),
found AS (SELECT p.probe_id, r.rule_id, CAST(min(r.rank_ord) AS BIGINT) AS rank_ord FROM probes p JOIN placed r
 ON (r.segment IS NULL OR p.segment = r.segment) AND (r.nation IS NULL OR p.nation = r.nation) GROUP BY p.probe_id, r.rule_id)
"""


def _ranked(spark: SparkSession, sf_dir: str, first: bool) -> DataFrame:
    rules = views(spark, sf_dir, SHARED).withColumn("rank", F.coalesce("value", F.lit(-1)))
    return RankedIndex(_RANKED_TREE(), rules, rank_col="rank").match(views(spark, sf_dir, X.CUSTOMER_PROBES), "probe_id", first)


def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDs by their best-ranked matching row."""
    return _ranked(spark, sf_dir, False)


_RANKED_NULLS_SQL = _RANKED_SQL.replace("coalesce(value, -1) DESC", "value DESC NULLS LAST")


def ranked_missing_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a rank come after all others, in insertion order."""
    return RankedIndex(_RANKED_TREE(), views(spark, sf_dir, SHARED), rank_col="value").match(views(spark, sf_dir, X.CUSTOMER_PROBES), "probe_id")


def numbered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules put in order by a string with nulls and a number; ties do not occur in the fixture."""
    rules = views(spark, sf_dir, SHARED).withColumnRenamed("pos", "key")
    found = RuleSchema(R.Include("nation")).build(numbered(rules, "segment", "key")).match(views(spark, sf_dir, X.CUSTOMER_PROBES))
    return found.select("probe_id", "rule_id", "rule_ord")


def ranked_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-ranked match alone."""
    return _ranked(spark, sf_dir, True)


_MORE: dict[str, tuple[Query, str]] = {
    "ordered_results": (ordered_results, _ORDERED.sql("SELECT probe_id, rule_id, rule_ord, row_number() OVER (PARTITION BY probe_id ORDER BY rule_ord) AS place FROM matches")),
    "first_match_per_probe": (first_match_per_probe, _ORDERED.sql("SELECT probe_id, rule_id, rule_ord FROM matches QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY rule_ord) = 1")),
    "first_three_per_probe": (first_three_per_probe, _ORDERED.sql("SELECT probe_id, rule_id, rule_ord FROM matches QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY rule_ord) <= 3")),
    "match_counts": (match_counts, _FEW.sql("SELECT p.probe_id, count(m.rule_id) AS matches FROM probes p LEFT JOIN matches m ON p.probe_id = m.probe_id GROUP BY p.probe_id")),
    "any_match": (any_match, _FEW.sql("SELECT DISTINCT probe_id FROM matches")),
    "no_match": (no_match, _FEW.sql("SELECT probe_id FROM probes WHERE probe_id NOT IN (SELECT probe_id FROM matches)")),
    "single_search": (single_search, _FEW._replace(probes="SELECT 0 AS probe_id, 'BUILDING' AS segment, 3 AS nation, 9 AS low, 10 AS high, 4 AS value").sql("SELECT rule_id, rule_ord FROM matches")),
    "local_dedup": (local_dedup, _FEW.sql()),
    "ranked_results": (ranked_results, _RANKED_SQL + "SELECT probe_id, rule_id, rank_ord FROM found"),
    "ranked_missing_ranks": (ranked_missing_ranks, _RANKED_NULLS_SQL + "SELECT probe_id, rule_id, rank_ord FROM found"),
    "numbered_rules": (numbered_rules, Case(None, [eq("nation")], f"SELECT row_number() OVER (ORDER BY segment NULLS LAST, pos) AS pos, * EXCLUDE (pos) FROM ({SHARED}) s").sql()),
    "ranked_match": (ranked_match, _RANKED_SQL + "SELECT probe_id, rule_id, rank_ord FROM found QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY rank_ord) = 1"),
}


def queries() -> dict[str, Query]:
    return {name: case.run for name, case in CASES.items()} | {name: q for name, (q, _) in _MORE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: case.sql() for name, case in CASES.items()} | {name: sql for name, (_, sql) in _MORE.items()}
