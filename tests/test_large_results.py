"""Probes that read alike, matched in rows of many: the same results as the SQL's, and each ID's pairs one after the other."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F
from tallymatch import GreaterOrEqual, Include, RankedIndex, RuleSchema
from tallymatch import queries as Q
from tallymatch.operators import index as index_module

SF = "/root/testdata/sf0.01"
ALIKE = ["exclude", "exclude_only_schema", "exclude_ineffective", "greater", "less", "in_list", "between_open_bounds", "compare_by", "composite_key_include", "include", "version_compare"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PAIRS", 1), ("ALIKE", 1), ("CHUNK", 16)):
        monkeypatch.setattr(index_module, name, value, raising=False)


@pytest.mark.parametrize("name", [*ALIKE, "greater_or_equal", "less_or_equal"])
def test_alike_probes_against_the_sql(spark, duck, small, name):
    found = [tuple(r) for r in Q.queries()[name](spark, SF).collect()]
    assert collections.Counter(found) == collections.Counter(duck.sql(f"SELECT probe_id, rule_id, rule_ord FROM ({Q.oracle_sql()[name]}) t").fetchall())
    if name in ALIKE:
        runs = 1 + sum(a[1:] != b[1:] for a, b in zip(found, found[1:], strict=False))
        assert runs < len(found) / 2


def test_hot_and_repeated_probes(spark, small):
    rules = spark.range(40).selectExpr("id AS pos", "id AS rule_id", "CASE WHEN id % 5 > 0 THEN id % 3 END AS v")
    index = RuleSchema(Include("v")).build(rules)
    hot = spark.range(3000).selectExpr("id", "CASE WHEN id % 10 > 0 THEN IF(id < 2500, 1, id % 4) END AS v")
    want = collections.Counter((p["id"], r["rule_id"]) for p in hot.collect() for r in rules.collect() if r["v"] is None or r["v"] == p["v"])
    assert "__probes" in index.match(hot)._jdf.queryExecution().analyzed().toString()
    assert collections.Counter((r["id"], r["rule_id"]) for r in index.match(hot).collect()) == want
    assert index._alike(index._asked(hot).select(F.struct("id", "v").alias("__probe"), "__q0")).agg(F.max(F.size("__probes"))).first()[0] == 16
    again = hot.select(F.lit(1).alias("id"), "v")  # rows that cannot be told apart stay as they are
    assert index.match(again).count() == sum(want.values())


def test_probes_that_differ_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(index_module, "PAIRS", 1, raising=False)
    index = RuleSchema(GreaterOrEqual("v")).build(spark.range(20).selectExpr("id AS pos", "id AS rule_id", "id AS v"))
    found = index.match(spark.range(100).selectExpr("id", "id AS v"))
    assert "__probes" not in found._jdf.queryExecution().analyzed().toString()
    assert found.count() == sum(min(20, i + 1) for i in range(100))


def test_ranked_probes_are_matched_by_kind(spark):
    """The join with the rows' IDs meets reduced pairs, and few of them where probes read alike; a key may stand for several probes."""
    rows = [(i, i % 7, None if i % 5 == 0 else i % 3, (i * 37) % 11) for i in range(60)]
    ranked = RankedIndex(Include("v"), spark.createDataFrame(rows, "pos long, rule_id long, v long, rank long"), rank_col="rank")
    probes = [(i % 500, None if i % 11 == 0 else i % 4) for i in range(2000)]
    df = spark.createDataFrame(probes, "k long, v long")
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    want = {}
    for k, v in probes:
        for place, r in enumerate(order):
            if r[2] is None or r[2] == v:
                want[k, r[1]] = min(place, want.get((k, r[1]), place))
    found = ranked.match(df, "k")
    assert {(r["k"], r["rule_id"]): r["rank_ord"] for r in found.collect()} == want and found.count() == len(want)
    best = {}
    for (k, i), place in want.items():
        best[k] = min((place, i), best.get(k, (place, i)))
    assert {r["k"]: (r["rank_ord"], r["rule_id"]) for r in ranked.match(df, "k", first=True).collect()} == best
    assert ranked.match(df, "k", first=True)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 3
