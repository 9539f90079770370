"""Matching by bitmaps: the same results as the SQL's and the join's, for values of all kinds and across batches and tiles."""

import collections
import itertools
import types

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallymatch import All, Between, CompareBy, Exclude, Greater, GreaterOrEqual, Include, Less, LessOrEqual, RuleSchema
from tallymatch import queries as Q
from tallymatch.operators import index as index_module
from tallymatch.operators import tiles

SF = "/root/testdata/sf0.01"


@pytest.fixture
def small(monkeypatch):
    """Bitmaps wherever they serve, in batches and tiles of which there are several."""
    for module, values in ((index_module, {"PAIRS": 1, "ALIKE": 10**9}), (tiles, {"BATCH": 100, "TILE": 2**13, "ROWS": 50, "SHARE": 0})):
        for name, value in values.items():
            monkeypatch.setattr(module, name, value)


def by_bitmaps(df) -> bool:
    return "MapInArrow" in df._jdf.queryExecution().analyzed().toString()


def counted(df) -> collections.Counter:
    return collections.Counter(map(repr, map(tuple, df.collect())))  # NaN has one text


def both(index, probes, monkeypatch):
    found = index.match(probes)
    assert by_bitmaps(found)
    monkeypatch.setattr(index_module, "PAIRS", 2**62)
    plain = index.match(probes)
    assert not by_bitmaps(plain) and plain.columns == found.columns and plain.dtypes == found.dtypes
    return counted(found), counted(plain)


@pytest.mark.parametrize("name", ["all_flat", "all_nested"])
def test_large_shares_against_the_sql(spark, monkeypatch, name):
    """At the size of the test tables' 15,000 x 2,000 pairs bitmaps are chosen by their own estimate."""
    monkeypatch.setattr(index_module, "PAIRS", 2**22)
    df = Q.queries()[name](spark, SF)
    assert by_bitmaps(df) and df.columns == ["probe_id", "rule_id", "rule_ord"]
    con = duckdb.connect()
    for t in ("part", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.register("found", df.toArrow())
    want = f"SELECT probe_id, rule_id, rule_ord FROM ({Q.oracle_sql()[name]}) t"
    assert con.sql(f"({want}) EXCEPT ALL SELECT * FROM found").fetchall() == [] == con.sql(f"SELECT * FROM found EXCEPT ALL ({want})").fetchall()


def test_selective_rules_are_joined(spark, monkeypatch):
    monkeypatch.setattr(index_module, "PAIRS", 1)
    assert not by_bitmaps(Q.queries()["production_shape"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("kinds", [2, 1024])
@pytest.mark.parametrize("leaf", [GreaterOrEqual, LessOrEqual, Greater, Less])
def test_orders(spark, small, monkeypatch, leaf, kinds):
    """Of doubles, by places in a batch (more values than kinds) and by truths; NaN is the greatest, and zeros are equal."""
    monkeypatch.setattr(tiles, "KINDS", kinds)
    odd = [float("nan"), float("inf"), float("-inf"), -0.0, 0.0, None, 1.5]
    rules = spark.createDataFrame([(i, f"rule {i // 2}", odd[i] if i < 7 else float(i % 13)) for i in range(60)], "pos long, rule_id string, v double")
    probes = spark.createDataFrame([(i, "é" * (i % 3), odd[i % 7] if i % 3 == 0 else float(i % 17) - 1.5) for i in range(700)], "id int, name string, v double").repartition(3)
    found, plain = both(RuleSchema(leaf("v")).build(rules), probes, monkeypatch)
    assert found == plain and len(found) > 1000


def test_all_kinds_of_leaves(spark, small, monkeypatch):
    """IDs of several rows, leaves of few and of many values, probes without any value, and a field named like another's alias."""
    monkeypatch.setattr(tiles, "KINDS", 40)
    rules = spark.range(300).selectExpr("id AS pos", "id % 130 AS rule_id", "IF(id % 4 > 0, concat('s', id % 5), NULL) AS s", "IF(id % 7 > 0, id * 31 % 199, NULL) AS low", "IF(id % 5 > 0, id * 31 % 199 + 150, NULL) AS high", "IF(id % 3 > 0, CAST(id % 6 AS INT), NULL) AS v", "CAST(id % 6 AS INT) AS op", "IF(id % 9 = 0, DATE'2020-01-01', NULL) AS d")
    probes = spark.range(1500).selectExpr("id AS c0", "IF(id % 11 > 0, concat('s', id % 6), NULL) AS s", "IF(id % 13 > 0, CAST(id * 7 % 311 AS INT), NULL) AS low", "IF(id % 17 > 0, CAST(id * 7 % 311 + id % 5 AS INT), NULL) AS high", "IF(id % 8 > 0, CAST(id % 7 AS SMALLINT), NULL) AS v", "IF(id % 3 = 0, DATE'2020-01-01', NULL) AS d", "IF(id % 10 = 0, 0.1D, NULL) AS `a.b`")
    tree = All(Include("s"), All(Between("low", "high"), CompareBy("v", "op")), Exclude("d"))
    found, plain = both(RuleSchema(tree).build(rules), probes, monkeypatch)
    assert found == plain and len(found) > 1000


def test_named_columns_alone(spark, small):
    index = RuleSchema(Include("v")).build(spark.range(20).selectExpr("id AS pos", "id AS rule_id", "IF(id % 2 = 0, id % 3, NULL) AS v"))
    probes = spark.range(50).selectExpr("id AS k", "id % 4 AS v")
    assert by_bitmaps(index.match(probes, columns=["k"]))
    assert counted(index.match(probes, columns=["k"])) == counted(index.match(probes).select("k", "rule_id", "rule_ord"))
    assert counted(index.match(probes.where(F.col("k") < 0))) == collections.Counter()


def runs_of(batches) -> list[tuple[int, tuple]]:
    """IDs and the probes that follow each other for them, as results come."""
    rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    return [(k, tuple(r[0] for r in g)) for k, g in itertools.groupby(rows, key=lambda r: r[1])]


@pytest.mark.parametrize("op", [">=", "<="])
def test_orders_come_in_runs_of_the_same_probes(op):
    """Values in no order: nearly all results are in runs of 256 or 64 probes, and few such runs repeat for many IDs."""
    values = np.random.default_rng(1).permutation(4096).astype(float)
    ends = np.arange(0, 4096, 41).astype(float)
    table = {"ids": pa.array(np.arange(len(ends))), "ords": pa.array(np.arange(len(ends))), "few": [], "many": [(op, ends, np.ones(len(ends), bool))]}
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 512)), pa.array(values[a : a + 512])], names=["c0", "c1"]) for a in range(0, 4096, 512)]
    shared = [types.SimpleNamespace(value=table)]
    found = runs_of(tiles._matches(shared, 1, tiles.BATCH, tiles.TILE, tiles.ROWS, tiles.WHOLE)(iter(batches)))
    want = {(i, p) for i, e in enumerate(ends) for p in np.flatnonzero(values >= e if op == ">=" else values <= e)}
    got = [(i, p) for i, run in found for p in run]
    assert len(got) == len(want) and set(got) == want
    long = [run for _, run in found if len(run) % 64 == 0]
    assert sum(map(len, long)) > 0.95 * len(got) and len(set(long)) < len(long) / 5


@pytest.mark.parametrize("nested", [False, True])
def test_ids_of_several_broadcasts(spark, small, monkeypatch, nested):
    """More IDs than one broadcast may hold are met a broadcast at a time; beyond BLOCKS of them probes are joined."""
    rules = spark.range(300).selectExpr("id AS pos", "id AS rule_id", "IF(id % 4 > 0, concat('s', id % 5), NULL) AS s", "IF(id % 7 > 0, id * 31 % 199, NULL) AS low")
    probes = spark.range(400).selectExpr("id AS k", "concat('s', id % 6) AS s", "CAST(id * 7 % 311 AS INT) AS low")
    leaf = GreaterOrEqual("low")
    index = RuleSchema(All(Include("s"), All(All(leaf)) if nested else leaf)).build(rules)
    monkeypatch.setattr(tiles, "BROADCAST_ROWS", 70)
    with monkeypatch.context() as m:
        found, plain = both(index, probes, m)
    assert found == plain and len(found) > 1000
    monkeypatch.setattr(tiles, "BLOCKS", 2)
    assert not by_bitmaps(index.match(probes))


def test_probes_of_short_kinds_go_by_bitmaps(spark, monkeypatch):
    """Probes that read alike, but in the mean not enough of them to fill a row."""
    for name in ("PAIRS", "ALIKE"):
        monkeypatch.setattr(index_module, name, 1)
    rules = spark.range(50).selectExpr("id AS pos", "id AS rule_id", "IF(id % 2 = 0, id % 3, NULL) AS v")
    probes = spark.range(900).selectExpr("id AS k", "IF(id % 10 > 0, id % 4, NULL) AS v")
    found, plain = both(RuleSchema(Exclude("v")).build(rules), probes, monkeypatch)
    assert found == plain and len(found) > 1000
