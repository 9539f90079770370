"""The engine against a model that checks every row, and the golden cases of the semantics."""

import operator
import random

import pytest
from pyspark.sql import functions as F
from tallymatch import All, AnyOf, Between, CompareBy, Exclude, Exists, Greater, GreaterOrEqual, Include, Less, LessOrEqual, Operator, RankedIndex, RuleSchema, load_index, numbered, save_index, truncated, version, zip_rules
from tallymatch.operators import index as index_module
from tallymatch.operators import schema as schema_module
from tallymatch.plans import tables as tables_module
from tallymatch.operators.schema import InvalidRule

OPS = [operator.eq, operator.lt, operator.le, operator.gt, operator.ge, operator.ne]


def build(spark, tree, fields, rows):
    """rows: (id, values...) in insertion order."""
    return RuleSchema(tree).build(zip_rules(spark, [r[1:] for r in rows], [r[0] for r in rows], fields, "string"))


# -- golden cases -------------------------------------------------------------------------------------------------------


def test_exclude_with_a_repeated_id(spark):
    ix = build(spark, Exclude("platform"), "platform string", [("1", "android"), ("1", "ios"), ("2", "ios")])
    assert ix.search(platform="android") == ["2"]
    assert ix.search(platform="ios") == []
    assert ix.search(platform="windows") == ["1", "2"]
    assert ix.search(platform=None) == ["1", "2"]


def test_a_wildcard_row_does_not_rescue_an_excluded_id(spark):
    ix = build(spark, Exclude("v"), "v int", [("1", 1), ("1", 2), ("1", 3), ("1", None)])
    assert [ix.search(v=x) for x in (None, 1, 4)] == [["1"], [], ["1"]]


def test_exclude_without_any_value_excludes_nothing(spark):
    ix = build(spark, All(Include("a"), Exclude("v")), "a int, v int", [("1", 1, None), ("2", None, None)])
    assert ix.search(a=1, v=7) == ["1", "2"]
    assert build(spark, Exclude("v"), "v int", [("1", None)]).search(v=3) == ["1"]


def test_between_sides_are_independent_per_id(spark):
    ix = build(spark, Between("lo", "hi"), "lo int, hi int", [("r", 0, 5), ("r", 15, 20)])
    assert ix.search(lo=10, hi=10) == ["r"]
    probes = spark.createDataFrame([(1, 10, 10), (2, -1, 3)], "id int, lo int, hi int")
    assert [r["id"] for r in ix.match(probes).collect()] == [1]


def test_between_open_bounds(spark):
    rows = [("w", None, None), ("from5", 5, None), ("to20", None, 20), ("5to20", 5, 20), ("15to20", 15, 20)]
    ix = build(spark, Between("lo", "hi"), "lo int, hi int", rows)
    assert ix.search(lo=10, hi=15) == ["w", "from5", "to20", "5to20"]
    assert ix.search(lo=None, hi=None) == ["w"]
    assert ix.search(lo=15, hi=10) == ["w", "from5", "to20", "5to20", "15to20"]  # ends are compared one by one


def test_compare_by_uses_the_stored_operator(spark):
    rows = [("gte", 4, 10), ("lte", 2, 20), ("eq", 0, 15), ("lt", 1, 15), ("gt", 3, 15), ("ne", 5, 15)]
    ix = build(spark, CompareBy("v", "op"), "op tinyint, v int", rows)
    assert ix.search(v=15, op=1) == ["gte", "lte", "eq"]
    assert ix.search(v=16) == ["gte", "lte", "gt", "ne"]
    assert ix.search(v=None) == []


@pytest.mark.parametrize(("leaf", "want"), [(GreaterOrEqual, ["w", "5", "10"]), (Greater, ["w", "5"]), (LessOrEqual, ["w", "10", "15"]), (Less, ["w", "15"]), (Include, ["w", "10"])])
def test_strictness_and_wildcards(spark, leaf, want):
    ix = build(spark, leaf("v"), "v int", [("w", None), ("5", 5), ("10", 10), ("15", 15)])
    assert ix.search(v=10) == want
    assert ix.search(v=None) == ["w"]


def test_order_is_that_of_an_ids_first_row(spark):
    ix = build(spark, Include("v"), "v int", [("first", 1), ("second", 1), ("third", 1), ("first", 1)])
    assert ix.search(v=1) == ["first", "second", "third"]
    ix = build(spark, Include("v"), "v int", [("X", 1), ("Y", 2), ("X", 2)])  # X comes first, by a row that does not match
    assert ix.search(v=2) == ["X", "Y"]
    probes = spark.createDataFrame([(2,)], "v int")
    assert [(r["rule_id"], r["rule_ord"]) for r in ix.match(probes).orderBy("rule_ord").collect()] == [("X", 0), ("Y", 1)]


def test_leaves_of_an_id_may_hold_by_different_rows(spark):
    ix = build(spark, All(Include("a"), Include("b")), "a int, b int", [("m", 1, 10), ("m", 2, 20)])
    assert ix.search(a=1, b=20) == ["m"]
    assert ix.search(a=1, b=30) == []


def test_zero_values_are_values(spark):
    ix = build(spark, All(Include("n"), Include("s"), Include("f")), "n int, s string, f boolean", [("zero", 0, "", False), ("w", None, None, None)])
    assert ix.search(n=0, s="", f=False) == ["zero", "w"]
    assert ix.search(n=1, s="", f=False) == ["w"]


@pytest.mark.parametrize("tree", [All(), All(Include("v"), All()), All(All(All()))])
def test_an_empty_all_matches_nothing(spark, tree):
    ix = build(spark, tree, "v int", [("1", 1), ("2", None)])
    assert ix.search(v=1) == []
    assert ix.match(spark.createDataFrame([(1,)], "v int")).collect() == []


def test_nested_alls_are_flat(spark):
    rows = [("a", "de", 5, "x", 3, 7), ("b", None, None, None, None, None), ("c", "de", 50, "y", 1, 7)]
    flat = All(Include("country"), GreaterOrEqual("minimum"), Exclude("excluded"), CompareBy("threshold", "op"))
    deep = All(Include("country"), All(GreaterOrEqual("minimum"), All(Exclude("excluded"))), CompareBy("threshold", "op"))
    fields = "country string, minimum int, excluded string, op tinyint, threshold int"
    for tree in (flat, deep):
        ix = build(spark, tree, fields, rows)
        assert ix.search(country="de", minimum=9, excluded="z", threshold=8) == ["a", "b"]
        assert ix.search(country="de", minimum=9, excluded="x", threshold=8) == ["b"]


# -- fields -------------------------------------------------------------------------------------------------------------


def test_nested_composite_and_version_fields(spark):
    rows = spark.sql("""
      SELECT * FROM VALUES (0L, 'old', named_struct('name', 'ios', 'v', named_struct('major', 1, 'minor', 9, 'patch', 9)), named_struct('l', 'x', 'g', 'a')),
       (1L, 'new', named_struct('name', 'ios', 'v', named_struct('major', 2, 'minor', 0, 'patch', 0)), NULL),
       (2L, 'any', NULL, named_struct('l', 'x', 'g', 'b')) AS t(pos, rule_id, platform, ab)""")
    tree = All(Include("platform.name"), GreaterOrEqual("platform.v"), Include("ab"))
    ix = RuleSchema(tree).build(rows)
    probes = spark.sql("""
      SELECT * FROM VALUES (1, named_struct('name', 'ios', 'v', named_struct('major', 1, 'minor', 10, 'patch', 0)), named_struct('l', 'x', 'g', 'a')),
       (2, named_struct('name', 'ios', 'v', named_struct('major', 2, 'minor', 0, 'patch', 0)), named_struct('l', 'x', 'g', 'b')),
       (3, NULL, NULL) AS t(id, platform, ab)""")
    got = sorted((r["id"], r["rule_id"]) for r in ix.match(probes).collect())
    assert got == [(1, "old"), (2, "any"), (2, "new")]


def test_getters_as_expressions_with_probe_sides_of_their_own(spark):
    tree = All(GreaterOrEqual(version("a", "b", "c"), version("x", "y", "z")), Include(truncated("t", "hour"), "date_trunc('hour', at)"))
    rows = zip_rules(spark, [(1, 2, 3, None), (None, None, None, None)], ["v", "w"], "a int, b int, c int, t timestamp", "string")
    probes = spark.sql("SELECT 1 AS x, 2 AS y, 2 AS z, timestamp '2024-01-01 10:11:12' AS at UNION ALL SELECT 1, 3, 0, NULL")
    got = sorted((r["y"], r["rule_id"]) for r in RuleSchema(tree).build(rows).match(probes).collect())
    assert got == [(2, "w"), (3, "v"), (3, "w")]


def test_types_of_probes_and_rules_may_differ(spark):
    ix = build(spark, All(Include("v"), Include("s")), "v int, s string", [("1", 5, "a"), ("w", None, None)])
    for kind in ("bigint", "smallint", "double", "decimal(10,2)"):
        probes = spark.sql(f"SELECT CAST(5 AS {kind}) AS v, 'a' AS s UNION ALL SELECT CAST(6 AS {kind}), 'a'")
        assert sorted(r["rule_id"] for r in ix.match(probes).collect()) == ["1", "w", "w"], kind


# -- lifecycle ----------------------------------------------------------------------------------------------------------


def test_errors(spark):
    with pytest.raises(ValueError):
        RuleSchema(None)
    with pytest.raises(ValueError):
        RuleSchema(Include("v")).build(None)
    with pytest.raises(ValueError):
        zip_rules(spark, [(1,)], [1, 2], "v int")
    schema = RuleSchema(CompareBy("v", "op"))
    rows = [(1, 0), (None, 99), (None, None), (3, 9), (4, None)]
    bad = zip_rules(spark, rows, range(5), "v int, op int")
    with pytest.raises(InvalidRule, match=r"^entry 3: .*9 is unknown"):
        schema.build(bad)
    with pytest.raises(InvalidRule, match=r"^entry 0: .*without an operator"):
        schema.build(bad.where("pos = 4").withColumn("pos", F.lit(0)))
    assert schema.build(bad.where("pos < 3")).search(v=1) == [0, 1, 2]  # usable after failures; wildcards' operators do not count
    with pytest.raises(ValueError):
        RuleSchema(AnyOf(Exclude("v")))
    with pytest.raises(ValueError):
        build(spark, Include("v"), "v int", [("1", 1)]).match(spark.createDataFrame([(1, 2)], "v int, rule_id int"))


def test_an_index_keeps_the_rows_it_was_built_from(spark, tmp_path):
    path = str(tmp_path / "rules")
    fields = "v int"
    zip_rules(spark, [(1,)], ["old"], fields, "string").write.parquet(path)
    schema = RuleSchema(Include("v"))
    ix = schema.build(spark.read.parquet(path))
    zip_rules(spark, [(1,)], ["new"], fields, "string").write.mode("overwrite").parquet(path)
    assert ix.search(v=1) == ["old"]
    assert schema.build(spark.read.parquet(path)).search(v=1) == ["new"]


def test_search_into_visit_local(spark):
    ix = build(spark, Include("v"), "v int", [("a", 1), ("b", None), ("c", 1), ("d", 2)])
    local = ix.local()
    for own in (ix, local):
        found = ["kept"]
        assert own.search_into(found, v=1) and found == ["kept", "a", "b", "c"]
        seen = []
        own.visit(lambda i: seen.append(i) or len(seen) < 2, v=1)  # noqa: B023
        assert seen == ["a", "b"]
        own.visit(None, v=1)
        assert own.search() == ["b"]
    with pytest.raises(ValueError):
        ix.search_into(None, v=1)
    again = local.search(v=1)
    again.append("mine")
    assert local.search(v=1) == ["a", "b", "c"]
    local.reset()
    assert local.cache == {} and local.search(v=2) == ["b", "d"]


def test_save_and_load(spark, tmp_path):
    schema = RuleSchema(All(Include("v"), Between("lo", "hi")))
    rows = [(i % 7 or None, i, i + 3) for i in range(60)]
    ix = schema.build(zip_rules(spark, rows, range(60), "v int, lo int, hi int"))
    save_index(ix, str(tmp_path / "ix"))
    back = load_index(spark, schema, str(tmp_path / "ix"))
    probes = spark.createDataFrame([(i, i % 9, i, i + i % 4) for i in range(60)], "id int, v int, lo int, hi int")
    assert sorted(map(tuple, back.match(probes).collect())) == sorted(map(tuple, ix.match(probes).collect()))


def test_numbered(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, rule_id string")
    assert {r["rule_id"]: r["pos"] for r in numbered(df, "k").collect()} == {"a": 0, "b": 1, "c": 2}


def test_numbered_by_any_types(spark, monkeypatch):
    rows = [(None, 2, "n"), ("b", 1, "x"), ("a", None, "y"), ("a", 1, "z"), ("b", 1, "w"), ("b", 1, "w")]
    df = spark.createDataFrame(rows, "k string, j int, rule_id string")
    for few in (100_000, 0):
        monkeypatch.setattr(tables_module, "FEW", few)
        found = sorted((r["pos"], r["k"], r["j"]) for r in numbered(df, "k", "j").collect())
        assert [f[0] for f in found] == list(range(6))
        assert [f[1:] for f in found] == [("a", 1), ("a", None), ("b", 1), ("b", 1), ("b", 1), (None, 2)]
        found = sorted((r["r"], r["k"]) for r in tables_module.dense_rank(df, "k", "r", 6).collect())
        assert [f for f in found] == [(0, "a"), (0, "a"), (1, "b"), (1, "b"), (1, "b"), (2, None)]
        assert [r["pos"] for r in numbered(df.where("false"), "k").collect()] == []
        back = {r["rule_id"]: r["pos"] for r in numbered(df, F.col("k").desc_nulls_first(), "j", "rule_id").collect()}
        assert (back["n"], back["x"], back["y"]) == (0, 3, 5)


def test_large_index_by_ranges(spark, monkeypatch):
    """Above FEW rows nothing is ranked in one task; the results are the same."""
    monkeypatch.setattr(schema_module, "FEW", 10)
    monkeypatch.setattr(tables_module, "FEW", 10)
    rows = [(i % 7 or None, i % 11) for i in range(200)]
    ix = RuleSchema(All(Include("a"), GreaterOrEqual("m"))).build(zip_rules(spark, rows, [i % 90 for i in range(200)], "a int, m int"))
    assert sorted(r["rule_ord"] for r in ix.ids.collect()) == list(range(90))
    assert {r["rule_id"]: r["rule_ord"] for r in ix.ids.collect()} == {i: i for i in range(90)}
    ix.clean()


# -- against a model ----------------------------------------------------------------------------------------------------

FIELDS = "a int, b string, m int, f int, u int, g int, w int, v int, op tinyint, x int"
NAMES = ("a", "b", "m", "f", "u", "g", "w", "v", "op", "x")
TREE = lambda: All(Include("a"), Include("b"), All(GreaterOrEqual("m"), Between("f", "u"), Between("g", "w")), CompareBy("v", "op"), Exclude("x"))


def model(rows, probe):
    """The definition: leaf by leaf, some row of the ID."""
    ids: dict = {}
    for r in rows:
        ids.setdefault(r[0], []).append(dict(zip(NAMES, r[1:], strict=True)))
    out = []
    for place, (i, own) in enumerate(ids.items()):
        some = lambda n, ok: any(r[n] is None or probe[n] is not None and ok(probe[n], r[n], r) for r in own)  # noqa: B023, E731
        good = some("a", lambda p, s, r: p == s) and some("b", lambda p, s, r: p == s) and some("m", lambda p, s, r: p >= s)
        good = good and some("f", lambda p, s, r: s <= p) and some("u", lambda p, s, r: p <= s) and some("g", lambda p, s, r: s <= p) and some("w", lambda p, s, r: p <= s)
        good = good and some("v", lambda p, s, r: OPS[r["op"]](p, s))
        if good and not any(r["x"] is not None and r["x"] == probe["x"] for r in own):
            out.append((probe["id"], i, place))
    return out


CASES = [(150, 1000, 0.25, 1000, 250_000), (300, 50, 0.2, 1000, 250_000), (400, 12, 0.02, 4, 250_000), (300, 40, 0.5, 1000, 250_000), (300, 120, 0.04, 1000, 250_000), (300, 120, 0.08, 1000, 40), (60, 20, 0.04, 1000, 3)]


@pytest.mark.parametrize(("n", "ids", "missing", "large", "broadcast"), CASES)
def test_random_rules_against_the_model(spark, monkeypatch, n, ids, missing, large, broadcast):
    monkeypatch.setattr(schema_module, "SET_VALUES", large)
    monkeypatch.setattr(index_module, "BROADCAST_ROWS", broadcast)
    rng = random.Random(n + ids)
    may = lambda x: None if rng.random() < missing else x

    def span():
        a = rng.randrange(40)
        return may(a), may(a + rng.randrange(9))

    rows = [(rng.randrange(ids), may(rng.randrange(4)), may(rng.choice("wxy")), may(rng.randrange(20)), *span(), *span(), may(rng.randrange(10)), rng.randrange(6), may(rng.randrange(25))) for _ in range(n)]
    probe = lambda i: dict(id=i, a=may(rng.randrange(4)), b=may(rng.choice("wxy")), m=may(20), f=may(rng.randrange(40)), u=may(rng.randrange(45)), g=may(rng.randrange(40)), w=may(rng.randrange(45)), v=may(rng.randrange(10)), x=may(rng.randrange(25)))
    probes = [probe(i) for i in range(150)]
    for p in probes[::2]:  # probes made to meet a rule, a third of them inverted in one interval or both
        own = rows[rng.randrange(n)]
        p |= {k: v for k, v in zip(NAMES[:2], own[1:3], strict=True) if v is not None}
        for (lo, hi), at in ((("f", "u"), 4), (("g", "w"), 6)):
            if own[at] is not None and own[at + 1] is not None:
                p[lo], p[hi] = (own[at + 1], own[at]) if rng.random() < 0.4 else (own[at], own[at + 1])
    ix = RuleSchema(TREE()).build(zip_rules(spark, [r[1:] for r in rows], [r[0] for r in rows], FIELDS))
    df = spark.createDataFrame([tuple(p.values()) for p in probes], "id long, a int, b string, m int, f int, u int, g int, w int, v int, x int")
    want = sorted(m for p in probes for m in model(rows, p))
    assert bool(ix.wide) == (large == 4) and want
    for dedup in (False, True):
        assert sorted((r["id"], r["rule_id"], r["rule_ord"]) for r in ix.match(df, dedup=dedup).collect()) == want
    for p in probes[:4]:
        fields = {k: v for k, v in p.items() if k != "id"}
        assert ix.search(**fields) == [i for _, i, _ in sorted(model(rows, p), key=lambda m: m[2])]
    counts = {r["id"]: r["matches"] for r in ix.match_counts(df, "id").collect()}
    assert counts == {p["id"]: len(model(rows, p)) for p in probes}
    assert {r["id"] for r in ix.any_match(df, "id").collect()} == {i for i, _, _ in want}
    assert {r["id"] for r in ix.no_match(df, "id").collect()} == {p["id"] for p in probes} - {i for i, _, _ in want}
    first = {}
    for i, r, o in sorted(want, key=lambda m: m[2]):
        first.setdefault(i, []).append(r)
    assert {r["id"]: r["rule_id"] for r in ix.first_k(df, "id").collect()} == {i: r[0] for i, r in first.items()}
    assert sorted((r["id"], r["rule_id"]) for r in ix.first_k(df, "id", 2).collect()) == sorted((i, x) for i, r in first.items() for x in r[:2])


def test_inverted_probes_meet_an_id_once(spark):
    both = All(Include("k"), Between("lo", "hi"))
    rows = [(1, 0, 4), (2, 0, 4), (1, 0, 4), (3, 0, 4)]
    ix = RuleSchema(both).build(zip_rules(spark, rows, [7, 7, 8, 8], "k int, lo int, hi int"))
    probes = spark.createDataFrame([(1, 3, 2)], "k int, lo int, hi int")
    assert [r["rule_id"] for r in ix.match(probes).orderBy("rule_ord").collect()] == [7, 8] == ix.search(k=1, lo=3, hi=2)
    plan = ix.match(probes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    two = RuleSchema(All(Between("a", "b"), Between("c", "d"))).build(zip_rules(spark, [(0, 4, 0, 4), (1, 5, 1, 5)], [0, 1], "a int, b int, c int, d int"))
    for probe in [(3, 2, 3, 2), (3, 2, 2, 3), (2, 3, 3, 2), (2, 3, 2, 3)]:
        found = two.match(spark.createDataFrame([probe], "a int, b int, c int, d int")).orderBy("rule_ord").collect()
        assert [r["rule_id"] for r in found] == [0, 1], probe


def test_bounds_that_no_bin_holds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0.0, 1.0), (5.0, nan), (-inf, 3.0), (2.0, inf), (1e300, 1e301), (1.0, 2.0)]
    ix = RuleSchema(Between("lo", "hi")).build(zip_rules(spark, rows, range(6), "lo double, hi double"))
    probes = [(0, 1.0, 1.0), (1, 100.0, 100.0), (2, nan, nan), (3, 1e300, 1e300), (4, -inf, inf)]
    above = lambda a, b: a != a or b == b and a >= b
    want = [(p[0], k) for p in probes for k, r in enumerate(rows) if above(p[1], r[0]) and above(r[1], p[2])]
    got = ix.match(spark.createDataFrame(probes, "id int, lo double, hi double")).collect()
    assert sorted((r["id"], r["rule_id"]) for r in got) == want


def test_entries_without_keys_beyond_the_broadcast_bound(spark, monkeypatch):
    """Orders alone: every probe meets every entry, in blocks, so that no task reads all probes or all entries."""
    monkeypatch.setattr(index_module, "BROADCAST_ROWS", 50)
    ix = RuleSchema(GreaterOrEqual("m")).build(zip_rules(spark, [(i,) for i in range(200)], range(200), "m int"))
    probes = spark.range(400).selectExpr("id", "CAST(id AS INT) AS m")
    assert ix.match(probes).count() == sum(min(i + 1, 200) for i in range(400))
    plan = ix.match(probes)._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    keys = ix._keyed(ix._asked(probes), [0])
    dealt = ix._dealt(keys, ix.entries, 4, F.lit(True)).select("id", "rule_id", F.col("__h"))
    assert dealt.count() == 400 * 200
    groups = ix._dealt(keys, ix.entries, 4, F.lit(True))._jdf.queryExecution().optimizedPlan().toString()
    assert "__ps" in groups and "__pb" in groups


def test_many_masks_fall_back_to_residual_conditions(spark):
    rng = random.Random(3)
    names = [f"v{i}" for i in range(16)]
    rows = [tuple(None if rng.random() < 0.5 else rng.randrange(3) for _ in names) for _ in range(200)]
    fields = ", ".join(f"{n} int" for n in names)
    ix = RuleSchema(All(*map(Include, names))).build(zip_rules(spark, rows, range(200), fields))
    assert 0 < len(ix.masks) <= schema_module.MASKS and len(ix.keys) < 16
    probes = [(i, *(rng.randrange(3) for _ in names)) for i in range(100)]
    want = sorted((p[0], k) for p in probes for k, r in enumerate(rows) if all(s is None or s == q for s, q in zip(r, p[1:], strict=True)))
    got = sorted((r["id"], r["rule_id"]) for r in ix.match(spark.createDataFrame(probes, f"id int, {fields}")).collect())
    assert got == want


def test_ranked(spark):
    rows = zip_rules(spark, [(123, 5, 10), (123, None, 9), (None, None, 1), (123, None, 10), (None, 6, 50)], [10, 10, 10, 20, 30], "store int, region int, rank int")
    tree = All(Include("store"), Include("region"))
    probes = spark.createDataFrame([(1, 123, 5), (2, 123, 7), (3, 9, 6), (4, None, None)], "id int, store int, region int")
    ix = RankedIndex(tree, rows, rank_col="rank")
    ranked = lambda df: [(r["id"], r["rule_id"]) for r in df.orderBy("id", "rank_ord").collect()]
    assert ranked(ix.match(probes, "id")) == [(1, 10), (1, 20), (2, 20), (2, 10), (3, 30), (3, 10), (4, 10)]
    assert ranked(ix.match(probes, "id", first=True)) == [(1, 10), (2, 20), (3, 30), (4, 10)]
    nulls = RankedIndex(tree, rows.withColumn("rank", F.when(F.col("rank") < 10, F.col("rank"))), rank_col="rank")
    assert ranked(nulls.match(probes, "id")) == [(1, 10), (1, 20), (2, 10), (2, 20), (3, 10), (3, 30), (4, 10)]
    plain = RankedIndex(tree, rows)
    assert ranked(plain.match(probes, "id", first=True)) == [(1, 10), (2, 10), (3, 10), (4, 10)]


# -- plans --------------------------------------------------------------------------------------------------------------


def test_equality_joins_by_hash_and_never_by_nested_loop(spark):
    rows = [(i % 9 or None, i % 5 or None, i) for i in range(200)]
    ix = RuleSchema(All(Include("a"), Include("b"), GreaterOrEqual("m"))).build(zip_rules(spark, rows, range(200), "a int, b int, m int"))
    probes = spark.range(1000).selectExpr("id", "id % 9 AS a", "id % 5 AS b", "id AS m")
    plan = ix.match(probes)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan and "Exchange hashpartitioning" not in plan
    ix.size = 10**9
    plan = ix.match(probes)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan or "HashJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_leaves_that_hold_for_all_are_dropped(spark):
    ix = RuleSchema(All(Include("a"), Include("none"), Exclude("never"))).build(zip_rules(spark, [(1, None, None), (2, None, None)], [1, 2], "a int, none int, never int"))
    assert ix.dropped == {1, 2}
    assert ix.search(a=1, none=5, never=4) == [1]


def test_presence(spark):
    ix = build(spark, All(Exists("a"), Include("b")), "b int", [("x", 1)])
    probes = spark.createDataFrame([(1, 1), (None, 1)], "a int, b int")
    assert [r["a"] for r in ix.match(probes).collect()] == [1]
    assert int(Operator.GTE) == 4
