import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallymatch.llm import mixing, queries
from tallymatch.llm.common import running_sums, sums_before
from tallymatch.llm.mixing import mix_documents, mix_sources, permute, plan, slots_of, targets

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    for sizes in ([100] * 4, [1000, 10, 10, 0, 500], [7], [0, 0], [], [1, 10**9, 3]):
        out = targets(sizes)
        assert sum(out) == pytest.approx(1.5 * sum(sizes))
        assert all(t <= 2 * s for t, s in zip(out, sizes, strict=True))
        unit = [t / (5, 2, 1)[i % 3] for i, (t, s) in enumerate(zip(out, sizes, strict=True)) if t < 2 * s]
        assert not unit or max(unit) == pytest.approx(min(unit))


def test_permutations():
    for n in (1, 2, 3, 100, 1025):
        for key in (1, 2**63 + 5):
            j = np.arange(n)
            of = lambda x, back: permute(x, np.full(n, n), np.full(n, key, np.uint64), back)  # noqa: B023, E731
            p = of(j, False)
            assert sorted(p.tolist()) == j.tolist()
            assert (of(p, True) == j).all()


def check(rows, block=512):
    by, size = defaultdict(int), defaultdict(int)
    for r in rows:
        by[r["source"], r["target"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
    for (source, target), taken in by.items():
        assert abs(taken - target) <= 0.5, (source, target, taken)
    assert all(r["source_size"] == size[r["source"]] for r in rows)


def test_query_takes_the_targets(spark, sf):
    a = queries.op10_source_mixing(spark, sf)
    docs = queries.read(spark, sf, "documents")
    rows = [r.asDict() for r in a.join(docs.select("doc_id", "source", "text"), "doc_id").collect()]
    assert len(rows) == docs.count()
    assert all(r["size"] == len(SIZE.findall(r["text"])) for r in rows)
    check(rows)
    names = sorted({r["source"] for r in rows})
    want = dict(zip(names, targets([next(r["source_size"] for r in rows if r["source"] == n) for n in names]), strict=True))
    assert {r["source"]: r["target"] for r in rows} == want
    again = {tuple(r) for r in queries.op10_source_mixing(spark, sf).collect()}
    assert again == {tuple(r) for r in a.collect()}


def test_small_blocks_odd_rows(spark):
    rows = [(i, ["b", "a", None, "Z", "é"][i % 5], " ".join("w" * (i % 7 + 1) for _ in range(i * 13 % 40))) for i in range(80)]
    rows += [(3, "a", "twice here"), (3, "a", "twice here"), (None, "a", "no id"), (500, "empty", ""), (501, "empty", None), (502, "big", "x " * 30_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, sid int")
    out = mix_sources(df, block=16, slots=8)
    got = out.collect()
    assert len(got) == len(rows)
    hashes = {r["text_hash"]: r["source"] for r in df.selectExpr("xxhash64(text) text_hash", "source").collect()}
    del hashes
    by = defaultdict(lambda: [0, 0])
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        by[r["source_size"], r["target"]][0] += r["taken"]
    assert all(abs(t - target) <= 0.5 for (_, target), (t, _) in by.items())
    mixed = mix_documents(df, block=16, slots=8).collect()
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in df.collect()}
    assert sum(r["doc_id"] == 500 for r in mixed) == 1


def test_copies_of_long_documents_meet_the_target(spark):
    """Ratios of 0.33 and 0.67 over documents of many blocks, a few short ones among them; rows of one document repeat."""
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], "w " * int(n)) for i, n in enumerate(rng.integers(4_000, 12_000, 300))]
    rows += [(1000 + i, "ab"[i % 2], "v " * int(n)) for i, n in enumerate(rng.integers(1, 400, 300))]
    rows += [(5000, "b", "u " * 3_000)] * 30 + [(5000, "a", "u " * 3_000)] * 30
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    size, target = {}, {}
    for name in "ab":
        size[name] = sum(len(t.split()) for _, s, t in rows if s == name)
    target = dict(zip("ab", targets(list(size.values()), (2, 1), 0.5), strict=True))
    got = [tuple(r) for r in mix_documents(df, weights=(2, 1), share=0.5).collect()]
    for name in "ab":
        ratio = target[name] / size[name]
        assert abs(sum(len(t.split()) for _, s, t in got if s == name) - target[name]) <= 12_000
        for short in (False, True):
            of = lambda x: sum(s == name and (i >= 1000) == short and i != 5000 for i, s, _ in x)  # noqa: B023, E731
            assert abs(of(got) / of(rows) - ratio) < (0.12 if short else 0.05), (name, short)
        again = sum(i == 5000 and s == name for i, s, _ in got)
        assert 0.5 * ratio * 30 < again < min(30, 1.5 * ratio * 30 + 1)
    assert sorted(got) == sorted(tuple(r) for r in mix_documents(df, weights=(2, 1), share=0.5).collect())


def test_taken_against_a_replay(spark):
    """Each word of each document's place in its source's stream, counted for every slot that takes its block, by plain loops."""
    rng = np.random.default_rng(9)
    rows = [(i, ["a", "b", None][i % 3], "w " * int(rng.integers(0, 90))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = {r["doc_id"]: r["taken"] for r in mix_sources(df, block=16, slots=8).collect()}
    names = ["a", "b", None]
    sizes = [sum(len(t.split()) for _, s, t in rows if s == n) for n in names]
    sources = plan(names, sizes, 16, mixing.SEED)
    sized = spark.createDataFrame([(names.index(s), i, len(t.split())) for i, s, t in rows], "sid int, doc_id long, size long")
    hashed = sized.join(df.selectExpr("doc_id d", "xxhash64(text) text_hash"), F.col("doc_id") == F.col("d"))
    owner = [[None] * n for n in sizes]
    for r in running_sums(hashed, ["sid"], F.struct("doc_id", "text_hash"), ["size"]).collect():
        for k in range(r["before_size"], r["before_size"] + r["size"]):
            assert owner[r["sid"]][k] is None
            owner[r["sid"]][k] = r["doc_id"]
    want = dict.fromkeys(got, 0)
    for r in slots_of(spark, sources, 8, mixing.SEED).collect():
        for k in range(r["block"] * 16, min((r["block"] + 1) * 16, sizes[r["sid"]]))[: r["words"]]:
            want[owner[r["sid"]][k]] += 1
    assert got == want


def test_sums_before(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(k), int(rng.integers(0, 9))) for g in ("x", None) for k in rng.choice(500, 60, replace=False)]
    for per in (1, 7, 4096):
        got = {(r["g"], r["k"]): r["before_v"] for r in sums_before(spark.createDataFrame(rows, "g string, k long, v long"), ["g"], "k", ["v"], per).collect()}
        assert got == {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}


def test_slots_meet_the_plan(spark):
    sources = plan(["a", "b"], [1000, 30], 16, 5)
    slots = slots_of(spark, sources, 10, 5).collect()
    for i, s in enumerate(sources):
        own = sorted((r["slot"], r["block"]) for r in slots if r["sid"] == i)
        assert [k for k, _ in own] == list(range(s.slots))
        first = [b for _, b in own[: s.blocks]]
        assert len(set(first)) == len(first)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix_sources(df).collect() == []
    assert mix_documents(df).collect() == []
    none = spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")
    assert [r["taken"] for r in mix_sources(none).collect()] == [0]
