import math
import random

import numpy as np
import pytest
from tallymatch.llm import queries, vectors
from tallymatch.llm.vectors import near_vectors


def brute(rows, least):
    """Every pair of a label, by cosine in double precision."""
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in ok}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    near = {i: [j for j in ok if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= least] for i in ok}
    out = []
    for i, (vid, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo = [k for j in todo for k in near.get(j, []) if k not in seen and not seen.add(k)]
        comp = min(rows[j][0] for j in seen)
        out.append((vid, len(near.get(i, [])), comp, vid == comp))
    return sorted(out)


@pytest.mark.parametrize(("per_list", "block"), [(1024, 4096), (40, 16), (100_000, 16)])
def test_against_brute_force(spark, monkeypatch, per_list, block):
    for name, value in (("PER_LIST", per_list), ("BLOCK", block), ("QUERIES", 50)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(90):
        base = rng.normal(size=24)
        for _ in range(rng.integers(1, 9)):
            rows.append(base + rng.normal(size=24) * rng.choice([0, 0.05, 0.2, 0.35]) * np.linalg.norm(base) / 24**0.5)
    rows = [(int(i) * 3 + 1, [float(x) for x in v], int(rng.integers(0, 3))) for i, v in enumerate(rows)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 24, [nan] * 24, [inf, *[1.0] * 23], [None, *[1.0] * 23], [1e-300] * 24, [2e-300] * 24, [1.0] * 5, [2.0] * 5, rows[0][1]]
    rows += [(5000 + i, v, 1) for i, v in enumerate(odd)] + [(6000, rows[0][1], None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n int").repartition(4)
    assert sorted(map(tuple, near_vectors(df, 0.93).collect())) == brute(rows, 0.93)


@pytest.mark.parametrize("longer", [False, True])
def test_pairs_across_many_borders(spark, monkeypatch, longer):
    """64 dimensions and many lists: displacements along the borders' normals, and a longer vector elsewhere in the table."""
    monkeypatch.setattr(vectors, "PER_LIST", 20)
    rng = np.random.default_rng(5)
    turn = rng.uniform(0, 2 * np.pi, 500)
    x = np.c_[np.cos(turn), np.sin(turn), rng.normal(size=(500, 62)) * 0.003]
    base = rng.normal(size=(60, 64))
    near = np.repeat(base, 5, axis=0) + rng.normal(size=(300, 64)) * 0.2
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate([*x, *near])]
    if longer:
        rows.append((9000, [1.0] * 1024, 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got, want = sorted(map(tuple, near_vectors(df, 0.93).collect())), brute(rows, 0.93)
    print("links found", sum(r[1] for r in got), "of", sum(r[1] for r in want))
    assert got == want


def test_query_against_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in queries.read(spark, sf, "embeddings").collect()]
    assert sorted(map(tuple, queries.op2_embedding_near_dedup(spark, sf).collect())) == brute(rows, 0.93)


@pytest.mark.parametrize("shape", ["random", "clustered", "four dimensions"])
def test_recall_at_hundreds_of_lists(spark, monkeypatch, shape):
    """20,000 vectors in 64 dimensions with planted near copies, some 300 lists, long lists divided: every link is found."""
    monkeypatch.setattr(vectors, "PER_LIST", 20)
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rng = np.random.default_rng(7)
    n = 20_000
    if shape == "random":
        x = rng.normal(size=(n, 64))
    elif shape == "clustered":
        x = rng.normal(size=(40, 64))[rng.integers(0, 40, n)] + rng.normal(size=(n, 64)) * 0.45
    else:
        x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 64)) + rng.normal(size=(n, 64)) * 0.3
    x[: n // 4] = x[n // 2 : n // 2 + n // 4] + rng.normal(size=(n // 4, 64)) * np.linalg.norm(x[n // 2 : n // 2 + n // 4], axis=1)[:, None] / 8 * rng.uniform(0.1, 0.45, n // 4)[:, None]
    label = rng.integers(0, 3, n)
    label[: n // 4] = label[n // 2 : n // 2 + n // 4]
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int").repartition(8)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df, 0.93).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.zeros(n, np.int64)
    for k in range(3):
        own = np.flatnonzero(label == k)
        for a in range(0, len(own), 1000):
            part = own[a : a + 1000]
            want[part] += ((u[part] @ u[own].T) >= 0.93).sum(axis=1) - 1
    found = np.array([got[i] for i in range(n)])
    print(shape, "links", found.sum() // 2, "of", want.sum() // 2)
    assert want.sum() > 4000 and np.abs(found - want).sum() <= 2  # a cosine at the border may round either way


def test_ids_that_repeat_with_other_vectors(spark):
    """Each row counts as a vector of its own; null ids link, and name no component."""
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (None, [-1.0, 0.0], 1), (9, [-1.0, 0.01], 1), (None, [0.0, -1.0], 1), (None, [0.01, -1.0], 1), (6, [5.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, near_vectors(df).collect()), key=str)
    want = [(5, 2, 5, True), (5, 1, 3, False), (7, 2, 5, False), (6, 2, 5, False), (3, 1, 3, True), (None, 1, 9, False), (9, 1, 9, True), (None, 1, None, False), (None, 1, None, False)]
    assert got == sorted(want, key=str)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    rows = [(int(rng.integers(0, 25)), (base[rng.integers(0, 30)] + rng.normal(size=8) * 0.12).tolist(), int(rng.integers(0, 2))) for _ in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert sorted(map(tuple, near_vectors(df, 0.93).collect())) == brute(rows, 0.93)


def test_defined_cases(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (7, [2.0, 4.0], 1), (7, [2.0, 4.0], 1), (9, None, 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, near_vectors(df).collect()), key=str)
    assert (9, 0, 9, True) in got and got.count((7, 2, 7, True)) == 2 and (None, 2, 7, False) in got and len(got) == 4
    assert near_vectors(df.limit(0)).collect() == []
    assert near_vectors(df.where("vec_id = 9")).collect()[0]["n_links"] == 0
