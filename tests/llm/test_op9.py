import random

import numpy as np
import pytest
from tallymatch.llm import lines as lines_module
from tallymatch.llm import queries
from tallymatch.llm.lines import PerfectHash, dedup_lines
from tallymatch.llm.shingles import mix

WHITE = " \t\n\x0b\x0c\r"


def brute(docs, chars, least):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    held = {}
    for n, (i, t) in enumerate(docs):
        for x in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(x, []).append((i, n))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= chars and len(held[key(x)]) >= least and max(h for h, _ in held[key(x)]) != i)]
        out.append((i, "\n".join(kept) if t is not None else None, len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("keys", [10**6, 0])
def test_against_brute_force(spark, keys):
    rng = random.Random(3)
    lines = [f"Line {i} " + "é" * rng.randint(0, 20) for i in range(40)]
    dress = lambda x: rng.choice(["", " ", "\t"]) + rng.choice([x, x.upper().replace("É", "é"), x]) + rng.choice(["", "\r"])
    docs = [(i * 7, "\n".join(dress(rng.choice(lines)) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    docs += [(1, None), (2, ""), (3, "\n\n"), (4, lines[0] + "\n" + lines[0]), (100_000, lines[0] + "\n" + lines[0] + "\n" + lines[1]), (5, "y" * 200_000 + "\n" + lines[1])]
    df = spark.createDataFrame([(i, t, 0, "hi", "z") for i, t in docs], "doc_id long, text string, n_lines int, hi string, mark string").repartition(5)
    got = dedup_lines(df, 12, 4, broadcast_keys=keys)
    assert got.columns == ["doc_id", "text", "hi", "mark", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.drop("hi", "mark").collect())) == sorted(brute(docs, 12, 4))


@pytest.mark.parametrize("keys", [10**6, 0])
def test_null_ids_repeats_and_empty(spark, keys):
    rows = [(None, "same line\nother"), (3, "same line"), (3, "same line"), (9, "same line\n same LINE")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, dedup_lines(df, 5, 4, broadcast_keys=keys).collect()), key=str)
    assert got == sorted([(None, "other", 2, 1), (3, "", 1, 1), (3, "", 1, 1), (9, "same line\n same LINE", 2, 0)], key=str)
    assert dedup_lines(df.limit(0), broadcast_keys=keys).collect() == []


def test_groups_of_a_shard_with_a_hot_line_are_bounded(spark, monkeypatch):
    """Six shards, and a line that every document holds: no group has much over GROUP probes, repeated rows included."""
    most, whole = 120, lines_module._probe_group

    def bounded(least):
        run = whole(least)

        def checked(arrays, probes):
            assert probes.num_rows <= most, probes.num_rows
            return run(arrays, probes)

        return checked

    for name, value in (("GROUP", 100), ("SHARD", 10), ("_probe_group", bounded)):
        monkeypatch.setattr(lines_module, name, value)
    docs = [(i, "a line of all\n" + "\n".join(f"a line number {(i * 5 + k) % 60}" for k in range(2))) for i in range(600)]
    docs += [(1000, "a line of all\nand one of mine")] * 300
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = dedup_lines(df, 8, 5, broadcast_keys=0)
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs, 8, 5))


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(mix(np.arange(20_000, dtype=np.uint64)))
    h = PerfectHash.build(keys)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    assert len(h.index(keys[:0])) == 0 and h.index(mix(keys)).max() < len(keys)
    assert PerfectHash.build(keys[:0]).index(keys[:3]).tolist() == [-1] * 3


def test_query_against_sql(spark, same_as_sql):
    same_as_sql(spark, queries.op9_line_dedup, queries.OP9_SQL)
