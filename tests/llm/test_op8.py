import hashlib
import random

from pyspark.sql import functions as F
from tallymatch.llm import order_minhash, queries
from tallymatch.llm.order_minhash import fingerprints, likeness, shown, with_fingerprint, with_next


def edits(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest())
    return out


def like(a, b):
    """Of two fingerprints as shown: ten digits a tuple, the first two its sketch."""
    a, b = ({x[k : k + 10] for k in range(0, len(x), 10)} for x in (a, b))
    either = {x[:2] for x in a | b}
    return len(a & b) / len(either) if either else 1.0


def test_likeness_against_the_fingerprints(spark, sf):
    """near_next and near_edited of every document from the fingerprints, and these from the texts alone."""
    docs = [tuple(r) for r in queries.read(spark, sf, "documents").select("doc_id", "text").collect()]
    rows = {r["doc_id"]: r for r in queries.op8_order_minhash(spark, sf).collect()}
    order = sorted(docs, key=lambda d: -d[0])
    edited = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)]
        assert abs(rows[i]["near_next"] - like(rows[i]["fingerprint"], rows[after[0]]["fingerprint"])) < 1e-12
        assert abs(rows[i]["near_edited"] - like(rows[i]["fingerprint"], rows[i]["edited_fingerprint"])) < 1e-12
        t, cut = t or "", len(t or "") // 3
        edited.append((i, t[: len(t) - cut] + (after[1] or "")[:cut]))
    lone = with_fingerprint(spark.createDataFrame(edited, "i long, text string"), "text", "fp").select("i", shown(F.col("fp")).alias("fp"))
    assert {r["i"]: r["fp"] for r in lone.collect()} == {i: r["edited_fingerprint"] for i, r in rows.items()}


def test_each_text_is_prepared_once(spark, sf):
    """The copies that head a bucket are found by id and text, before any fingerprint."""
    plan = queries.op8_order_minhash(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "regexp_extract_all" not in plan[plan.index("Aggregate") :]
    assert plan.count("regexp_extract_all") == 3  # edited texts, rows, and the heads that the aggregate has found


def test_heavy_ids_are_cut(spark, monkeypatch):
    """One id, and the null id, hold most rows: every row still has one next row, in one cycle."""
    monkeypatch.setattr(order_minhash, "HEAVY", 20)
    rows = [(7, f"text number {i}") for i in range(300)] + [(None, f"null {i % 90}") for i in range(100)] + [(i, f"other {i}") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    buckets = []
    out = with_next(df, "doc_id", "text", lambda x: buckets.append(x) or x, ["text"]).collect()
    assert len(out) == len(rows) and sorted((r["text"] for r in out)) == sorted(r["next_text"] for r in out)
    sizes = [r["count"] for r in buckets[0].where("__head = 0 and (doc_id = 7 or doc_id is null)").groupBy("__bucket").count().collect()]
    assert max(sizes) < 60
    texts = [t for _, t in rows if not t.startswith("null")]
    step = {r["text"]: r["next_text"] for r in out if not r["text"].startswith("null")}
    assert [step[f"other {i}"] for i in range(159, 100, -1)] == [f"other {i}" for i in range(158, 99, -1)]
    seven = spark.createDataFrame([(t,) for t in texts if t.startswith("text")], "t string").selectExpr("t", "xxhash64(t, 1) h").collect()
    seven = [r["t"] for r in sorted(seven, key=lambda r: -r["h"])]
    assert [step[t] for t in seven[:-1]] == seven[1:] and step["other 100"] == seven[0] and step[seven[-1]].startswith("null")


def test_query(spark, sf):
    df = queries.op8_order_minhash(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = {r["doc_id"]: r for r in df.collect()}
    docs = [tuple(r) for r in queries.read(spark, sf, "documents").select("doc_id", "text").collect()]
    want = edits(docs)
    assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in rows.items()} == want
    texts = dict(docs)
    by = {}
    for i, r in rows.items():
        assert by.setdefault(texts[i], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for r in rows.values() if r["n_chars"] > 500]
    mean = lambda k: sum(r[k] for r in long) / len(long)
    assert 0.25 < mean("near_edited") < 0.7 and mean("near_next") < 0.2


def test_occurrences_and_order(spark):
    """The array form against the definition, with hashes of Spark itself."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(30)] + ["", "  ", "one", "two words", "q" * 100, "x " * 3000]
    df = with_fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", "fp")
    got = {r["i"]: sorted(r["fp"]) for r in df.collect()}
    units = [[w[k : k + 16] for w in t.split() for k in range(0, len(w), 16)] for t in texts]
    kmers = [(i, p, *(u[p : p + 3] + [None] * 3)[:3]) for i, u in enumerate(units) for p in range(max(len(u) - 2, 1) if u else 0)]
    k = spark.createDataFrame(kmers, "i int, p int, a string, b string, c string").selectExpr("i", "p", "shiftright(xxhash64(a, b, c), 31) h").collect()
    seen, rows = {}, []
    for r in sorted(k, key=lambda r: (r["i"], r["p"])):
        n = seen[r["i"], r["h"]] = seen.get((r["i"], r["h"]), -1) + 1
        rows.append((r["i"], r["p"], r["h"], n))
    v = spark.createDataFrame(rows, "i int, p int, h long, n long").selectExpr("i", "p", "shiftright(xxhash64(h, n), 31) v").collect()
    tuples = []
    for i in range(len(texts)):
        by = {}
        for r in sorted((r for r in v if r["i"] == i), key=lambda r: (r["v"], r["p"])):
            by.setdefault(r["v"] >> 27, []).append((r["p"], r["v"]))
        tuples += [(i, s + 32, *[x for _, x in sorted(own[:2])], *[None] * (2 - len(own))) for s, own in by.items()]
    want = spark.createDataFrame(tuples, "i int, s long, x long, y long").selectExpr("i", "shiftleft(s, 32) | (xxhash64(x, y) & 4294967295) t").collect()
    assert {i: got[i] for i in got} == {i: sorted(r["t"] for r in want if r["i"] == i) for i in got}


def test_sensitive_to_order(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    swapped = words[200:] + words[:200]
    once = words[:100] + ["zz"] + words[100:]
    df = with_fingerprint(spark.createDataFrame([(" ".join(w),) for w in (words, swapped, once)], "text string"), "text", "fp")
    a, b, c = [r["fp"] for r in df.collect()]
    near = spark.createDataFrame([(a, b), (a, c)], "x array<long>, y array<long>").select(likeness(F.col("x"), F.col("y"))).collect()
    assert near[0][0] < 0.75 < near[1][0]


def test_null_empty_repeats(spark):
    rows = [(5, "same text here"), (5, "same text here"), (7, None), (9, ""), (None, "x"), (11, "é" * 100_000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, fingerprint string, n_chars int")
    got = fingerprints(df).collect()
    assert len(got) == 6
    assert {r["fingerprint"] for r in got if r["doc_id"] in (7, 9)} == {""}
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 5) == 1
    lone = fingerprints(df.where("doc_id = 11")).collect()[0]
    assert lone["near_next"] == 1.0 and lone["n_chars"] == 100_000
    assert fingerprints(df.limit(0)).collect() == []
