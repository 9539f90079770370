import collections
import math
import re
import zlib

from pyspark.sql import functions as F
from tallymatch.llm import queries
from tallymatch.llm.language import gram_counts, identify, train


def test_held_out_accuracy(spark, sf):
    docs = {r["doc_id"]: r for r in queries.read(spark, sf, "documents").collect()}
    got = queries.op6_language_id(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or ""))
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held)
    assert right >= 0.97 * len(held)


def test_defined_cases(spark):
    rows = [(1, "the cat sat on the mat", "en", "x")] * 5 + [(2, "der hund ist im haus", "de", "x")] * 5 + [(3, None, "en", "x"), (4, "123 -", "de", "x"), (None, "the mat", "en", "x"), (5, "the dog " * 30_000, None, "x"), (6, "漢字", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identify(df, F.col("doc_id") < 3).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "en"]
    assert by[6]["rejected"] and not by[1]["rejected"] and by[3]["rejected"]
    assert by[None]["lang_pred"] == "en" and not by[None]["held_out"] and by[4]["held_out"]
    assert identify(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in identify(df, F.lit(False)).collect()} == {"und"}


def test_query_against_brute_force(spark, sf):
    """Predictions from the learnt centroids by plain loops over characters, counts and centroids; document frequencies by sets."""
    docs = [r for r in queries.read(spark, sf, "documents").collect()]
    learns = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1
    model = train(queries.read(spark, sf, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)

    def grams(text):
        s = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())).strip(" ") + " "
        lead, trail = (text or "").lower()[:1], (text or "").lower()[-1:]
        s = (" " if lead and not lead.isalpha() else "") + s + (" " if trail and not trail.isalpha() else "")
        out = {}
        for n in (2, 3):
            for k in range(len(s) - n + 1):
                h = 0
                a, b = ord(s[k]), ord(s[k + 1])
                h = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF)
                if n == 3:
                    h = (h * 0xC2B2AE3D & 0xFFFFFFFF) ^ (ord(s[k + 2]) * 0x27D4EB2F & 0xFFFFFFFF)
                h = ((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 20
                out[h] = out.get(h, 0) + 1
        return out

    known = [grams(r["text"]) for r in docs if learns(r) and r["lang"] is not None and any(c.isalpha() for c in r["text"] or "")]
    df = collections.Counter(g for x in known for g in x)
    for g in range(0, 4096, 7):
        assert abs(model.idf[g] - (math.log((1 + len(known)) / (1 + df[g])) + 1)) < 1e-12
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, sf).collect()}
    for r in docs[::5]:
        if not any(c.isalpha() for c in r["text"] or ""):
            continue
        x = {g: math.log1p(n) * model.idf[g] for g, n in grams(r["text"]).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        cos = [sum(v * c[g] for g, v in x.items()) / size for c in model.centroids]
        best = max(cos)
        assert abs(got[r["doc_id"]]["score"] - min(1.0, max(0.0, best))) < 1e-9
        assert got[r["doc_id"]]["lang_pred"] in {lang for lang, c in zip(model.langs, cos, strict=True) if c > best - 1e-9}


def test_counts_beyond_two_bytes(spark):
    """The fit sees whole counts, as predictions do."""
    df = spark.createDataFrame([(i, "ab " * 70_000 + "cd " * k, "xx") for i, k in enumerate((0, 5))], "doc_id long, text string, lang string")
    model = train(df, F.lit(True))
    assert all(model.predict("ab " * 70_000 + "cd " * k)[1] > 1 - 1e-6 for k in (0, 5))


def test_grams():
    a, b = gram_counts("Ab  c!d"), gram_counts("ab c d")
    assert (a == b).all() and gram_counts("") is None and gram_counts(" 1_") is None
    assert gram_counts("a").sum() == 3
