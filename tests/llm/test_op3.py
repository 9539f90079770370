import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from tallymatch.llm import jaccard, queries
from tallymatch.llm.components import components
from tallymatch.llm.jaccard import jaccard_classes
from tallymatch.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def union(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def brute(docs, n, num, den):
    sets = {i: shingles(t, n) for i, t in docs}
    ids, links = list(sets), []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                links.append((a, b))
    root = union(ids, links)
    return {(i, len(sets[i]), root[i]) for i in ids}


def got(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(("n", "t", "block"), [(3, (9, 10), 4096), (5, (4, 5), 4096), (3, (9, 10), 3), (5, (4, 5), 2)])
def test_near_copies_against_brute_force(spark, monkeypatch, n, t, block):
    """Also with columns of more than a few rows split, and with hot shingles salted."""
    if block < 10:
        for name, value in (("BLOCK", block), ("VISITORS", 2), ("HOT", 1), ("WIDE", 3)):
            monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(n)
    vocab = [f"w{i}" for i in range(300)]
    docs, key = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(2, 160))]
        for _ in range(rng.randint(1, 14)):
            copy = [rng.choice(vocab) if rng.random() < rng.choice([0, 0, 0.01, 0.02, 0.05]) else w for w in base]
            docs.append((key := key + rng.randint(1, 3), " ".join(copy)))
    docs += [(key + 1, None), (key + 2, ""), (key + 3, " \t\n"), (key + 4, "One"), (key + 5, "one"), (key + 6, "one two"), (key + 7, "two one"), (key + 8, "ÉTÉ été\x0bx"), (key + 9, "a " * 5000)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, component string, n int")
    assert got(jaccard_classes(df, n, t)) == brute(docs, n, *t)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in queries.read(spark, SF, "documents").select("doc_id", "text").collect()]
    assert got(queries.op3_ngram_jaccard_join(spark, SF)) == brute(docs, 3, 9, 10)


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert got(jaccard_classes(none)) == set()
    twice = spark.createDataFrame([(4, "a b c"), (4, "a b c"), (2, "A b  c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    rows = [tuple(r) for r in jaccard_classes(twice).collect()]
    assert sorted(rows, key=str) == sorted([(4, 1, 2), (4, 1, 2), (2, 1, 2), (None, 1, 2), (None, 0, None)], key=str)


def test_one_id_with_different_texts(spark):
    """Each row links as a document of its own: all texts of the first case share few ids."""
    rng = random.Random(8)
    docs = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 400)}" for _ in range(80)]
        for _ in range(rng.randint(1, 6)):
            docs.append((rng.randint(1, 6), " ".join(base[: rng.randint(76, 80)])))
    sets = [shingles(t, 5) for _, t in docs]
    root = union(range(len(docs)), [(a, b) for a in range(len(docs)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    least = {r: min(i for k, (i, _) in enumerate(docs) if root[k] == r) for r in set(root.values())}
    want = sorted((i, len(sets[k]), least[root[k]]) for k, (i, _) in enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_classes(df, 5, (4, 5)).collect())) == want


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5)]
    root = union({x for e in links for x in e}, links)
    lone = {a for a, b in links} | {b for a, b in links}
    want = {(i, root[i]) for i in lone if any(i in e and e[0] != e[1] for e in links)}
    assert got(components(spark.createDataFrame(links, "src long, dst long"))) == want
    assert got(components(spark.createDataFrame([], "src long, dst long"))) == set()


def test_hashes_agree_with_word_sets():
    texts = ["a b a b a b", "x" * 3_000_000 + " y z", None, "ü ñ É", "Ab aB AB", " "]
    for n in (1, 3):
        sets = list(shingle_sets(pa.array(texts), n))
        assert [len(s) for s in sets] == [len(shingles(t, n)) for t in texts]
    by = defaultdict(set)
    for t in texts[:1] * 2 + ["A b  a\tb a b"]:
        by[next(shingle_sets(pa.array([t]), 3)).tobytes()].add(t)
    assert len(by) == 1


def test_split_columns_give_the_same_pairs(monkeypatch):
    """A column's blocks with visitors, a few visitors at a time, against the column in one piece."""
    import numpy as np

    rng = np.random.default_rng(6)
    names = ["gram", "salt", "away", "doc", "label", "n", "pos", "parity"]
    base = rng.integers(0, 256, 128, dtype=np.uint8)

    def row(doc, salt, away):
        bits = base.copy()
        bits[doc % 5] ^= np.uint8(doc % 7)
        return (7, salt, away, doc, doc % 4 if doc % 3 else 0, 100 + doc % 6, doc % 3, bits.tobytes())

    def pairs(rows, pivots):
        rows = sorted(rows, key=lambda r: r[:3])
        t = pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=names)
        out = [b.to_pylist() for b in jaccard._candidates(9, 10, pivots)(iter(t.to_batches(max_chunksize=11)))]
        return {(r["i"], r["j"]) for b in out for r in b}

    docs = range(200)
    whole = pairs([row(d, 0, False) for d in docs], None)
    monkeypatch.setattr(jaccard, "VISITORS", 5)
    minor = [d for d in docs if row(d, 0, False)[4] != 0]
    dealt = [row(d, s, s != d % 4) for d in docs for s in (range(4) if d in minor else [d % 4])]
    assert pairs(dealt, None) == whole and len(whole) > 1000
    assert pairs([row(d, 0, False) for d in docs], 4) <= whole


def test_block_product_counts_every_overlap(monkeypatch):
    """Overlap counts accumulated by row and column, whole and in small steps; links join what the exact similarities join."""
    import numpy as np

    rng = random.Random(4)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 50))), np.uint64) for _ in range(40)]
    sets += [sets[k] for k in (0, 1, 1, 2)]
    for step in (1 << 21, 5):
        monkeypatch.setattr(jaccard, "CELLS_AT_ONCE", step)
        block = jaccard._RowBlock(dict(enumerate(sets[:15])), 1, 2)
        assert block.product(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets[:15]] for a in sets]
        found = [e for k in range(0, len(sets), 7) for e in block.links(list(range(len(sets)))[k : k + 7], sets[k : k + 7])]
        want = [(a, b) for a in range(len(sets)) for b in range(15) if a != b and 2 * len(np.intersect1d(sets[a], sets[b])) >= len(np.union1d(sets[a], sets[b]))]
        assert set(found) <= set(want) and union(range(len(sets)), found) == union(range(len(sets)), want)


def test_null_ids_link_like_others(spark):
    base = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([(None, " ".join(base)), (3, " ".join(base[:96])), (2, " ".join(base[4:])), (None, "lone text"), (None, "lone text")], "doc_id long, text string")
    # the whole text links with both others, which do not link with each other
    assert sorted(map(tuple, jaccard_classes(df, 5, (19, 20)).collect()), key=str) == sorted([(None, 96, 2), (3, 92, 2), (2, 92, 2), (None, 1, None), (None, 1, None)], key=str)


def test_bitmaps_of_any_widths():
    """Cells that differ are counted at the smaller width, and never exceed the symmetric difference."""
    import numpy as np

    rng = random.Random(3)
    sets = [{rng.randrange(3000) for _ in range(rng.choice((3, 90, 300, 1500)))} for _ in range(40)]

    def parity(own, width):
        bits = np.zeros(width, np.uint8)
        for x in own:
            bits[x * 2654435761 % width] ^= 1
        return bits

    widths = [rng.choice((128, 256, 512, 1024)) for _ in sets]
    maps = jaccard._Bitmaps([np.packbits(parity(s, w)).tobytes() for s, w in zip(sets, widths, strict=True)])
    x, y = (a.ravel() for a in np.meshgrid(np.arange(40), np.arange(40)))
    got = maps.apart(x, y)
    for i, j, d in zip(x.tolist(), y.tolist(), got.tolist(), strict=True):
        w = min(widths[i], widths[j])
        assert d == int((parity(sets[i], w) ^ parity(sets[j], w)).sum()) <= len(sets[i] ^ sets[j])
