import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tallymatch.llm import queries
from tallymatch.llm.pieces import SPACE, Pieces, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return Pieces(f.read()), sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(own):
    rng = random.Random(4)
    vocab = list(own.ids)
    some = [*"  aeot\n\n.,=-*#/1é中\x00ﬁ<>&'$%", SPACE, "the", "ing", " a", SPACE * 2, "  ", "--"]
    for _ in range(4000):
        yield "".join(rng.choice(some) for _ in range(rng.randint(0, 60)))
        yield "".join(rng.choice(vocab) for _ in range(rng.randint(1, 6)))
        yield "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(20))
    for k in range(40):
        for x in ("", "a", "\x00", "中b", "$$$"):
            yield " " * k + x
    yield from ("x" * 100_000, "ab" * 50_000, " " * 20_000, "</s> <s> <unk> <0x0A>")


def test_same_ids_and_text_as_the_library(both):
    own, lib = both
    for t in texts(own):
        ids = own.encode(t)
        want = lib.encode(t)
        assert ids == want, t[:80]
        assert own.decode(ids) == lib.decode(want)


def test_query_against_the_library(spark, sf, both):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for i, t in queries.read(spark, sf, "documents").select("doc_id", "text").collect():
        ids = [*both[1].encode(t or ""), 2]
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(both[1].decode(ids))))
    assert {tuple(r) for r in queries.op4_sentencepiece(spark, sf).collect()} == want


def test_null_empty_repeats_and_ids(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "a b", 5), (None, "a b", 5)], "doc_id long, text string, n_tokens int")
    rows = encode_documents(df, PATH, ids=True).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], tuple(r["ids"])) for r in rows) == [("1", 1, (2,)), ("1", 1, (2,)), ("None", 3, (264, 287, 2)), ("None", 3, (264, 287, 2))]
    assert encode_documents(df.limit(0), PATH).collect() == []
