import corpus_pipeline as pipeline
import public_tokenizers
import sentencepiece

from tallymatch.llm import queries
from tallymatch.llm.mixing import targets
from tallymatch.llm.toxicity import train

from . import test_op3, test_op9


def stages(spark, docs, sf_dir):
    out = []
    for _, stage in pipeline.STAGES:
        docs = pipeline.table(stage(spark, docs, sf_dir), "stage")
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, sf):
    docs = queries.read(spark, sf, "documents")
    clean, lines, lone, mixed, ids = stages(spark, docs, sf)
    assert all(x.columns == docs.columns for x in (clean, lines, lone, mixed))

    model = train(docs, queries.read(spark, sf, "labels"))
    keep = {r["doc_id"] for r in docs.collect() if model.severity(r["text"])[1][0] < 0.5}
    assert {r["doc_id"] for r in clean.collect()} == keep and len(keep) < docs.count()

    want = {i: t for i, t, _, _ in test_op9.brute([(r["doc_id"], r["text"]) for r in clean.collect()], 40, 5)}
    got = lines.collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)

    classes = test_op3.brute([(r["doc_id"], r["text"]) for r in got], 5, 4, 5)
    assert sorted(r["doc_id"] for r in lone.collect()) == sorted(i for i, _, c in classes if i == c)

    size = {r["doc_id"]: (r["source"], len(test_op3.words(r["text"]))) for r in lone.collect()}
    names = sorted({s for s, _ in size.values()})
    total = [sum(n for s, n in size.values() if s == name) for name in names]
    rows = mixed.collect()
    times = {i: sum(r["doc_id"] == i for r in rows) for i in size}
    assert {r["doc_id"] for r in rows} <= set(size) and max(times.values()) <= 2
    for name, target, own in zip(names, targets(total), total, strict=True):
        took = sum(times[i] * n for i, (s, n) in size.items() if s == name)
        assert abs(took - target) <= max(n for s, n in size.values() if s == name) + 0.1 * own

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pipeline.MODEL))
    texts = {r["doc_id"]: r["text"] for r in rows}
    out = ids.collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in rows)
    assert all(r["ids"] == [*lib.encode(texts[r["doc_id"]]), 2] for r in out)


def test_run_and_odd_rows(spark, sf, tmp_path):
    queries.read(spark, sf, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "w " * 50_000, None, None, 100_000)], queries.read(spark, sf, "documents").schema)
    for docs, n in ((odd, None), (odd.limit(0), 0)):
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = pipeline.run(spark, str(tmp_path)).collect()
        assert n is None or len(got) == n
        assert all(r["ids"][-1] == 2 for r in got)


def test_one_row_of_each_group_stays(spark):
    """Ids that repeat with other texts, with the same text, and with near copies of their own."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(5, a), (9, a + " z"), (5, b), (3, b), (5, c), (5, c), (6, c + " z"), (7, d), (7, d + " z"), (None, a), (1, ""), (1, "")]
    df = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    got = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_copies(spark, df, "").collect()]
    assert [x for x in got if x[0] == 7] in ([(7, d)], [(7, d + " z")])
    assert sorted((x for x in got if x[0] != 7), key=str) == sorted([(5, a), (3, b), (5, c), (None, a), (1, ""), (1, "")], key=str)


def test_columns_of_documents_stay(spark, sf):
    """Columns that are named like what a stage computes pass through."""
    docs = queries.read(spark, sf, "documents").limit(40)
    names = ("toxic", "grade", "severity", "n_lines", "n_dropped", "size", "taken", "component_id", "stage_toxic")
    extra = docs.selectExpr("*", *[f"doc_id * 10 + {k} AS {n}" for k, n in enumerate(names)])
    for _, stage in pipeline.STAGES[:-1]:
        extra = pipeline.table(stage(spark, extra, sf), "stage")
        assert extra.columns == [*docs.columns, *names]
        rows = extra.collect()
        assert rows and all(r[n] == r["doc_id"] * 10 + k for r in rows for k, n in enumerate(names))


def test_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is pipeline.run
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "source_mixing", "sentencepiece"]
