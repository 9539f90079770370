from tallymatch import All, Exclude, GreaterOrEqual, Include, RuleSchema, match_batches, match_stream, zip_rules
from tallymatch.operators import schema as schema_module

FIELDS = "a int, m int, x int"


def probes_at(spark, tmp_path):
    path = str(tmp_path / "probes")
    spark.range(300).selectExpr("id", "CAST(id % 7 AS INT) AS a", "CAST(id % 11 AS INT) AS m", "CAST(id % 5 AS INT) AS x").repartition(3).write.parquet(path)
    return path


def rules(spark, n=60):
    return zip_rules(spark, [(i % 7 or None, i % 11 or None, i % 5 or None) for i in range(n)], [i // 2 for i in range(n)], FIELDS)


def test_stream_equals_batch(spark, tmp_path):
    path = probes_at(spark, tmp_path)
    ix = RuleSchema(All(Include("a"), GreaterOrEqual("m"), Exclude("x"))).build(rules(spark))
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = match_stream(ix, stream).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(map(tuple, ix.match(batch).collect()))
    assert sorted(map(tuple, spark.table("found").collect())) == want and want


def test_batches_serve_wide_sets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(schema_module, "SET_VALUES", 2)
    path = probes_at(spark, tmp_path)
    ix = RuleSchema(All(Include("a"), Exclude("x"))).build(zip_rules(spark, [(i % 7, 0, 9) for i in range(20)], [0] * 20, FIELDS))
    assert ix.wide
    batch = spark.read.parquet(path)
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(batch.schema).parquet(path)
    match_batches(ix, stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ix.match(batch).collect()))
