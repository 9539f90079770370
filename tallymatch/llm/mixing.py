"""Mixing sources to target weights: fixed-length blocks, multinomial draws per output shard, pseudorandom permutations.

The words of a source form one stream (documents in the order of running_sums), cut into blocks of a fixed length. Each output
shard draws by a multinomial how many of its slots each source gets. The slots of a source are numbered through all shards;
slot k takes the block that the source's permutation of pass k // blocks (a keyed Feistel network walked into range) gives to
k % blocks, so a pass takes every block once. Draws beyond a source's target are void and what the draws left open goes to
closing shards, and the last slot is cut, so a source gives its target to the word. Slots and blocks meet by (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import columns, forget, running_sums, small, sums_before, table
from .shingles import mix

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Size classes of an octave that the remainders of documents are given out by, and what one copy counts in their sums.
CLASSES, ONE = 16, 1 << 24
#: Words of a block, and slots of an output shard.
BLOCK, SLOTS, SEED = 512, 4096, 20240611
_U = np.uint64


class Source(NamedTuple):
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    cut: int  # words that the last slot takes


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares share * sum(sizes) by weight (repeating); a target stops at most * size, and the excess is dealt again by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    rest = min(share, most) * sum(sizes)
    while left:
        unit = rest / sum(weight[i] for i in left)
        full = [i for i in left if unit * weight[i] > most * sizes[i]]
        if not full:
            for i in left:
                out[i] = unit * weight[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            rest -= out[i]
        left = [i for i in left if i not in set(full)]
    return out


def permute(j: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each key, or its inverse: four Feistel rounds, repeated until in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (_U(1) << half) - _U(1)
    out, todo = j.astype(np.uint64), np.ones(len(j), bool)
    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            if back:
                left, right = right ^ (mix(left + k + _U(r * 0x9E3779B97F4A7C15 % 2**64)) & m), left
            else:
                left, right = right, left ^ (mix(right + k + _U(r * 0x9E3779B97F4A7C15 % 2**64)) & m)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= n[todo].astype(np.uint64)
    return out.astype(np.int64)


def _key(source: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(source.astype(np.uint64) + _U(seed)) + turn.astype(np.uint64))


def plan(names: list[str | None], sizes: list[int], block: int, seed: int, weights=WEIGHTS, share=SHARE, most=MOST) -> list[Source]:
    out = []
    for i, (name, size, target) in enumerate(zip(names, sizes, targets(sizes, weights, share, most), strict=True)):
        blocks, words = -(-size // block), round(target)
        turns, rest = divmod(words, size) if size else (0, 0)
        slots, cut = turns * blocks, size - (blocks - 1) * block
        if rest:
            short = block - (size - (blocks - 1) * block)
            one = lambda x: np.array([x])
            at = int(permute(one(blocks - 1), one(blocks), _key(one(i), one(turns), seed), back=True)[0])
            more = -(-rest // block)
            more += at < more and more * block - short < rest
            before = (more - 1) * block - short * (at < more - 1)
            slots, cut = slots + more, rest - before
        elif turns:
            at = int(permute(np.array([blocks - 1]), np.array([blocks]), _key(np.array([i]), np.array([turns - 1]), seed))[0])
            cut = block if at != blocks - 1 else cut
        out.append(Source(name, size, target, blocks, slots, cut))
    return out


def _draw(sources, slots: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = sources.value["slots"] / max(sources.value["slots"].sum(), 1)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(slots, share)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["shard", "sid", "n"])

    return run


def _slots(sources, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, total, cut = (sources.value[k] for k in ("blocks", "slots", "cut"))
        for batch in batches:
            for shard, sid, a, b in zip(*(batch.column(c).to_pylist() for c in ("shard", "sid", "a", "b")), strict=True):
                k = np.arange(a, b)
                source = np.full(len(k), sid)
                turn, j = np.divmod(k, blocks[sid])
                at = permute(j, blocks[source], _key(source, turn, seed))
                words = np.where(k == total[sid] - 1, cut[sid], 2**31 - 1)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(k), pa.int64()), pa.array(source, pa.int32()), pa.array(k, pa.int64()), pa.array(at, pa.int64()), pa.array(words, pa.int64())], names=["shard", "sid", "slot", "block", "words"])

    return run


def slots_of(spark, sources: list[Source], slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, sid, slot, block, words): which block each slot of each output shard takes, and how many words of it at most."""
    shards = -(-sum(s.slots for s in sources) // slots)
    arrays = spark.sparkContext.broadcast({k: np.array([getattr(s, k) for s in sources], np.int64) for k in ("blocks", "slots", "cut")})  # three numbers a source
    drawn = table(spark.range(shards).mapInArrow(_draw(arrays, slots, seed), "shard long, sid int, n long"), "draws")
    drawn = sums_before(drawn, ["sid"], "shard", ["n"]).select("shard", "sid", F.col("before_n").alias("a"), (F.col("before_n") + F.col("n")).alias("b"))
    quota = small(spark.createDataFrame([(i, s.slots) for i, s in enumerate(sources) if s.slots], "qid int, quota long"))
    runs = drawn.join(quota, F.col("sid") == F.col("qid")).select("shard", "sid", "a", F.least("b", "quota").alias("b")).where("a < b")
    most = drawn.groupBy("sid").agg(F.max("b").alias("most"))
    rest = quota.join(most, F.col("sid") == F.col("qid"), "left").withColumn("a", F.coalesce("most", F.lit(0))).where("a < quota")
    rest = rest.withColumn("a", F.explode(F.expr(f"sequence(a, quota - 1, {slots}L)"))).select((shards + F.floor(F.col("a") / slots)).alias("shard"), F.col("qid").alias("sid"), "a", F.least(F.col("a") + slots, "quota").alias("b"))
    return runs.union(rest).mapInArrow(_slots(arrays, seed), "shard long, sid int, slot long, block long, words long")


def _taken(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """What mix_sources returns, and sid and source."""
    spark = documents.sparkSession
    docs = columns(documents, "doc_id", "source", "text")
    counted = sized = table(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size")), "sizes")
    totals = sorted(((r[0], r[1]) for r in sized.groupBy("source").agg(F.sum("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sources = plan([t[0] for t in totals], [t[1] for t in totals], block, seed, weights, share, most)
    ids = spark.createDataFrame([(i, s.name, s.size, s.target) for i, s in enumerate(sources)], "sid int, name string, source_size long, target double")
    sized = sized.join(small(ids), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    if not sum(s.slots for s in sources):
        return sized.select("sid", "source", "doc_id", "text_hash", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    placed = table(running_sums(sized, ["sid"], F.struct("doc_id", "text_hash"), ["size"]), "placed")
    forget(counted)
    parts = placed.where("size > 0").select("sid", F.col("before_size").alias("at"), F.col("size").alias("n"))
    parts = parts.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + n - 1) div {block})")))
    parts = parts.select("sid", "at", "block", F.greatest(F.col("at") - F.col("block") * block, F.lit(0)).alias("a"), F.least(F.col("at") + F.col("n") - F.col("block") * block, F.lit(block)).alias("b"))
    met = slots_of(spark, sources, slots, seed).withColumnsRenamed({"sid": "s", "block": "k"})
    met = met.join(parts, (F.col("s") == F.col("sid")) & (F.col("k") == F.col("block")))
    taken = met.groupBy("sid", "at").agg(F.sum(F.greatest(F.least("b", "words") - F.col("a"), F.lit(0))).alias("got")).withColumnsRenamed({"sid": "__sid", "at": "__at"})
    out = placed.join(taken, (F.col("sid") == F.col("__sid")) & (F.col("before_size") == F.col("__at")) & (F.col("size") > 0), "left")
    return out.select("sid", "source", "doc_id", "text_hash", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def mix_sources(documents: DataFrame, **options) -> DataFrame:
    """How many words of each document the mix takes, repeats counted, and text_hash to tell rows of one doc_id apart.

    Returns doc_id, text_hash, size (words of the text; a null text has none), source_size, target (of the source) and taken,
    one row per row of documents. Sources are taken by code point, null last. A source's taken words sum up to its rounded
    target, no document's exceed most (a whole number) times its size, and a rerun takes the same. Rows without words take
    nothing, and an empty table gives no rows. The names and totals of the sources (one row each) are the driver's only data:
    targets depend on all of them at once. Tasks get three numbers a source.
    """
    return _taken(documents, **options).drop("sid", "source")


def _copies(taken: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, text_hash, times, more): the copies of each row, and how many of the rows that agree in these get one more.

    Whole multiples of a document's size stay; the remainders, as parts of a copy, are summed up along the source, from the
    longest size class to the shortest and in hashed order in each, and a copy goes to the row in which the sum (which starts at
    a hashed part of a copy) passes a whole number. So each row gets its part on average, whatever its size, and since sizes
    fall along the sum, the words of a source miss its target by about one document at most.
    """
    rows = taken.groupBy("sid", "source", "doc_id", "text_hash", "size").agg(F.sum("taken").alias("got"), F.count("*").alias("rows"))
    rows = rows.withColumn("times", F.when(F.col("size") > 0, F.expr("got div (size * rows)")).otherwise(1))
    rows = rows.withColumn("part", F.when(F.col("size") > 0, F.round((F.col("got") - F.col("times") * F.col("size") * F.col("rows")) / F.col("size") * ONE)).otherwise(0).cast("long"))
    rows = table(rows.withColumn("class", F.floor(F.log2("size") * CLASSES)), "parts")
    placed = table(running_sums(rows.where("part > 0"), ["sid", "class"], F.struct("doc_id", "text_hash"), ["part"]), "parts")
    longer = Window.partitionBy("sid").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.pmod(F.xxhash64("sid", F.lit(seed)), F.lit(ONE))
    base = placed.groupBy("sid", "class").agg(F.sum("part").alias("all")).select(F.col("sid").alias("__sid"), F.col("class").alias("__class"), (F.coalesce(F.sum("all").over(longer), F.lit(0)) + start).alias("base"))
    placed = placed.join(small(table(base, "classes")), (F.col("sid") == F.col("__sid")) & (F.col("class") == F.col("__class"))).withColumn("at", F.col("base") + F.col("before_part"))
    placed = placed.withColumn("more", F.expr(f"(at + part) div {ONE} - at div {ONE}"))
    out = placed.select("source", "doc_id", "text_hash", "rows", "times", "more").union(rows.where("part = 0").select("source", "doc_id", "text_hash", "rows", "times", F.lit(0).cast("long")))
    all_rows = F.col("more") >= F.col("rows")
    out = out.select("source", "doc_id", "text_hash", (F.col("times") + F.when(all_rows, 1).otherwise(0)).cast("int").alias("times"), F.when(all_rows, 0).otherwise(F.col("more")).alias("more"))
    return out.where("times > 0 or more > 0")


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """The rows of documents, each as often as the mix takes its words: so some repeat and some go.

    A row stays floor(taken / size) times, and the remainders of a source are given out as whole copies (see _copies): without
    regard to length, and up to the source's target. Rows without words hold nothing to mix and stay once.
    """
    taken = _copies(_taken(documents, **options), options.get("seed", SEED))
    taken = table(taken.select(F.col("source").alias("__source"), F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("times").alias("__times"), F.col("more").alias("__more")), "taken")
    source = documents["source"] if "source" in documents.columns else F.lit(None).cast("string")
    joined = documents.join(small(taken), documents["doc_id"].eqNullSafe(F.col("__id")) & source.eqNullSafe(F.col("__source")) & (F.xxhash64(documents["text"]) == F.col("__hash")))
    out = joined.where("__more = 0")
    if not taken.where("__more > 0").isEmpty():  # rows that repeat doc_id, source and text, of which some get a copy more
        others = [documents[c] for c, kind in documents.dtypes if c != "text" and "map<" not in kind and "variant" not in kind]
        rank = F.row_number().over(Window.partitionBy("__source", "__id", "__hash").orderBy(F.xxhash64(*others)))
        out = out.union(joined.where("__more > 0").withColumn("__times", F.col("__times") + F.when(rank <= F.col("__more"), 1).otherwise(0)).where("__times > 0"))
    return out.withColumn("__copy", F.explode(F.expr("sequence(1, __times)"))).select(*[F.col(f"`{c}`") for c in documents.columns])
