"""Order MinHash fingerprints, in DataFrame functions alone.

A text's units are its runs of non-space characters, cut after UNIT characters; its k-mers are K units in a row, hashed and
numbered by occurrence (the n-th equal k-mer hashes to something else). The numbered hashes fall into 2^BITS sketches by their
leading bits, so one pass serves all sketches. Each sketch selects its two smallest, puts them back in text order and hashes
that tuple: moving text changes the tuples as much as changing it. A fingerprint lists the tuples of the sketches that have
k-mers; the likeness of two fingerprints is the share of equal tuples among the sketches that either has.

A limit: units are counted from the start of their run, so in a run of over UNIT characters (text without spaces, as Chinese,
Japanese or Thai) an inserted or deleted character shifts all later units of the run, and near copies look unlike.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, partitions

UNIT, K, BITS = 16, 3, 6
#: Bits of a k-mer's place in the text: as many as an array has elements. The rest of the long is its hash.
PLACE = 31
#: Rows of one id beyond which they are dealt to several buckets.
HEAVY = 50_000
_MASK = 2**PLACE - 1
_STEPS = [2**i for i in range(31, -1, -1)]


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of a column of non-null texts as an array of longs; a text without units has none."""
    n = lambda name: f"__{out}_{name}"
    get, shift, mask = F.get, F.shiftright, F.lit(_MASK).cast("long")

    def occurrence(s: Column, x: Column, i: Column) -> Column:
        """How many equal k-mers precede in the sorted array: by binary search, where the one before is equal at all."""
        same = lambda j: F.coalesce(shift(get(s, j), PLACE) == shift(x, PLACE), F.lit(False))
        far = F.aggregate(F.array(*[F.lit(v).cast("long") for v in _STEPS]), F.lit(0).cast("long"), lambda acc, step: F.when((i - acc - step >= 0) & same((i - acc - step).cast("int")), acc + step).otherwise(acc))
        return F.when((i > 0) & same(i - 1), far).otherwise(F.lit(0).cast("long"))

    df = df.withColumn(n("u"), F.regexp_extract_all(text, F.lit(rf"\S{{1,{UNIT}}}"), F.lit(0)))
    u = F.col(n("u"))
    at = F.when(F.size(u) > 0, F.sequence(F.lit(0), F.greatest(F.size(u) - K, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(n("s"), F.sort_array(F.transform(at, lambda i: F.xxhash64(*[get(u, i + j) for j in range(K)]).bitwiseAND(F.lit(~_MASK).cast("long")).bitwiseOR(i.cast("long").bitwiseAND(mask)))))
    s = F.col(n("s"))
    df = df.withColumn(n("r"), F.sort_array(F.transform(s, lambda x, i: F.xxhash64(shift(x, PLACE), occurrence(s, x, i)).bitwiseAND(F.lit(~_MASK).cast("long")).bitwiseOR(x.bitwiseAND(mask)))))
    r = F.col(n("r"))
    sketch = lambda x: shift(x, 64 - BITS)
    first = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | (sketch(get(r, i - 1)) != sketch(get(r, i))))
    first = F.when(F.size(r) > 0, first).otherwise(F.array().cast("array<int>"))

    def tuple_of(i: Column) -> Column:
        a, b = get(r, i), get(r, i + 1)
        value = lambda x: shift(x, PLACE)
        pair = F.when(a.bitwiseAND(mask) < b.bitwiseAND(mask), F.xxhash64(value(a), value(b))).otherwise(F.xxhash64(value(b), value(a)))
        both = F.when(F.coalesce(sketch(a) == sketch(b), F.lit(False)), pair).otherwise(F.xxhash64(value(a)))
        low = F.lit(2**32 - 1).cast("long")
        return F.shiftleft((sketch(a) + F.lit(2 ** (BITS - 1))).cast("long"), 32).bitwiseOR(both.bitwiseAND(low))

    return df.withColumn(out, F.transform(first, tuple_of)).drop(n("u"), n("s"), n("r"))



def likeness(a: Column, b: Column) -> Column:
    """Equal tuples by sketches that either has; 1 if neither has any."""
    sketches = lambda x: F.transform(x, lambda v: F.shiftright(v, 32))
    either = F.size(F.array_union(sketches(a), sketches(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def shown(a: Column) -> Column:
    """A fingerprint as text: ten hexadecimal digits a tuple, the first two its sketch."""
    return F.array_join(F.transform(a, lambda v: F.lpad(F.lower(F.hex(v)), 10, "0")), "")


def with_next(df: DataFrame, id_col: str, text: str, prepare: Callable[[DataFrame], DataFrame], values: list[str]) -> DataFrame:
    """prepare(df) with next_<value>: the value in the row that follows by descending id (nulls last, then by the text's hash, then text), after the last the first.

    Rows are dealt by quantiles of the id to four buckets a shuffle partition (so that partitions get alike shares); a bucket of
    one id with more than HEAVY rows is cut by ranges of the hash. Each bucket gets a copy of the first row of the one after it;
    so no window spans the table or an id. Only an id and a hash for each bucket reach the driver. prepare adds the values to
    rows of id and text, copies included, so each row is prepared once.
    """
    spark, key = df.sparkSession, F.col(id_col)
    n = 4 * partitions(spark)
    found = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(found) | {b - 1 for b in found if found.count(b) > 1 and b > -(2**63)})  # an id that fills buckets gets one of its own
    by = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    steps = F.array(*[F.lit(s) for s in _STEPS if 0 < s <= max(len(bounds), 1)])
    below = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(bounds)) & (F.get(by, p + s - 1) < key), p + s).otherwise(p))
    df = df.withColumn("__bucket", F.when(key.isNull(), F.lit(0)).otherwise(below + 1).cast("long"))
    seen = df.groupBy("__bucket").agg(F.count("*").alias("n"), F.min(id_col).alias("low"), F.max(id_col).alias("top")).collect()
    bits = {r["__bucket"]: min(16, math.ceil(math.log2(r["n"] / HEAVY))) for r in seen if r["n"] > HEAVY and r["low"] == r["top"]}
    tops = {(r["__bucket"] << 16): (r["top"], None) for r in seen}
    mixed, cut = F.xxhash64(F.col(text), F.lit(1)), F.col("__bucket") * F.lit(1 << 16)
    if bits:
        width = F.get(F.array(*[F.lit(bits.get(b, 0)) for b in range(len(bounds) + 2)]), F.col("__bucket").cast("int"))
        df = df.withColumn("__bucket", cut + F.when(width > 0, F.call_function("shiftright", mixed, 64 - width) + F.call_function("shiftleft", F.lit(1).cast("long"), width - 1)).otherwise(0))
        heavy = df.where(F.shiftright("__bucket", 16).isin(list(bits))).groupBy("__bucket").agg(F.max(id_col), F.max(mixed)).collect()
        tops = {b: t for b, t in tops.items() if b >> 16 not in bits} | {b: (i, h) for b, i, h in heavy}
    else:
        df = df.withColumn("__bucket", cut)
    order = sorted(tops, reverse=True)
    follow = [(b, *tops[order[(k + 1) % len(order)]]) for k, b in enumerate(order)]
    after = spark.createDataFrame(follow, "__of long, __top long, __hash long")
    met = key.eqNullSafe(F.col("__top")) & (F.col("__hash").isNull() | (mixed == F.col("__hash")))
    heads = df.select(id_col, text).join(F.broadcast(after), met)
    heads = heads.groupBy(F.col("__of").alias("__bucket")).agg(F.max(F.struct(mixed.alias("h"), F.col(text).alias("t"))).alias("h")).select("__bucket", F.lit(None).cast("long").alias(id_col), F.col("h.t").alias(text))
    rows = prepare(df.withColumn("__head", F.lit(0)).unionByName(heads.withColumn("__head", F.lit(1)), allowMissingColumns=True))
    w = Window.partitionBy("__bucket").orderBy("__head", key.desc_nulls_last(), mixed.desc(), F.col(text).desc())
    return rows.withColumns({f"next_{v}": F.lead(v).over(w) for v in values}).where("__head = 0").drop("__bucket", "__head")


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edit: the last third of its code points replaced by the next document's first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (text), near_edited and near_next, one row per row
    of documents. A null text counts as empty; a text without non-space characters has an empty fingerprint, alike (1.0) only
    another of these. Rows that repeat a doc_id follow each other by a hash of their text; null ids come last. A lone row is its
    own next. Other columns are ignored; an empty table gives no rows.
    """
    docs = columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, "doc_id", "text", lambda rows: with_fingerprint(rows, "text", "tuples"), ["text", "tuples"])
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("__cut", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("__cut")).cast("int")), F.substring("next_text", F.lit(1), F.col("__cut")))
    docs = with_fingerprint(docs.withColumn("__edited", edited), "__edited", "edited_tuples")
    return docs.select(
        "doc_id", "n_chars", F.sha2(F.col("__edited"), 256).alias("edited_sha256"), shown(F.col("tuples")).alias("fingerprint"), shown(F.col("edited_tuples")).alias("edited_fingerprint"),
        likeness(F.col("tuples"), F.col("edited_tuples")).alias("near_edited"), likeness(F.col("tuples"), F.col("next_tuples")).alias("near_next"),
    )
