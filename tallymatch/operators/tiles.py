"""Matching by bitmaps, for results that are a large share of all pairs: a join would look at each pair of them on its own.

A leaf tells few values of probes and few states of IDs apart. Spark decides once which go together, by the leaf's own condition;
then a batch of probes has one bitmap for each state, and an ID's matches are the conjunction of its leaves' bitmaps. Orders of
numbers that take many values have a bitmap for each place in the batch's order. IDs are taken in tiles, so that a task holds
TILE pairs at once.

A batch's probes are put in the order of what the leaves read, so an ID matches many in a row. Runs of WHOLE words come before what
is left of them, all IDs of a tile that match a run one after the other: a columnar file has an ID once a run, and the same probes
again and again at the same bits of a byte.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compile import Part
from ..plans.tables import BROADCAST_ROWS, forget, snapshot

if TYPE_CHECKING:
    from .index import RuleIndex

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # matching asks no executor to have this package
#: Values of a probe's field and states of an ID that a leaf may tell apart, and pairs of these that reach the driver.
KINDS, TRUTHS = 1024, 2**18
#: Share of all pairs, as the leaves' own shares let expect it, from which on bitmaps are used.
SHARE = 1 / 500
#: Probes of a batch, pairs that a task holds as bits at once, and rows handed on at once.
BATCH, TILE, ROWS = 2**13, 2**21, 2**14
#: Words of 64 probes that an ID's results are cut to, as long as it matches all of them.
WHOLE, ALL = (4, 1), np.uint64(2**64 - 1)
#: Tiles whose runs are handed on together, before what is left of each: a file's page then has fewer runs of probes.
TOGETHER = 4
#: Broadcasts of IDs, of BROADCAST_ROWS each, and so the most IDs that reach the driver (one broadcast at a time).
BLOCKS = 8
_PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double", "string", "boolean", "date", "binary")
_NUMBERS = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "double", "double": "double"}


def _state(index: RuleIndex, p: Part) -> list[str]:
    """What the part's condition reads of an ID."""
    return [c for c in index.ids.columns if c.startswith(f"{p.r}_")]


def _sorts(index: RuleIndex, asked: DataFrame, p: Part) -> str | None:
    """The type in which an order's two sides compare as numbers do, or None."""
    if p.kind != "order":
        return None
    kinds = {_NUMBERS.get(x.dataType.simpleString()) for x in (asked.schema[p.q], index.ids.schema[f"{p.r}_end"])}
    return kinds.pop() if len(kinds) == 1 else None


def _kinds(df: DataFrame, groups: list[list[str]]) -> DataFrame:
    """For each group g of columns (__g) its distinct values, numbered (__k), and their rows (__rows); the other columns are null."""
    names = [c for g in groups for c in g]
    sets = df.select(*names).groupingSets([[F.col(c) for c in g] for g in groups], *[F.col(c) for c in names]).agg(F.grouping_id().alias("__gid"), F.count("*").alias("__rows"))
    given = lambda g: sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in g)
    number = F.coalesce(*[F.when(F.col("__gid") == given(g), F.lit(i)) for i, g in enumerate(groups)])
    place = F.row_number().over(Window.partitionBy("__g").orderBy(*names)) - 1
    return snapshot(sets.withColumn("__g", number).drop("__gid").withColumn("__k", place), "kinds")


def _numbered(df: DataFrame, kinds: DataFrame, groups: list[list[str]], name: str) -> DataFrame:
    """df with the number of its values in each group, as <name><g>."""
    for g, cols in enumerate(groups):
        own = kinds.where(F.col("__g") == g).select(*[F.col(c).alias(f"__of_{c}") for c in cols], F.col("__k").alias(f"{name}{g}"))
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in cols])
        df = df.join(F.broadcast(own), on, "left").drop(*[f"__of_{c}" for c in cols])
    return df


def match(index: RuleIndex, asked: DataFrame, names: list[str], id_name: str, ord_name: str, distinct: list[int]) -> DataFrame | None:
    """The probes' columns (names) with the IDs that match and their places, or None where bitmaps do not serve.

    asked: probes with what each leaf reads of them; distinct: about how many values each leaf's field takes. IDs reach the driver
    as an ID, its place and a number for each leaf, as many at once as one broadcast may hold (BROADCAST_ROWS).
    """
    parts = [p for p in index.compiled.parts if p.n not in index.dropped]
    plain = lambda c, schema: schema[c].dataType.simpleString() in _PLAIN
    if not parts or any(p.optional or p.kind == "presence" for p in parts) or not all(plain(c, asked.schema) for c in names) or not plain("rule_id", index.ids.schema):
        return None
    states = {p.n: _state(index, p) for p in parts}
    if sum(map(len, states.values())) > 60:  # columns of one grouping ID
        return None
    n, *told = index.ids.agg(F.count("*"), *[F.approx_count_distinct(F.xxhash64(*states[p.n])) for p in parts]).first()
    many = [p for p, s in zip(parts, told, strict=True) if max(s, distinct[p.n]) > KINDS * 9 // 10]
    few = [p for p in parts if p not in many]
    if n > BLOCKS * BROADCAST_ROWS or any(_sorts(index, asked, p) is None for p in many):
        return None
    values, of_ids, truths, share = None, None, [], 0.5 ** len(many)
    probes, rules = asked, index.ids
    if few:
        values, of_ids = _kinds(asked, [[p.q] for p in few]), _kinds(index.ids, [states[p.n] for p in few])
        counts = [{(r[0], r[1]): r[2] for r in df.select("__g", "__k", "__rows").collect()} for df in (values, of_ids)]
        size = [[1 + max((k for g, k in c if g == i), default=-1) for i in range(len(few))] for c in counts]
        if any(v > KINDS or s > KINDS or v * s > TRUTHS for v, s in zip(*size, strict=True)):
            many, few = None, []
    if few:
        pairs = []
        for i, p in enumerate(few):
            v, s = (df.where(F.col("__g") == i) for df in (values, of_ids))
            v, s = v.select(p.q, F.col("__k").alias("__v")), s.select(*states[p.n], F.col("__k").alias("__s"))
            pairs.append(s.join(F.broadcast(v), p.condition()).select(F.lit(i).alias("__g"), "__s", "__v"))
        held = reduce(DataFrame.unionAll, pairs).toArrow()
        g, s, v = (held.column(c).to_numpy() for c in ("__g", "__s", "__v"))
        for i in range(len(few)):
            truth = np.zeros((size[1][i], size[0][i]), bool)
            truth[s[g == i], v[g == i]] = True
            weights = [np.array([c[i, k] for k in range(truth.shape[a])], float) for c, a in ((counts[1], 0), (counts[0], 1))]
            share *= weights[0] @ truth @ weights[1] / max(1.0, weights[0].sum() * weights[1].sum())
            truths.append(truth)
    if many is None or share < SHARE:
        for df in (values, of_ids):
            if df is not None:
                forget(df)
        return None
    if few:
        probes, rules = _numbered(asked, values, [[p.q] for p in few], "__v"), _numbered(rules, of_ids, [states[p.n] for p in few], "__s")
    kind = {p.n: _sorts(index, asked, p) for p in many}
    read = [F.col(f"`{c}`") for c in names] + [F.col(f"__v{i}") for i in range(len(few))] + [F.col(p.q).cast(kind[p.n]) for p in many]
    ends: list[Column] = [F.when(~F.col(f"{p.r}_any"), F.col(f"{p.r}_end").cast(kind[p.n])).alias(f"__e{i}") for i, p in enumerate(many)]
    own = rules.select("rule_id", "rule_ord", *[f"__s{i}" for i in range(len(few))], *ends)
    blocks = -(-n // BROADCAST_ROWS)
    if blocks > 1:  # read once for all blocks
        own = snapshot(own.withColumn("__block", F.pmod(F.xxhash64("rule_ord"), F.lit(blocks)).cast("int")), "blocks")
    shared = [_shared(own.where(F.col("__block") == b).drop("__block") if blocks > 1 else own, truths, [p.op for p in many]) for b in range(max(1, blocks))]
    for df in (of_ids, own if blocks > 1 else None):
        if df is not None:
            forget(df)
    schema = T.StructType([*[asked.schema[c] for c in names], T.StructField(id_name, index.ids.schema["rule_id"].dataType), T.StructField(ord_name, T.LongType())])
    return probes.select(*[c.alias(f"c{i}") for i, c in enumerate(read)]).mapInArrow(_matches(shared, len(names), BATCH, TILE, ROWS, WHOLE), schema)


def _shared(own: DataFrame, truths: list[np.ndarray], ops: list[str]) -> Broadcast:
    """IDs, in a broadcast: own has an ID, its place, its state of each of truths and its end of each of ops."""
    spark, own = own.sparkSession, own.orderBy("rule_ord").toArrow().combine_chunks()
    table = {
        "ids": own.column("rule_id").combine_chunks(), "ords": own.column("rule_ord").combine_chunks(),
        "few": [(truth, own.column(f"__s{i}").to_numpy().astype(np.int32)) for i, truth in enumerate(truths)],
        "many": [(op, *_numbers(own.column(f"__e{i}").combine_chunks())) for i, op in enumerate(ops)],
    }
    return spark.sparkContext.broadcast(table)


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, with 0 for nulls, and which there are."""
    there = values.is_valid().to_numpy(zero_copy_only=False)
    return values.fill_null(0).to_numpy(zero_copy_only=False), there


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of most, and a last one."""
    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= most:
            full = pa.concat_batches(held)
            yield from (full.slice(a, most) for a in range(0, rows - most + 1, most))
            held, rows = [full.slice(rows - rows % most)], rows % most
    if rows:
        yield pa.concat_batches(held)


def _matches(shared: list, width: int, most: int, tile: int, rows: int, whole: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, most):
            batch = batch.take(pa.array(np.lexsort([k for c in reversed(batch.columns[width:]) for k in _numbers(c)])))
            for block in shared:
                yield from one(block.value, batch)

    def one(rules: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shift = max(6, (batch.num_rows - 1).bit_length())
        bitmaps = []  # of each leaf: a row of bits for each state or place, and that of each ID
        for (truth, state), values in zip(rules["few"], batch.columns[width:], strict=False):
            if values.null_count:
                raise ValueError("the probes have changed since they were counted")
            bits = np.zeros((len(truth), 1 << shift), bool)
            bits[:, : batch.num_rows] = truth[:, values.to_numpy()]
            bitmaps.append((np.packbits(bits, axis=1, bitorder="little").view(np.uint64), state))
        for (op, end, strict), values in zip(rules["many"], batch.columns[width + len(rules["few"]) :], strict=True):
            bitmaps.append(_places(op, end, strict, *_numbers(values), shift))
        names, kinds = [f"c{i}" for i in range(width + 2)], len(rules["ords"])
        step = max(1, tile >> shift)

        def pairs(rule: np.ndarray, probe: np.ndarray) -> pa.RecordBatch:
            rule, probe = pa.array(rule), pa.array(probe)
            return pa.RecordBatch.from_arrays([*[c.take(probe) for c in batch.columns[:width]], rules["ids"].take(rule), rules["ords"].take(rule)], names=names)

        for a in range(0, kinds, TOGETHER * step):
            held = reduce(np.bitwise_and, (bits.take(at[a : a + TOGETHER * step], axis=0) for bits, at in bitmaps))
            for words in whole:
                if held.shape[1] % words == 0:
                    runs = held.reshape(len(held), -1, words)
                    full = (runs == ALL).all(axis=2)
                    run, rule = np.nonzero(full.T)
                    runs[full] = 0
                    n = 64 * words
                    for b in range(0, len(run), part := max(1, rows // n)):
                        yield pairs(np.repeat(rule[b : b + part] + a, n), (run[b : b + part, None] * n + np.arange(n)).reshape(-1))
            for c in range(0, len(held), step):
                left = held[c : c + step].view(np.uint8).reshape(-1)
                full = np.flatnonzero(left != 0)
                bit = np.flatnonzero(np.unpackbits(left[full], bitorder="little").view(bool))
                found = (full[bit >> 3] << 3) + (bit & 7)
                for b in range(0, len(found), rows):
                    yield pairs((found[b : b + rows] >> shift) + a + c, found[b : b + rows] & ((1 << shift) - 1))

    return run


def _places(op: str, end: np.ndarray, strict: np.ndarray, values: np.ndarray, there: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """An order's bitmaps for each place in the order of the batch's values, and each ID's: the probes from it on, or up to it.

    The last is for IDs that every probe passes. NaN is the greatest to NumPy's sort, as to Spark.
    """
    at = np.flatnonzero(there)
    at = at[np.argsort(values[at], kind="stable")]
    n = len(at)
    bits = np.zeros((n + 2, 1 << (shift - 3)), np.uint8)
    up = op in (">=", ">")
    bits[np.arange(n) + (not up), at >> 3] = 1 << (at & 7)
    words = bits.view(np.uint64)
    run = words[n::-1] if up else words[: n + 1]
    np.bitwise_or.accumulate(run, axis=0, out=run)
    bits[n + 1] = np.packbits(np.arange(1 << shift) < len(values), bitorder="little")
    place = np.searchsorted(values[at], end, side="left" if op in (">=", "<") else "right")
    return words, np.where(strict, place, n + 1)
