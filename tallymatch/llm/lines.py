"""Line dedup: a sharded minimal perfect hash over the distinct hashes of frequent lines, probed by documents.

Lines are counted by a 128-bit hash of their key (stripped, A-Z lower-cased); counts and largest holders combine before the
shuffle, so a line that every document holds costs a row a task. The hashes of lines to drop are dealt to shards; each shard
builds a minimal perfect hash (levels of bit arrays: a key takes a bit that no other key of the level wants) that indexes
compact arrays of 64-bit fingerprints, counts and holders. Documents probe the arrays: in place where a count proves that all
shards fit a fixed broadcast, else by sending each shard the distinct hashes of the documents in bounded groups, as many as its own count of them asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, small, table, thrifty
from .shingles import mix, parts

WHITE = " \t\n\x0b\x0c\r"
#: Keys of a shard; keys that may be broadcast (about 30 bytes each); probes of a group.
SHARD, BROADCAST, GROUP = 100_000, 1_000_000, 500_000
_U = np.uint64
_ARRAYS = "shard int, sizes binary, bits binary, prints binary, counts binary, holders binary"


def line_hash(line: str, least: int) -> tuple[int, int] | None:
    """Two signed 64-bit halves of the hash of the line's key; None if the key has fewer code points."""
    key = line.strip(WHITE)
    if len(key) < least:
        return None
    x = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())
    hi, lo = x >> 64, x & (2**64 - 1)
    return hi - 2**64 if hi >= 2**63 else hi, lo - 2**64 if lo >= 2**63 else lo


class PerfectHash:
    """Maps each of n distinct 64-bit keys to its own index below n; any other key to some index or to -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.ranks = np.r_[0, np.cumsum(np.bitwise_count(bits).astype(np.int64))]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, taken, level = [], [], 0
        while len(keys):
            size = max(64, -(-3 * len(keys) // 2 // 64) * 64)
            slot = cls._slot(keys, level, size)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            taken.append(alone)
            keys, level = keys[~alone[slot]], level + 1
        flat = np.concatenate(taken) if taken else np.empty(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flat, bitorder="little").view(np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self._slot(keys[left], level, size) + self.starts[level]
            word, bit = self.bits[at >> 6], _U(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            out[left[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - _U(1)))
            left = left[~hit]
        return out


class Shard:
    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, holders: bytes):
        self.hash = PerfectHash(np.frombuffer(sizes, np.int64), np.frombuffer(bits, np.uint64))
        self.prints, self.counts, self.holders = np.frombuffer(prints, np.int64), np.frombuffer(counts, np.uint32), np.frombuffer(holders, np.int64)

    def dropped(self, hi: np.ndarray, lo: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
        """Which of the lines must go from which document."""
        at = self.hash.index(hi.view(np.uint64))
        if not len(self.prints):
            return np.zeros(len(hi), bool)
        return (at >= 0) & (self.prints[at] == lo) & (self.counts[at] >= least) & (self.holders[at] != doc)


def _build_shard(t: pa.Table) -> pa.Table:
    hi, lo, n, holder = (t.column(c).to_numpy() for c in ("hi", "lo", "n", "holder"))
    first = np.unique(hi, return_index=True)[1]  # the halves together are the key; two keys with equal first halves go to two rows
    parts = [first, np.setdiff1d(np.arange(len(hi)), first)]
    rows = []
    for part in parts:
        if len(part):
            h = PerfectHash.build(hi[part].view(np.uint64))
            at = h.index(hi[part].view(np.uint64))
            arrays = [np.empty(len(part), k) for k in (np.int64, np.uint32, np.int64)]
            for array, values in zip(arrays, (lo, n, holder), strict=True):
                array[at] = values[part]
            rows.append([t.column("shard")[0].as_py(), h.sizes.tobytes(), h.bits.tobytes(), *[a.tobytes() for a in arrays]])
    kinds = [pa.int32()] + [pa.binary()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "sizes", "bits", "prints", "counts", "holders"])


def _doc(ids: pa.Array) -> list[int]:
    """A null id counts as the smallest."""
    return [-(2**63) if i is None else i for i in ids.to_pylist()]


def _lines(least: int, marked: bool):
    """The distinct long lines of each document, with the document's id or also the hash of its text."""
    names = ["hi", "lo", "doc", *(["mark"] if marked else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in parts(whole, 1)):
            rows: list[tuple[int, ...]] = []
            marks = batch.column("mark").to_pylist() if marked else [0] * batch.num_rows
            for i, text, mark in zip(_doc(batch.column("doc")), batch.column("text").to_pylist(), marks, strict=True):
                own = {h for line in (text or "").split("\n") if (h := line_hash(line, least))}
                rows += [(*h, i, mark)[: len(names)] for h in own]
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 50_000], strict=True)], names=names)

    return run


def _probe(shards: list[tuple], n: int):
    """Loads the shards once a task; then says which of the lines go."""
    loaded: dict[int, list[Shard]] = {}
    for shard, *arrays in shards:
        loaded.setdefault(shard, []).append(Shard(*arrays))

    def dropped(hi: np.ndarray, lo: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
        own = np.mod(hi, n)
        out = np.zeros(len(hi), bool)
        for shard, parts in loaded.items():
            at = np.flatnonzero(own == shard)
            for part in parts if len(at) else []:
                out[at] |= part.dropped(hi[at], lo[at], doc[at], least)
        return out

    return dropped


def _clean(least: int, docs: int, names: list[str], width: int, where: int, doc_at: int, shards=None, n: int = 0):
    """Drops lines: by probing the shards (broadcast), or by the document's own list of hashes in the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _probe(shards.value, n) if shards is not None else None
        for batch in (x for whole in batches for x in parts(whole, where)):
            texts = batch.column(where).to_pylist()
            lines = [(t or "").split("\n") for t in texts]
            found = [(i, k, h) for i, own in enumerate(lines) for k, line in enumerate(own) if (h := line_hash(line, least))]
            gone: list[set[int]] = [set() for _ in texts]
            if probe:
                doc = np.array(_doc(batch.column(doc_at)), np.int64)
                if found:
                    hashes = np.array([h for _, _, h in found], np.int64)
                    which = np.array([i for i, _, _ in found])
                    for x in np.flatnonzero(probe(hashes[:, 0], hashes[:, 1], doc[which], docs)).tolist():
                        gone[found[x][0]].add(found[x][1])
            else:
                lists = [{(x["hi"], x["lo"]) for x in own or []} for own in batch.column(batch.num_columns - 1).to_pylist()]
                for i, k, h in found:
                    if h in lists[i]:
                        gone[i].add(k)
            kept = [t if not g else "\n".join(x for k, x in enumerate(own) if k not in g) for t, own, g in zip(texts, lines, gone, strict=True)]
            cols = [batch.column(k) for k in range(width)]
            cols[where] = pa.array(kept, cols[where].type)
            counts = [pa.array(map(len, x), pa.int64()) for x in (lines, gone)]
            yield pa.RecordBatch.from_arrays([*cols, *counts], names=[*batch.schema.names[:width], *names])

    return run


def _probe_group(least: int):
    def run(arrays: pa.Table, probes: pa.Table) -> pa.Table:
        out = np.zeros(probes.num_rows, bool)
        hi, lo, doc = (probes.column(c).to_numpy() for c in ("hi", "lo", "doc"))
        for row in arrays.select(["sizes", "bits", "prints", "counts", "holders"]).to_pylist() if probes.num_rows else []:
            out |= Shard(*row.values()).dropped(hi, lo, doc, least)
        return probes.select(["doc", "mark", "hi", "lo"]).filter(pa.array(out))

    return run


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_keys: int = BROADCAST, prefix: str = "") -> DataFrame:
    """Drop lines whose key has min_chars code points at least and is found in min_docs documents at least, except in the largest doc_id that holds it.

    Returns every column of documents with the rest of each text (other lines joined by newline), n_lines and n_dropped (names
    that begin with prefix); columns of these two names are replaced. A null or empty text is one empty line, and a null text stays null. Every row
    counts as a document, also one that repeats a doc_id; a null doc_id counts as the smallest. All lines of a key in the
    document that keeps it stay. An empty table gives no rows.
    """
    spark = documents.sparkSession
    added = [f"{prefix}{n}" for n in ("n_lines", "n_dropped")]
    documents = documents.drop(*added)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc"), "text")
    counted = docs.mapInArrow(thrifty(_lines(min_chars, False)), "hi long, lo long, doc long").groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc").alias("holder"))
    frequent = table(counted.where(F.col("n") >= min_docs).withColumn("n", F.least("n", F.lit(2**32 - 1)).cast("long")), "lines")
    keys = frequent.count()
    shards = max(1, -(-keys // SHARD))
    arrays = table(frequent.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_build_shard, _ARRAYS), "arrays")
    forget(frequent)

    names = documents.columns
    where, doc_at = names.index("text"), names.index("doc_id")
    out = documents.withColumns({n: F.lit(0).cast("long") for n in added}).schema
    if keys <= broadcast_keys:
        held = spark.sparkContext.broadcast([tuple(r) for r in arrays.collect()])
        forget(arrays)
        return documents.mapInArrow(thrifty(_clean(min_chars, min_docs, added, len(names), where, doc_at, held, shards)), out)
    marked = docs.withColumn("mark", F.xxhash64("text"))
    probes = marked.mapInArrow(thrifty(_lines(min_chars, True)), "hi long, lo long, doc long, mark long")
    probes = table(probes.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int")), "probes")
    salts = table(probes.groupBy(F.col("shard").alias("of")).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts")), "salts")
    # a salt is as good as another, so rows are dealt by number: no line, document or repeated row makes a group larger
    probes = probes.withColumn("at", F.monotonically_increasing_id()).join(small(salts), F.col("shard") == F.col("of"))
    probes = probes.withColumn("salt", F.pmod("at", F.col("salts")).cast("int")).drop("at", "of", "salts")
    dealt = arrays.join(small(salts), F.col("shard") == F.col("of")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("of", "salts")
    hits = dealt.groupBy("shard", "salt").cogroup(probes.groupBy("shard", "salt")).applyInArrow(_probe_group(min_docs), "doc long, mark long, hi long, lo long")
    hits = hits.groupBy("doc", "mark").agg(F.collect_set(F.struct("hi", "lo")).alias("__gone")).withColumnsRenamed({"doc": "__doc", "mark": "__mark"})
    joined = documents.join(hits, (F.coalesce(documents["doc_id"].cast("long"), F.lit(-(2**63))) == F.col("__doc")) & (F.xxhash64(documents["text"]) == F.col("__mark")), "left").drop("__doc", "__mark")
    return joined.mapInArrow(thrifty(_clean(min_chars, min_docs, added, len(names), where, doc_at)), out)
