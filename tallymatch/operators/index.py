"""A built index and its searches."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.getters import column
from ..plans.compile import Compiled
from ..plans.tables import BROADCAST_ROWS, forget
from . import tiles

#: Masks without any key: that of IDs, and that of their entries for inverted probes.
LONE = (0, -1)
#: Probes that read alike are matched in one row of so many from so many pairs on, if each kind has so many probes in the mean.
CHUNK, PAIRS, ALIKE = 256, 2**28, 8
#: Results of one joined row that a task may hold at once: generated code hands them on only after the last.
HELD = 2**16
_WHOLE = ("bigint", "int", "smallint", "tinyint")


def _conform(c: Column, kind: str, to: str) -> Column:
    """A probe's value in the type of the stored ones, so that equal values are equal and hash alike; NULL if there is none."""
    if kind == to or to in ("void", "") or kind == "void":
        return c.cast(to) if kind == "void" and to else c
    if to == "bigint" and (kind in ("double", "float") or kind.startswith("decimal")):
        return F.when((c == F.floor(c)) & (F.abs(c.cast("double")) < 2.0**63), c.cast("bigint"))
    if to in ("bigint", "double") and kind in (*_WHOLE, "float") or to.startswith("decimal"):
        return c.cast(to)
    return c


def _odd(kind: DataType) -> bool:
    """Whether values of this type have no hash."""
    return re.search("map<|variant", kind.simpleString()) is not None


def _spread(probes: DataFrame) -> DataFrame:
    """Probes read from little data dealt over all cores; larger inputs come in enough partitions as they are.

    Judged by the sizes of what is read, as the planner knows them: nothing runs for it.
    """
    if probes.isStreaming:
        return probes
    spark = probes.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = probes._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return probes.repartition(2 * cores) if read < cores * 2**27 else probes


class RuleIndex:
    """One row per rule ID and the entries that probes join with. Immutable: it reads the snapshot it was built from."""

    def __init__(self, compiled: Compiled, ids: DataFrame, entries: DataFrame, masks: list[int], keys: list, dropped: frozenset[int], wide: dict[int, DataFrame], single: frozenset[int] = frozenset()):
        self.compiled, self.ids, self.entries, self.masks, self.keys, self.dropped, self.wide, self.single = compiled, ids, entries, masks, keys, dropped, wide, single
        self.size = entries.count()

    def clean(self) -> None:
        """Delete the index's snapshots; it and DataFrames that read it cannot be used any more."""
        for df in (self.ids, self.entries, *self.wide.values()):
            forget(df)

    # -- the probe side ---------------------------------------------------------------------------------------------

    def _stored_type(self, n: int) -> str:
        p = self.compiled.parts[n]
        if p.kind == "presence" or p.kind == "order":
            return ""
        return self.ids.schema[f"{p.r}_set"].dataType.elementType.simpleString()

    def _asked(self, probes: DataFrame) -> DataFrame:
        """Probes with what each leaf reads of them."""
        read = {p.q: column(p.asked) for p in self.compiled.parts}
        kinds = {f.name: f.dataType.simpleString() for f in probes.select(*[c.alias(q) for q, c in read.items()]).schema} if read else {}
        return probes.withColumns({q: _conform(c, kinds[q], self._stored_type(int(q[3:]))) for q, c in read.items()})

    def _key_values(self, asked: DataFrame) -> tuple[list[Column], Column]:
        """What a probe brings for each join key (a value, or the bin of its interval's start), and the bits of intervals that end before they start."""
        from .schema import as_number

        out, inverted = [], F.lit(0).cast("long")
        for bit, (n, interval) in enumerate(self.keys):
            if interval:
                a, b, width = interval
                kinds = [asked.schema[f"__q{x}"].dataType.simpleString() for x in (a, b)]
                low, high = (as_number(F.col(f"__q{x}"), k) for x, k in zip((a, b), kinds, strict=True))
                out.append(F.when(low <= high, F.floor(low / width)))
                inverted = inverted + F.when(low > high, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
            else:
                out.append(F.col(f"__q{n}"))
        return out, inverted

    def _keyed(self, asked: DataFrame, masks: list[int], blocks: int = 1) -> DataFrame:
        """A copy of each probe for every mask whose keys it has, and every block of entries, with the hash to join on; inverted ones, also for the negated masks."""
        values, inverted = self._key_values(asked)
        lacks = F.lit(0).cast("long")
        for bit, v in enumerate(values):
            lacks = lacks + F.when(v.isNull(), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
        listed = lambda ms: F.array(*[F.lit(m).cast("long") for m in ms]) if ms else F.array().cast("array<long>")
        out = asked.withColumns({"__lacks": lacks, "__inv": inverted})
        own = F.filter(listed([m for m in masks if m >= 0]), lambda m: m.bitwiseAND(F.col("__lacks")) == 0)
        if odd := [m for m in masks if m < 0]:
            own = F.concat(own, F.when(F.col("__inv") != 0, F.filter(listed(odd), lambda m: (-1 - m).bitwiseAND(F.col("__lacks")) == 0)).otherwise(listed([])))
        if blocks == 1:
            out = out.withColumn("__m", F.explode(own))
        else:  # __from is read so that this is no constant: lambdas end a stage of generated code, which holds a row's results
            each = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
            cut = F.flatten(F.transform(own, lambda m: F.transform(each, lambda b: F.struct(m.alias("m"), b.alias("b"), F.col("__from").alias("f")))))
            out = out.withColumn("__cut", F.explode(cut)).withColumns({"__m": F.col("__cut.m"), "__b": F.col("__cut.b")}).drop("__cut")
        mask = F.when(F.col("__m") < 0, -1 - F.col("__m")).otherwise(F.col("__m"))
        values = [F.when(mask.bitwiseAND(F.lit(1 << bit).cast("long")) != 0, v) for bit, v in enumerate(values)]
        out = out.withColumn("__h", F.xxhash64("__m", *values)).drop("__lacks")
        return out if blocks == 1 else out.withColumn("__h", F.col("__h").bitwiseXOR(F.col("__b"))).drop("__b")

    def _all_masks(self) -> list[int]:
        from .schema import binned_bits

        bins = binned_bits(self.keys)
        return [*self.masks, *sorted({-1 - (m & ~bins) for m in self.masks if m & bins})]

    # -- matching ---------------------------------------------------------------------------------------------------

    def match(self, probes: DataFrame, id_name: str = "rule_id", ord_name: str = "rule_ord", dedup: bool = False, columns: list[str] | None = None) -> DataFrame:
        """Every probe's columns (or those named, which spares large results the others) with each rule ID that matches it, and the ID's place in insertion order.

        The join is on (mask of stored keys, hash of their values), so wildcards cost a copy of the probe per kind of mask and
        no nested loop; all leaves are then tested on the pair. IDs are joined as a broadcast if they are proven to be few.
        With dedup, probes that read alike are matched once.
        """
        taken = {id_name, ord_name} & set(probes.columns)
        if taken or any(c.startswith("__") for c in probes.columns):
            raise ValueError(f"probe columns clash with the result's: {sorted(taken) or 'names that start with __'}")
        names = [c for c in probes.columns] if columns is None else columns
        asked = self._asked(_spread(probes))
        result = [F.col("rule_id").alias(id_name), F.col("rule_ord").alias(ord_name)]
        if dedup and self.compiled.parts:
            reads = [p.q for p in self.compiled.parts]
            once = self._pairs(asked.select(*reads).distinct()).select(*[F.col(q).alias(f"{q}_") for q in reads], F.col("rule_id").alias("__rid"), F.col("rule_ord").alias("__ord"))
            on = [F.col(q).eqNullSafe(F.col(f"{q}_")) for q in reads]
            return asked.join(once, on).select(*[F.col(f"`{c}`") for c in names], F.col("__rid").alias(id_name), F.col("__ord").alias(ord_name))
        packed = asked.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__probe"), *[p.q for p in self.compiled.parts]) if names else asked
        seen = self._seen(packed) if names else None
        first = bool(seen) and seen[0] < CHUNK * seen[1]  # rows of probes that read alike would be short
        alike = self._alike(packed, seen) if seen and not first else None
        if seen and alike is None and (found := tiles.match(self, asked, names, id_name, ord_name, seen[2:])) is not None:
            return found
        if first:
            alike = self._alike(packed, seen)
        pairs = self._pairs(packed) if alike is None else self._pairs(alike, -(-self.size * CHUNK // HELD)).select(F.explode("__probes").alias("__probe"), "rule_id", "rule_ord")
        return pairs.select(*[F.col("__probe")[c].alias(c) for c in names], *result)

    def _seen(self, packed: DataFrame) -> tuple[int, ...] | None:
        """How many probes there are, about how many kinds of them, and values of each leaf's field; None if pairs are few or go the plain way."""
        reads = [p.q for p in self.compiled.parts]
        if packed.isStreaming or not reads or self.wide or self.compiled.never or not self.masks or any(_odd(packed.schema[q].dataType) for q in reads):
            return None
        seen = packed.agg(F.count("*"), *[F.approx_count_distinct(F.xxhash64(*qs)) for qs in (reads, *[[q] for q in reads])]).first()
        return tuple(seen) if seen[0] * self.size >= PAIRS else None

    def _alike(self, packed: DataFrame, seen: tuple[int, ...] | None = None) -> DataFrame | None:
        """Probes that read alike in rows of about CHUNK (__probes), or None if they are few or mostly read differently.

        An ID is tested once for a row of probes, and its pairs with them come one after the other: then a columnar file has the
        ID once a row, and the same probes again and again, so a large result takes a fraction of the bytes. One pass over
        the probes counts; kinds are counted only if that pays, each is dealt to as many groups as its own count asks for, by a
        hash of the probe, and probes that repeat beyond a row stay as they are.
        """
        reads = [p.q for p in self.compiled.parts]
        if (seen := seen or self._seen(packed)) is None:
            return None
        rows, kinds = seen[:2]
        if rows < ALIKE * kinds or kinds > BROADCAST_ROWS // 2:
            return None
        told = [F.col("__probe")[f.name] for f in packed.schema["__probe"].dataType if not _odd(f.dataType)]
        own = packed.withColumns({"__kind": F.xxhash64(*reads), "__own": F.xxhash64(F.lit(1), *told)})
        counts = own.groupBy("__kind", "__own").count().groupBy("__kind").agg(F.sum("count").alias("__rows"), F.max("count").alias("__most"))
        sizes = {r[0]: r[1:] for r in counts.collect()}
        if max((most for _, most in sizes.values()), default=0) > CHUNK:
            return None
        group, rows = 16 * CHUNK, 16  # of probes that are gathered, and of rows that a task gets
        spark, cores = packed.sparkSession, packed.sparkSession.sparkContext.defaultParallelism
        salts = spark.createDataFrame([(k, -(-n // group)) for k, (n, _) in sizes.items()], "__of long, __salts long")
        dealt = own.join(F.broadcast(salts), F.col("__kind") == F.col("__of"), "left").withColumn("__salt", F.pmod("__own", F.coalesce("__salts", F.lit(1))))
        groups = dealt.groupBy(*reads, "__salt").agg(F.collect_list("__probe").alias("__all"))
        starts = F.explode(F.sequence(F.lit(1), F.size("__all"), F.lit(CHUNK))).alias("__from")
        chunks = groups.select(*reads, "__all", starts).select(*reads, "__from", F.slice("__all", F.col("__from"), F.lit(CHUNK)).alias("__probes"))
        return chunks.repartition(max(4 * cores, sum(-(-n // CHUNK) for n, _ in sizes.values()) // rows))

    def _pairs(self, asked: DataFrame, blocks: int = 1) -> DataFrame:
        """Probes (with the __q columns) joined with the IDs that match, a block of the entries at a time."""
        wide = frozenset(n for n in self.wide if self.compiled.parts[n].kind != "veto")
        condition = self.compiled.condition(self.dropped, wide, self.single, frozenset(n for n, interval in self.keys if not interval))
        if self.compiled.never or not self.masks:
            return asked.join(self.ids, F.lit(False))
        masks = self._all_masks()
        if any(m < 0 for m in masks):  # a probe meets a negated entry only if a bin kept it from the ID's others
            condition = ((F.col("__m") >= 0) | (F.col("__bins").bitwiseAND(F.col("__inv")) != 0)) & condition
        keyed = (F.col("__h") == F.col("__key")) & ((F.col("__m") - F.col("__mask")) == 0) & condition  # one long key, so a lean hash table
        entries = self.entries
        if blocks > 1:  # a block is part of the key, and an entry in one block, so a pair is met once
            entries = entries.withColumn("__key", F.col("__key").bitwiseXOR(F.pmod(F.xxhash64("rule_ord"), F.lit(blocks).cast("long"))))
        if self.size <= BROADCAST_ROWS:
            return self._with_wide(self._keyed(asked, masks, blocks).join(F.broadcast(entries), keyed))
        lone = F.col("__mask").isin(*LONE)
        bound, free = entries.where(~lone), entries.where(lone)
        n = free.count()
        out = self._keyed(asked, [m for m in masks if m not in LONE], blocks).join(F.broadcast(bound) if self.size - n <= BROADCAST_ROWS else bound, keyed)
        if n and n <= BROADCAST_ROWS:
            out = out.unionByName(self._keyed(asked, [m for m in masks if m in LONE], blocks).join(F.broadcast(free), keyed))
        elif n:
            out = out.unionByName(self._dealt(self._keyed(asked, [m for m in masks if m in LONE], blocks), free, -(-n // BROADCAST_ROWS), keyed))
        return self._with_wide(out)

    def _dealt(self, probes: DataFrame, free: DataFrame, blocks: int, condition: Column) -> DataFrame:
        """Probes met with entries that have no key, too many to broadcast: blocks of entries with groups of probes, so no task gets all of either."""
        salts = -(-2 * int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
        told = [c for c, kind in probes.dtypes if "map<" not in kind and "variant" not in kind]
        number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        probes = probes.withColumn("__ps", F.pmod(F.xxhash64(*told), F.lit(salts)).cast("int")).withColumn("__pb", number(blocks))
        free = free.withColumn("__eb", F.pmod(F.xxhash64("rule_ord", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("__es", number(salts))
        return probes.join(free, (F.col("__pb") == F.col("__eb")) & (F.col("__ps") == F.col("__es")) & condition).drop("__ps", "__pb", "__es", "__eb")

    def _with_wide(self, out: DataFrame) -> DataFrame:
        """Pairs of probes and IDs that also hold for the sets kept apart."""
        for n, values in self.wide.items():
            p = self.compiled.parts[n]
            values = values.select(F.col("rule_ord").alias("__ord"), F.col("value").alias("__value"))
            hit = (F.col("rule_ord") == F.col("__ord")) & (F.col(p.q) == F.col("__value"))
            if p.kind == "veto":
                out = out.join(values, hit, "left_anti")
            else:
                flag = p.condition() | ~F.col(f"{p.r}_wide")
                out = out.where(flag).unionByName(out.where(~flag).join(values, hit, "left_semi"))
        return out

    def match_counts(self, probes: DataFrame, key: str, name: str = "matches") -> DataFrame:
        """Per probe key, how many IDs match; keys without any have 0."""
        found = self.match(probes).groupBy(key).agg(F.count("*").alias(name)).withColumnRenamed(key, "__key")
        return probes.select(key).distinct().join(found, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def any_match(self, probes: DataFrame, key: str) -> DataFrame:
        """Probes that some ID matches; key tells probes apart."""
        return probes.join(self._matched(probes, key), F.col(key) == F.col("__key"), "left_semi")

    def no_match(self, probes: DataFrame, key: str) -> DataFrame:
        return probes.join(self._matched(probes, key), F.col(key) == F.col("__key"), "left_anti")

    def _matched(self, probes: DataFrame, key: str) -> DataFrame:
        return self.match(probes).select(F.col(key).alias("__key")).distinct()

    def first_k(self, probes: DataFrame, key: str, k: int = 1) -> DataFrame:
        """Each probe's first k IDs by insertion order."""
        found = self.match(probes)
        if k == 1:
            others = [c for c in found.columns if c != key]
            first = found.groupBy(key).agg(F.min_by(F.struct(*others), "rule_ord").alias("__first"))
            return first.select(*[F.col(key) if c == key else F.col("__first")[c].alias(c) for c in found.columns])
        return found.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("rule_ord"))).where(F.col("__n") <= k).drop("__n")

    # -- one probe --------------------------------------------------------------------------------------------------

    def _matching(self, fields: dict[str, Any]) -> DataFrame:
        """IDs that match one probe of literal fields: one pass over the IDs beside a single row."""
        one = self.ids.sparkSession.range(1).select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])
        wide = frozenset(n for n in self.wide if self.compiled.parts[n].kind != "veto")
        met = self.ids.join(F.broadcast(self._asked(one)), self.compiled.condition(self.dropped, wide))
        return self._with_wide(met).select("rule_id", "rule_ord").orderBy("rule_ord")

    def search(self, **fields: Any) -> list:
        """IDs that match one probe, in insertion order; fields not given are missing."""
        return [r["rule_id"] for r in self._matching(self._complete(fields)).collect()]

    def search_into(self, found: list, **fields: Any) -> bool:
        """Append the IDs that match to found; whether this call matched any."""
        if found is None:
            raise ValueError("nothing to append to")
        own = self.search(**fields)
        found.extend(own)
        return bool(own)

    def visit(self, accept: Callable[[Any], bool] | None, **fields: Any) -> None:
        """Call accept with each matching ID in insertion order until it returns False; fetches partition by partition."""
        if accept is None:
            return
        for row in self._matching(self._complete(fields)).toLocalIterator():
            if accept(row["rule_id"]) is False:
                return

    def _complete(self, fields: dict[str, Any]) -> dict[str, Any]:
        """Fields that the probe's getters name but the call does not give are missing."""
        named = {p.asked for p in self.compiled.parts if isinstance(p.asked, str) and p.asked.isidentifier()}
        return {n: None for n in named} | fields

    def local(self) -> Local:
        return Local(self)


class Local:
    """The same results as the index's, remembered: for repeated probes on one thread."""

    def __init__(self, index: RuleIndex, keep: int = 128):
        self.index, self.keep = index, keep
        self.cache: dict[tuple, list] = {}

    def search(self, **fields: Any) -> list:
        key = tuple(sorted(fields.items()))
        try:
            found = self.cache.pop(key, None)
        except TypeError:
            return self.index.search(**fields)
        if found is None:
            found = self.index.search(**fields)
            if len(self.cache) >= self.keep:
                self.cache.pop(next(iter(self.cache)))
        self.cache[key] = found
        return list(found)

    def search_into(self, found: list, **fields: Any) -> bool:
        own = self.search(**fields)
        found.extend(own)
        return bool(own)

    def visit(self, accept: Callable[[Any], bool] | None, **fields: Any) -> None:
        for found in self.search(**fields) if accept else ():
            if accept(found) is False:
                return

    def match(self, probes: DataFrame, **options) -> DataFrame:
        return self.index.match(probes, dedup=True, **options)

    def reset(self) -> None:
        """Forget what was found; stays usable."""
        self.cache.clear()
