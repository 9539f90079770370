"""Building an index: snapshot, validation, one row per ID, profile, join entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.getters import Operator
from ..plans.compile import compile_rules
from ..plans.rules import Rule
from ..plans.tables import FEW, dense_rank, forget, snapshot
from .index import RuleIndex

#: Values of one leaf that an ID keeps in its row; larger sets stay a table of their own.
SET_VALUES = 1000
#: Kinds of wildcard patterns that probes are expanded over, and values or interval bins that an ID is expanded over.
MASKS, EXPANDED, BINS = 64, 64, 8
#: Masks that are looked at to choose the keys.
MANY = 100_000
_NUMBERS = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


class InvalidRule(ValueError):
    """A stored row that the schema does not allow; names the first one in insertion order."""


class RuleSchema:
    """A rule tree that builds indexes; reusable, also after a failed build."""

    def __init__(self, tree: Rule):
        if tree is None:
            raise ValueError("a schema needs a rule")
        self.compiled = compile_rules(tree)

    def build(self, rules: DataFrame, id_col: str = "rule_id", pos_col: str = "pos") -> RuleIndex:
        """An index of the rows of rules as they are now. pos_col gives the insertion order; rows that share an ID are combined."""
        if rules is None:
            raise ValueError("no rules to build from")
        parts = self.compiled.parts
        raw = {name: _widened(rules, c) for p in parts for name, c in p.raw().items()}
        rows = snapshot(rules.select(F.col(id_col).alias("rule_id"), F.col(pos_col).cast("long").alias("pos"), *[c.alias(n) for n, c in raw.items()]), "rules")
        most = self._validate(rows)
        wide: dict[int, DataFrame] = {}
        if most <= SET_VALUES:
            ids = rows.groupBy("rule_id").agg(F.min("pos").alias("first_pos"), *[c.alias(n) for p in parts for n, c in p.kept().items()])
        else:
            ids, wide = self._large(rows)
        index = self._entries(snapshot(ids, "ids"), wide)
        forget(rows)
        return index

    def _validate(self, rows: DataFrame) -> int:
        """Raise for the first bad row; else the most rows that an ID has. One pass."""
        reasons = []
        for p in self.compiled.parts:
            if p.kind == "compare":
                op = F.col(f"{p.r}_op")
                wrong = F.when(F.col(p.r).isNotNull() & op.isNull(), F.lit("CompareBy value without an operator"))
                reasons.append(wrong.when(F.col(p.r).isNotNull() & ~op.isin([int(o) for o in Operator]), F.concat(F.lit("CompareBy operator "), op.cast("string"), F.lit(" is unknown"))))
        reasons.append(F.when(F.col("pos").isNull(), F.lit("no position")))
        reason = F.coalesce(*reasons)
        groups = rows.withColumn("bad", F.when(reason.isNotNull(), F.struct("pos", reason.alias("reason")))).groupBy("rule_id").agg(F.count("*").alias("n"), F.min("bad").alias("bad"))
        most, bad = groups.agg(F.max("n"), F.min("bad")).first()
        if bad:
            at = rows.where(F.col("pos") < F.lit(bad["pos"])).count()
            raise InvalidRule(f"entry {at}: {bad['reason']}")
        return most or 0

    def _large(self, rows: DataFrame) -> tuple[DataFrame, dict[int, DataFrame]]:
        """One row per ID where some IDs have many rows: sets are deduplicated and counted before any is gathered."""
        parts = self.compiled.parts
        key = F.col("rule_id").eqNullSafe(F.col("__id"))
        scalar = [c.alias(n) for p in parts for n, c in p.kept().items() if not n.endswith("_set")]
        ids = rows.groupBy("rule_id").agg(F.min("pos").alias("first_pos"), *scalar)
        wide = {}
        for p in parts:
            if p.kind not in ("set", "veto", "compare"):
                continue
            value = F.explode(p.r) if p.listed else F.col(p.r)
            own = rows.where(F.col(f"{p.r}_op") == int(Operator.EQ)) if p.kind == "compare" else rows
            values = own.where(F.col(p.r).isNotNull()).select("rule_id", value.alias("value")).where("value is not null").distinct()
            sizes = values.groupBy(F.col("rule_id").alias("__id")).agg(F.count("*").alias("__size"))
            sets = values.join(sizes.where(F.col("__size") <= SET_VALUES), key).groupBy("__id").agg(F.collect_set("value").alias(f"{p.r}_set"))
            empty = F.array().cast(sets.schema[f"{p.r}_set"].dataType)
            large = sizes.where(F.col("__size") > SET_VALUES).select("__id", F.lit(True).alias("__large"))
            ids = ids.join(sets, key, "left").drop("__id").withColumn(f"{p.r}_set", F.coalesce(f"{p.r}_set", empty))
            ids = ids.join(large, key, "left").drop("__id").withColumn(f"{p.r}_wide", F.coalesce("__large", F.lit(False))).drop("__large")
            if not large.isEmpty():
                wide[p.n] = values.join(large, key, "left_semi")
        return ids, wide

    def _entries(self, ids: DataFrame, wide: dict[int, DataFrame]) -> RuleIndex:
        """Profile the IDs, drop leaves that hold for all, and choose the equality keys of the join."""
        parts = self.compiled.parts
        facts = [F.count("*").alias("ids")]
        for p in parts:
            if p.kind in ("set", "order", "compare"):
                facts.append(F.count(F.when(~F.col(f"{p.r}_any"), 1)).alias(f"strict{p.n}"))
            if p.kind == "set":
                facts.append(F.approx_count_distinct(F.when(~F.col(f"{p.r}_any"), F.get(f"{p.r}_set", F.lit(0)))).alias(f"values{p.n}"))
            if p.kind == "veto":
                facts.append(F.count(F.when(F.size(f"{p.r}_set") > 0, 1)).alias(f"strict{p.n}"))
        for a, b in self.compiled.intervals:
            if is_number(ids, f"r{a}_end") and is_number(ids, f"r{b}_end"):
                facts.append(F.percentile_approx(F.when(~F.col(f"r{a}_any") & ~F.col(f"r{b}_any"), number(ids, f"r{b}_end") - number(ids, f"r{a}_end")), 0.5).alias(f"width{a}"))
        sets = [p.n for p in parts if p.kind in ("set", "veto", "compare")]
        facts += [F.max(F.size(f"r{n}_set")).alias(f"most{n}") for n in sets]
        seen = ids.agg(*facts).first()
        single = frozenset(n for n in sets if (seen[f"most{n}"] or 0) <= 1 and n not in wide)
        first, ids = ids, dense_rank(ids, "first_pos", "rule_ord", seen["ids"]).drop("first_pos")
        if seen["ids"] > FEW:
            ids = snapshot(ids, "ids")
            forget(first)
        for n, values in wide.items():
            wide[n] = snapshot(values.join(ids.select(F.col("rule_id").alias("__id"), "rule_ord"), F.col("rule_id").eqNullSafe(F.col("__id"))).select("rule_ord", "value"), "values")
        dropped = frozenset(p.n for p in parts if p.kind != "presence" and not seen[f"strict{p.n}"] and p.n not in wide)

        keys = []
        for p in parts:
            if p.kind == "set" and not p.optional and p.n not in dropped:
                keys.append((seen[f"strict{p.n}"] * max(1, seen[f"values{p.n}"]), p.n, None))
        for a, b in self.compiled.intervals:
            width = seen[f"width{a}"] if f"width{a}" in seen.asDict() else None
            if width and 0 < width < float("inf") and a not in dropped and b not in dropped:
                keys.append((seen["ids"], a, (a, b, float(width))))
        keys = [k[1:] for k in sorted(keys, key=lambda k: -k[0])][:62]
        while True:
            # a mask over fewer keys is a mask's low bits: the most keys that keep the masks few
            found = [r[0] for r in self._masks(ids, keys).select("__mask").distinct().limit(MANY + 1).collect()]
            if len(found) <= MANY:
                break
            keys = keys[: len(keys) // 2]
        few = max(k for k in range(len(keys) + 1) if len({m & ((1 << k) - 1) for m in found}) <= MASKS)
        keys, masks = keys[:few], sorted({m & ((1 << few) - 1) for m in found})
        # entries carry what conditions read: one value instead of a set where no ID has more, nothing of dropped leaves
        entries = self._masked(ids, keys).withColumns({f"r{n}_one": F.get(f"r{n}_set", F.lit(0)) for n in single})
        unread = [c for c in ids.columns if c.split("_")[0][1:].isdigit() and int(c.split("_")[0][1:]) in dropped]
        entries = entries.drop(*[f"r{n}_set" for n in single], *unread, *[f"r{n}_one" for n in dropped])
        return RuleIndex(self.compiled, ids, snapshot(entries, "entries"), masks, keys, dropped, wide, single)

    def _masks(self, ids: DataFrame, keys: list[tuple[int, tuple[int, int, float] | None]]) -> DataFrame:
        """Each ID with the mask of keys that it has: all of one value, and the first of several values."""
        ok, size = [], []
        for n, interval in keys:
            r = f"r{n}"
            if interval:
                a, b, width = interval
                low, high = (number(ids, f"r{x}_end") / width for x in (a, b))
                binned = (low <= high) & (F.abs(low) < 2.0**53) & (F.abs(high) < 2.0**53)  # NaN is not
                size.append(F.when(binned, F.floor(high) - F.floor(low) + 1))
                ok.append(F.coalesce(~F.col(f"r{a}_any") & ~F.col(f"r{b}_any") & (size[-1] <= BINS), F.lit(False)))
            else:
                size.append(F.size(f"{r}_set"))
                kept = ~F.col(f"{r}_wide") if f"{r}_wide" in ids.columns else F.lit(True)
                ok.append(~F.col(f"{r}_any") & (size[-1] > 0) & (size[-1] <= EXPANDED) & kept)
        several = F.coalesce(*[F.when(o & (s > 1), F.lit(bit)) for bit, (o, s) in enumerate(zip(ok, size, strict=True))], F.lit(-1))
        out = ids.withColumn("__several", several)
        bits = [F.when(o & ((s <= 1) | (F.col("__several") == bit)), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")) for bit, (o, s) in enumerate(zip(ok, size, strict=True))]
        return out.withColumn("__mask", sum(bits, F.lit(0).cast("long"))).drop("__several")

    def _masked(self, ids: DataFrame, keys: list[tuple[int, tuple[int, int, float] | None]]) -> DataFrame:
        """Each ID once for each combination of values that a probe could meet it with, and their hash.

        An ID with a binned interval has further entries for probes whose interval ends before it starts, which have no bin: one
        for each combination of its equality values alone, with the mask of these, negated (-1 - mask), and __bins, the
        intervals that such a probe is missed by.
        """
        out = self._masks(ids, keys)
        main = F.lit(True)
        for bit, (n, interval) in enumerate(keys):
            has = F.col("__mask").bitwiseAND(F.lit(1 << bit).cast("long")) != 0
            if interval:
                a, b, width = interval
                low, high = (F.floor(number(ids, f"r{x}_end") / width) for x in (a, b))
                values = F.sequence(low, high)
                main = main & F.coalesce(F.col(f"__k{bit}") == low, F.lit(True))
            else:
                values = F.col(f"r{n}_set")
            out = out.withColumn(f"__k{bit}", F.explode_outer(F.when(has, values)))
        bins = binned_bits(keys)
        if bins:
            kinds = F.when((F.col("__bins") != 0) & main, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
            out = out.withColumn("__bins", F.col("__mask").bitwiseAND(F.lit(bins).cast("long"))).withColumn("__odd", F.explode(kinds))
            out = out.withColumn("__mask", F.when(F.col("__odd"), -1 - F.col("__mask").bitwiseAND(F.lit(~bins).cast("long"))).otherwise(F.col("__mask")))
            out = out.withColumns({f"__k{bit}": F.when(~F.col("__odd"), F.col(f"__k{bit}")) for bit, (_, interval) in enumerate(keys) if interval}).drop("__odd")
        key = F.xxhash64("__mask", *[F.col(f"__k{bit}") for bit in range(len(keys))])
        return out.withColumn("__key", key).drop(*[f"__k{bit}" for bit in range(len(keys))])


def binned_bits(keys: list) -> int:
    """The bits of a mask that stand for intervals."""
    return sum(1 << bit for bit, (_, interval) in enumerate(keys) if interval)


def is_number(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString() in ("bigint", "double", "date", "timestamp", "timestamp_ntz")


def number(df: DataFrame, name: str) -> Column:
    """A bound as a double that keeps the order; times in microseconds."""
    return as_number(F.col(name), df.schema[name].dataType.simpleString())


def as_number(c: Column, kind: str) -> Column:
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def _widened(df: DataFrame, c: Column) -> Column:
    """Integers as BIGINT and floats as DOUBLE, so that equal values hash alike on both sides."""
    kind = df.select(c.alias("c")).schema["c"].dataType.simpleString()
    if kind in _NUMBERS:
        return c.cast(_NUMBERS[kind])
    if kind.startswith("array<") and kind[6:-1] in _NUMBERS:
        return c.cast(f"array<{_NUMBERS[kind[6:-1]]}>")
    if kind == "void":
        return c.cast("string")
    return c
