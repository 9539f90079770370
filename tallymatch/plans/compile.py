"""Compiles a rule tree: what each leaf keeps of an ID's rows, what it reads from a probe, and when it holds.

Per-ID semantics need no grouping at match time, because every leaf's "some row of the ID holds" collapses into one value when
the index is built: a set of values for equality, a least or greatest bound for orders, one of each per operator for CompareBy,
and whether some row is a wildcard. So an ID becomes one row, and a match is a join of probes with IDs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.getters import Getter, Operator, column
from . import rules as R

_ORDER = {R.GreaterOrEqual: ">=", R.LessOrEqual: "<=", R.Greater: ">", R.Less: "<"}


def _holds(op: str, probe: Column, bound: Column) -> Column:
    return {">=": probe >= bound, "<=": probe <= bound, ">": probe > bound, "<": probe < bound}[op]


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


@dataclass
class Part:
    """One compiled leaf. Columns of the rules side are named r<n>..., of the probe side __q<n>."""

    n: int
    kind: str  # set, veto, order, compare, presence
    stored: dict[str, Getter] = field(default_factory=dict)
    asked: Getter | None = None
    op: str = ""
    listed: bool = False
    present: bool = True
    optional: bool = False  # below an AnyOf: never a join key

    @property
    def r(self) -> str:
        return f"r{self.n}"

    @property
    def q(self) -> str:
        return f"__q{self.n}"

    def raw(self) -> dict[str, Column]:
        """What to read of each stored row."""
        return {name: column(getter) for name, getter in self.stored.items()}

    def kept(self) -> dict[str, Column]:
        """What to keep of an ID's rows."""
        r = self.r
        if self.kind == "presence":
            return {}
        missing = F.bool_or(F.col(r).isNull())
        if self.kind in ("set", "veto"):
            values = F.array_compact(F.array_distinct(F.flatten(F.collect_list(r)))) if self.listed else F.collect_set(r)
            out = {f"{r}_set": values}
            return out if self.kind == "veto" else {f"{r}_any": missing} | out
        if self.kind == "order":
            return {f"{r}_any": missing, f"{r}_end": (F.min if self.op in (">=", ">") else F.max)(r)}
        of = lambda op: F.when(F.col(f"{r}_op") == int(op), F.col(r))
        return {
            f"{r}_any": missing, f"{r}_set": F.collect_set(of(Operator.EQ)), f"{r}_lt": F.max(of(Operator.LT)), f"{r}_lte": F.max(of(Operator.LTE)),
            f"{r}_gt": F.min(of(Operator.GT)), f"{r}_gte": F.min(of(Operator.GTE)), f"{r}_ne": F.min(of(Operator.NE)), f"{r}_nf": F.max(of(Operator.NE)),
        }

    def condition(self, wide: bool = False, single: bool = False) -> Column:
        """Whether the leaf holds for an ID and a probe; with wide, IDs whose set is kept apart pass here; with single, sets are one value."""
        r, q = self.r, F.col(self.q)
        if self.kind == "presence":
            return q.isNotNull() if self.present else q.isNull()
        if self.kind != "order":
            held = (q == F.col(f"{r}_one")) if single else F.array_contains(f"{r}_set", q)
        if self.kind == "veto":
            return ~_sure(held)
        if self.kind == "set":
            found = F.col(f"{r}_any") | _sure(held)
            return found | F.col(f"{r}_wide") if wide else found
        if self.kind == "order":
            return F.col(f"{r}_any") | _sure(_holds(self.op, q, F.col(f"{r}_end")))
        tests = [held, q < F.col(f"{r}_lt"), q <= F.col(f"{r}_lte"), q > F.col(f"{r}_gt"), q >= F.col(f"{r}_gte"), (q != F.col(f"{r}_ne")) | (q != F.col(f"{r}_nf"))]
        found = reduce(lambda a, b: a | b, [F.col(f"{r}_any"), *map(_sure, tests)])
        return found | F.col(f"{r}_wide") if wide else found


@dataclass
class Compiled:
    parts: list[Part]
    tree: R.Rule
    numbers: dict[int, list[int]]  # of each leaf object, its parts
    never: bool
    intervals: list[tuple[int, int]]  # parts of a Between's two ends, where both must hold

    def condition(self, dropped: frozenset[int] = frozenset(), wide: frozenset[int] = frozenset(), single: frozenset[int] = frozenset(), last: frozenset[int] = frozenset()) -> Column:
        """Whether an ID's row matches a probe; parts in dropped hold for every ID.

        Nested Alls are one conjunction. Orders are tested first (cheap), sets and exclusions next, and parts in last, which a
        join has already looked at, at the end.
        """
        if self.never:
            return F.lit(False)
        own = lambda n: F.lit(True) if n in dropped else self.parts[n].condition(n in wide, n in single)

        def of(rule: R.Rule) -> Column:
            if isinstance(rule, R.All):
                return reduce(lambda a, b: a & b, map(of, rule.rules))
            if isinstance(rule, R.AnyOf):
                return reduce(lambda a, b: a | b, map(of, rule.rules), F.lit(False))
            return reduce(lambda a, b: a & b, map(own, self.numbers[id(rule)]))

        def terms(rule: R.Rule) -> list[tuple[int, Column]]:
            if isinstance(rule, R.All):
                return [t for child in rule.rules for t in terms(child)]
            if isinstance(rule, R.AnyOf):
                return [(4, of(rule))]
            return [(5 if n in last else {"presence": 0, "order": 1, "veto": 2, "compare": 3, "set": 3}[self.parts[n].kind], own(n)) for n in self.numbers[id(rule)] if n not in dropped]

        return reduce(lambda a, b: a & b, [c for _, c in sorted(terms(self.tree), key=lambda t: t[0])], F.lit(True))


def compile_rules(tree: R.Rule) -> Compiled:
    parts: list[Part] = []
    numbers: dict[int, list[int]] = {}
    intervals: list[tuple[int, int]] = []

    def add(rule: R.Rule, optional: bool) -> None:
        if isinstance(rule, (R.All, R.AnyOf)):
            for child in rule.rules:
                add(child, optional or isinstance(rule, R.AnyOf))
            return
        own = numbers.setdefault(id(rule), [])
        if own:
            return
        for leaf in rule.leaves():
            n = len(parts)
            r = f"r{n}"
            if isinstance(leaf, R._Presence):
                part = Part(n, "presence", asked=leaf.probe, present=isinstance(leaf, R.Exists))
            elif isinstance(leaf, R.CompareBy):
                part = Part(n, "compare", {r: leaf.stored, f"{r}_op": leaf.operator}, leaf.asked)
            elif isinstance(leaf, (R.Exclude, R.NotIn)):
                if optional:
                    raise ValueError("an exclusion cannot stand below AnyOf")
                part = Part(n, "veto", {r: leaf.stored}, leaf.asked, listed=isinstance(leaf, R.NotIn))
            elif isinstance(leaf, (R.Include, R.In)):
                part = Part(n, "set", {r: leaf.stored}, leaf.asked, listed=isinstance(leaf, R.In))
            elif isinstance(leaf, R.Side):
                part = Part(n, "order", {r: leaf.stored}, leaf.asked, op=leaf.op)
            elif type(leaf) in _ORDER:
                part = Part(n, "order", {r: leaf.stored}, leaf.asked, op=_ORDER[type(leaf)])
            else:
                raise TypeError(f"not a rule: {leaf!r}")
            part.optional = optional
            parts.append(part)
            own.append(n)
        if isinstance(rule, R.Between) and not optional:
            intervals.append((own[0], own[1]))

    def never(rule: R.Rule) -> bool:
        return isinstance(rule, R.All) and (not rule.rules or any(map(never, rule.rules)))

    add(tree, False)
    return Compiled(parts, tree, numbers, never(tree), intervals)
