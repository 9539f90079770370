"""Rule trees. A leaf names an expression of the stored rule and one of the probe (the same text unless given).

NULL in a stored rule is a wildcard; NULL in a probe meets stored wildcards only. Rows that share a rule ID are combined leaf by
leaf: a positive leaf holds for the ID if it holds for any of its rows, an exclusion vetoes the ID if any of its rows does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from ..functions.getters import Getter


class Rule:
    def leaves(self) -> Iterator[Leaf]:
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class Leaf(Rule):
    stored: Getter
    probe: Getter | None = None

    def leaves(self) -> Iterator[Leaf]:
        yield self

    @property
    def asked(self) -> Getter:
        return self.stored if self.probe is None else self.probe


class Include(Leaf):
    """The probe's value equals the stored one."""


class Exclude(Leaf):
    """The probe's value equals no value stored for the ID."""


class GreaterOrEqual(Leaf):
    """The probe's value is at least the stored one."""


class LessOrEqual(Leaf):
    """The probe's value is at most the stored one."""


class Greater(Leaf):
    """The probe's value is greater than the stored one."""


class Less(Leaf):
    """The probe's value is less than the stored one."""


class In(Leaf):
    """The probe's value is in the stored array (a NULL array is a wildcard, an empty one matches nothing)."""


class NotIn(Leaf):
    """The probe's value is in no array stored for the ID."""


@dataclass(frozen=True, eq=False)
class CompareBy(Rule):
    """The probe's value compares to the stored value as the stored operator (Operator, 0 to 5) asks."""

    stored: Getter
    operator: Getter
    probe: Getter | None = None

    def leaves(self) -> Iterator[Leaf]:
        yield self

    @property
    def asked(self) -> Getter:
        return self.stored if self.probe is None else self.probe


@dataclass(frozen=True, eq=False)
class Side(Leaf):
    """One bound of an interval: ``op`` relates the probe's bound to the stored one."""

    op: str = "<="


class _Pair(Rule):
    def __init__(self, stored_from: Getter, stored_until: Getter, probe_from: Getter | None = None, probe_until: Getter | None = None):
        self.stored = stored_from, stored_until
        self.asked = stored_from if probe_from is None else probe_from, stored_until if probe_until is None else probe_until


class Between(_Pair):
    """The stored interval covers the probe's, both ends included; each end may be missing on its own and is a leaf of its own."""

    def leaves(self) -> Iterator[Leaf]:
        yield Side(self.stored[0], self.asked[0], ">=")
        yield Side(self.stored[1], self.asked[1], "<=")


class Overlaps(_Pair):
    """The stored interval and the probe's share a point; stored ends may be missing."""

    def leaves(self) -> Iterator[Leaf]:
        yield Side(self.stored[0], self.asked[1], ">=")
        yield Side(self.stored[1], self.asked[0], "<=")


@dataclass(frozen=True, eq=False)
class _Presence(Rule):
    probe: Getter

    def leaves(self) -> Iterator[Leaf]:
        yield self


class Exists(_Presence):
    """The probe has a value, whatever is stored."""


class Missing(_Presence):
    """The probe has no value, whatever is stored."""


class All(Rule):
    """Every child holds for the ID. Without children nothing matches, and neither does anything around it."""

    def __init__(self, *rules: Rule):
        self.rules = rules

    def leaves(self) -> Iterator[Leaf]:
        for rule in self.rules:
            yield from rule.leaves()

    def empty(self) -> bool:
        return not self.rules or any(isinstance(r, All) and r.empty() for r in self.rules)


class AnyOf(Rule):
    """Some child holds for the ID; exclusions are not allowed below."""

    def __init__(self, *rules: Rule):
        self.rules = rules

    def leaves(self) -> Iterator[Leaf]:
        for rule in self.rules:
            yield from rule.leaves()
