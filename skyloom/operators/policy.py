"""Policies as data: conditions on JSON fields, authority rules, missing values.

Rules are folded into one Column expression each, so a policy of any length is
still a projection inside code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
}
_KINDS = {"number": "double", "string": "string", "boolean": "boolean"}


@dataclass(frozen=True)
class Condition:
    """``operator`` on the value at ``path`` of the JSON text in ``column``; without a path, on the column itself.

    Operators: eq, ne, gt, gte, lt, lte, not_null, ne_or_null, bitmask_none.
    """

    column: str
    path: str | None
    operator: str
    value: object = None
    kind: str = "number"


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the row has this rank and reason, and ``score`` orders rows of one rank."""

    rank: int
    reason: str
    conditions: tuple[Condition, ...] = ()
    score: tuple[str, str] | None = None  # column and JSON path
    ascending: bool = field(default=False)


def condition(c: Condition) -> Column:
    """The condition as an expression; null where the value is missing or of another type (null never holds)."""
    if c.operator not in (*_COMPARE, "not_null", "ne_or_null", "bitmask_none") or c.kind not in _KINDS:
        raise ValueError(f"unknown operator or type: {c.operator}, {c.kind}")
    text = F.get_json_object(c.column, c.path) if c.path else F.col(c.column).cast("string")
    if c.operator == "not_null":
        return text.isNotNull()
    if c.operator == "bitmask_none":
        return text.try_cast("bigint").bitwiseAND(F.lit(int(c.value))) == 0
    typed = text.try_cast(_KINDS[c.kind])
    if c.operator == "ne_or_null":
        return text.isNull() | (typed != F.lit(c.value))
    return _COMPARE[c.operator](typed, F.lit(c.value).cast(_KINDS[c.kind]))


def holds(conditions: Sequence[Condition]) -> Column:
    """True where all conditions hold; no conditions always hold."""
    return F.coalesce(reduce(lambda a, b: a & b, [condition(c) for c in conditions], F.lit(True)), F.lit(False))


def authority(rules: Sequence[Rule]) -> tuple[Column, Column, Column]:
    """Rank, reason and score of the first rule that holds; null where none does."""
    rank, reason, score = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for r in reversed(rules):
        at = holds(r.conditions)
        own = F.lit(None).cast("double")
        if r.score:
            own = F.get_json_object(*r.score).try_cast("double") * (-1.0 if r.ascending else 1.0)
        rank, reason, score = F.when(at, r.rank).otherwise(rank), F.when(at, r.reason).otherwise(reason), F.when(at, own).otherwise(score)
    return rank, reason, score


def present(value: Column, sentinels: Sequence[float] = (), zero_is_missing: bool = False, minimum: float | None = None, absolute: bool = False) -> Column:
    """A double, null where the policy calls it missing: NaN, a sentinel, zero, or below the minimum (of its size, if ``absolute``)."""
    v = value.cast("double")
    ok = ~F.isnan(v)
    if sentinels:
        ok = ok & ~v.isin(*[float(s) for s in sentinels])
    if zero_is_missing:
        ok = ok & (v != 0)
    if minimum is not None:
        ok = ok & ((F.abs(v) if absolute else v) >= minimum)
    return F.when(ok, F.abs(v) if absolute else v)
