"""Rule-driven tags: a registry of evaluators, member-to-group rollup, status guards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A tag given where an evaluator's condition on one column holds."""

    tag: str
    evaluator: str
    column: str
    params: dict


EVALUATORS: dict[str, Callable[[Column, dict], Column]] = {
    "at_least": lambda c, p: c >= p["value"],
    "at_most": lambda c, p: c <= p["value"],
    "between": lambda c, p: (c >= p["low"]) & (c < p["high"]),
    "one_of": lambda c, p: c.isin(*p["values"]),
    "bit": lambda c, p: c.bitwiseAND(p["mask"]) != 0,
    "matches": lambda c, p: c.rlike(p["pattern"]),
    "equals": lambda c, p: c == p["value"],
    "above_to": lambda c, p: (c > p["low"]) & (c <= p["high"]),
    "class_in": lambda c, p: F.upper(F.trim(c)).isin(*p["values"]),
    # Of objects whose status is one of those allowed; a missing one is the first.
    "below": lambda c, p: (c < p["value"]) & F.lower(F.coalesce(F.col(p["status"]), F.lit(p["allowed"][0]))).isin(*p["allowed"]),
}


def evaluate(objects: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """``key, tag``: all rules in one pass over the objects; an unknown evaluator or a repeated tag is an error.

    A null column gives no tag.
    """
    unknown = {r.evaluator for r in rules} - set(EVALUATORS)
    if unknown or len({r.tag for r in rules}) != len(rules):
        raise ValueError(f"unknown evaluators {sorted(unknown)} or repeated tags")
    tags = F.array_compact(F.array(*[F.when(EVALUATORS[r.evaluator](F.col(r.column), r.params), F.lit(r.tag)) for r in rules]))
    return objects.select(key, F.explode(tags).alias("tag"))


def rollup(assigned: DataFrame, members: DataFrame, member: str, group: str) -> DataFrame:
    """``group, tag, n_members, first_member``: tags of members on their group."""
    return assigned.join(members.select(member, group), member).groupBy(group, "tag").agg(F.countDistinct(member).alias("n_members"), F.min(member).alias("first_member"))


def require_known(df: DataFrame, column: str, allowed: list[str]) -> None:
    """Raises with an example if a status outside the allowed ones occurs."""
    bad = df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).select(column).limit(1).collect()
    if bad:
        raise ValueError(f"unknown {column}: {bad[0][0]!r}")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    """Raises with an example if a key occurs twice."""
    bad = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"repeated key {bad[0].asDict()}")


def representation(groups: dict[str, DataFrame], key: str) -> DataFrame:
    """``key, policies``: which policies keep each object, as an ordered list; a union of key sets in one aggregation."""
    both = reduce(lambda a, b: a.unionByName(b), [df.select(key).withColumn("_p", F.lit(name)) for name, df in sorted(groups.items())])
    return both.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("_p")), ",").alias("policies"))
