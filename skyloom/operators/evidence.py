"""Selection of one coherent set of facts per object, and checks on the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_sets(sets: DataFrame, key: str | list[str], set_id: str, *order: Column) -> DataFrame:
    """``key, set_id, runner_up, n_sets``: the first set per object in ``order``, then by id, and the next one.

    The rank limit of two is applied map-side and the count is combined there, so no object's sets meet in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order, F.col(set_id))
    two = sets.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    at = lambda n: F.max(F.when(F.col("_rn") == n, F.col(set_id)))
    counts = sets.groupBy(*keys).agg(F.count("*").alias("n_sets"))
    return two.groupBy(*keys).agg(at(1).alias(set_id), at(2).alias("runner_up")).join(counts, keys)


def select_facts(facts: DataFrame, selected: DataFrame, key: str, set_id: str) -> DataFrame:
    """All facts of the winning sets."""
    return facts.join(selected.select(key, set_id), [key, set_id], "left_semi")


def integrity(checks: dict[str, DataFrame]) -> DataFrame:
    """``check_name, n_bad`` for frames that must be empty."""
    each = [df.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check_name"), "n_bad") for name, df in sorted(checks.items())]
    return reduce(lambda a, b: a.unionByName(b), each)


def require_clean(report: DataFrame) -> None:
    """Raises with the failed checks; the report has one row per check."""
    bad = {r["check_name"]: r["n_bad"] for r in report.where("n_bad > 0").collect()}
    if bad:
        raise ValueError(f"integrity checks failed: {bad}")


def interval(value: Column, minus: Column, plus: Column) -> tuple[Column, Column]:
    """Lower and upper bound from a value and its uncertainties; a missing side has no bound."""
    return value - F.abs(minus), value + F.abs(plus)
