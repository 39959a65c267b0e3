"""Source rows to typed records: measurements with errors and limits, bundles, solutions, impact of changed sources."""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from skyloom.operators.relational import keep_one


@dataclass(frozen=True)
class Measure:
    """A quantity of a wide row with the columns of its errors, limit flag and reference; columns it lacks are None."""

    quantity: str
    value: str
    error_low: str | None = None
    error_high: str | None = None
    limit: str | None = None
    reference: str | None = None
    unit: str | None = None
    band: str | None = None


def unpivot_measures(df: DataFrame, ids: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """``ids, quantity_key, value, error_low, error_high, bound, reference, unit, band``: one row per measure that has a value.

    A single upper error stands for both sides. ``bound`` is lower, upper or null by the sign of the limit flag. All
    measures of a row come from one pass; a row with no value gives none.
    """
    pick = lambda c, kind: F.col(c).cast(kind) if c else F.lit(None).cast(kind)
    rows = [
        F.struct(
            F.lit(m.quantity).alias("quantity_key"), pick(m.value, "double").alias("value"), F.abs(F.coalesce(pick(m.error_low, "double"), pick(m.error_high, "double"))).alias("error_low"),
            F.abs(pick(m.error_high, "double")).alias("error_high"), F.when(pick(m.limit, "int") > 0, "upper").when(pick(m.limit, "int") < 0, "lower").alias("bound"),
            F.nullif(F.trim(pick(m.reference, "string")), F.lit("")).alias("reference"), F.lit(m.unit).cast("string").alias("unit"), F.lit(m.band).cast("string").alias("band"),
        )
        for m in measures
    ]
    return df.select(*ids, F.inline(F.filter(F.array(*rows), lambda r: r["value"].isNotNull() & ~F.isnan(r["value"]))))


def probability_bundle(df: DataFrame, key: str, models: dict[str, dict[str, str]], name: str = "bundle") -> DataFrame:
    """``key, name``: the published probabilities of each model as one JSON object per record; fails if one lies outside [0, 1].

    A model without any value is left out of the object; a record without any model gives no row.
    """
    values = [F.col(c) for m in models.values() for c in m.values()]
    outside = reduce(lambda a, b: a | b, [F.coalesce((v < 0) | (v > 1) | F.isnan(v.cast("double")), F.lit(False)) for v in values])
    each = {m: F.struct(*[F.col(c).cast("double").alias(label) for label, c in cols.items()]) for m, cols in models.items()}
    some = {m: reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols.values()]) for m, cols in models.items()}
    body = F.to_json(F.struct(*[F.when(some[m], s).alias(m) for m, s in each.items()]))
    checked = F.when(outside, F.raise_error(F.lit("a probability lies outside [0, 1]"))).otherwise(body)
    return df.where(reduce(lambda a, b: a | b, some.values())).select(key, checked.alias(name))


def best_solutions(solutions: DataFrame, key: str, type_rank: dict[str, int]) -> DataFrame:
    """One solution per object: most significant, then by the rank of its type (others last), shortest period, type name. ``n_solutions`` counts them all."""
    rank = F.lit(len(type_rank) + 1)
    for t, r in type_rank.items():
        rank = F.when(F.col("type") == t, r).otherwise(rank)
    counts = solutions.groupBy(key).agg(F.count("*").alias("n_solutions"))
    best = keep_one(solutions.withColumn("_rank", rank), [key], F.desc_nulls_last("significance"), F.col("_rank"), F.asc_nulls_last("period"), F.col("type"))
    return best.drop("_rank").join(counts, key)


def reconcile_orbits(orbits: DataFrame, reference: DataFrame, key: str, tolerance: float = 0.05) -> DataFrame:
    """``key, status, reason`` of solutions ``key, period, eccentricity`` against the accepted period of their pair.

    quarantined: an impossible orbit; excluded: no period, or no such pair; accepted: within the tolerance, or the pair has
    no period yet; else quarantined as a conflict.
    """
    r = reference.groupBy(key).agg(F.min("period").alias("_p"))
    j = orbits.join(r.withColumn("_known", F.lit(True)), key, "left")
    p, e = F.col("period"), F.col("eccentricity")
    impossible = (p <= 0) | (e < 0) | (e >= 1)
    near = F.abs(p - F.col("_p")) <= F.col("_p") * tolerance
    reason = (
        F.when(F.coalesce(impossible, F.lit(False)), "impossible").when(p.isNull(), "no_period").when(F.col("_known").isNull(), "no_pair").when(F.col("_p").isNull(), "first_period").when(near, "agrees").otherwise("conflict")
    )
    status = F.when(reason.isin("impossible", "conflict"), "quarantined").when(reason.isin("no_period", "no_pair"), "excluded").otherwise("accepted")
    return j.select(key, status.alias("status"), reason.alias("reason"))


def impact_plan(delta: DataFrame, lineage: DataFrame, full_share: float = 0.5) -> DataFrame:
    """``source, change, n_rows, plan``: how many distinct rows a changed source touches, and whether to rebuild in part.

    ``delta``: ``source, change`` (new, missing, changed); ``lineage``: ``source, row_id``. ``incremental`` unless a source is missing or its rows are
    more than ``full_share`` of all rows.
    """
    n = lineage.groupBy("source").agg(F.countDistinct("row_id").alias("n_rows"))
    total = n.agg(F.sum("n_rows").alias("_total"))
    out = delta.join(n, "source", "left").crossJoin(F.broadcast(total)).withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    full = (F.col("change") == "missing") | (F.col("n_rows") > full_share * F.coalesce("_total", F.lit(0)))
    return out.select("source", "change", "n_rows", F.when(full, "full").otherwise("incremental").alias("plan"))


def contributions(rows: DataFrame, object_key: str, source: str) -> DataFrame:
    """``object_key, n_sources, sources, main_source``: which sources say something about each object; the main one has most rows, then the smaller name."""
    per = rows.where(F.col(source).isNotNull()).groupBy(object_key, source).agg(F.count("*").alias("_n"))
    return per.groupBy(object_key).agg(
        F.count("*").alias("n_sources"), F.array_join(F.sort_array(F.collect_list(source)), ",").alias("sources"), F.min(F.struct((-F.col("_n")).alias("n"), source))[source].alias("main_source")
    )


def agreeing_mean(df: DataFrame, keys: list[str], value: Column, error: Column, tolerance: float = 0.1) -> DataFrame:
    """``keys, mean, mean_low, mean_high, n, agree``: inverse-variance mean with its bounds; ``agree`` if no value is further than the tolerance from it.

    Rows without a positive error have no weight and are left out.
    """
    w = 1 / (error * error)
    g = df.where((error > 0) & value.isNotNull()).groupBy(*keys).agg(F.sum(value * w).alias("_s"), F.sum(w).alias("_w"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("n"))
    mean, sigma = F.col("_s") / F.col("_w"), F.sqrt(1 / F.col("_w"))
    agree = F.greatest(F.abs(F.col("_hi") - mean), F.abs(mean - F.col("_lo"))) <= tolerance * F.abs(mean)
    return g.select(*keys, mean.alias("mean"), (mean - sigma).alias("mean_low"), (mean + sigma).alias("mean_high"), "n", agree.alias("agree"))


def nested_groups(places: DataFrame, stars: DataFrame) -> DataFrame:
    """Nodes below a root with at least two stars directly under them: groups within a system, as ``root, key, n_stars``.

    ``places``: ``key, root, depth, parent``; ``stars``: ``key``.
    """
    under = places.where("depth > 0 AND parent IS NOT NULL").join(stars.select("key").distinct(), "key", "left_semi").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_stars"))
    return places.where("depth > 0").select("key", "root").join(under.where("n_stars >= 2"), "key")


def first_scope(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` keys in order: a deterministic scope for trial runs, to be semi-joined (a top-k, not a sort)."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n)


def json_shape(c: Column) -> tuple[Column, Column]:
    """The keys of a JSON object in order (null for other texts) and the type of the text: object, array, string, number, boolean, null."""
    t = F.trim(c)
    kind = F.when(t.startswith("{"), "object").when(t.startswith("["), "array").when(t.startswith('"'), "string").when(t.isin("true", "false"), "boolean").when(t == "null", "null").when(t.try_cast("double").isNotNull(), "number")
    return F.array_sort(F.json_object_keys(t)), kind


@F.pandas_udf(BinaryType())
def gzip_text(texts: pd.Series) -> pd.Series:
    """Texts as gzip bytes without a time stamp, so equal texts are equal bytes; null stays null."""
    return texts.map(lambda t: None if t is None else gzip.compress(t.encode(), mtime=0))


@F.pandas_udf(StringType())
def gunzip_text(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else gzip.decompress(b).decode())


def weight_changes(before: dict[str, float], after: dict[str, float], allowed: Iterable[str]) -> dict[str, tuple[float | None, float | None]]:
    """What differs between two weight profiles; an unknown name, a negative weight or no weight at all is an error."""
    for profile in (before, after):
        if set(profile) - set(allowed) or any(not w >= 0 for w in profile.values()) or not sum(profile.values()) > 0:
            raise ValueError(f"not a profile: {profile}")
    return {k: (before.get(k), after.get(k)) for k in sorted({*before, *after}) if before.get(k) != after.get(k)}
