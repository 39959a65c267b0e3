"""Interest of systems: features of their members, weighted sum, rank; tags with evidence and hero choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.classify import clamp01, weighted_score
from skyloom.operators.hierarchy import dense_index
from skyloom.storage import Scratch

#: What a spectral class is worth.
CLASS_SCORES = {"O": 1.0, "B": 0.9, "A": 0.8, "F": 0.55, "G": 0.45, "K": 0.35, "M": 0.25, "L": 0.2, "T": 0.15, "Y": 0.1}
OTHER_CLASS = 0.1
#: Limits of a pleasant planet.
NICE = {"confidence": 0.8, "mass": (0.3, 8.0), "eccentricity": 0.35, "temperature": (180.0, 350.0), "insolation": (0.35, 1.70)}
FEATURES = ("luminosity", "proper_motion", "multiplicity", "nice_planets", "weird_planets", "proximity", "complexity", "exotic")


def class_score(c: Column) -> Column:
    out = F.lit(OTHER_CLASS)
    for letter, score in CLASS_SCORES.items():
        out = F.when(c == letter, score).otherwise(out)
    return out


def nice_planet(confidence: Column, mass: Column, eccentricity: Column, temperature: Column, insolation: Column) -> Column:
    """A well-known planet of moderate mass and orbit, warm by its temperature or, lacking that, its insolation."""
    warm = F.when(temperature.isNotNull(), temperature.between(*NICE["temperature"])).otherwise(insolation.between(*NICE["insolation"]))
    return F.coalesce((confidence >= NICE["confidence"]) & mass.between(*NICE["mass"]) & (eccentricity <= NICE["eccentricity"]) & warm, F.lit(False))


def system_features(systems: DataFrame, stars: DataFrame, planets: DataFrame) -> DataFrame:
    """``system_id`` and ``FEATURES``, each in [0, 1], for every system.

    ``systems``: ``system_id, dist_ly``; ``stars``: ``system_id, class, pm, exotic``; ``planets``: ``system_id, nice, weird``.
    Sums of proper motions are taken in millionths as integers, so that their order does not matter.
    """
    pm = F.round(F.col("pm") * 1e6).cast("long")
    s = stars.groupBy("system_id").agg(
        F.count("*").alias("n_stars"), F.max(class_score(F.col("class"))).alias("light"), (F.sum(pm) / F.count("pm") / 1e6).alias("motion"), F.max("exotic").alias("odd")
    )
    p = planets.groupBy("system_id").agg(F.count("*").alias("n_planets"), F.count_if("nice").alias("n_nice"), F.count_if("weird").alias("n_weird"))
    top = s.agg(F.max("motion").alias("top"))
    x = systems.select("system_id", "dist_ly").join(s, "system_id", "left").join(p, "system_id", "left").crossJoin(F.broadcast(top))
    zero = lambda c: F.coalesce(c, F.lit(0))
    n, k, nice, weird = (zero(F.col(c)) for c in ("n_stars", "n_planets", "n_nice", "n_weird"))
    near = F.coalesce("dist_ly", F.lit(10000.0)) / 20
    together = (F.log(1 + n) / F.log(F.lit(5.0)) + F.log(1 + k) / F.log(F.lit(11.0))) / 2 + F.when((n >= 2) & (k >= 1), 0.1).otherwise(0.0) + F.when((nice > 0) & (weird > 0), 0.1).otherwise(0.0)
    return x.select(
        "system_id", F.coalesce("light", F.lit(0.0)).alias("luminosity"), F.coalesce(F.col("motion") / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0)).alias("proper_motion"),
        (F.least(F.greatest(n - 1, F.lit(0)), F.lit(4)) / 4.0).alias("multiplicity"), (F.least(nice, F.lit(3)) / 3.0).alias("nice_planets"), (F.least(weird, F.lit(3)) / 3.0).alias("weird_planets"),
        (1 / (1 + near * near)).alias("proximity"), F.least(together, F.lit(1.0)).alias("complexity"), clamp01(F.coalesce("odd", F.lit(0.0))).alias("exotic"),
    )


def rank_systems(features: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``system_id, score, rank``: by the weighted sum (to nine digits), then by id, without a one-partition window."""
    if set(weights) != set(FEATURES):
        raise ValueError(f"weights must name {FEATURES}")
    total = weighted_score({f: (F.col(f), w) for f, w in weights.items()})
    s = features.select("system_id", F.round(100 * total, 6).alias("score"), (-F.round(total, 9)).alias("_order"))
    ranked = dense_index(Scratch(features.sparkSession, "interest"), s, "_order", "system_id", name="rank")
    return ranked.select("system_id", "score", (F.col("rank") + 1).alias("rank"))


#: Bit of each evidence status, and the claim mode it speaks for.
STATUS_BITS = {"source": 1, "accepted": 1, "derived": 2, "assumed": 4, "screen": 8, "candidate": 16, "ambiguous": 32, "quarantined": 64, "missing": 128, "source_model": 256}
CLAIM_MODES = {"source": "accepted", "accepted": "accepted", "derived": "derived", "source_model": "modeled", "screen": "modeled", "assumed": "candidate", "candidate": "candidate"}


def status_bit(status: Column) -> Column:
    out = F.lit(0)
    for s, bit in STATUS_BITS.items():
        out = F.when(F.lower(F.trim(status)) == s, bit).otherwise(out)
    return out


def claim_mode(status: Column, configured: Column | None = None) -> Column:
    """What kind of claim a tag with this status is; a configured mode other than ``evidence_bound`` stands."""
    mode = F.lit("disputed")
    for s, m in CLAIM_MODES.items():
        mode = F.when(F.lower(F.trim(status)) == s, m).otherwise(mode)
    return mode if configured is None else F.when(configured != "evidence_bound", configured).otherwise(mode)


#: Order of claim modes, and how many tags of a family one system may show.
MODE_RANK = {"observed": 0, "accepted": 1, "derived": 2, "likely": 3, "modeled": 4}
FAMILY_LIMITS = {"architecture": 1, "exceptional_science": 2, "planet_environment": 1}
HERO_TAGS = 4


def hero_candidates(assigned: DataFrame, definitions: DataFrame, total_systems: int) -> DataFrame:
    """Scored tags per system: ``system_id, tag, score, family, grp``.

    ``assigned``: ``system_id, tag, target_type, target_key, status, confidence``; ``definitions`` (a fixed policy):
    ``tag, base_interest, rarity_weight, specificity, concept, family, grp``. The best assignment of a tag counts: by claim
    mode, confidence (a missing one is 0.5), type and key of its target. Disputed and candidate claims do not show.
    """
    mode = claim_mode(F.col("status"))
    rank = F.lit(None).cast("int")
    for m, r in MODE_RANK.items():
        rank = F.when(mode == m, r).otherwise(rank)
    rows = assigned.withColumns({"_mode": mode, "_rank": rank}).where(F.col("_rank").isNotNull())
    order = F.struct("_rank", (-F.coalesce("confidence", F.lit(0.5))).alias("c"), "target_type", "target_key", "_mode")
    best = rows.groupBy("system_id", "tag").agg(F.min(order).alias("b"))
    often = assigned.select("system_id", "tag").distinct().groupBy("tag").agg(F.count("*").alias("_n"))
    x = best.join(F.broadcast(definitions), "tag").join(F.broadcast(often), "tag")
    direct, m = F.col("b.target_type") == "system", F.col("b._mode")
    share = F.greatest(F.lit(1.0 / max(total_systems, 1)), F.col("_n") / float(max(total_systems, 1)))
    rare = F.least(F.lit(28.0), F.bround(-F.log10(share) * F.col("rarity_weight"), 0))
    score = F.col("base_interest") + rare + 2 * F.col("specificity") + F.when(direct, 8).otherwise(3) + F.when(F.col("concept"), 4).otherwise(0) - F.when(m == "modeled", 8).when(m == "derived", 2).otherwise(0)
    return x.select("system_id", "tag", F.bround(score, 0).cast("int").alias("score"), "family", "grp")


def catalog_assessment(n_rows: Column, matched: Column, coverage_pct: Column, reliability: Column) -> tuple[Column, Column]:
    """Composite of a catalog (0 to 100: half coverage, three tenths overlap, two tenths reliability) and its tier."""
    overlap = F.coalesce(F.round(matched / F.nullif(n_rows, F.lit(0)) * 100, 2), F.lit(0.0))
    composite = F.round((0.5 * coverage_pct / 100 + 0.3 * overlap / 100 + 0.2 * reliability) * 100, 2)
    tier = (
        F.when(n_rows == 0, "meh").when((overlap >= 20) & (coverage_pct >= 65), "indispensable").when((overlap >= 8) & (coverage_pct >= 55), "strong")
        .when(coverage_pct >= 45, "situational").otherwise("meh")
    )
    return composite, tier


#: Issue, severity, addition per further case, its limit.
ISSUES = (("repeated_key", 100, 5, 40), ("gaia_conflict", 85, 5, 20), ("hip_conflict", 65, 5, 20), ("hd_conflict", 55, 5, 20), ("name_conflict", 20, 2, 20), ("partial_hierarchy", 45, 0, 0))


def severity(counts: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Score, queue and label of the issues of one object; ``counts`` maps the names of ``ISSUES`` to how often each occurs."""
    score, kinds = F.lit(0), F.lit(0)
    for name, base, each, most in ISSUES:
        if name in counts:
            n = F.coalesce(counts[name].cast("int"), F.lit(0))
            score = score + F.when(n > 0, base + F.least(F.lit(most), n * each)).otherwise(0)
            kinds = kinds + (n > 0).cast("int")
    queue = F.when((score >= 100) | (kinds >= 2), "adjudication").when(score >= 40, "review").otherwise("watch")
    return score, queue, F.when(score >= 120, "high").when(score >= 50, "medium").otherwise("low")


def element_richness(feh: Column) -> tuple[Column, Column]:
    """Score in [0, 1] and class from the metallicity of the host; null and ``unknown`` without one."""
    score = clamp01((F.least(F.greatest(feh, F.lit(-0.8)), F.lit(0.6)) + 0.8) / 1.4)
    name = F.when(feh.isNull(), "unknown").when(feh < -0.4, "very_low").when(feh < -0.2, "low").when(feh < 0.1, "moderate").when(feh < 0.3, "high").otherwise("very_high")
    return F.when(feh.isNotNull(), score), name


def habitability(similarity: Column, habitable: Column) -> Column:
    """A similarity index within [0, 1], else 0.9 or 0.75 by the habitability class (2 and 1), else null."""
    return F.coalesce(F.when(similarity.between(0.0, 1.0), similarity), F.when(habitable >= 2, 0.9).when(habitable >= 1, 0.75))
