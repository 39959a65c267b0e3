"""Positions: cross-match on binned sky, octree tiles with samples, public slices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import astro as A


def sky_crossmatch(left: DataFrame, right: DataFrame, max_arcsec: float, matched: DataFrame | None = None) -> DataFrame:
    """``left_id, right_id, sep_arcsec, dmag``: the nearest right position within ``max_arcsec`` of each left one.

    Inputs have ``id, ra, dec`` in degrees and, if both do, ``mag``. Positions are binned as unit vectors in a grid of
    cubes eight radii wide, so the sky has no seam at 0/360 degrees and no poles; a right position is copied to the cubes
    within a radius of it (two on average) and the match is an equi join on the cube. Ties of separation (to a
    thousandth of an arcsecond) fall to the smaller difference of magnitudes, a missing one last, then the smaller id. Left ids
    in the first column of ``matched`` are left out. Null positions match nothing.
    """
    both = "mag" in left.columns and "mag" in right.columns
    reach = 2 * math.sin(math.radians(max_arcsec / 3600) / 2) * (1 + 1e-9) + 1e-15
    size = 8 * reach
    mag = lambda df: F.col("mag").cast("double") if both else F.lit(None).cast("double")
    if matched is not None:
        left = left.join(matched.select(F.col(matched.columns[0]).alias("id")), "id", "left_anti")
    l = left.where("ra IS NOT NULL AND dec IS NOT NULL").select(F.col("id").alias("left_id"), F.col("ra").alias("a1"), F.col("dec").alias("d1"), mag(left).alias("m1"))
    r = right.where("ra IS NOT NULL AND dec IS NOT NULL").select(F.col("id").alias("right_id"), F.col("ra").alias("a2"), F.col("dec").alias("d2"), mag(right).alias("m2"))
    axes = ("bx", "by", "bz")
    for axis, v in zip(axes, A.cartesian(F.col("a1"), F.col("d1"), F.lit(1.0))):
        l = l.withColumn(axis, F.floor(v / size))
    for axis, v in zip(axes, A.cartesian(F.col("a2"), F.col("d2"), F.lit(1.0))):
        r = r.withColumn(axis, F.explode(F.sequence(F.floor((v - reach) / size), F.floor((v + reach) / size))))
    pairs = l.join(r, list(axes)).withColumn("sep_arcsec", A.separation_arcsec(F.col("a1"), F.col("d1"), F.col("a2"), F.col("d2"))).where(F.col("sep_arcsec") <= max_arcsec)
    dmag = F.abs(F.col("m1") - F.col("m2"))
    best = pairs.groupBy("left_id").agg(F.min(F.struct(F.round("sep_arcsec", 3).alias("s"), F.coalesce(dmag, F.lit(1e9)).alias("d"), "right_id", "sep_arcsec", dmag.alias("dmag"))).alias("b"))
    return best.select("left_id", F.col("b.right_id").alias("right_id"), F.col("b.sep_arcsec").alias("sep_arcsec"), F.col("b.dmag").alias("dmag"))


def octree_tiles(points: DataFrame, limit: int, depth: int, half: float = 1024.0) -> DataFrame:
    """Adaptive tiles: a cell of ``depth`` holds its points unless more than ``limit``, then they go one level down."""
    cells = A.with_octree_cells(points, {"up": depth - 1, "cell": depth, "down": depth + 1}, half=half)
    counts = cells.groupBy("cell").agg(F.count("*").alias("n_cell"))
    deep = F.col("n_cell") > limit
    out = cells.join(counts, "cell")
    return out.withColumns({
        "depth": F.when(deep, depth + 1).otherwise(depth),
        "tile": F.when(deep, F.col("down")).otherwise(F.col("cell")),
        "parent": F.when(deep, F.col("cell")).otherwise(F.col("up")),
    }).drop("cell", "n_cell", "up", "down")


def tile_sample(points: DataFrame, tile: str, score: str, key: str, each: int = 128) -> DataFrame:
    """Per tile the ``each`` best by score (ties: larger key) and the ``each`` of smallest mixed hash.

    Ranks are limited map-side, so a crowded tile sends few rows.
    """
    p = A.with_mixed_hash(points, key, "_h")

    def top(*order, basis: str) -> DataFrame:
        ranked = p.withColumn("_rn", F.row_number().over(Window.partitionBy(tile).orderBy(*order))).where(F.col("_rn") <= each)
        return ranked.select(tile, key, F.lit(basis).alias("basis"))

    a = top(F.desc_nulls_last(score), F.desc(key), basis="interest")
    b = top(F.asc("_h"), F.desc(key), basis="uniform")
    return a.unionByName(b).groupBy(tile, key).agg(F.min("basis").alias("basis"))
