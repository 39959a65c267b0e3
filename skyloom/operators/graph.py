"""Reachability, closures, components and bounded walks over edge tables.

Every loop is semi-naive: only the frontier of the last round is joined. Rounds
are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.storage import Scratch


def reachable(edges: DataFrame, seeds: DataFrame, src: str, dst: str, node: str, rounds: int | None = None) -> DataFrame:
    """``node, depth``: nodes reached from the seeds (depth 0) and the fewest links to each; cycles end by themselves."""
    scratch = Scratch(edges.sparkSession, "reach")
    links = scratch.write(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s IS NOT NULL AND d IS NOT NULL").distinct())
    seen = scratch.write(seeds.select(F.col(node).alias("n")).where("n IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    frontier, k = seen, 0
    while rounds is None or k < rounds:
        k += 1
        step = links.join(frontier.select(F.col("n").alias("s")), "s", "left_semi").select(F.col("d").alias("n")).distinct()
        new = scratch.write(step.join(seen.select("n"), "n", "left_anti").withColumn("depth", F.lit(k)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new) if k % 8 else scratch.write(seen.unionByName(new))
        frontier = new
    return seen.withColumnRenamed("n", node)


def walk_best(edges: DataFrame, seeds: DataFrame, src: str, dst: str, weight: str, node: str, depth: int = 8) -> DataFrame:
    """``root, node, confidence``: the best path of at most ``depth`` links, a path being worth its weakest link.

    Of the paths of one length to a node only the best is kept, so rounds don't multiply paths.
    """
    scratch = Scratch(edges.sparkSession, "walk")
    links = scratch.write(edges.groupBy(F.col(src).alias("s"), F.col(dst).alias("d")).agg(F.max(weight).alias("w")).where("s IS NOT NULL AND d IS NOT NULL"))
    frontier = seeds.select(F.col(node).alias("root")).distinct().select("root", F.col("root").alias("n"), F.lit(None).cast("double").alias("c"))
    found = None
    for _ in range(depth):
        step = frontier.join(links, F.col("n") == F.col("s")).select("root", F.col("d").alias("n"), F.least(F.coalesce("c", "w"), "w").alias("c"))
        frontier = scratch.write(step.groupBy("root", "n").agg(F.max("c").alias("c")))
        if frontier.isEmpty():
            break
        found = frontier if found is None else found.unionByName(frontier)
    if found is None:
        return frontier.select("root", F.col("n").alias(node), F.col("c").alias("confidence")).limit(0)
    return found.groupBy("root", "n").agg(F.max("c").alias("confidence")).withColumnRenamed("n", node)


def components(edges: DataFrame, a: str, b: str, node: str = "node") -> DataFrame:
    """``node, component``: the smallest node connected with each.

    Alternates large-star and small-star contractions, which end after a
    logarithmic number of rounds also on long chains; every star is reduced by
    aggregation, never collected.
    """
    scratch = Scratch(edges.sparkSession, "components")
    raw = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = scratch.write(raw.select("u").union(raw.select("v")).distinct())
    links = scratch.write(raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large)
        # Small star: a node's smaller neighbours and the node itself go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.write(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        done = small.count() == links.count() and small.join(links, ["u", "v"], "left_anti").isEmpty()
        links = small
        if done:
            break
    out = nodes.join(links.groupBy("u").agg(F.min("v").alias("m")), "u", "left")
    return out.select(F.col("u").alias(node), F.coalesce("m", "u").alias("component"))


def leaves(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Nodes that are a child but no parent."""
    return edges.select(F.col(child).alias("node")).distinct().join(edges.select(F.col(parent).alias("node")).distinct(), "node", "left_anti")
