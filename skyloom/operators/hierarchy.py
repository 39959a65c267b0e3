"""Parent-child links to full hierarchies with Euler tours and list ranking.

Leaves are peeled off first. The chains of the inner nodes are followed to
their tops by pointer jumping (``chase``), which peels twice as many levels each
round; what reaches no top lies on a cycle or below one. Over the inner nodes of the remaining
trees an Euler tour is linked with equi joins only, each enter mark
carrying the weight of its leaves, and parallel list ranking (``chase`` again)
turns it into entry and exit numbers. Those give depth, root, leaf counts, and by
containment of intervals ancestors and descendants.

Scale: ids are dense longs; a round of ``chase`` is one shuffle join on them over
written tables, only rows not yet at their end are carried on, and there are
log2(longest chain) rounds until so few rows are open that one task can follow
them. Siblings are ordered by one global range sort, so a parent with a third of
all children is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.storage import Scratch

MAX_ROUNDS = 64  # 2**64 levels or nodes; reaching it means a fault, which is raised
#: Open rows (of some longs each) that one task follows to their ends; more are followed in shuffle rounds.
BLOCK_ROWS = 200_000


def _any(df: DataFrame, condition: Column) -> bool:
    return not df.where(condition).select(F.lit(1)).isEmpty()


def _follow(sums: list[str]):
    """Follows all chains within one block of rows ``e, nxt, tail, *sums``; a row with a tail is an end."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        # A row that was met at its end counts before the same row still open.
        rows = rows.sort_values(["e", "tail"], na_position="last").drop_duplicates("e")
        e = rows["e"].to_numpy("int64")
        end = rows["tail"].notna().to_numpy()
        nxt = rows["nxt"].fillna(-1).to_numpy("int64")
        to = np.minimum(np.searchsorted(e, nxt), max(len(e) - 1, 0))
        to = np.where(end, np.arange(len(e)), to)
        total = rows[sums].to_numpy("int64") if sums else np.zeros((len(e), 0), "int64")
        way = np.where(end[:, None], 0, total)
        for _ in range(max(len(e), 1).bit_length() + 1):
            way = way + way[to]
            to = to[to]
        reached = end[to]
        out = pd.DataFrame({"e": e, "tail": pd.array(np.where(reached, rows["tail"].fillna(-1).to_numpy("int64")[to], -1), "Int64")})
        out.loc[~reached, "tail"] = pd.NA
        for i, c in enumerate(sums):
            out[c] = np.where(reached, way[:, i] + total[to, i], 0)
        yield out

    return solve


def chase(scratch: Scratch, marks: DataFrame, sums: list[str], block: int = BLOCK_ROWS) -> DataFrame:
    """Follows every chain of ``marks`` (``e``, unique; ``nxt``, another ``e`` or null at an end; long ``sums``) to its end.

    ``e, tail, *sums``: the end of the chain and the sums from the mark to the end, both included;
    a null tail (and sums of no meaning) where the chain runs into a cycle.
    """
    marks = scratch.write(marks.select("e", "nxt", *[F.col(c).cast("long").alias(c) for c in sums]))
    done = [marks.where("nxt IS NULL").select("e", F.col("e").alias("tail"), *sums)]
    open_ = marks.where("nxt IS NOT NULL")
    n, last = open_.count(), None
    for _ in range(MAX_ROUNDS):
        if n == 0 or n == last:
            break  # no chain came to its end in a whole round: the rest circles
        ended = reduce(lambda a, b: a.unionByName(b), done)
        if n <= block:
            met = F.broadcast(open_).withColumnsRenamed({c: f"_{c}" for c in sums}).withColumnRenamed("e", "_e").join(ended.withColumnRenamed("e", "nxt"), "nxt")
            met = scratch.write(met.select(F.col("_e").alias("e"), F.lit(None).cast("long").alias("nxt"), "tail", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums]))
            rows = met.unionByName(open_.withColumn("tail", F.lit(None).cast("long"))).coalesce(1)
            schema = ", ".join(["e long", "tail long", *[f"{c} long" for c in sums]])
            return ended.unionByName(scratch.write(rows.mapInPandas(_follow(sums), schema)))
        far = open_.select(F.col("e").alias("nxt"), F.col("nxt").alias("n2"), F.lit(None).cast("long").alias("tail"), *[F.col(c).alias(f"_{c}") for c in sums])
        near = ended.select(F.col("e").alias("nxt"), F.lit(None).cast("long").alias("n2"), "tail", *[F.col(c).alias(f"_{c}") for c in sums])
        step = open_.join(far.unionByName(near), "nxt").select("e", F.col("n2").alias("nxt"), "tail", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])
        step = scratch.write(step)
        done.append(step.where("nxt IS NULL").select("e", "tail", *sums))
        open_ = step.where("nxt IS NOT NULL").select("e", "nxt", *sums)
        last, n = n, open_.count()
    else:
        raise RuntimeError("chains did not end")
    return reduce(lambda a, b: a.unionByName(b), [*done, open_.select("e", F.lit(None).cast("long").alias("tail"), *sums)])


def _tagged(k: int):
    return lambda i: F.struct(F.lit(k).alias("k"), i.cast("bigint").alias("i"))


#: Blocks of ``contained`` are powers of 2**RADIX_BITS wide.
RADIX_BITS = 4


def contained(points: DataFrame, spans: DataFrame, tree: str, at: str, low: str, high: str) -> DataFrame:
    """Pairs of points and spans of the same ``tree`` with ``low < at < high``, by equi joins only.

    A span is cut into aligned blocks of the powers of 16, at most 30 of each; a
    point lies in one block of each power that is no wider than the widest span. No
    tree, however large, is compared pair by pair, and trees without a span
    drop out first. Column names of the two sides must differ but for ``tree``.
    """
    widest = spans.agg(F.max(F.col(high) - F.col(low)).alias("w")).first()["w"] or 1
    levels = range(max(int(widest), 1).bit_length() // RADIX_BITS + 1)
    radix = 1 << RADIX_BITS
    blocks = []
    for k in levels:
        size = 1 << (RADIX_BITS * k)
        a, b = F.expr(f"shiftright(`{low}` + {size}, {RADIX_BITS * k})"), F.expr(f"shiftright(`{high}`, {RADIX_BITS * k})")  # the whole blocks of this width in the span: [a, b)
        up, down = F.ceil(a / radix) * radix, F.floor(b / radix) * radix  # those of the next width: [up, down)
        run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
        mine = F.when(up > down, run(a, b)).otherwise(F.concat(run(a, up), run(down, b)))
        blocks.append(F.transform(mine, _tagged(k)))
    cut = spans.withColumn("_b", F.explode(F.flatten(F.array(*blocks)))).select("*", F.col("_b.k").alias("_k"), F.col("_b.i").alias("_i")).drop("_b")
    near = points.join(spans.select(tree).distinct(), tree, "left_semi")
    places = near.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in levels]))).withColumn("_i", F.expr(f"shiftright(`{at}`, {RADIX_BITS} * _k)"))
    return places.join(cut, [tree, "_k", "_i"]).drop("_k", "_i")


def dense_index(scratch: Scratch, df: DataFrame, *order: str, name: str = "g") -> DataFrame:
    """``df`` sorted by ``order`` with a dense 0-based long index, without a one-partition window.

    Rows are range-sorted and written once; the driver sees one count per partition.
    """
    sorted_ = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    marked = scratch.write(sorted_.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    counts = sorted((r["_p"], r["n"], r["low"]) for r in marked.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("low")).collect())
    offsets, total = [], 0
    for p, n, low in counts:
        offsets.append((p, total - low))
        total += n
    shift = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p int, _shift long")
    return marked.join(F.broadcast(shift), "_p").withColumn(name, F.col("_m") + F.col("_shift")).drop("_p", "_m", "_shift")


class Forest:
    """The hierarchy of nodes and links: ``places`` has a row per distinct node key.

    Null keys and links with an end that is no node are left out; repeated
    nodes and links count once; a link from a node to itself is a cycle. A node
    with several parents, none on or below a cycle, hangs below the smallest
    parent key.

    ``places``: ``key, root, depth`` (int), ``entry, exit`` (long; a node is
    below another of the same root iff its entry lies strictly within the
    other's interval), ``parent``. On or below a cycle: root '', depth -1, null
    intervals, null parent. ``n_leaves``: the leaves at or below it. Empty tables give no rows.
    """

    def __init__(self, nodes: DataFrame, links: DataFrame, node: str, parent: str, child: str, block: int = BLOCK_ROWS):
        self.block = block
        self.scratch = Scratch(nodes.sparkSession, "forest")
        write = self.scratch.write
        keys = nodes.select(F.col(node).alias("key")).where("key IS NOT NULL").distinct()
        self.ids = write(keys.withColumn("id", F.monotonically_increasing_id()))
        ends = links.select(F.col(parent).alias("pk"), F.col(child).alias("ck")).where("pk IS NOT NULL AND ck IS NOT NULL")
        ids = self.ids
        # Repeated links are dropped as pairs of longs, after the joins on text keys.
        both = ends.join(ids.select(F.col("key").alias("ck"), F.col("id").alias("c")), "ck").select("pk", "c").join(ids.select(F.col("key").alias("pk"), F.col("id").alias("p")), "pk")
        self.links = write(both.select("p", "c").distinct())
        self.tree = self._peel()
        self.places = self._tour()

    def _peel(self) -> DataFrame:
        """The good links ``p, c``, one per child, and in ``self.bad`` the nodes on or below a cycle.

        Leaves are peeled first: their place is that of their parent. Inner
        nodes with one parent jump upwards until a top; a node with several
        parents is a junction and a top of its own, settled once the tops of all
        its parents are.
        """
        write, links = self.scratch.write, self.links
        degree = write(links.groupBy("c").agg(F.count("*").alias("n"), F.min("p").alias("p")))
        several = degree.where("n > 1")
        if not several.isEmpty():
            # Of several parents the one with the smallest key.
            named = links.join(several.select("c", "n"), "c").join(self.ids.select(F.col("id").alias("p"), "key"), "p")
            named = named.groupBy("c").agg(F.max("n").alias("n"), F.min(F.struct("key", "p"))["p"].alias("p"))
            degree = degree.where("n = 1").unionByName(write(named))
        inner = links.select(F.col("p").alias("v")).distinct()
        # Tops are roots (no parent) and junctions.
        start = inner.join(degree.withColumnRenamed("c", "v"), "v", "left")
        state = chase(self.scratch, start.select(F.col("v").alias("e"), F.when(F.col("n") == 1, F.col("p")).alias("nxt")), [], self.block)
        # Junctions: peel those whose parents' tops are all good, until nothing changes.
        circling = state.where("tail IS NULL").select(F.col("e").alias("v"))
        tops = state.where("tail IS NOT NULL").select(F.col("e").alias("v"), F.col("tail").alias("top"))
        # Leaves with several parents are junctions too.
        multi = degree.where("n > 1").select(F.col("c").alias("j"))
        arcs = links.join(multi.withColumnRenamed("j", "c"), "c", "left_semi").select(F.col("c").alias("j"), F.col("p").alias("v"))
        place = tops.unionByName(circling.withColumn("top", F.lit(-1).cast("long")))
        arcs = write(arcs.join(place, "v").select("j", "top").distinct())
        pending = write(arcs.join(multi.withColumnRenamed("j", "top"), "top", "left_semi").select("j", "top").unionByName(arcs.where("top = -1")).distinct())
        # One round per level of junctions that hang below each other, as every parent counts; trees need none.
        n = pending.count()
        while n:
            # A junction stays while one of its tops is circling or a junction that stays.
            stays = pending.select(F.col("j").alias("top")).distinct()
            new = write(pending.where("top = -1").unionByName(pending.where("top <> -1").join(stays, "top", "left_semi").select("j", "top")))
            m = new.count()
            self.scratch.drop(pending)
            pending = new
            if m == n:
                break
            n = m
        junction_bad = pending.select("j").distinct()
        bad_tops = junction_bad.withColumnRenamed("j", "top")
        bad_inner = circling.unionByName(tops.join(bad_tops, "top", "left_semi").select("v")).unionByName(junction_bad.withColumnRenamed("j", "v")).distinct()
        bad_inner = write(bad_inner)
        below = links.join(bad_inner.withColumnRenamed("v", "p"), "p", "left_semi").select(F.col("c").alias("v"))
        self.bad = write(bad_inner.unionByName(below).distinct())
        good = degree.select("p", "c").join(self.bad.withColumnRenamed("v", "c"), "c", "left_anti")
        return write(good.select("p", "c"))

    def _tour(self) -> DataFrame:
        """Entry, exit, depth, root and leaves of every node by list ranking over the inner nodes.

        Mark 2v enters node v and 2v+1 leaves it. The leaves of v come right
        behind its enter mark, which has their weight. ``w`` counts marks, ``b`` balances
        them and ``l`` counts leaves from a mark to the end of its tour, which ends by leaving the root.
        """
        write = self.scratch.write
        inner = self.tree.select(F.col("p").alias("c")).distinct().withColumn("inner", F.lit(True))
        kinds = self.tree.join(inner, "c", "left").select("p", "c", F.coalesce("inner", F.lit(False)).alias("inner"))
        order = write(dense_index(self.scratch, kinds, "p", "inner", "c"))
        family = write(order.groupBy("p").agg(F.min("g").alias("first"), F.count_if(~F.col("inner")).alias("leaves"), F.count("*").alias("n")))
        child = order.where("inner").select("p", "c", "g")
        # Inner children follow the leaves of the same parent, so the next place holds the next one.
        ahead = child.select(F.col("p").alias("np"), F.col("c").alias("nc"), (F.col("g") - 1).alias("g"))
        after = child.join(ahead, "g", "left").select(F.col("c").alias("v"), F.when(F.col("np") == F.col("p"), F.col("nc") * 2).otherwise(F.col("p") * 2 + 1).alias("after"))
        eldest = family.where("leaves < n").select(F.col("p").alias("v"), (F.col("first") + F.col("leaves")).alias("g")).join(child.select("c", "g"), "g").select("v", (F.col("c") * 2).alias("into"))
        nodes = family.select(F.col("p").alias("v"), "leaves").join(eldest, "v", "left").join(after, "v", "left")
        both = F.array(
            F.struct((F.col("v") * 2).alias("e"), F.coalesce("into", F.col("v") * 2 + 1).alias("nxt"), (1 + 2 * F.col("leaves")).alias("w"), F.lit(1).cast("long").alias("b"), F.col("leaves").alias("l")),
            F.struct((F.col("v") * 2 + 1).alias("e"), F.col("after").alias("nxt"), F.lit(1).cast("long").alias("w"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("l")),
        )
        ranked = chase(self.scratch, nodes.select(F.inline(both)), ["w", "b", "l"], self.block)
        if _any(ranked, F.col("tail").isNull()):
            raise RuntimeError("a tour does not end")
        # Back to nodes: one row per inner node from its two marks; root by the mark that ends its tour.
        mark = ranked.select(F.expr("e div 2").alias("id"), (F.col("e") % 2 == 0).alias("enter"), "w", "b", "l", F.expr("tail div 2").alias("r"))
        at = lambda c, enter: F.max(F.when(F.col("enter") == enter, F.col(c)))
        per = mark.groupBy("id").agg(at("w", True).alias("we"), at("w", False).alias("wx"), (-at("b", True)).alias("d"), (at("l", True) - at("l", False)).alias("n_leaves"), F.max("r").alias("r"))
        whole = per.where("id = r").select("r", F.col("we").alias("size")).join(self.ids.select(F.col("id").alias("r"), F.col("key").alias("root")), "r")
        tops = write(per.join(whole, "r").select("id", "root", "d", (F.col("size") - F.col("we")).alias("entry"), (F.col("size") - F.col("wx")).alias("exit"), "n_leaves"))
        above = tops.join(family.select(F.col("p").alias("id"), "first"), "id").select(F.col("id").alias("up"), "root", "d", "entry", "first")
        leaf = order.where("NOT inner").select(F.col("p").alias("up"), F.col("c").alias("id"), "g").join(above, "up")
        start = F.col("entry") + 1 + 2 * (F.col("g") - F.col("first"))
        leaf = leaf.select("id", "root", (F.col("d") + 1).alias("d"), start.alias("entry"), (start + 1).alias("exit"), F.lit(1).cast("long").alias("n_leaves"), "up")
        parents = self.tree.join(inner, "c", "left_semi").select(F.col("c").alias("id"), F.col("p").alias("up"))
        placed = leaf.unionByName(tops.join(parents, "id", "left").select(leaf.columns))
        bad = self.bad.select(F.col("v").alias("id"), F.lit(True).alias("bad"))
        every = self.ids.join(placed, "id", "left").join(bad, "id", "left")
        alone, cyclic = F.col("root").isNull(), F.coalesce(F.col("bad"), F.lit(False))
        pick = lambda single, value: F.when(cyclic, F.lit(None)).when(alone, F.lit(single)).otherwise(value).cast("long")
        return every.select(
            "id", "key",
            F.when(cyclic, F.lit("")).when(alone, F.col("key")).otherwise(F.col("root")).alias("root"),
            F.when(cyclic, F.lit(-1)).when(alone, F.lit(0)).otherwise(F.col("d")).cast("int").alias("depth"),
            pick(0, F.col("entry")).alias("entry"), pick(1, F.col("exit")).alias("exit"), pick(1, F.col("n_leaves")).alias("n_leaves"),
            F.when(~cyclic, F.col("up")).alias("up"),
        )

    def paths(self, separator: str = "/") -> DataFrame:
        """``key, path`` from the root down, joined by ``separator``; null on or below a cycle.

        Inner nodes double their known part of the path each round; leaves take
        their parent's path at the end.
        """
        write = self.scratch.write
        good = write(self.places.where("depth >= 0").select("id", "key", "up"))
        inner = good.select(F.col("up").alias("id")).where("id IS NOT NULL").distinct()
        state = write(good.join(inner, "id", "left_semi").select("id", "up", F.col("key").alias("path")))
        for _ in range(MAX_ROUNDS):
            if not _any(state, F.col("up").isNotNull()):
                break
            above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
            new = write(state.join(above, "up", "left").select("id", F.col("up2").alias("up"), F.concat_ws(separator, "path2", "path").alias("path")))
            self.scratch.drop(state)
            state = new
        done = good.join(state.select(F.col("id").alias("up"), F.col("path").alias("above")), "up", "left")
        listed = done.select("key", F.concat_ws(separator, "above", "key").alias("path"))
        return listed.unionByName(self.places.where("depth < 0").select("key", F.lit(None).cast("string").alias("path")))

    def descendants(self) -> DataFrame:
        """``key, root, depth, entry, exit, descendants``: how many nodes hang below each.

        All nodes below one are those of its root with an entry between its entry and exit.
        """
        count = F.expr("(exit - entry - 1) div 2")
        return self.places.select("key", "root", "depth", "entry", "exit", count.alias("descendants"))

    def descendants_of(self, keys: DataFrame) -> DataFrame:
        """``key, descendant, depth`` (of the descendant) for the nodes in the first column of ``keys``; none for leaves and cycles."""
        spans = self._of(keys).select("root", F.col("key").alias("key"), F.col("entry").alias("low"), F.col("exit").alias("high"))
        points = self.places.where("depth >= 0").select("root", F.col("key").alias("descendant"), "depth", "entry")
        return contained(points, spans, "root", "entry", "low", "high").select("key", "descendant", "depth")

    def ancestors_of(self, keys: DataFrame) -> DataFrame:
        """``key, ancestor, depth`` (of the ancestor) for the nodes in the first column of ``keys``; none for roots and cycles."""
        points = self._of(keys).select("root", "key", "entry")
        spans = self.places.where("depth >= 0 AND exit > entry + 1").select("root", F.col("key").alias("ancestor"), "depth", F.col("entry").alias("low"), F.col("exit").alias("high"))
        return contained(points, spans, "root", "entry", "low", "high").select("key", "ancestor", "depth")

    def _of(self, keys: DataFrame) -> DataFrame:
        asked = keys.select(F.col(keys.columns[0]).alias("key")).where("key IS NOT NULL").distinct()
        return self.places.where("depth >= 0").join(asked, "key", "left_semi")
