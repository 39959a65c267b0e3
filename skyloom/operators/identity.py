"""Identity resolution: candidate methods by priority, outcomes, bindings, conflicts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_by_priority(candidates: list[DataFrame], subject: str, target: str) -> DataFrame:
    """``subject, target, priority, outcome``: the first method that finds anything decides.

    Method i is a frame of ``subject, target`` pairs. Exactly one distinct target
    of the best method is accepted, several are ambiguous (null target).
    """
    both = reduce(lambda a, b: a.unionByName(b), [c.select(subject, target).withColumn("priority", F.lit(i)) for i, c in enumerate(candidates)])
    per = both.where(F.col(target).isNotNull()).groupBy(subject, "priority").agg(F.min(target).alias("lo"), F.max(target).alias("hi"))
    best = per.groupBy(subject).agg(F.min(F.struct("priority", "lo", "hi")).alias("b"))
    single = F.col("b.lo") == F.col("b.hi")
    return best.select(subject, F.when(single, F.col("b.lo")).alias(target), F.col("b.priority").alias("priority"), F.when(single, "accepted").otherwise("ambiguous").alias("outcome"))


def canonical_key(*prefixed: tuple[str, Column]) -> Column:
    """The first identifier present, under its namespace."""
    return F.coalesce(*[F.when(c.isNotNull(), F.concat(F.lit(p), c.cast("string"))) for p, c in prefixed])


def binding_state(n_left: Column, n_right: Column, excluded: Column, conflicting: Column) -> Column:
    """Outcome of binding two releases of an object from its counts on either side."""
    return (
        F.when(excluded, "excluded").when(conflicting, "quarantined").when((n_left == 0) | (n_right == 0), "missing")
        .when((n_left == 1) & (n_right == 1), "accepted").when(n_left == 1, "ambiguous_split").when(n_right == 1, "ambiguous_merge").otherwise("ambiguous")
    )


def conflicts(rules: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """``rule, key, n``: keys that map to several values, per rule ``(frame, key, value)``."""
    each = []
    for name, (df, key, value) in sorted(rules.items()):
        g = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.countDistinct(value).alias("n")).where("n > 1")
        each.append(g.select(F.lit(name).alias("rule"), "key", "n"))
    return reduce(lambda a, b: a.unionByName(b), each)


def lifecycle_transition(before: Column, after: Column) -> Column:
    """How a status moved: retracted beats confirmed beats candidate beats controversial."""
    rank = lambda c: F.when(c == "confirmed", 3).when(c == "candidate", 2).when(c == "controversial", 1)
    return (
        F.when(after == "retracted", "retracted").when(before.isNull(), "new").when(after.isNull(), "gone").when(before == after, "unchanged")
        .when(rank(after) > rank(before), "promoted").otherwise("demoted")
    )


@dataclass(frozen=True)
class NodeRule:
    """How the rows of one source table become nodes: its name, its kind and the columns of its identifiers by namespace."""

    source: str
    kind: str
    key: str
    identifiers: dict[str, str]
    name: str | None = None


def source_nodes(tables: dict[str, DataFrame], rules: list[NodeRule]) -> DataFrame:
    """``node_key, source, kind, name, ids`` (namespace to identifier, blanks dropped) of all source tables in one union.

    Rows with a null key are left out; a key delivered again counts once, with the smallest name and its identifiers merged.
    """
    each = []
    for r in rules:
        # Every namespace of any rule has an entry, so that the frames align.
        ids = F.map_from_arrays(F.array(*[F.lit(n) for n in r.identifiers]), F.array(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in r.identifiers.values()]))
        rows = tables[r.source].where(F.col(r.key).isNotNull())
        each.append(rows.select(
            F.concat(F.lit(f"src:{r.source}:"), F.col(r.key).cast("string")).alias("node_key"), F.lit(r.source).alias("source"), F.lit(r.kind).alias("kind"),
            (F.col(r.name).cast("string") if r.name else F.lit(None).cast("string")).alias("name"), F.map_filter(ids, lambda k, v: v.isNotNull()).alias("ids"),
        ))
    both = reduce(lambda a, b: a.unionByName(b), each)
    spaces = sorted({n for r in rules for n in r.identifiers})
    merged = both.groupBy("node_key", "source", "kind").agg(F.min("name").alias("name"), *[F.min(F.try_element_at("ids", F.lit(n))).alias(f"_{i}") for i, n in enumerate(spaces)])
    ids = F.map_from_arrays(F.array(*[F.lit(n) for n in spaces]), F.array(*[F.col(f"_{i}") for i in range(len(spaces))]))
    return merged.select("node_key", "source", "kind", "name", F.map_filter(ids, lambda k, v: v.isNotNull()).alias("ids"))


@dataclass(frozen=True)
class EdgeRule:
    """Nodes of two kinds that share an identifier are related; ``unique`` joins only identifiers that occur once on either side."""

    relation: str
    left: str
    right: str
    namespace: str
    confidence: float
    tier: str
    unique: bool = False


def identity_edges(nodes: DataFrame, rules: list[EdgeRule]) -> DataFrame:
    """``left_key, right_key, relation, confidence, tier``: the best rule per pair of nodes (confidence, then relation).

    Every rule is an equi join on the identifier; a rule within one kind gives each pair once, smaller key first.
    """
    each = []
    for r in rules:
        value = F.try_element_at("ids", F.lit(r.namespace))
        side = lambda kind, name: nodes.where(F.col("kind") == kind).select(F.col("node_key").alias(name), value.alias("_v")).where("_v IS NOT NULL")
        a, b = side(r.left, "left_key"), side(r.right, "right_key")
        if r.unique:
            a, b = (x.groupBy("_v").agg(F.min(k).alias(k), F.count("*").alias("_n")).where("_n = 1").drop("_n") for x, k in ((a, "left_key"), (b, "right_key")))
        pairs = a.join(b, "_v").drop("_v")
        if r.left == r.right:
            pairs = pairs.where("left_key < right_key")
        each.append(pairs.select("left_key", "right_key", F.lit(r.relation).alias("relation"), F.lit(r.confidence).alias("confidence"), F.lit(r.tier).alias("tier")))
    both = reduce(lambda a, b: a.unionByName(b), each)
    best = both.groupBy("left_key", "right_key").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "relation", "tier")).alias("b"))
    return best.select("left_key", "right_key", F.col("b.relation").alias("relation"), (-F.col("b.c")).alias("confidence"), F.col("b.tier").alias("tier"))


def bridge_identifiers(nodes: DataFrame, via: str, to: str) -> DataFrame:
    """Nodes with the identifier ``to`` filled from others with the same ``via``, where those name exactly one ``to``."""
    at = lambda n: F.try_element_at("ids", F.lit(n))
    known = nodes.select(at(via).alias("_via"), at(to).alias("_to")).where("_via IS NOT NULL AND _to IS NOT NULL")
    single = known.groupBy("_via").agg(F.min("_to").alias("_to"), F.max("_to").alias("_hi")).where("_to = _hi").select("_via", "_to")
    out = nodes.withColumn("_via", at(via)).join(single, "_via", "left")
    fill = at(to).isNull() & F.col("_to").isNotNull()
    return out.withColumn("ids", F.when(fill, F.map_concat("ids", F.map_from_arrays(F.array(F.lit(to)), F.array("_to")))).otherwise(F.col("ids"))).drop("_via", "_to")


def canonical_objects(nodes: DataFrame, order: list[tuple[str, float]]) -> DataFrame:
    """``node_key, canonical_key, method, confidence``: the first namespace of ``order`` that the node has, else the node itself (0.5)."""
    at = lambda n: F.try_element_at("ids", F.lit(n))
    key, method, sure = F.concat(F.lit("node:"), F.col("node_key")), F.lit("node"), F.lit(0.5)
    for n, confidence in reversed(order):
        key, method, sure = F.when(at(n).isNotNull(), F.concat(F.lit(f"{n}:"), at(n))).otherwise(key), F.when(at(n).isNotNull(), n).otherwise(method), F.when(at(n).isNotNull(), confidence).otherwise(sure)
    return nodes.select("node_key", "kind", "name", key.alias("canonical_key"), method.alias("method"), sure.alias("confidence"))


def emit_canonical(scratch, objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The objects of a build, the map of old keys to new ids, and the alias terms.

    Objects: ``object_id`` (dense, in order of key), ``canonical_key, kind, name, n_nodes, confidence``. Map: ``node_key,
    object_id``. Terms: ``object_id, term`` (normal form of every name and key, each once).
    """
    from skyloom.functions.text import normalize_name
    from skyloom.operators.hierarchy import dense_index

    merged = objects.groupBy("canonical_key").agg(F.min("kind").alias("kind"), F.min("name").alias("name"), F.count("*").alias("n_nodes"), F.max("confidence").alias("confidence"))
    ids = dense_index(scratch, merged, "canonical_key", name="object_id")
    remap = objects.join(ids.select("canonical_key", "object_id"), "canonical_key")
    terms = remap.select("object_id", F.explode(F.array("name", "canonical_key")).alias("t")).select("object_id", normalize_name(F.col("t")).alias("term")).where("term IS NOT NULL").distinct()
    return ids, remap.select("node_key", "object_id"), terms


def host_match(planets: DataFrame, stars: DataFrame, methods: list[tuple[str, str, float]]) -> DataFrame:
    """``planet, star, method, confidence`` for every planet: the first method whose key names exactly one star, else ``unmatched``.

    ``methods``: planet column, star column, confidence. ``planets`` has ``planet``, ``stars`` has ``star``. One equi join per
    method against keys that occur once.
    """
    out = planets.where("planet IS NOT NULL")
    for i, (mine, theirs, _) in enumerate(methods):
        single = stars.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_k{i}")).agg(F.min("star").alias(f"_s{i}"), F.max("star").alias("_hi")).where(f"_s{i} = _hi").drop("_hi")
        out = out.withColumn(f"_k{i}", F.col(mine)).join(single, f"_k{i}", "left")
    star, method, sure = F.lit(None), F.lit("unmatched"), F.lit(0.0)
    for i, (mine, _, confidence) in reversed(list(enumerate(methods))):
        hit = F.col(f"_s{i}").isNotNull()
        star, method, sure = F.when(hit, F.col(f"_s{i}")).otherwise(star), F.when(hit, mine).otherwise(method), F.when(hit, confidence).otherwise(sure)
    best = out.select("planet", star.alias("star"), method.alias("method"), sure.alias("confidence"))
    return best.groupBy("planet").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "star", "method")).alias("b")).select("planet", F.col("b.star").alias("star"), F.col("b.method").alias("method"), (-F.col("b.c")).alias("confidence"))


def merge_status(claims: DataFrame, key: str, status: str) -> DataFrame:
    """``key, status``: the strongest of all claims: retracted, confirmed, candidate, controversial, else the smallest other one."""
    order = F.when(F.col(status) == "retracted", 0).when(F.col(status) == "confirmed", 1).when(F.col(status) == "candidate", 2).when(F.col(status) == "controversial", 3).otherwise(4)
    return claims.where(F.col(status).isNotNull()).groupBy(key).agg(F.min(F.struct(order.alias("o"), status))[status].alias(status))


def bind_endpoints(relations: DataFrame, targets: DataFrame) -> DataFrame:
    """``relation_id, left_object, right_object, status`` of relations ``relation_id, left_key, right_key``.

    ``targets``: ``key, object``. Both ends are unpivoted and bound in one join. ``invalid``: both ends are one key;
    ``accepted``: each end has exactly one object; ``ambiguous``: an end has several; else ``unresolved``.
    """
    single = targets.where("key IS NOT NULL AND object IS NOT NULL").groupBy("key").agg(F.min("object").alias("lo"), F.max("object").alias("hi"))
    ends = relations.select("relation_id", (F.col("left_key") == F.col("right_key")).alias("_self"), F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("left_key").alias("key")), F.struct(F.lit(1).alias("side"), F.col("right_key").alias("key")))))
    bound = ends.join(single, "key", "left")
    at = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    per = bound.groupBy("relation_id").agg(
        F.bool_or("_self").alias("_self"), at("lo", 0).alias("l"), at("lo", 1).alias("r"), F.bool_or(F.col("lo") != F.col("hi")).alias("_several")
    )
    status = F.when(F.col("_self"), "invalid").when(F.coalesce("_several", F.lit(False)), "ambiguous").when(F.col("l").isNotNull() & F.col("r").isNotNull(), "accepted").otherwise("unresolved")
    ok = status == "accepted"
    return per.select("relation_id", F.when(ok, F.col("l")).alias("left_object"), F.when(ok, F.col("r")).alias("right_object"), status.alias("status"))
