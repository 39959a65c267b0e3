"""Text search over a term table: tiers, bounded edit distance, trigram postings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.text import trigrams
from skyloom.operators.relational import keyset_page


def search_tier(terms: DataFrame, query: str, term: str = "term") -> DataFrame:
    """All terms of the first tier that has any: 0 exact, 1 prefix, 2 substring (3 letters on), 3 fuzzy (4 on).

    One pass computes each term's ``tier`` and ``distance`` (-1 beyond the allowed edits); the least tier is an aggregate of one row.
    """
    t = F.col(term)
    allowed = 1 if len(query) <= 5 else 2 if len(query) <= 10 else 3
    tier = F.when(t == query, 0).when(t.startswith(query), 1)
    if len(query) >= 3:
        tier = tier.when(t.contains(query), 2)
    distance = F.levenshtein(t, F.lit(query), allowed) if len(query) >= 4 else F.lit(-1)
    near = F.abs(F.length(t) - len(query)) <= allowed
    found = terms.withColumn("distance", F.when(near, distance).otherwise(-1)).withColumn("tier", tier.when(F.col("distance") >= 0, 3)).where(F.col("tier").isNotNull())
    least = found.agg(F.min("tier").alias("tier"))
    return found.join(F.broadcast(least), "tier")


def tiered_search(terms: DataFrame, query: str, term: str = "term", limit: int = 2000) -> DataFrame:
    """The page of the first ``limit`` hits of ``search_tier`` by distance, length and term."""
    return search_tier(terms, query, term).orderBy("tier", "distance", F.length(term), term).limit(limit)


#: Orders of a search: column, descending, what stands for null.
ORDERS: dict[str, list[tuple[str, bool, object]]] = {
    "match": [("tier", False, 9), ("name", False, "\uffff")],
    "name": [("name", False, "\uffff")],
    "distance": [("dist", False, 1e12)],
    "interest": [("interest", True, -1e18)],
    "stars": [("n_stars", True, -1)],
    "planets": [("n_planets", True, -1)],
    "hottest": [("temperature", True, -1e18)],
}


@dataclass(frozen=True)
class SearchSpec:
    """One faceted search. Empty facets filter nothing."""

    text: str = ""
    within: float | None = None  # distance from ``origin``
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    at_least: dict[str, float] = field(default_factory=dict)
    at_most: dict[str, float] = field(default_factory=dict)
    classes: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    order: str = "name"
    size: int = 50
    cursor: str | None = None


def facet_search(items: DataFrame, tags: DataFrame, spec: SearchSpec) -> DataFrame:
    """The items that pass all facets, in the spec's order: one page after its cursor.

    ``items``: ``id`` (unique), ``name, term`` (normal form of the name), ``class, x, y, z, dist`` and the columns of the
    orders; ``tags``: ``id, tag``. Facets are predicates of one plan: those on columns reach the scan, tags
    are one aggregated join, a null coordinate counts as 0 and an item without coordinates falls back to ``dist``.
    """
    if spec.order not in ORDERS:
        raise ValueError(f"unknown order {spec.order}")
    out = items
    for c, v in spec.at_least.items():
        out = out.where(F.col(c) >= v)
    for c, v in spec.at_most.items():
        out = out.where(F.col(c) <= v)
    if spec.classes:
        out = out.where(F.col("class").isin(*spec.classes))
    if spec.within is not None:
        parts = [F.pow(F.coalesce(F.col(c), F.lit(0.0)) - o, F.lit(2.0)) for c, o in zip("xyz", spec.origin)]
        away = F.when(F.coalesce("x", "y", "z").isNotNull(), F.sqrt(parts[0] + parts[1] + parts[2])).otherwise(F.col("dist"))
        out = out.where(away <= spec.within)
    out = search_tier(out, spec.text) if spec.text else out.withColumns({"tier": F.lit(0), "distance": F.lit(0)})
    if spec.any_of or spec.all_of or spec.none_of:
        out = filter_tags(out, tags, "id", "tag", list(spec.any_of), list(spec.all_of), list(spec.none_of))
    return keyset_page(out, [*ORDERS[spec.order], ("id", False, 2**63 - 1)], spec.size, spec.cursor)


def page_of(rows: DataFrame, order: list, size: int, offset: int) -> DataFrame:
    """An OFFSET page with ``total`` and ``next_offset`` (null on the last page) on every row."""
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))
    return page.withColumn("next_offset", F.when(F.lit(offset + size) < F.col("total"), F.lit(offset + size)))


def trigram_postings(terms: DataFrame, key: str, term: str) -> DataFrame:
    """``gram, key``: the index that answers substring and similarity queries with an equi join."""
    return terms.select(F.explode(trigrams(F.col(term))).alias("gram"), F.col(key)).distinct()


def trigram_candidates(postings: DataFrame, query: str, key: str, least: int = 1) -> DataFrame:
    """``key, shared``: how many of the query's grams each entry has, ``least`` at least."""
    grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    return postings.where(F.col("gram").isin(*grams) if grams else F.lit(False)).groupBy(key).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def filter_tags(items: DataFrame, tags: DataFrame, key: str, tag: str, any_of: list[str] = (), all_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """Items with any, all and none of the given tags; one aggregation of the tag table."""
    wanted = [*any_of, *all_of, *none_of]
    hit = tags.where(F.col(tag).isin(*wanted)).groupBy(key).agg(
        F.max(F.col(tag).isin(*any_of) if any_of else F.lit(True)).alias("any"),
        F.size(F.collect_set(F.when(F.col(tag).isin(*all_of), F.col(tag)) if all_of else F.lit(None).cast("string"))).alias("all"),
        F.max(F.col(tag).isin(*none_of) if none_of else F.lit(False)).alias("none"),
    )
    ok = (F.coalesce("any", F.lit(not any_of))) & (F.coalesce("all", F.lit(0)) == len(set(all_of))) & ~F.coalesce("none", F.lit(False))
    return items.join(hit, key, "left").where(ok).drop("any", "all", "none")


def greedy_tags(candidates: DataFrame, key: str, limits: dict[str, int], most: int) -> DataFrame:
    """Per key the best tags in order of score, skipping a group already taken and full families.

    A candidate that its family's limit rejects leaves its group free, so this
    is a fold over the sorted candidates, not a window. Candidates of one key
    are few; columns: ``key, tag, score, family, grp``.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "tag", "family", "grp")))
    limit_of = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    empty = F.struct(F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("families"), F.array().cast("array<string>").alias("groups"))

    def step(acc, x):
        used = F.size(F.filter(acc["families"], lambda f: f == x["family"]))
        free = (F.size(acc["tags"]) < most) & ~F.array_contains(acc["groups"], x["grp"]) & (used < F.coalesce(F.try_element_at(limit_of, x["family"]), F.lit(most)))
        taken = F.struct(F.array_append(acc["tags"], x["tag"]).alias("tags"), F.array_append(acc["families"], x["family"]).alias("families"), F.array_append(acc["groups"], x["grp"]).alias("groups"))
        return F.when(free, taken).otherwise(acc)

    chosen = candidates.groupBy(key).agg(F.aggregate(ordered, empty, step)["tags"].alias("tags"))
    return chosen.select(key, F.posexplode("tags").alias("place", "tag"))


def resolve_exact(asked: DataFrame, terms: DataFrame, query: str, term: str) -> DataFrame:
    """``query, n, status`` for every asked identifier: accepted if exactly one term row equals it, else missing or ambiguous.

    Nothing falls through to prefixes or similar terms. Only the terms that are asked for are counted.
    """
    asked = asked.select(query).where(F.col(query).isNotNull()).distinct()
    counts = terms.join(asked, F.col(term) == F.col(query), "left_semi").groupBy(F.col(term).alias(query)).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return asked.join(counts, query, "left").select(query, n.alias("n"), F.when(n == 0, "missing").when(n == 1, "accepted").otherwise("ambiguous").alias("status"))
