"""Attribute-value rows into wide tables with typed columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numbers import is_missing_text, real_value
from skyloom.functions.text import FALSE_TEXTS, TRUE_TEXTS
from skyloom.functions.units import MAX_POLICY_ROWS

ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    spellings: tuple[str, ...]


def attribute_form(c: Column) -> Column:
    """Case, blanks, hyphens and underscores do not tell attribute names apart."""
    return F.lower(F.regexp_replace(c, r"[\s_\-]+", ""))


def read_catalog(catalog: DataFrame) -> list[Attribute]:
    """The attributes in the order of their names: a fixed policy of at most ``MAX_POLICY_ROWS`` rows."""
    rows = catalog.limit(MAX_POLICY_ROWS + 1).collect()
    if len(rows) > MAX_POLICY_ROWS:
        raise ValueError("the attribute catalog is not a bounded policy table")
    out: dict[str, Attribute] = {}
    for r in sorted((r for r in rows if r["quantity_key"]), key=lambda r: r["quantity_key"]):
        names = (r["quantity_key"], *[n for n in (r["other_names"] or []) if n])
        out.setdefault(r["quantity_key"], Attribute(r["quantity_key"], r["value_type"], names))
    return list(out.values())


def typed_text(kind: Column, text: Column, number: Column) -> Column:
    """The value of a fact in the text form of its type, null if it is no value of that type."""
    t = F.trim(text, F.lit(" \t\r\n"))
    low = F.lower(t)
    whole = t.rlike(r"^[+-]?[0-9]+$") & t.try_cast("bigint").isNotNull() & ~t.isin("-9999", "-99999", "-999")
    time = t.rlike(ISO_TIME) & ~t.startswith("0000") & t.try_cast("timestamp").isNotNull()
    return (
        F.when(kind == "double", real_value(number).cast("string"))
        .when(kind == "bigint", F.when(whole, t.try_cast("bigint").cast("string")))
        .when(kind == "boolean", F.when(low.isin(*TRUE_TEXTS), "true").when(low.isin(*FALSE_TEXTS), "false"))
        .when(kind == "timestamp", F.when(time, t))
        .otherwise(F.when(~is_missing_text(t), t))
    )


def best_cells(facts: DataFrame, evidence: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """``entity, position, value, selected_fact_id``: the fact that fills each cell.

    Cells that no fact fills have null value and id; position -1 only keeps
    entities that have no known attribute.

    Facts are reduced per entity and attribute with map-side combine, so one
    entity may hold any share of the rows. A fact without an entity, with an
    attribute the catalog lacks or without a value of its type fills nothing.
    Only the facts whose number may stand in their evidence row meet the evidence.
    """
    spark = facts.sparkSession
    known = spark.createDataFrame(
        [(f, i, a.kind) for i, a in enumerate(attributes) for f in sorted({"".join(ch for ch in s.lower() if ch not in " \t\n_-") for s in a.spellings})] or [("", 0, "")],
        "_form string, position int, kind string",
    ).dropDuplicates(["_form"])
    f = (
        facts.select(
            F.lower(F.trim(F.col("stable_object_key"), F.lit(" \t\r\n"))).alias("entity"), attribute_form(F.col("quantity_key")).alias("_form"), "value_raw",
            real_value(F.col("normalized_value")).alias("number"), "evidence_id", "selected_fact_id", "authority_rank", "selected_at",
        )
        .where(F.col("entity") != "")
        .join(F.broadcast(known), "_form", "left")
        .withColumn("position", F.coalesce("position", F.lit(-1)))
    )
    linked = (F.coalesce(F.col("kind"), F.lit("")) == "double") & F.col("number").isNull() & F.col("evidence_id").isNotNull()
    numbers = (
        evidence.select("evidence_id", real_value(F.col("normalized_value")).alias("_number"))
        .where("evidence_id IS NOT NULL AND _number IS NOT NULL")
        .groupBy("evidence_id")
        .agg(F.min("_number").alias("_number"))
    )
    through = f.where(linked).join(numbers, "evidence_id", "left").withColumn("number", F.col("_number")).drop("_number")
    every = f.where(~linked).unionByName(through.select(f.columns))
    kind = F.when(F.col("position") >= 0, F.col("kind"))
    cells = every.select(
        "entity", "position", F.when(kind.isNotNull(), typed_text(kind, F.col("value_raw"), F.col("number"))).alias("value"), "selected_fact_id",
        F.coalesce("authority_rank", F.lit(2**31 - 1)).alias("_rank"), F.coalesce(-F.unix_micros(F.col("selected_at").cast("timestamp")), F.lit(2**63 - 1)).alias("_late"),
    )
    order = F.struct(F.col("value").isNull().alias("_none"), "_rank", "_late", "selected_fact_id", "value")
    best = cells.groupBy("entity", "position").agg(F.min(order).alias("b"))
    fact = F.when(F.col("b.value").isNotNull(), F.col("b.selected_fact_id"))
    return best.select("entity", "position", F.col("b.value").alias("value"), fact.alias("selected_fact_id"))


def wide_rows(facts: DataFrame, evidence: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """One row per entity: ``entity`` and ``cells``, an array with a place for every attribute.

    The best cells are collected per entity, at most one per attribute by then,
    so no group is large. The grid is completed within the row: every position
    of the catalog's fixed list looks up its cell and stays null without one,
    which is the left join of the grid with the values at the cost of no further
    shuffle. An entity whose facts all fill nothing still gets a row of nulls;
    an empty table gives no rows.
    """
    best = best_cells(facts, evidence, attributes)
    got = best.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("value", "selected_fact_id")))).alias("_got"))
    grid = F.sequence(F.lit(0), F.lit(max(len(attributes) - 1, 0)))
    return got.select("entity", F.transform(grid, lambda p: F.try_element_at(F.col("_got"), p)).alias("cells"))


def typed_wide(wide: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """One typed column per attribute, read from its fixed place by a type-specific try-cast."""
    types = {"double": "double", "bigint": "bigint", "boolean": "boolean", "timestamp": "timestamp", "string": "string"}
    return wide.select("entity", *[F.get(F.col("cells"), F.lit(i))["value"].try_cast(types.get(a.kind, "string")).alias("entity_" if a.name == "entity" else a.name) for i, a in enumerate(attributes)])


def filled_cells(wide: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """One row per filled cell of the wide rows: ``entity, attribute, selected_fact_id``."""
    names = F.array(*[F.lit(a.name) for a in attributes])
    cell = wide.select("entity", F.posexplode("cells").alias("position", "c")).where(F.col("c.value").isNotNull())
    return cell.select("entity", F.get(names, F.col("position")).alias("attribute"), F.col("c.selected_fact_id").alias("selected_fact_id"))
