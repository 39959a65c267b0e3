"""From evidence to selected facts: bindings, candidates, competition of authorities, checks.

Sets compete per object and quantity group. The winner and its runner-up are
found with a rank limit that prunes map-side and counts with map-side combine,
so an object may hold any share of the candidates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numbers import real_value
from skyloom.operators.evidence import select_sets
from skyloom.operators.policy import Rule, authority

OBJECT = ["object_key", "quantity_group"]


def bind_records(records: DataFrame, objects: DataFrame, quarantined: DataFrame, excluded: Column) -> DataFrame:
    """``source_record_id, object_key, status``: the object that each source record is about.

    ``records``: ``source_record_id, object_key`` (null if the record names none) and the columns of
    ``excluded``; ``objects`` and ``quarantined``: ``object_key``. In this order: ``excluded`` by scope,
    ``unresolved`` (names no object), ``ambiguous`` (its deliveries name several), ``quarantined``, ``missing`` (no such
    object), ``accepted``. Only accepted records keep their key. A null record id is left out.
    """
    rows = records.where("source_record_id IS NOT NULL").groupBy("source_record_id").agg(
        F.min("object_key").alias("object_key"), F.max("object_key").alias("_hi"), F.bool_and(F.coalesce(excluded, F.lit(False))).alias("_out")
    )
    known = objects.select("object_key").where("object_key IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    held = quarantined.select("object_key").where("object_key IS NOT NULL").distinct().withColumn("_held", F.lit(True))
    rows = rows.join(known, "object_key", "left").join(held, "object_key", "left")
    status = (
        F.when(F.col("_out"), "excluded").when(F.col("object_key").isNull(), "unresolved").when(F.col("object_key") != F.col("_hi"), "ambiguous")
        .when(F.col("_held").isNotNull(), "quarantined").when(F.col("_known").isNull(), "missing").otherwise("accepted")
    )
    return rows.select("source_record_id", F.when(status == "accepted", F.col("object_key")).alias("object_key"), status.alias("status"))


def fact_candidates(evidence: DataFrame, sets: DataFrame, bindings: DataFrame, catalog: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Evidence with a value, of a set and an accepted object, with the authority that ``rules`` give its set.

    Rules see ``method``, ``model``, ``set_quality`` and ``declared_rank`` of the set. Evidence that no rule
    ranks, or of a quantity outside the catalog, is no candidate. Repeated deliveries count once.
    """
    value = real_value(F.col("normalized_value"))
    first = ["parameter_set_id", "quantity_key", "reference_raw", "bound_semantics"]
    rows = evidence.where(F.col("evidence_id").isNotNull() & F.col("parameter_set_id").isNotNull() & value.isNotNull()).groupBy("evidence_id").agg(
        *[F.min(c).alias(c) for c in first], F.min(value).alias("normalized_value"),
        F.min(real_value(F.col("uncertainty_lower"))).alias("uncertainty_lower"), F.min(real_value(F.col("uncertainty_upper"))).alias("uncertainty_upper"),
    )
    rank, reason, score = authority(rules)
    per = sets.where("parameter_set_id IS NOT NULL").groupBy("parameter_set_id").agg(
        *[F.min(c).alias(c) for c in ("source_record_id", "method", "model")], F.min("quality_json").alias("set_quality"), F.min("authority_rank").alias("declared_rank")
    )
    per = per.select("parameter_set_id", "source_record_id", rank.alias("authority_rank"), reason.alias("authority_reason"), score.alias("quality_score")).where("authority_rank IS NOT NULL")
    per = per.join(bindings.where("status = 'accepted'").select("source_record_id", "object_key"), "source_record_id")
    groups = F.broadcast(catalog.select("quantity_key", "quantity_group").dropDuplicates(["quantity_key"]))
    return rows.join(groups, "quantity_key").join(per, "parameter_set_id")


def compete(candidates: DataFrame) -> DataFrame:
    """One decision per object and quantity group.

    Order: authority, most quantities, most with an uncertainty, most with a reference, best quality (null last),
    set id. Columns: ``OBJECT, parameter_set_id, authority_rank, authority_reason, quality_score, quantity_count,
    uncertainty_count, reference_count, candidate_count, runner_up`` (null if there is none).
    """
    sure = F.col("uncertainty_lower").isNotNull() | F.col("uncertainty_upper").isNotNull()
    cited = F.nullif(F.trim("reference_raw"), F.lit("")).isNotNull()
    keep = [F.min("authority_rank").alias("authority_rank"), F.min("authority_reason").alias("authority_reason"), F.max("quality_score").alias("quality_score")]
    each = candidates.groupBy(*OBJECT, "parameter_set_id", "quantity_key").agg(*keep, F.max(sure.cast("int")).alias("sure"), F.max(F.coalesce(cited, F.lit(False)).cast("int")).alias("cited"))
    sets = each.groupBy(*OBJECT, "parameter_set_id").agg(*keep, F.count("*").alias("quantity_count"), F.sum("sure").alias("uncertainty_count"), F.sum("cited").alias("reference_count"))
    order = [F.col("authority_rank"), *[F.desc(c) for c in ("quantity_count", "uncertainty_count", "reference_count")], F.desc_nulls_last("quality_score")]
    decided = select_sets(sets, OBJECT, "parameter_set_id", *order).withColumnRenamed("n_sets", "candidate_count")
    return decided.join(sets, [*OBJECT, "parameter_set_id"])


def facts_of(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """All facts of the winning sets with their bounds: endpoints as they are, else value less and plus its uncertainty."""
    endpoint = F.lower(F.coalesce("bound_semantics", F.lit(""))).contains("endpoint")
    value, low, high = (F.col(c) for c in ("normalized_value", "uncertainty_lower", "uncertainty_upper"))
    won = candidates.join(decisions.select(*OBJECT, "parameter_set_id"), [*OBJECT, "parameter_set_id"], "left_semi")
    return won.select(
        *OBJECT, "quantity_key", "evidence_id", "parameter_set_id", "authority_rank", "normalized_value",
        F.when(endpoint, low).otherwise(value - F.abs(low)).alias("value_lower"), F.when(endpoint, high).otherwise(value + F.abs(high)).alias("value_upper"),
    )


def fact_checks(facts: DataFrame, decisions: DataFrame, bindings: DataFrame) -> dict[str, DataFrame]:
    """Frames that must be empty, by the name of the check."""
    repeated = lambda df, keys: df.groupBy(*keys).count().where("count > 1")
    pair = [*OBJECT, "parameter_set_id"]
    return {
        "decision_repeated": repeated(decisions, OBJECT),
        "decision_without_fact": decisions.join(facts.select(*pair), pair, "left_anti"),
        "fact_without_decision": facts.join(decisions.select(*pair), pair, "left_anti"),
        "fact_repeated": repeated(facts, ["object_key", "evidence_id"]),
        "several_sets_per_group": facts.select(*pair).distinct().groupBy(*OBJECT).count().where("count > 1"),
        "fact_without_object": facts.where("object_key IS NULL"),
        "fact_without_value": facts.where("normalized_value IS NULL OR isnan(normalized_value)"),
        "bounds_crossed": facts.where("value_lower > value_upper"),
        "value_outside_bounds": facts.where("normalized_value < value_lower OR normalized_value > value_upper"),
        "rank_missing": decisions.where("authority_rank IS NULL"),
        "runner_up_is_winner": decisions.where("runner_up = parameter_set_id"),
        "single_with_runner_up": decisions.where("candidate_count = 1 AND runner_up IS NOT NULL"),
        "several_without_runner_up": decisions.where("candidate_count > 1 AND runner_up IS NULL"),
        "uncertain_exceed_quantities": decisions.where("uncertainty_count > quantity_count OR reference_count > quantity_count"),
        "binding_repeated": repeated(bindings, ["source_record_id"]),
        "binding_status_unknown": bindings.where("status NOT IN ('accepted', 'ambiguous', 'excluded', 'missing', 'quarantined', 'unresolved')"),
        "accepted_without_object": bindings.where("status = 'accepted' AND object_key IS NULL"),
        "object_without_acceptance": bindings.where("status <> 'accepted' AND object_key IS NOT NULL"),
    }


def unit_routes(evidence: DataFrame, routes: DataFrame) -> DataFrame:
    """Source-native attribute rows sent to their destination by a route table.

    ``routes``: ``source_id, release_id, source_field, destination_table, mapping_status``, a fixed policy. Rows
    without a route go to ``unmapped``; ``disposition`` is the route's status or ``unrouted``.
    """
    r = F.broadcast(routes.groupBy("source_id", "release_id", F.col("source_field").alias("quantity_key")).agg(F.min("destination_table").alias("destination"), F.min("mapping_status").alias("disposition")))
    out = evidence.join(r, ["source_id", "release_id", "quantity_key"], "left")
    return out.withColumns({"destination": F.coalesce("destination", F.lit("unmapped")), "disposition": F.coalesce("disposition", F.lit("unrouted"))})


def identifier_claims(rows: DataFrame, record: str, fields: dict[str, str], composite: dict[str, Sequence[str]] | None = None, pattern: str = r"^[0-9A-Za-z+\-.]+$") -> DataFrame:
    """``record, namespace, identifier, status``: one claim per identifier field of a record that is not blank.

    ``fields`` maps columns to namespaces; ``composite`` maps a namespace to columns that only together, joined by ``:``,
    make an identifier. Identifiers are trimmed and their inner blanks dropped; one that does not match
    ``pattern`` is ``rejected`` (with its text), not lost.
    """
    claims = [F.struct(F.lit(ns).alias("namespace"), F.col(c).cast("string").alias("raw")) for c, ns in fields.items()]
    for ns, parts in (composite or {}).items():
        whole = reduce(lambda a, b: a & b, [F.nullif(F.trim(F.col(p).cast("string")), F.lit("")).isNotNull() for p in parts])
        claims.append(F.struct(F.lit(ns).alias("namespace"), F.when(whole, F.concat_ws(":", *[F.trim(F.col(p).cast("string")) for p in parts])).alias("raw")))
    out = rows.select(record, F.inline(F.array(*claims)))
    name = F.regexp_replace("raw", r"\s+", "")
    out = out.where(F.nullif(name, F.lit("")).isNotNull()).select(record, "namespace", name.alias("identifier"))
    good = F.when(F.col("namespace").isin(*(composite or {})), F.lit(True)).otherwise(F.col("identifier").rlike(pattern)) if composite else F.col("identifier").rlike(pattern)
    return out.withColumn("status", F.when(good, "accepted").otherwise("rejected")).distinct()
