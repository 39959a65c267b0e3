"""Queries p1, p6, p7, p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import packing, reading, tokenize, truth
from skyloom.operators import units
from skyloom.session import table


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return truth.set_claims(*[table(spark, d, t) for t in ("stellar_parameter_sets", "stellar_parameter_evidence", "unit_conversions")])


GROUP = ["source_record_id", "component_scope"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    winners, _ = truth.discover_truth(_claims(spark, d), GROUP, "quantity_key", "evidence_id", "method", trust="trust")
    return winners.select(*GROUP, "quantity_key", "evidence_id")


def _value_claims(spark: SparkSession, d: str) -> DataFrame:
    """The claims of every evidence row with a value; stated numbers in the common unit as p4 resolves them."""
    evidence, records, dispositions, conversions = (table(spark, d, t) for t in ("stellar_parameter_evidence", "source_records", "source_field_dispositions", "unit_conversions"))
    resolved = units.resolve_units(evidence, records, dispositions, conversions, keep=("component_scope", "method"))
    return truth.value_claims(evidence, resolved, conversions)


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """Truth discovery on the values themselves: methods vote per group and quantity without a trust order."""
    return truth.best_values(_value_claims(spark, d))


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Where the declared order of sets (p1_found) and free discovery on the values (p1_values) choose the same, per quantity.

    ``n_cells`` of groups of several sets that both decide; ``n_contested`` of them hold several values;
    ``same_row`` and ``same_value`` (to two digits) count all cells, ``contested_same`` the contested ones with the same value.
    """
    claims = _value_claims(spark, d)
    cell = [*GROUP, "quantity_key"]
    free = truth.best_values(claims).withColumnRenamed("evidence_id", "free_id").withColumn("free_bin", truth.significant(F.col("best_value"), 2))
    spread = claims.groupBy(*cell).agg((F.min("bin") != F.max("bin")).alias("contested"))
    bins = claims.where("evidence_id IS NOT NULL").groupBy("evidence_id").agg(F.min("bin").alias("bin"))
    both = p1_found(spark, d).join(bins, "evidence_id").join(free, cell).join(spread, cell)
    same = F.col("bin") == F.col("free_bin")
    return both.groupBy("quantity_key").agg(
        F.count("*").alias("n_cells"), F.count_if("contested").alias("n_contested"), F.count_if(F.col("evidence_id") == F.col("free_id")).alias("same_row"),
        F.count_if(same).alias("same_value"), F.count_if(same & F.col("contested")).alias("contested_same"),
    )


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are not restored by decoding their ids (none)."""
    docs = table(spark, d, "documents")
    back = tokenize.decode_ids(tokenize.encode_texts(docs)).withColumnRenamed("text", "decoded")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id").where("text <> decoded").select("doc_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_summary(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.level_profile(p8_found(spark, d), table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_values": p1_values, "p1_agreement": p1_agreement, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip,
    "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_profile": p8_profile,
}
ORACLES: dict[str, str] = {
    "p6_round_trip": "SELECT doc_id FROM documents WHERE FALSE",
    "p1_found": """
WITH uq AS (SELECT DISTINCT quantity_key FROM unit_conversions), marks AS (SELECT ['', '-', '--', '...', '?', '??', 'n/a', 'nan', 'null', 'none', 'unknown'] AS m),
e AS (SELECT evidence_id, parameter_set_id, quantity_key, trim(value_raw) AS t, normalized_value AS v, uncertainty_lower AS lo, uncertainty_upper AS up FROM stellar_parameter_evidence SEMI JOIN uq USING (quantity_key)),
h AS (SELECT * FROM e WHERE CASE WHEN t IS NULL OR list_contains((SELECT m FROM marks), lower(t)) THEN v IS NOT NULL AND NOT isnan(v) AND abs(v) < 1e60 AND v NOT IN (-9999, -999.99)
 ELSE regexp_matches(t, '^([<>~]|ca\\.|about)? *[+−-]?[0-9]') AND t NOT IN ('-9999', '-9999.0', '-999.99', '1e+99') END),
had AS (SELECT parameter_set_id, quantity_key, min(evidence_id) AS ev, bool_or(coalesce(NOT isnan(lo) AND lo > 0, false) OR coalesce(NOT isnan(up) AND up > 0, false)) AS sure FROM h GROUP BY 1, 2),
per AS (SELECT parameter_set_id, count(*) AS n, count(*) FILTER (WHERE sure) AS u FROM had GROUP BY 1),
s AS (SELECT source_record_id, coalesce(component_scope, '') AS scope, parameter_set_id, min(authority_rank) AS a, max(retrieved_at) AS r FROM stellar_parameter_sets GROUP BY 1, 2, 3),
g AS (SELECT source_record_id, scope FROM s GROUP BY 1, 2 HAVING count(*) > 1),
w AS (SELECT source_record_id, scope, quantity_key, ev, row_number() OVER (PARTITION BY source_record_id, scope, quantity_key ORDER BY n DESC, u DESC, a NULLS LAST, r DESC NULLS LAST, parameter_set_id) AS rn
 FROM s SEMI JOIN g USING (source_record_id, scope) JOIN per USING (parameter_set_id) JOIN had USING (parameter_set_id))
SELECT source_record_id, scope AS component_scope, quantity_key, ev AS evidence_id FROM w WHERE rn = 1""",
}
