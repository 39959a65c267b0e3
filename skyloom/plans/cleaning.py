"""Queries p2 to p5: parsing failures, hierarchies, units, wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.numbers import STATED
from skyloom.functions.units import SPELLINGS
from skyloom.operators import rejects as R
from skyloom.operators import units as U
from skyloom.operators import wide as W
from skyloom.operators.hierarchy import Forest
from skyloom.session import table


def _unit_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, d, t) for t in ("stellar_parameter_evidence", "source_records", "source_field_dispositions", "unit_conversions"))


def p4_resolved(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return U.resolve_units(*_unit_inputs(spark, d), keep=keep)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    conversions = table(spark, d, "unit_conversions")
    rows = p4_resolved(spark, d).where(F.col("verdict").isin("missing", "wrong")).select(F.col("evidence_id").alias("record_key"), "unit_key")
    claims = U.claim_units(table(spark, d, "seed_golden_cases"), conversions)
    return rows.unionByName(claims).groupBy("record_key").agg(F.min("unit_key").alias("unit_key"))


def p4_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Every stated number in its common unit with the verdict on the delivered value."""
    rows = p4_resolved(spark, d).groupBy("evidence_id").agg(
        F.min("quantity_key").alias("quantity_key"), F.min("unit_key").alias("unit_key"), F.min("unit_basis").alias("unit_basis"), F.min("common_value").alias("common_value"), F.min("verdict").alias("verdict")
    )
    return rows


def p4_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Every stated number whose unit neither its texts nor its history tell."""
    return p4_resolved(spark, d, ("value_raw", "unit_raw")).where("verdict = 'unknown'").select("evidence_id", "quantity_key", "value_raw", "unit_raw")


def p4_changepoints(spark: SparkSession, d: str) -> DataFrame:
    evidence, records, _, conversions = _unit_inputs(spark, d)
    return U.unit_histories(evidence, records, conversions)


def p4_inference(spark: SparkSession, d: str) -> DataFrame:
    """Units inferred from the histories against the declared ones, which they never see."""
    return U.inference_quality(*_unit_inputs(spark, d))


def _checked(spark: SparkSession, d: str) -> tuple[DataFrame, list[R.Layout]]:
    layouts = R.read_layouts(table(spark, d, "native_layouts"))
    return R.check_records(table(spark, d, "evidence_lake_native"), layouts), layouts


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return R.rejects(_checked(spark, d)[0]).select("native_row_id", "reason")


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Every reject with its place in the source, all its errors and the raw text."""
    return R.rejects(_checked(spark, d)[0]).select("native_row_id", "source_member", "source_line_number", "reason", F.array_join("errors", ";").alias("errors"), "raw_row")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """All valid records in typed columns; tables with other layouts have null there."""
    checked, layouts = _checked(spark, d)
    keep = ["native_row_id", "source_table", "source_line_number"]
    out = None
    for layout in layouts:
        part = R.load_valid(checked, layout, keep)
        part = part.select(*keep, *[F.col(c).alias(f"{layout.table}__{c}") for c in part.columns if c not in keep])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else checked.select(*keep)


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, list[W.Attribute]]:
    attributes = W.read_catalog(table(spark, d, "quantity_catalog"))
    return W.wide_rows(table(spark, d, "selected_facts"), table(spark, d, "stellar_parameter_evidence"), attributes), attributes


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cells = W.filled_cells(*_wide(spark, d))
    return cells.select(F.col("entity").alias("stable_object_key"), F.col("attribute").alias("quantity_key"), "selected_fact_id")


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    return W.typed_wide(*_wide(spark, d)).withColumnRenamed("entity", "stable_object_key")


def _forest(spark: SparkSession, d: str) -> Forest:
    return Forest(table(spark, d, "hierarchy_nodes"), table(spark, d, "hierarchy_edges"), "hierarchy_node_key", "parent_node_key", "child_node_key")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d).places.select(F.col("key").alias("hierarchy_node_key"), F.col("root").alias("root_node_key"), "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d).paths().withColumnRenamed("key", "hierarchy_node_key")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes hang below each; which ones, ``descendants_of`` tells by the entry and exit numbers."""
    return _forest(spark, d).descendants().select(F.col("key").alias("hierarchy_node_key"), F.col("root").alias("root_node_key"), "depth", "descendants")


def p3_tour(spark: SparkSession, d: str) -> DataFrame:
    """Entry and exit numbers: a node lies below another of its root iff its entry lies within the other's interval."""
    return _forest(spark, d).places.select(F.col("key").alias("hierarchy_node_key"), F.col("root").alias("root_node_key"), "depth", "entry", "exit", "n_leaves")


QUERIES = {
    "p2_found": p2_found, "p2_rejects": p2_rejects, "p2_loaded": p2_loaded,
    "p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_tour": p3_tour,
    "p4_found": p4_found, "p4_normalized": p4_normalized, "p4_unknown": p4_unknown, "p4_changepoints": p4_changepoints, "p4_inference": p4_inference,
    "p5_found": p5_found, "p5_wide": p5_wide,
}
NO_VALUE = "('', '-', '--', '---', '...', '?', '??', 'n/a', 'na', 'n.a.', 'nan', 'null', 'none', 'nil', 'unknown', 'inf', '-inf', '+inf')"
FILLS = "(-9999, -999.99, -99999, -9999.99, -999.9, -999)"
#: The spellings of every unit with its conversion, as rows.
SPELLED_UNITS = ", ".join(f"('{u}', '{form}')" for u, forms in SPELLINGS.items() for form in forms)


def _form(c: str) -> str:
    """SQL of the normal form of a unit text."""
    return rf"""regexp_replace(replace(replace(regexp_replace(lower(translate({c}, '☉⊙⊕−', '☉☉⊕-')), '[\s_.^*·]+', '', 'g'), '☉', 'sun'), '⊕', 'earth'), '^\((.*)\)$', '\1')"""


def _number(c: str) -> str:
    """SQL of the number that a text begins with, null for a fill number."""
    v = rf"TRY_CAST(regexp_replace(translate(regexp_extract({c}, '{STATED}', 1), '−,', '-'), '\s*[x×]\s*10\^?', 'e') AS DOUBLE)"
    return f"CASE WHEN abs({v}) < 1e60 AND {v} NOT IN {FILLS} THEN {v} END"


P4_SQL = rf"""
WITH sp AS (SELECT quantity_key, unit_key, conversion, factor, shift, unit_key = common_unit AS is_common, form FROM unit_conversions JOIN (SELECT u, f AS form FROM (VALUES {SPELLED_UNITS}) v(u, f)) ON u = unit_key UNION SELECT quantity_key, unit_key, conversion, factor, shift, unit_key = common_unit, replace(lower(unit_key), '_', '') FROM unit_conversions),
s AS (SELECT quantity_key, form, min(unit_key) AS unit_key FROM sp GROUP BY 1, 2),
e AS (SELECT evidence_id, source_record_id, quantity_key, normalized_value AS nv, {_number('value_raw')} AS num, trim(regexp_extract(value_raw, '{STATED}', 3)) AS rest, unit_raw FROM stellar_parameter_evidence WHERE quantity_key IN (SELECT quantity_key FROM unit_conversions)),
o AS (SELECT *, CASE WHEN lower(rest) NOT IN {NO_VALUE} THEN rest WHEN lower(trim(unit_raw)) NOT IN {NO_VALUE} THEN unit_raw END AS own FROM e WHERE num IS NOT NULL),
t AS (SELECT source_id, release_id, source_field AS quantity_key, unnest([{{'p': 1, 't': source_unit}}, {{'p': 2, 't': regexp_extract(source_description, '\[unit: (.+)\]\s*$', 1)}}, {{'p': 3, 't': regexp_extract(source_description, '; unit (.+)$', 1)}}, {{'p': 4, 't': regexp_extract(source_description, 'given in (.+)$', 1)}}, {{'p': 5, 't': regexp_extract(source_description, ' pipeline \((.+)\)\s*$', 1)}}]) AS x FROM source_field_dispositions),
d AS (SELECT t.source_id, t.release_id, t.quantity_key, arg_min(s.unit_key, x.p) AS unit_key FROM t JOIN s ON s.quantity_key = t.quantity_key AND s.form = {_form('x.t')} GROUP BY 1, 2, 3),
r AS (SELECT source_record_id, min(source_id) AS source_id, min(release_id) AS release_id FROM source_records GROUP BY 1),
u AS (SELECT o.*, CASE WHEN own IS NULL THEN d.unit_key ELSE s.unit_key END AS unit_key FROM o LEFT JOIN s ON s.quantity_key = o.quantity_key AND s.form = {_form('own')} LEFT JOIN r USING (source_record_id) LEFT JOIN d ON d.source_id = r.source_id AND d.release_id = r.release_id AND d.quantity_key = o.quantity_key),
c AS (SELECT u.*, CASE conversion WHEN 'linear' THEN num * factor + shift WHEN 'log10' THEN CASE WHEN num * factor > 0 THEN log10(num * factor) + shift END WHEN 'exp10' THEN CASE WHEN abs(num) < 300 THEN pow(10, num) * factor END END AS common FROM u JOIN unit_conversions USING (quantity_key, unit_key)),
k AS (SELECT case_id || '#' || claim_id AS record_key, predicate, value, unit, source_excerpt FROM (SELECT case_id, source_excerpt, unnest(expected.claims, recursive := true) FROM seed_golden_cases) WHERE predicate IN (SELECT quantity_key FROM unit_conversions)),
n AS (SELECT record_key, predicate, coalesce(nullif(trim(unit), ''), nullif(trim(regexp_extract(value, '{STATED}', 3)), ''), nullif(regexp_extract(source_excerpt, '(?:^|[ =])' || replace(replace(trim(regexp_extract(value, '{STATED}', 1)), '.', '\.'), '+', '\+') || '\s+([^()=]+?)(?: for the | *\(|\.(?:\s|$)|;|$)', 1), '')) AS said FROM k WHERE {_number('value')} IS NOT NULL)
SELECT evidence_id AS record_key, min(unit_key) AS unit_key FROM c WHERE nv IS NULL OR isnan(nv) OR abs(nv) >= 1e60 OR nv IN {FILLS} OR abs(nv - common) > 0.01 * abs(common) GROUP BY 1
UNION ALL SELECT record_key, min(s.unit_key) FROM n JOIN s ON s.quantity_key = predicate AND s.form = {_form('said')} WHERE s.unit_key <> (SELECT any_value(common_unit) FROM unit_conversions q WHERE q.quantity_key = predicate) GROUP BY 1"""
P5_CELLS = f"""WITH c AS (SELECT quantity_key AS q, value_type AS vt, lower(regexp_replace(unnest(list_append(other_names, quantity_key)), '[ _-]+', '', 'g')) AS form FROM quantity_catalog),
ev AS (SELECT evidence_id, min(normalized_value) AS ev FROM stellar_parameter_evidence WHERE NOT isnan(normalized_value) AND abs(normalized_value) < 1e60 AND normalized_value NOT IN (-9999, -999.99) GROUP BY 1),
f AS (SELECT lower(trim(stable_object_key)) AS k, q, vt, trim(value_raw) AS t, selected_fact_id AS id, authority_rank AS r, selected_at AS s, ev,
 CASE WHEN NOT isnan(normalized_value) AND abs(normalized_value) < 1e60 AND normalized_value NOT IN (-9999, -999.99) THEN normalized_value END AS v
 FROM selected_facts JOIN c ON form = lower(regexp_replace(quantity_key, '[ _-]+', '', 'g')) LEFT JOIN ev USING (evidence_id) WHERE trim(stable_object_key) <> ''),
g AS (SELECT k, q, id, r, s, t, coalesce(v, ev) AS num FROM f WHERE CASE vt WHEN 'double' THEN coalesce(v, ev) IS NOT NULL WHEN 'bigint' THEN regexp_full_match(t, '[+-]?[0-9]+') AND t <> '-9999'
 WHEN 'boolean' THEN lower(t) IN ('1', 'true', 't', 'yes', 'y', 'on', '0', 'false', 'f', 'no', 'n', 'off') WHEN 'timestamp' THEN TRY_CAST(t AS TIMESTAMP) IS NOT NULL AND regexp_matches(t, '^[0-9]{{4}}-') ELSE t IS NOT NULL AND lower(t) NOT IN {NO_VALUE} END)"""
#: The attributes of the catalog of these tables and their types.
P5_TYPES = {
    "bigint": "companion_count discovery_year observation_count",
    "boolean": "has_flares is_controversial is_variable",
    "double": "age eccentricity effective_temperature lithium_abundance log10_surface_gravity luminosity magnetic_field mass mean_density metallicity_m_h orbital_period planet_mass planet_radius projected_rotation_velocity radial_velocity rotation_period stellar_radius",
    "string": "discovery_method spectral_type variability_class",
    "timestamp": "announced_at last_observed_at",
}
P5_VALUES = {
    "double": "num", "bigint": "TRY_CAST(t AS BIGINT)", "boolean": "lower(t) IN ('1', 'true', 't', 'yes', 'y', 'on')", "string": "t",
    "timestamp": "TRY_CAST(CASE WHEN t LIKE '%Z' THEN t[:-2] ELSE t END AS TIMESTAMP)",
}
P5_COLUMNS = ", ".join(f"max({P5_VALUES[kind]}) FILTER (WHERE q = '{name}') AS {name}" for kind, names in P5_TYPES.items() for name in names.split())
#: Only nodes with one parent hang in a tree of these tables; the operator also settles others.
ORACLES: dict[str, str] = {
    "p4_found": P4_SQL,
    "p3_found": """
WITH RECURSIVE n AS (SELECT DISTINCT hierarchy_node_key AS k FROM hierarchy_nodes WHERE hierarchy_node_key IS NOT NULL),
e AS (SELECT DISTINCT parent_node_key AS p, child_node_key AS c FROM hierarchy_edges WHERE parent_node_key IN (SELECT k FROM n) AND child_node_key IN (SELECT k FROM n)),
m AS (SELECT c, count(*) AS parents FROM e GROUP BY c),
r AS (SELECT k, k AS root, 0 AS depth FROM n WHERE k NOT IN (SELECT c FROM e) UNION ALL SELECT e.c, r.root, r.depth + 1 FROM r JOIN e ON e.p = r.k JOIN m ON m.c = e.c AND m.parents = 1)
SELECT n.k AS hierarchy_node_key, coalesce(root, '') AS root_node_key, CAST(coalesce(depth, -1) AS INTEGER) AS depth FROM n LEFT JOIN r ON r.k = n.k""",
    "p3_paths": """
WITH RECURSIVE n AS (SELECT DISTINCT hierarchy_node_key AS k FROM hierarchy_nodes WHERE hierarchy_node_key IS NOT NULL),
e AS (SELECT DISTINCT parent_node_key AS p, child_node_key AS c FROM hierarchy_edges WHERE parent_node_key IN (SELECT k FROM n) AND child_node_key IN (SELECT k FROM n)),
m AS (SELECT c, any_value(p) AS p FROM e GROUP BY c HAVING count(*) = 1),
r AS (SELECT k, k AS path FROM n WHERE k NOT IN (SELECT c FROM e) UNION ALL SELECT m.c, r.path || '/' || m.c FROM r JOIN m ON m.p = r.k)
SELECT n.k AS hierarchy_node_key, path FROM n LEFT JOIN r ON r.k = n.k""",
    "p3_descendants": """
WITH RECURSIVE n AS (SELECT DISTINCT hierarchy_node_key AS k FROM hierarchy_nodes WHERE hierarchy_node_key IS NOT NULL),
e AS (SELECT DISTINCT parent_node_key AS p, child_node_key AS c FROM hierarchy_edges WHERE parent_node_key IN (SELECT k FROM n) AND child_node_key IN (SELECT k FROM n)),
m AS (SELECT c, any_value(p) AS p FROM e GROUP BY c HAVING count(*) = 1),
r AS (SELECT k, k AS root, 0 AS depth FROM n WHERE k NOT IN (SELECT c FROM e) UNION ALL SELECT m.c, r.root, r.depth + 1 FROM r JOIN m ON m.p = r.k),
up AS (SELECT k, k AS a FROM r UNION ALL SELECT up.k, m.p FROM up JOIN m ON m.c = up.a),
d AS (SELECT a, count(*) - 1 AS descendants FROM up GROUP BY a)
SELECT n.k AS hierarchy_node_key, coalesce(root, '') AS root_node_key, CAST(coalesce(depth, -1) AS INTEGER) AS depth, descendants FROM n LEFT JOIN r ON r.k = n.k LEFT JOIN d ON d.a = n.k""",
    "p5_wide": f"""
{P5_CELLS},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, q ORDER BY r NULLS LAST, s DESC NULLS LAST, id) AS rn FROM g) WHERE rn = 1)
SELECT k AS stable_object_key, {P5_COLUMNS} FROM (SELECT DISTINCT lower(trim(stable_object_key)) AS k FROM selected_facts WHERE trim(stable_object_key) <> '') LEFT JOIN b USING (k) GROUP BY 1""",
    "p5_found": f"""
{P5_CELLS}
SELECT k AS stable_object_key, q AS quantity_key, id AS selected_fact_id FROM (SELECT *, row_number() OVER (PARTITION BY k, q ORDER BY r NULLS LAST, s DESC NULLS LAST, id) AS rn FROM g) WHERE rn = 1""",
}
