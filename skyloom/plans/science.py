"""Queries on policies, fact selection, the identity graph, interest, tags and faceted search."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import astro as A
from skyloom.functions import text as X
from skyloom.functions.numbers import real_value
from skyloom.operators import evidence as E
from skyloom.operators import facts as K
from skyloom.operators import identity as I
from skyloom.operators import interest as N
from skyloom.operators import policy as Y
from skyloom.operators import search as S
from skyloom.operators.policy import Condition, Rule
from skyloom.operators.relational import encode_cursor
from skyloom.plans.registry import Registry
from skyloom.storage import Scratch

reg = Registry()
query = reg.query


# Policies -------------------------------------------------------------------


AUTHORITY = [
    Rule(1, "declared first, well measured", (Condition("authority_rank", None, "lte", 1), Condition("quality_json", "$.snr", "gte", 60)), ("quality_json", "$.snr")),
    Rule(2, "fitted spectrum", (Condition("method", None, "eq", "spectroscopic_fit", "string"),), ("quality_json", "$.snr")),
    Rule(3, "no other model", (Condition("model", None, "ne_or_null", "mixed_layer", "string"), Condition("quality_json", "$.snr", "not_null"))),
    Rule(9, "any"),
]
AUTHORITY_SQL = """CASE WHEN {rank} <= 1 AND {snr} >= 60 THEN 1 WHEN method = 'spectroscopic_fit' THEN 2 WHEN (model IS NULL OR model <> 'mixed_layer') AND {snr} IS NOT NULL THEN 3 ELSE 9 END"""
SNR = "TRY_CAST(json_extract_string({q}, '$.snr') AS DOUBLE)"


@query(f"""SELECT DISTINCT parameter_set_id, authority_rank, rank, CASE WHEN rank <= 2 THEN snr END AS score FROM (SELECT *, {AUTHORITY_SQL.format(rank='authority_rank', snr='snr')} AS rank FROM (SELECT *, {SNR.format(q='quality_json')} AS snr FROM stellar_parameter_sets)) WHERE parameter_set_id IS NOT NULL""")
def policy_authority(t):
    """A list of authority rules compiled to rank and score of every parameter set."""
    rank, _, score = Y.authority(AUTHORITY)
    return t("stellar_parameter_sets").where("parameter_set_id IS NOT NULL").select("parameter_set_id", "authority_rank", rank.alias("rank"), score.alias("score")).distinct()


@query("""SELECT evidence_id, flag_ok, snr_ok, text_ok FROM (SELECT DISTINCT evidence_id, coalesce((TRY_CAST(json_extract_string(quality_json, '$.flag') AS BIGINT) & 2) = 0, false) AS flag_ok, coalesce(TRY_CAST(json_extract_string(quality_json, '$.snr') AS DOUBLE) >= 50 AND TRY_CAST(json_extract_string(quality_json, '$.snr') AS DOUBLE) < 150, false) AS snr_ok, coalesce(json_extract_string(quality_json, '$.flag') IS NULL OR json_extract_string(quality_json, '$.flag') <> '0', false) AS text_ok FROM stellar_parameter_evidence) WHERE evidence_id IS NOT NULL""")
def policy_conditions(t):
    """Conditions on paths of a JSON column, as a policy states them."""
    q = "quality_json"
    return t("stellar_parameter_evidence").where("evidence_id IS NOT NULL").select(
        "evidence_id", Y.holds([Condition(q, "$.flag", "bitmask_none", 2)]).alias("flag_ok"), Y.holds([Condition(q, "$.snr", "gte", 50), Condition(q, "$.snr", "lt", 150)]).alias("snr_ok"),
        Y.holds([Condition(q, "$.flag", "ne_or_null", "0", "string")]).alias("text_ok"),
    ).distinct()


@query("""SELECT evidence_id, max(CASE WHEN NOT isnan(normalized_value) AND normalized_value NOT IN (-9999, -999.99, 1e99) AND normalized_value <> 0 AND abs(normalized_value) >= 0.001 THEN abs(normalized_value) END) AS value FROM stellar_parameter_evidence WHERE evidence_id IS NOT NULL GROUP BY 1""")
def policy_missing(t):
    """Numbers under a missing-value policy: sentinels, zero, a least size, as absolute values."""
    v = Y.present(F.col("normalized_value"), [-9999, -999.99, 1e99], zero_is_missing=True, minimum=0.001, absolute=True)
    return t("stellar_parameter_evidence").where("evidence_id IS NOT NULL").groupBy("evidence_id").agg(F.max(v).alias("value"))


# Facts ----------------------------------------------------------------------


BOUND = """obj AS (SELECT DISTINCT lower(trim(stable_object_key)) AS k FROM selected_facts WHERE trim(stable_object_key) <> ''),
held AS (SELECT k FROM (SELECT DISTINCT lower(trim(stable_object_key)) AS k, lower(trim(system_stable_object_key)) AS s FROM selected_facts WHERE stable_object_key IS NOT NULL AND system_stable_object_key IS NOT NULL) GROUP BY k HAVING count(*) > 1),
rec AS (SELECT source_record_id, min(nullif(lower(trim(stable_object_key)), '')) AS lo, max(nullif(lower(trim(stable_object_key)), '')) AS hi, bool_and(coalesce(object_scope = 'component', false)) AS ex FROM source_records WHERE source_record_id IS NOT NULL GROUP BY 1),
bnd AS (SELECT source_record_id, lo, CASE WHEN ex THEN 'excluded' WHEN lo IS NULL THEN 'unresolved' WHEN lo <> hi THEN 'ambiguous' WHEN lo IN (SELECT k FROM held) THEN 'quarantined' WHEN lo NOT IN (SELECT k FROM obj) THEN 'missing' ELSE 'accepted' END AS status FROM rec)"""
REAL = "CASE WHEN NOT isnan({c}) AND abs({c}) < 1e60 AND {c} NOT IN (-9999, -999.99, -99999, -9999.99, -999.9, -999) THEN {c} END"
CANDIDATES = f"""{BOUND},
ev AS (SELECT evidence_id, min(parameter_set_id) AS parameter_set_id, min(quantity_key) AS quantity_key, min(reference_raw) AS ref, min(bound_semantics) AS sem, min({REAL.format(c='normalized_value')}) AS v, min({REAL.format(c='uncertainty_lower')}) AS lo, min({REAL.format(c='uncertainty_upper')}) AS up
 FROM stellar_parameter_evidence WHERE evidence_id IS NOT NULL AND parameter_set_id IS NOT NULL AND {REAL.format(c='normalized_value')} IS NOT NULL GROUP BY 1),
ps AS (SELECT *, {AUTHORITY_SQL.format(rank='dr', snr=SNR.format(q='q'))} AS rank, {SNR.format(q='q')} AS snr FROM (SELECT parameter_set_id, min(source_record_id) AS source_record_id, min(method) AS method, min(model) AS model, min(quality_json) AS q, min(authority_rank) AS dr FROM stellar_parameter_sets WHERE parameter_set_id IS NOT NULL GROUP BY 1)),
cand AS (SELECT lo_key AS object_key, quantity_group, evidence_id, parameter_set_id, quantity_key, ref, sem, v, lo, up, rank, CASE WHEN rank <= 2 THEN snr END AS score FROM ev JOIN quantity_catalog USING (quantity_key) JOIN ps USING (parameter_set_id) JOIN (SELECT source_record_id, lo AS lo_key FROM bnd WHERE status = 'accepted') USING (source_record_id)),
st AS (SELECT object_key, quantity_group, parameter_set_id, min(rank) AS rank, max(score) AS score, count(DISTINCT quantity_key) AS nq, count(DISTINCT quantity_key) FILTER (WHERE lo IS NOT NULL OR up IS NOT NULL) AS nu, count(DISTINCT quantity_key) FILTER (WHERE trim(ref) <> '') AS nr FROM cand GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER w AS rn, lead(parameter_set_id) OVER w AS runner_up, count(*) OVER (PARTITION BY object_key, quantity_group) AS candidate_count FROM st WINDOW w AS (PARTITION BY object_key, quantity_group ORDER BY rank, nq DESC, nu DESC, nr DESC, score DESC NULLS LAST, parameter_set_id)),
dec AS (SELECT * FROM rk WHERE rn = 1)"""
FACT_RULES = [
    Rule(r.rank, r.reason, tuple(Condition({"authority_rank": "declared_rank", "quality_json": "set_quality"}.get(c.column, c.column), c.path, c.operator, c.value, c.kind) for c in r.conditions), ("set_quality", "$.snr") if r.score else None)
    for r in AUTHORITY
]


def _bindings(t):
    key = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    facts = t("selected_facts").select(key("stable_object_key").alias("object_key"), F.lower(F.trim("system_stable_object_key")).alias("system"))
    held = I.conflicts({"several_systems": (facts, "object_key", "system")}).select(F.col("key").alias("object_key"))
    records = t("source_records").select("source_record_id", key("stable_object_key").alias("object_key"), "object_scope")
    return K.bind_records(records, facts, held, F.col("object_scope") == "component")


def _competition(t):
    candidates = K.fact_candidates(t("stellar_parameter_evidence"), t("stellar_parameter_sets"), _bindings(t), t("quantity_catalog"), FACT_RULES)
    candidates = Scratch(candidates.sparkSession, "facts").write(candidates)
    return candidates, K.compete(candidates)


@query(f"""WITH {BOUND} SELECT source_record_id, CASE WHEN status = 'accepted' THEN lo END AS object_key, status FROM bnd""")
def fact_bindings(t):
    """Which object every source record is about, or why it is bound to none."""
    return _bindings(t)


@query(f"""WITH {CANDIDATES} SELECT object_key, quantity_group, parameter_set_id, runner_up, candidate_count, rank AS authority_rank, nq AS quantity_count, nu AS uncertainty_count, nr AS reference_count, score AS quality_score FROM dec""")
def fact_competition(t):
    """The winning set per object and quantity group, by authority and what it has, with its runner-up."""
    out = _competition(t)[1]
    return out.select(*K.OBJECT, "parameter_set_id", "runner_up", "candidate_count", "authority_rank", "quantity_count", "uncertainty_count", "reference_count", "quality_score")


@query(f"""WITH {CANDIDATES} SELECT object_key, quantity_group, quantity_key, evidence_id, parameter_set_id, cand.rank AS authority_rank, v AS normalized_value, CASE WHEN lower(coalesce(sem, '')) LIKE '%endpoint%' THEN lo ELSE v - abs(lo) END AS value_lower, CASE WHEN lower(coalesce(sem, '')) LIKE '%endpoint%' THEN up ELSE v + abs(up) END AS value_upper FROM cand SEMI JOIN dec USING (object_key, quantity_group, parameter_set_id)""")
def fact_selection(t):
    """All facts of the winning sets with their bounds."""
    return K.facts_of(*_competition(t))


CHECKS = ("accepted_without_object", "binding_repeated", "binding_status_unknown", "bounds_crossed", "decision_repeated", "decision_without_fact", "fact_repeated", "fact_without_decision", "fact_without_object", "fact_without_value", "object_without_acceptance", "rank_missing", "runner_up_is_winner", "several_sets_per_group", "several_without_runner_up", "single_with_runner_up", "uncertain_exceed_quantities", "value_outside_bounds")


@query(f"""SELECT unnest({list(CHECKS)}) AS check_name, CAST(0 AS BIGINT) AS n_bad""")
def fact_integrity(t):
    """Eighteen checks on bindings, decisions and facts, none of which may find anything."""
    candidates, decisions = _competition(t)
    scratch = Scratch(candidates.sparkSession, "checks")
    decisions, bindings = scratch.write(decisions), scratch.write(_bindings(t))
    return E.integrity(K.fact_checks(scratch.write(K.facts_of(candidates, decisions)), decisions, bindings))


@query("""WITH r AS (SELECT source_record_id, min(source_id) AS source_id, min(release_id) AS release_id FROM source_records GROUP BY 1), d AS (SELECT source_id, release_id, source_field AS quantity_key, min(destination_table) AS destination, min(mapping_status) AS disposition FROM source_field_dispositions GROUP BY 1, 2, 3)
SELECT coalesce(destination, 'unmapped') AS destination, coalesce(disposition, 'unrouted') AS disposition, count(*) AS n FROM stellar_parameter_evidence LEFT JOIN r USING (source_record_id) LEFT JOIN d USING (source_id, release_id, quantity_key) GROUP BY 1, 2""")
def evidence_routing(t):
    """Attribute rows sent to their destination by the field list of their source and release."""
    r = t("source_records").where("source_record_id IS NOT NULL").groupBy("source_record_id").agg(F.min("source_id").alias("source_id"), F.min("release_id").alias("release_id"))
    rows = t("stellar_parameter_evidence").select("source_record_id", "quantity_key").join(r, "source_record_id", "left")
    return K.unit_routes(rows, t("source_field_dispositions")).groupBy("destination", "disposition").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT hierarchy_node_key AS node, namespace, id AS identifier, CASE WHEN namespace = 'pair' OR regexp_full_match(id, '[0-9A-Za-z+.:-]+') THEN 'accepted' ELSE 'rejected' END AS status FROM (SELECT hierarchy_node_key, 'canonical' AS namespace, regexp_replace(canonical_key, '\\s+', '', 'g') AS id FROM hierarchy_nodes UNION ALL SELECT hierarchy_node_key, 'wds', regexp_replace(wds_id, '\\s+', '', 'g') FROM hierarchy_nodes UNION ALL SELECT hierarchy_node_key, 'name', regexp_replace(display_name, '\\s+', '', 'g') FROM hierarchy_nodes
 UNION ALL SELECT hierarchy_node_key, 'pair', regexp_replace(trim(node_kind) || ':' || trim(wds_id), '\\s+', '', 'g') FROM hierarchy_nodes WHERE trim(node_kind) <> '' AND trim(wds_id) <> '') WHERE id <> ''""")
def identifier_claims(t):
    """Plain and composite identifiers of every node, with those that are no identifiers kept as rejected."""
    fields = {"canonical_key": "canonical", "wds_id": "wds", "display_name": "name"}
    return K.identifier_claims(t("hierarchy_nodes"), "hierarchy_node_key", fields, {"pair": ("node_kind", "wds_id")}, r"^[0-9A-Za-z+.:-]+$").withColumnRenamed("hierarchy_node_key", "node")


# Identity graph -------------------------------------------------------------


NODES = "SELECT 'src:customer:' || c_custkey AS node_key, 'star' AS kind, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 5000 AS VARCHAR) END AS gaia, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 700 AS VARCHAR) END AS hip FROM customer UNION ALL SELECT 'src:supplier:' || s_suppkey, 'component', s_name, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS VARCHAR) END, CASE WHEN s_suppkey % 2 = 1 THEN CAST(s_suppkey AS VARCHAR) END FROM supplier"
NODE_RULES = [I.NodeRule("customer", "star", "c_custkey", {"gaia": "gaia", "hip": "hip"}, "c_name"), I.NodeRule("supplier", "component", "s_suppkey", {"gaia": "gaia", "hip": "hip"}, "s_name")]
EDGE_RULES = [I.EdgeRule("same_gaia", "star", "component", "gaia", 1.0, "exact"), I.EdgeRule("same_hip", "star", "component", "hip", 0.9, "strong", unique=True), I.EdgeRule("twin_gaia", "star", "star", "gaia", 0.6, "weak")]


def _nodes(t):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    customer = t("customer").select("c_custkey", "c_name", F.when(c % 3 == 0, (c % 5000).cast("string")).alias("gaia"), F.when(c % 2 == 0, (c % 700).cast("string")).alias("hip"))
    supplier = t("supplier").select("s_suppkey", "s_name", F.when(s % 4 == 0, s.cast("string")).alias("gaia"), F.when(s % 2 == 1, s.cast("string")).alias("hip"))
    return I.source_nodes({"customer": customer, "supplier": supplier}, NODE_RULES)


@query(f"""SELECT * FROM ({NODES})""")
def source_nodes(t):
    """Several source tables as one node table, by rules."""
    at = lambda n: F.try_element_at("ids", F.lit(n)).alias(n)
    return _nodes(t).select("node_key", "kind", "name", at("gaia"), at("hip"))


@query(f"""WITH n AS ({NODES}), s AS (SELECT hip, min(node_key) AS k FROM n WHERE kind = 'star' AND hip IS NOT NULL GROUP BY 1 HAVING count(*) = 1), c AS (SELECT hip, min(node_key) AS k FROM n WHERE kind = 'component' AND hip IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
e AS (SELECT a.node_key AS l, b.node_key AS r, 'same_gaia' AS relation, 1.0 AS confidence, 'exact' AS tier FROM n a JOIN n b ON a.gaia = b.gaia AND a.kind = 'star' AND b.kind = 'component' UNION ALL SELECT s.k, c.k, 'same_hip', 0.9, 'strong' FROM s JOIN c USING (hip) UNION ALL SELECT a.node_key, b.node_key, 'twin_gaia', 0.6, 'weak' FROM n a JOIN n b ON a.gaia = b.gaia AND a.kind = 'star' AND b.kind = 'star' AND a.node_key < b.node_key)
SELECT l AS left_key, r AS right_key, relation, CAST(confidence AS DOUBLE) AS confidence, tier FROM (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY confidence DESC, relation) AS rn FROM e) WHERE rn = 1""")
def identity_edges(t):
    """Relations between nodes by rules on shared identifiers, the best rule per pair."""
    return I.identity_edges(_nodes(t), EDGE_RULES)


BRIDGED = f"n AS ({NODES}), one AS (SELECT hip, min(gaia) AS g FROM n WHERE hip IS NOT NULL AND gaia IS NOT NULL GROUP BY 1 HAVING count(DISTINCT gaia) = 1), b AS (SELECT node_key, kind, name, coalesce(gaia, g) AS gaia, n.hip FROM n LEFT JOIN one ON n.hip = one.hip), c AS (SELECT *, CASE WHEN gaia IS NOT NULL THEN 'gaia:' || gaia WHEN hip IS NOT NULL THEN 'hip:' || hip ELSE 'node:' || node_key END AS canonical_key, CASE WHEN gaia IS NOT NULL THEN 'gaia' WHEN hip IS NOT NULL THEN 'hip' ELSE 'node' END AS method, CASE WHEN gaia IS NOT NULL THEN 1.0 WHEN hip IS NOT NULL THEN 0.95 ELSE 0.5 END AS confidence FROM b)"


def _objects(t):
    return I.canonical_objects(I.bridge_identifiers(_nodes(t), "hip", "gaia"), [("gaia", 1.0), ("hip", 0.95)])


@query(f"""WITH {BRIDGED} SELECT node_key, canonical_key, method, CAST(confidence AS DOUBLE) AS confidence FROM c""")
def canonical_resolution(t):
    """The canonical key of every node, after identifiers were bridged where they are unique, with method and confidence."""
    return _objects(t).select("node_key", "canonical_key", "method", "confidence")


@query(f"""WITH {BRIDGED}, o AS (SELECT canonical_key, min(kind) AS kind, min(name) AS name, count(*) AS n_nodes, CAST(max(confidence) AS DOUBLE) AS confidence FROM c GROUP BY 1) SELECT row_number() OVER (ORDER BY canonical_key) - 1 AS object_id, * FROM o""")
def canonical_emit(t):
    """The objects of a build under dense new ids."""
    o = _objects(t)
    return I.emit_canonical(Scratch(o.sparkSession, "emit"), o)[0].select("object_id", "canonical_key", "kind", "name", "n_nodes", "confidence")


@query(f"""WITH {BRIDGED}, i AS (SELECT canonical_key, row_number() OVER (ORDER BY canonical_key) - 1 AS object_id FROM c GROUP BY 1), x AS (SELECT object_id, unnest([name, canonical_key]) AS t FROM c JOIN i USING (canonical_key)) SELECT DISTINCT object_id, trim(lower(regexp_replace(t, '[^0-9A-Za-z]+', ' ', 'g'))) AS term FROM x WHERE t IS NOT NULL""")
def canonical_terms(t):
    """Every name and key of an object as a search term, once."""
    o = _objects(t)
    return I.emit_canonical(Scratch(o.sparkSession, "emit"), o)[2]


PLANETS = "SELECT 'p' || p_partkey AS planet, CAST(p_partkey % 900 AS VARCHAR) AS gaia, CAST(p_size AS VARCHAR) AS hip, p_brand AS hostname FROM part"
STARS = "SELECT 's' || s_suppkey AS star, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS gaia, CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey % 40 AS VARCHAR) END AS hip, 'Brand#' || (s_suppkey % 60) AS hostname FROM supplier"


def _single(c: str) -> str:
    return f"(SELECT {c}, min(star) AS star FROM s WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT star) = 1)"


@query(f"""WITH p AS ({PLANETS}), s AS ({STARS}) SELECT planet, coalesce(a.star, b.star, c.star) AS star, CASE WHEN a.star IS NOT NULL THEN 'gaia' WHEN b.star IS NOT NULL THEN 'hip' WHEN c.star IS NOT NULL THEN 'hostname' ELSE 'unmatched' END AS method, CASE WHEN a.star IS NOT NULL THEN 1.0 WHEN b.star IS NOT NULL THEN 0.95 WHEN c.star IS NOT NULL THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence FROM p LEFT JOIN {_single('gaia')} a USING (gaia) LEFT JOIN {_single('hip')} b USING (hip) LEFT JOIN {_single('hostname')} c USING (hostname)""")
def host_match(t):
    """The host of every planet by the best method that names exactly one star; unmatched ones stay."""
    k, n = F.col("s_suppkey"), F.col("p_partkey")
    planets = t("part").select(F.concat(F.lit("p"), n).alias("planet"), (n % 900).cast("string").alias("gaia"), F.col("p_size").cast("string").alias("hip"), F.col("p_brand").alias("hostname"))
    stars = t("supplier").select(F.concat(F.lit("s"), k).alias("star"), F.when(k % 3 == 0, k.cast("string")).alias("g"), F.when(k % 5 == 0, (k % 40).cast("string")).alias("h"), F.concat(F.lit("Brand#"), k % 60).alias("b"))
    return I.host_match(planets, stars, [("gaia", "g", 1.0), ("hip", "h", 0.95), ("hostname", "b", 0.8)])


STATUS = "CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN 'candidate' WHEN 1 THEN 'controversial' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'retracted' ELSE 'listed' END"


@query(f"""SELECT user_id, arg_min(s, CASE s WHEN 'retracted' THEN 0 WHEN 'confirmed' THEN 1 WHEN 'candidate' THEN 2 WHEN 'controversial' THEN 3 ELSE 4 END) AS status FROM (SELECT user_id, {STATUS} AS s FROM events WHERE event_id % 7 < 2) GROUP BY 1""")
def status_merge(t):
    """The strongest status that any source gives an object."""
    k = F.col("event_id")
    s = F.when(k % 5 == 0, "candidate").when(k % 5 == 1, "controversial").when(k % 5 == 2, "confirmed").when(k % 5 == 3, "retracted").otherwise("listed")
    return I.merge_status(t("events").where(k % 7 < 2).select("user_id", s.alias("status")), "user_id", "status")


@query("""WITH e AS (SELECT hierarchy_edge_id AS id, parent_node_key AS l, child_node_key AS r FROM hierarchy_edges), m AS (SELECT hierarchy_node_key AS k, min(canonical_key) AS lo, max(canonical_key) AS hi FROM hierarchy_nodes WHERE hierarchy_node_key IS NOT NULL AND canonical_key IS NOT NULL GROUP BY 1),
j AS (SELECT id, coalesce(l = r, false) AS s, a.lo AS x, b.lo AS y, coalesce(a.lo <> a.hi, false) OR coalesce(b.lo <> b.hi, false) AS many FROM e LEFT JOIN m a ON l = a.k LEFT JOIN m b ON r = b.k),
o AS (SELECT *, CASE WHEN s THEN 'invalid' WHEN many THEN 'ambiguous' WHEN x IS NOT NULL AND y IS NOT NULL THEN 'accepted' ELSE 'unresolved' END AS status FROM j) SELECT id AS relation_id, CASE WHEN status = 'accepted' THEN x END AS left_object, CASE WHEN status = 'accepted' THEN y END AS right_object, status FROM o""")
def relation_binding(t):
    """Both ends of every link bound to canonical objects."""
    e = t("hierarchy_edges").select(F.col("hierarchy_edge_id").alias("relation_id"), F.col("parent_node_key").alias("left_key"), F.col("child_node_key").alias("right_key"))
    return I.bind_endpoints(e, t("hierarchy_nodes").select(F.col("hierarchy_node_key").alias("key"), F.col("canonical_key").alias("object")))


# Interest, tags, search -----------------------------------------------------


WEIGHTS = dict(zip(N.FEATURES, (0.2, 0.1, 0.15, 0.15, 0.1, 0.15, 0.1, 0.05)))
SYSTEMS = """sy AS (SELECT c_custkey AS system_id, CASE WHEN c_custkey % 11 <> 0 THEN abs(c_acctbal) / 50 END AS dist_ly FROM customer),
sr AS (SELECT o_custkey AS system_id, substr('OBAFGKMX', CAST(o_orderkey % 8 AS INTEGER) + 1, 1) AS class, round(o_totalprice, 2) AS pm, CASE WHEN o_orderstatus = 'P' THEN 0.7 ELSE 0.0 END AS exotic FROM orders),
pl AS (SELECT o_custkey AS system_id, coalesce(l_discount * 10 >= 0.8 AND l_quantity / 5 BETWEEN 0.3 AND 8 AND l_tax * 10 <= 0.35 AND (CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / 100 BETWEEN 180 AND 350 ELSE l_tax * 30 BETWEEN 0.35 AND 1.7 END), false) AS nice, l_returnflag = 'R' AND l_quantity > 45 AS weird FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
FEATURE_SQL = f"""{SYSTEMS},
s AS (SELECT system_id, count(*) AS n, max(CASE class WHEN 'O' THEN 1.0 WHEN 'B' THEN 0.9 WHEN 'A' THEN 0.8 WHEN 'F' THEN 0.55 WHEN 'G' THEN 0.45 WHEN 'K' THEN 0.35 WHEN 'M' THEN 0.25 ELSE 0.1 END)::DOUBLE AS light, sum(CAST(round(pm * 1e6) AS BIGINT)) / count(pm) / 1e6 AS motion, max(exotic)::DOUBLE AS odd FROM sr GROUP BY 1),
p AS (SELECT system_id, count(*) AS k, count(*) FILTER (WHERE nice) AS nice, count(*) FILTER (WHERE weird) AS weird FROM pl GROUP BY 1),
x AS (SELECT system_id, coalesce(light, 0) AS luminosity, coalesce(motion / (SELECT max(motion) FROM s), 0) AS proper_motion, least(greatest(coalesce(n, 0) - 1, 0), 4) / 4.0 AS multiplicity, least(coalesce(nice, 0), 3) / 3.0 AS nice_planets, least(coalesce(weird, 0), 3) / 3.0 AS weird_planets,
 1 / (1 + (coalesce(dist_ly, 10000) / 20) * (coalesce(dist_ly, 10000) / 20)) AS proximity, least((ln(1 + coalesce(n, 0)) / ln(5) + ln(1 + coalesce(k, 0)) / ln(11)) / 2 + CASE WHEN n >= 2 AND k >= 1 THEN 0.1 ELSE 0 END + CASE WHEN nice > 0 AND weird > 0 THEN 0.1 ELSE 0 END, 1) AS complexity, least(greatest(coalesce(odd, 0), 0), 1) AS exotic
 FROM sy LEFT JOIN s USING (system_id) LEFT JOIN p USING (system_id))"""


def _features(t):
    k = F.col("c_custkey")
    systems = t("customer").select(k.alias("system_id"), F.when(k % 11 != 0, F.abs("c_acctbal") / 50).alias("dist_ly"))
    o = t("orders")
    letter = F.lit("OBAFGKMX").substr((F.col("o_orderkey") % 8 + 1).cast("int"), F.lit(1))
    stars = o.select(F.col("o_custkey").alias("system_id"), letter.alias("class"), F.round("o_totalprice", 2).alias("pm"), F.when(F.col("o_orderstatus") == "P", 0.7).otherwise(0.0).alias("exotic"))
    nice = N.nice_planet(F.col("l_discount") * 10, F.col("l_quantity") / 5, F.col("l_tax") * 10, F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice") / 100), F.col("l_tax") * 30)
    line = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), nice.alias("nice"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("weird"))
    planets = line.join(o.select("o_orderkey", F.col("o_custkey").alias("system_id")), "o_orderkey").drop("o_orderkey")
    return N.system_features(systems, stars, planets)


@query(f"""WITH {FEATURE_SQL} SELECT system_id, {', '.join(f'round({f}, 9)::DOUBLE AS {f}' for f in N.FEATURES)} FROM x""")
def interest_features(t):
    """The eight features of the interest of a system."""
    return _features(t).select("system_id", *[F.round(f, 9).cast("double").alias(f) for f in N.FEATURES])


@query(f"""WITH {FEATURE_SQL}, w AS (SELECT system_id, {' + '.join(f'{f} * {w}' for f, w in WEIGHTS.items())} AS total FROM x) SELECT system_id, round(100 * total, 6)::DOUBLE AS score, row_number() OVER (ORDER BY round(total, 9) DESC, system_id) AS rank FROM w""")
def interest_rank(t):
    """Score and rank of every system by eight weighted features."""
    return N.rank_systems(_features(t), WEIGHTS).select("system_id", F.col("score").cast("double").alias("score"), "rank")


@query("""SELECT event_id, CASE s WHEN 'source' THEN 1 WHEN 'accepted' THEN 1 WHEN 'derived' THEN 2 WHEN 'assumed' THEN 4 WHEN 'screen' THEN 8 ELSE 0 END AS bit, CASE s WHEN 'source' THEN 'accepted' WHEN 'accepted' THEN 'accepted' WHEN 'derived' THEN 'derived' WHEN 'assumed' THEN 'candidate' WHEN 'screen' THEN 'modeled' ELSE 'disputed' END AS mode FROM (SELECT event_id, CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN 'source' WHEN 1 THEN 'accepted' WHEN 2 THEN 'derived' WHEN 3 THEN 'assumed' WHEN 4 THEN 'screen' ELSE 'other' END AS s FROM events)""")
def claim_modes(t):
    k = F.col("event_id")
    s = F.when(k % 6 == 0, "source").when(k % 6 == 1, " Accepted").when(k % 6 == 2, "derived").when(k % 6 == 3, "assumed").when(k % 6 == 4, "SCREEN").otherwise("other")
    return t("events").select("event_id", N.status_bit(s).alias("bit"), N.claim_mode(s).alias("mode"))


ASSIGNED = "SELECT o_custkey AS system_id, o_orderpriority AS tag, CASE WHEN o_orderkey % 3 = 0 THEN 'system' ELSE 'star' END AS target_type, o_orderkey AS target_key, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'derived' ELSE 'screen' END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN 1.0 END AS confidence FROM orders"
DEFINITIONS = [("1-URGENT", 10.0, 6.0, 3.0, True, "architecture", "a"), ("2-HIGH", 8.0, 5.0, 1.0, False, "exceptional_science", "a"), ("3-MEDIUM", 7.0, 4.0, 2.0, False, "exceptional_science", "b"), ("5-LOW", 3.0, 9.0, 0.0, False, "planet_environment", "c")]


def _hero(t):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    assigned = t("orders").select(
        F.col("o_custkey").alias("system_id"), F.col("o_orderpriority").alias("tag"), F.when(k % 3 == 0, "system").otherwise("star").alias("target_type"), k.alias("target_key"),
        F.when(s == "F", "accepted").when(s == "O", "derived").otherwise("screen").alias("status"), F.when(k % 5 != 0, 1.0).alias("confidence"),
    )
    definitions = assigned.sparkSession.createDataFrame(DEFINITIONS, "tag string, base_interest double, rarity_weight double, specificity double, concept boolean, family string, grp string")
    return N.hero_candidates(assigned, definitions, t("customer").count())


@query(f"""WITH a AS ({ASSIGNED}), d AS (SELECT * FROM (VALUES {', '.join(str(d).replace('True', 'true').replace('False', 'false') for d in DEFINITIONS)}) v(tag, base, rw, spec, concept, family, grp)), m AS (SELECT *, CASE status WHEN 'accepted' THEN 1 WHEN 'derived' THEN 2 ELSE 4 END AS mr FROM a),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_id, tag ORDER BY mr, coalesce(confidence, 0.5) DESC, target_type, target_key) AS rn FROM m) WHERE rn = 1), n AS (SELECT tag, count(DISTINCT system_id) AS n FROM a GROUP BY 1), t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM customer)
SELECT system_id, tag, CAST(round_even(base + least(28.0, round_even(-log10(greatest(1.0 / t, n / t)) * rw, 0)) + 2 * spec + CASE target_type WHEN 'system' THEN 8 ELSE 3 END + CASE WHEN concept THEN 4 ELSE 0 END - CASE mr WHEN 4 THEN 8 WHEN 2 THEN 2 ELSE 0 END, 0) AS INTEGER) AS score, family, grp FROM b JOIN d USING (tag) JOIN n USING (tag), t""")
def hero_scores(t):
    """Scored tags of every system: interest, rarity, specificity, how direct and how sure."""
    return _hero(t)


@query()
def hero_tags(t):
    """At most four tags per system, greedily by score within the limits of groups and families."""
    return S.greedy_tags(_hero(t), "system_id", N.FAMILY_LIMITS, N.HERO_TAGS)


@query("""SELECT source_id, composite, CASE WHEN n = 0 THEN 'meh' WHEN o >= 20 AND c >= 65 THEN 'indispensable' WHEN o >= 8 AND c >= 55 THEN 'strong' WHEN c >= 45 THEN 'situational' ELSE 'meh' END AS tier FROM (SELECT *, round((0.5 * c / 100 + 0.3 * o / 100 + 0.2 * 0.75) * 100, 2) AS composite FROM (SELECT source_id, count(*) AS n, round(100.0 * count(stable_object_key) / count(*), 2) AS c, round(count(*) FILTER (WHERE stable_object_key IN (SELECT stable_object_key FROM selected_facts)) / count(*) * 100, 2) AS o FROM source_records WHERE source_id IS NOT NULL GROUP BY 1))""")
def catalog_assessment(t):
    """Coverage, overlap and reliability of every source as one figure and tier."""
    known = t("selected_facts").select("stable_object_key").where("stable_object_key IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    r = t("source_records").where("source_id IS NOT NULL").join(known, "stable_object_key", "left")
    g = r.groupBy("source_id").agg(F.count("*").alias("n"), F.round(100.0 * F.count("stable_object_key") / F.count("*"), 2).alias("c"), F.count("_hit").alias("m"))
    composite, tier = N.catalog_assessment(F.col("n"), F.col("m"), F.col("c"), F.lit(0.75))
    return g.select("source_id", composite.alias("composite"), tier.alias("tier"))


@query("""SELECT p_partkey, CASE WHEN feh IS NOT NULL THEN round(least(greatest((least(greatest(feh, -0.8), 0.6) + 0.8) / 1.4, 0), 1), 6) END::DOUBLE AS richness, CASE WHEN feh IS NULL THEN 'unknown' WHEN feh < -0.4 THEN 'very_low' WHEN feh < -0.2 THEN 'low' WHEN feh < 0.1 THEN 'moderate' WHEN feh < 0.3 THEN 'high' ELSE 'very_high' END AS class, coalesce(CASE WHEN esi BETWEEN 0 AND 1 THEN esi END, CASE WHEN hab >= 2 THEN 0.9 WHEN hab >= 1 THEN 0.75 END)::DOUBLE AS habitability FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size / 25.0 - 1.0 END AS feh, CASE WHEN p_size % 2 = 0 THEN p_size / 40.0 END AS esi, p_size % 4 AS hab FROM part)""")
def planet_proxies(t):
    n = F.col("p_size")
    score, name = N.element_richness(F.when(n % 7 != 0, n / 25.0 - 1.0))
    return t("part").select("p_partkey", F.round(score, 6).alias("richness"), name.alias("class"), N.habitability(F.when(n % 2 == 0, n / 40.0), n % 4).alias("habitability"))


@query("""SELECT p_partkey, round(pow(m * pow(p / 365.25, 2), 1.0 / 3), 6) AS axis, round(pow(m * 0.9 * pow(p / 365.25, 2), 1.0 / 3), 6) AS axis_low, round(pow(m * 1.1 * pow(p * 1.01 / 365.25, 2), 1.0 / 3), 6) AS axis_high, round(0.8 / pow(pow(m * 1.1 * pow(p * 1.01 / 365.25, 2), 1.0 / 3), 2), 6) AS s_low, round(1.3 / pow(pow(m * 0.9 * pow(p / 365.25, 2), 1.0 / 3), 2), 6) AS s_high,
 CASE WHEN p_size % 3 = 0 THEN round(p_size / 332946.0487, 12) ELSE round(p_size / 1047.3486, 12) END AS planet_mass, round(120 * sqrt(p_size / pi()), 6) AS radius_arcmin, round(2000 + (2450000 + p - 2451545) / 365.25, 9) AS julian, round(1900 + (2450000 + p - 2415020.31352) / 365.242198781, 9) AS besselian FROM (SELECT p_partkey, p_size, 0.5 + p_size / 50.0 AS m, p_retailprice AS p FROM part)""")
def derivation_bounds(t):
    """Axis and insolation with their bounds, the mass ladder, equivalent radius and epochs."""
    n, p = F.col("p_size"), F.col("p_retailprice")
    m = 0.5 + n / 50.0
    axis, low, high = A.kepler_interval(m, m * 0.9, m * 1.1, p, F.lit(None).cast("double"), p * 1.01)
    _, s_low, s_high = A.insolation_interval(F.lit(1.0), F.lit(0.8), F.lit(1.3), axis, low, high)
    mass = A.planet_mass_solar({("best", "earth"): F.when(n % 3 == 0, n), ("minimum", "jupiter"): n})
    values = {"axis": axis, "axis_low": low, "axis_high": high, "s_low": s_low, "s_high": s_high}
    return t("part").select(
        "p_partkey", *[F.round(v, 6).alias(k) for k, v in values.items()], F.round(mass, 12).alias("planet_mass"), F.round(A.equivalent_radius_arcmin(n), 6).alias("radius_arcmin"),
        F.round(A.julian_year(2450000 + p), 9).alias("julian"), F.round(A.besselian_year(2450000 + p), 9).alias("besselian"),
    )


@query("""SELECT p_partkey, CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN 'TOI-' || (p_partkey + 1) WHEN 1 THEN 'TIC ' || p_partkey END AS designation, CASE CAST(p_partkey % 6 AS INTEGER) WHEN 2 THEN 'identifier_out_of_range' WHEN 3 THEN 'malformed_identifier' END AS reason, CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN 'A' WHEN 1 THEN 'Aa1' WHEN 2 THEN 'A' WHEN 3 THEN 'C' END AS l, CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN 'B' WHEN 1 THEN 'Aa2' WHEN 2 THEN 'Bb' WHEN 3 THEN 'D' END AS r FROM part""")
def designations(t):
    """Candidate designations with the reason why a text is none, and the grammar of pair labels."""
    k = F.col("p_partkey")
    text = F.when(k % 6 == 0, F.concat(F.lit("toi_"), k + 1)).when(k % 6 == 1, F.concat(F.lit("tic-"), k)).when(k % 6 == 2, "TOI 0").when(k % 6 == 3, "tic 12x").otherwise(F.concat(F.lit("ticket "), k))
    pair = F.when(k % 6 == 0, " ").when(k % 6 == 1, "Aa1,2").when(k % 6 == 2, "A - Bb").when(k % 6 == 3, "CD").otherwise("what?!")
    left, right = X.pair_labels(pair)
    return t("part").select("p_partkey", X.candidate_designation(text).alias("designation"), X.candidate_reason(text).alias("reason"), left.alias("l"), right.alias("r"))


ITEMS = "SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', ' ')) AS term, substr(c_mktsegment, 1, 1) AS class, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 100 END AS x, CAST(NULL AS DOUBLE) AS y, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey * 1.0 END AS z, abs(c_acctbal) / 90 AS dist, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS interest, coalesce(n, 0) AS n_stars, c_nationkey % 5 AS n_planets, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey * 100.0 END AS temperature FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey"
PASSED = f"SELECT * FROM ({ITEMS}) i WHERE n_stars >= 2 AND class IN ('A', 'B', 'M') AND CASE WHEN x IS NOT NULL OR y IS NOT NULL OR z IS NOT NULL THEN sqrt((coalesce(x, 0) - 10) * (coalesce(x, 0) - 10) + coalesce(z, 0) * coalesce(z, 0)) ELSE dist END <= 80 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = id AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = id AND o_orderpriority = '5-LOW')"


def _items(t):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t("customer").join(n, "c_custkey", "left").select(
        k.alias("id"), F.col("c_name").alias("name"), F.lower(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("term"), F.substring("c_mktsegment", 1, 1).alias("class"), F.when(k % 4 != 0, b / 100).alias("x"),
        F.lit(None).cast("double").alias("y"), F.when(k % 4 != 0, F.col("c_nationkey") * 1.0).alias("z"), (F.abs(b) / 90).alias("dist"), F.when(k % 6 != 0, b).alias("interest"), F.coalesce("n", F.lit(0)).alias("n_stars"),
        (F.col("c_nationkey") % 5).alias("n_planets"), F.when(k % 5 != 0, F.col("c_nationkey") * 100.0).alias("temperature"),
    )


#: Order, SQL of the sort key, cursor (null for the first page) and its SQL condition.
PAGES = {
    "name": ("name", {"name": "Customer#000000100", "id": 100}, "(name > 'Customer#000000100' OR (name = 'Customer#000000100' AND id > 100))"),
    "distance": ("coalesce(dist, 1e12)", {"dist": 20.0, "id": 5}, "(coalesce(dist, 1e12) > 20 OR (coalesce(dist, 1e12) = 20 AND id > 5))"),
    "interest": ("coalesce(interest, -1e18) DESC", {"interest": 5000.0, "id": 5}, "(coalesce(interest, -1e18) < 5000 OR (coalesce(interest, -1e18) = 5000 AND id > 5))"),
    "stars": ("n_stars DESC", {"n_stars": 12, "id": 50}, "(n_stars < 12 OR (n_stars = 12 AND id > 50))"),
    "planets": ("n_planets DESC", {"n_planets": 3, "id": 77}, "(n_planets < 3 OR (n_planets = 3 AND id > 77))"),
    "hottest": ("coalesce(temperature, -1e18) DESC", None, "true"),
}


def _facets(order: str, cursor: dict | None):
    def run(t):
        tags = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("tag"))
        spec = S.SearchSpec(within=80.0, origin=(10.0, 0.0, 0.0), at_least={"n_stars": 2}, classes=("A", "B", "M"), any_of=("1-URGENT", "2-HIGH"), none_of=("5-LOW",), order=order, size=40, cursor=encode_cursor(cursor) if cursor else None)
        return S.facet_search(_items(t), tags, spec).select("id", "name")

    return run


for _order, (_key, _cursor, _after) in PAGES.items():
    query(f"SELECT id, name FROM ({PASSED}) WHERE {_after} ORDER BY {_key}, id LIMIT 40", name=f"facet_search_{_order}")(_facets(_order, _cursor))


@query(f"""WITH i AS ({ITEMS}), x AS (SELECT *, CASE WHEN term = 'customer 00000010' THEN 0 WHEN starts_with(term, 'customer 00000010') THEN 1 WHEN contains(term, 'customer 00000010') THEN 2 WHEN abs(length(term) - 17) <= 3 AND levenshtein(term, 'customer 00000010') <= 3 THEN 3 END AS tier FROM i) SELECT id, name, CAST(tier AS INTEGER) AS tier FROM x WHERE tier = (SELECT min(tier) FROM x) ORDER BY tier, name, id LIMIT 40""")
def facet_search_match(t):
    """The same search by text: hits of the best tier in the order of the match."""
    return S.facet_search(_items(t), t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("tag")), S.SearchSpec(text="customer 00000010", order="match", size=40)).select("id", "name", "tier")


@query("""SELECT o_orderkey, count(*) OVER () AS total, CASE WHEN count(*) OVER () > 60 THEN 60 END AS next_offset FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40""")
def counted_page(t):
    """An OFFSET page with the total and where the next one starts."""
    return S.page_of(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 20, 40).select("o_orderkey", "total", "next_offset")


QUERIES, ORACLES = reg.queries, reg.oracles
