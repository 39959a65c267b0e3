"""Queries on identity, evidence, space, graphs, search, tags, scores and audits, bound to the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import astro as A
from skyloom.functions import classify as C
from skyloom.functions import text as X
from skyloom.operators import evidence as E
from skyloom.operators import graph as G
from skyloom.operators import identity as I
from skyloom.operators import relational as R
from skyloom.operators import search as S
from skyloom.operators import spatial as P
from skyloom.plans.registry import Registry

reg = Registry()
query = reg.query


# Text and identifiers -------------------------------------------------------


@query("""SELECT p_partkey, nullif(trim(lower(regexp_replace(p_name || ' / ' || p_brand, '[^0-9A-Za-z]+', ' ', 'g'))), '') AS name FROM part""")
def name_normalise(t):
    return t("part").select("p_partkey", X.normalize_name(F.concat("p_name", F.lit(" / "), "p_brand")).alias("name"))


@query("""WITH q AS (SELECT c_custkey, CASE CAST(c_custkey % 5 AS INTEGER) WHEN 0 THEN 'HIP ' || c_custkey WHEN 1 THEN 'hd' || c_custkey WHEN 2 THEN 'Gaia DR3 ' || (c_custkey + 4000000000) WHEN 3 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS s FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(lower(s), '[0-9]{10,}') THEN 'gaia' WHEN regexp_full_match(s, '[0-9]+') THEN 'numeric' WHEN regexp_full_match(lower(s), 'gaia\\s*(dr[0-9]+|edr3)?\\s*[0-9]+') THEN 'gaia' WHEN regexp_full_match(lower(s), 'hip\\s*[0-9]+') THEN 'hip' WHEN regexp_full_match(lower(s), 'hd\\s*[0-9]+') THEN 'hd' END AS kind,
CASE WHEN c_custkey % 5 = 3 THEN '' ELSE regexp_extract(s, '([0-9]+)$', 1) END AS number FROM q""")
def identifier_parse(t):
    k = F.col("c_custkey")
    s = F.when(k % 5 == 0, F.concat(F.lit("HIP "), k)).when(k % 5 == 1, F.concat(F.lit("hd"), k)).when(k % 5 == 2, F.concat(F.lit("Gaia DR3 "), k + 4000000000)).when(k % 5 == 3, F.col("c_name")).otherwise(k.cast("string"))
    return t("customer").select("c_custkey", s.alias("s")).select("c_custkey", X.identifier_kind(F.col("s")).alias("kind"), X.identifier_number(F.col("s")).alias("number"))


@query("""SELECT p_partkey, 'TOI-' || (p_partkey + 1) || '.' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS toi, 'ngc ' || (p_partkey + 1) || 'a' AS deep FROM part""")
def designation_parse(t):
    n = F.col("p_partkey") + 1
    return t("part").select(
        "p_partkey", X.candidate_designation(F.concat(F.lit("toi 00"), n, F.lit("."), F.col("p_size"))).alias("toi"),
        X.deep_sky_designation(F.concat(F.lit("NGC 000"), n, F.lit("A"))).alias("deep"))


@query("""SELECT s_suppkey, round((CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END) * (s_suppkey % 60 + 30 / 60.0 + 15.5 / 3600.0), 6) AS deg FROM supplier""")
def coordinate_parse(t):
    k = F.col("s_suppkey")
    s = F.concat(F.when(k % 2 == 0, "-").otherwise("+"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(" 30 15.5"))
    return t("supplier").select("s_suppkey", F.round(X.sexagesimal_degrees(s), 6).alias("deg"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey < 26 THEN chr(97 + n_nationkey % 26) ELSE '' END AS label, CASE WHEN n_nationkey + 30 < 52 THEN 'a' ELSE 'b' END || chr(97 + (n_nationkey + 30) % 26) AS label2 FROM nation""")
def component_labels(t):
    return t("nation").select("n_nationkey", X.ordinal_label(F.col("n_nationkey")).alias("label"), X.ordinal_label(F.col("n_nationkey") + 30).alias("label2"))


@query("""SELECT vec_id, round(list_sum(list_filter(v, lambda x: x IS NOT NULL)), 3) AS total, CAST(len(list_filter(v, lambda x: x IS NULL)) AS BIGINT) AS n_masked FROM (SELECT vec_id, [CAST(vec_id AS DOUBLE), NULL, CAST(label AS DOUBLE) + 0.5, NULL] AS v FROM embeddings)""")
def masked_vector(t):
    text = F.concat(F.lit("["), F.col("vec_id").cast("string"), F.lit(".0 -- "), F.col("label").cast("string"), F.lit(".5 --]"))
    v = X.masked_vector(text)
    return t("embeddings").select("vec_id", F.round(F.aggregate(F.filter(v, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.size(F.filter(v, lambda x: x.isNull())).cast("bigint").alias("n_masked"))


@query("""SELECT doc_id, CAST(i AS BIGINT) AS line_number, text_lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS text_lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)""")
def document_lines(t):
    lines = t("documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_number"), "line")


@query("""SELECT DISTINCT native_row_id, field_name, CASE WHEN v = '' THEN NULL ELSE v END AS value
FROM (SELECT native_row_id, field_name, trim(TRY(decode(encode(raw_row)[start_byte:end_byte]))) AS v FROM evidence_lake_native JOIN (SELECT * FROM native_layouts WHERE layout_kind = 'fixed_width') USING (source_table) WHERE raw_row IS NOT NULL)""")
def fixed_width_parse(t):
    """Every field that the layouts declare for a fixed-width table, cut by bytes from every line; a line too short for a field gives null."""
    from skyloom.sources.text import cut_bytes

    layouts = F.broadcast(t("native_layouts").where("layout_kind = 'fixed_width'").select("source_table", "field_name", "start_byte", "end_byte"))
    rows = t("evidence_lake_native").where("raw_row IS NOT NULL").select("native_row_id", "source_table", "raw_row").join(layouts, "source_table")
    v = cut_bytes(F.col("raw_row"), F.col("start_byte"), F.col("end_byte"))
    return rows.select("native_row_id", "field_name", F.nullif(v, F.lit("")).alias("value")).distinct()


# Identity -------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'gaia:' || o_orderkey WHEN o_orderkey % 5 = 0 THEN 'hip:' || o_custkey ELSE 'node:' || o_orderkey END AS canonical FROM orders""")
def canonical_keys(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", I.canonical_key(("gaia:", F.when(k % 3 == 0, k)), ("hip:", F.when(k % 5 == 0, F.col("o_custkey"))), ("node:", k)).alias("canonical"))


@query("""WITH e AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL), c AS (SELECT user_id, c_custkey AS target, 0 AS p FROM e JOIN customer ON user_id = c_custkey AND c_acctbal > 5000 UNION ALL SELECT user_id, c_custkey, 1 FROM e JOIN customer ON user_id % 977 = c_custkey % 977 AND c_nationkey = 3),
g AS (SELECT user_id, p, min(target) AS lo, max(target) AS hi FROM c GROUP BY 1, 2), b AS (SELECT user_id, min(p) AS p FROM g GROUP BY 1) SELECT user_id, CASE WHEN lo = hi THEN lo END AS target, p AS priority, CASE WHEN lo = hi THEN 'accepted' ELSE 'ambiguous' END AS outcome FROM g JOIN b USING (user_id, p)""")
def identity_waterfall(t):
    e = t("events").where("user_id IS NOT NULL").select("user_id").distinct()
    c = t("customer")
    first = e.join(c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("target")), "user_id")
    second = e.withColumn("m", F.col("user_id") % 977).join(c.where("c_nationkey = 3").select((F.col("c_custkey") % 977).alias("m"), F.col("c_custkey").alias("target")), "m").select("user_id", "target")
    return I.resolve_by_priority([first, second], "user_id", "target")


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) AS nl, max(CAST(l_returnflag = 'R' AS INTEGER)) AS r FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, 1 AS n, o_orderstatus AS s FROM orders)
SELECT k, CASE WHEN s = 'P' THEN 'excluded' WHEN coalesce(nl, 0) > 6 AND r = 1 THEN 'quarantined' WHEN nl IS NULL THEN 'missing' WHEN nl = 1 THEN 'accepted' ELSE 'ambiguous_split' END AS state FROM o LEFT JOIN l USING (k)""")
def release_state_machine(t):
    l = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("nl"), F.max(F.col("l_returnflag") == "R").alias("r"))
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")).join(l, "k", "left")
    n = F.coalesce("nl", F.lit(0))
    return o.select("k", I.binding_state(F.lit(1), n, F.col("s") == "P", (n > 6) & F.coalesce("r", F.lit(False))).alias("state"))


@query("""SELECT 'name_to_many' AS rule, s_name || '' AS key, count(DISTINCT s_suppkey) AS n FROM (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS s_name FROM supplier) GROUP BY 2 HAVING count(DISTINCT s_suppkey) > 1 UNION ALL SELECT 'order_to_many', CAST(o_custkey AS VARCHAR), count(DISTINCT o_orderpriority) FROM orders GROUP BY 2 HAVING count(DISTINCT o_orderpriority) > 1""")
def quarantine_conflicts(t):
    return I.conflicts({"name_to_many": (t("supplier"), "s_nationkey", "s_suppkey"), "order_to_many": (t("orders"), "o_custkey", "o_orderpriority")})


@query("""SELECT event_id, CASE WHEN a = 'retracted' THEN 'retracted' WHEN b IS NULL THEN 'new' WHEN a = b THEN 'unchanged' WHEN b = 'candidate' THEN (CASE a WHEN 'confirmed' THEN 'promoted' ELSE 'demoted' END) ELSE 'demoted' END AS transition FROM (SELECT event_id, CASE CAST(event_id % 3 AS INTEGER) WHEN 0 THEN 'confirmed' WHEN 1 THEN 'candidate' END AS b, CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 'confirmed' WHEN 1 THEN 'candidate' WHEN 2 THEN 'controversial' ELSE 'retracted' END AS a FROM events)""")
def lifecycle_transitions(t):
    k = F.col("event_id")
    before = F.when(k % 3 == 0, "confirmed").when(k % 3 == 1, "candidate")
    after = F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "candidate").when(k % 4 == 2, "controversial").otherwise("retracted")
    return t("events").select("event_id", I.lifecycle_transition(before, after).alias("transition"))


@query("""SELECT c_nationkey AS left_key, p_size AS right_key, max(l_discount) AS confidence, count(*) AS support FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def canonical_relations(t):
    """Edges between records lifted to their canonical objects."""
    e = t("lineitem").select("l_orderkey", "l_partkey", "l_discount").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    e = e.join(t("customer").select("c_custkey", F.col("c_nationkey").alias("left_key")), "c_custkey").join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("right_key")), "l_partkey")
    return e.groupBy("left_key", "right_key").agg(F.max("l_discount").alias("confidence"), F.count("*").alias("support"))


# Evidence and derivation ----------------------------------------------------


OFFERS = "SELECT l_partkey AS part, l_suppkey AS supp, count(*) AS n_rows, count(DISTINCT l_returnflag) AS n_kinds, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2"


@query(f"""SELECT part, supp, runner_up, n_sets FROM (SELECT part, supp, lead(supp) OVER w AS runner_up, count(*) OVER (PARTITION BY part) AS n_sets, row_number() OVER w AS rn FROM ({OFFERS}) WINDOW w AS (PARTITION BY part ORDER BY n_rows DESC, n_kinds DESC, top DESC NULLS LAST, supp)) WHERE rn = 1""")
def preselect_sets(t):
    offers = t("lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).agg(F.count("*").alias("n_rows"), F.countDistinct("l_returnflag").alias("n_kinds"), F.max("l_extendedprice").alias("top"))
    return E.select_sets(offers, "part", "supp", F.desc("n_rows"), F.desc("n_kinds"), F.desc_nulls_last("top"))


@query("""WITH w AS (SELECT l_partkey, l_suppkey FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, max(l_quantity) DESC, l_suppkey) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1) SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem SEMI JOIN w USING (l_partkey, l_suppkey)""")
def select_facts(t):
    line = t("lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    sets = line.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    return E.select_facts(line, E.select_sets(sets, "l_partkey", "l_suppkey", F.desc("n"), F.desc("q")), "l_partkey", "l_suppkey").drop("l_quantity")


@query("""SELECT 'negative_quantity' AS check_name, count(*) AS n_bad FROM lineitem WHERE l_quantity < 0 UNION ALL SELECT 'orphan_lines', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) UNION ALL SELECT 'repeated_orders', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)""")
def integrity_checks(t):
    line, orders = t("lineitem"), t("orders")
    return E.integrity({
        "negative_quantity": line.where("l_quantity < 0"),
        "orphan_lines": line.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti"),
        "repeated_orders": orders.groupBy("o_orderkey").count().where("count > 1"),
    })


@query("""SELECT p_partkey, round(a, 6) AS axis, round(1.2 / (a * a), 6) AS s, round(278.5 * pow(1.2 / (a * a), 0.25), 4) AS t_eq, round(r * r * pow((3000 + p_retailprice) / 5772.0, 4), 6) AS lum FROM (SELECT p_partkey, p_retailprice, p_size / 10.0 AS r, pow((0.5 + p_size / 50.0) * pow(p_retailprice / 365.25, 2), 1.0 / 3) AS a FROM part)""")
def derive_orbits(t):
    axis = A.kepler_axis(0.5 + F.col("p_size") / 50.0, F.col("p_retailprice"))
    s = A.insolation(F.lit(1.2), axis)
    return t("part").select("p_partkey", F.round(axis, 6).alias("axis"), F.round(s, 6).alias("s"), F.round(A.equilibrium_temperature(s), 4).alias("t_eq"), F.round(A.luminosity_from(F.col("p_size") / 10.0, 3000 + F.col("p_retailprice")), 6).alias("lum"))


@query("""SELECT p_partkey, round(1000 / (p_size + 0.5), 6) AS pc, round(p_size / nullif(abs((p_size + 2.0) - (p_size - 1.0)) / 2, 0), 6) AS snr FROM part""")
def parallax_distance(t):
    p = F.col("p_size") + 0.5
    return t("part").select("p_partkey", F.round(A.parallax_distance_pc(p), 6).alias("pc"), F.round(F.col("p_size") / F.nullif(A.half_width(F.col("p_size") - 1.0, F.col("p_size") + 2.0), F.lit(0.0)), 6).alias("snr"))


@query("""SELECT p_partkey, CASE WHEN t >= 30000 THEN 'O' WHEN t >= 10000 THEN 'B' WHEN t >= 7500 THEN 'A' WHEN t >= 6000 THEN 'F' WHEN t >= 5200 THEN 'G' WHEN t >= 3700 THEN 'K' WHEN t >= 2400 THEN 'M' ELSE 'L' END AS by_teff, CASE WHEN m >= 16 THEN 'O' WHEN m >= 2.1 THEN 'B' WHEN m >= 1.4 THEN 'A' WHEN m >= 1.04 THEN 'F' WHEN m >= 0.85 THEN 'G' WHEN m >= 0.65 THEN 'K' WHEN m >= 0.08 THEN 'M' ELSE 'L' END AS by_mass FROM (SELECT p_partkey, p_retailprice * 8 AS t, p_size / 10.0 AS m FROM part)""")
def class_buckets(t):
    return t("part").select("p_partkey", C.class_from_temperature(F.col("p_retailprice") * 8).alias("by_teff"), C.class_from_mass(F.col("p_size") / 10.0).alias("by_mass"))


#: The spellings of an attribute in the catalog, without case, blanks, hyphens and underscores.
SPELLED = "lower(regexp_replace(quantity_key, '[ _-]+', '', 'g')) IN (SELECT lower(regexp_replace(unnest(list_append(other_names, quantity_key)), '[ _-]+', '', 'g')) FROM quantity_catalog WHERE quantity_key = 'spectral_type')"


def spelled(t, attribute):
    """The facts of an attribute under any of its catalog spellings."""
    from skyloom.operators.wide import attribute_form

    names = t("quantity_catalog").where(F.col("quantity_key") == attribute).select(F.explode(F.array_append("other_names", F.col("quantity_key"))).alias("n"))
    forms = names.select(attribute_form(F.col("n")).alias("_form")).distinct()
    return t("selected_facts").withColumn("_form", attribute_form(F.col("quantity_key"))).join(F.broadcast(forms), "_form", "left_semi").drop("_form")


@query(f"""SELECT selected_fact_id, CASE WHEN regexp_matches(trim(value_raw), '^(WR|WN|WC|WO)') THEN 'WR' WHEN regexp_matches(trim(value_raw), '^(WD|D[ABCOQXZ])') THEN 'WD' WHEN regexp_matches(trim(value_raw), '^(esd|sd|d)?[OBAFGKMLTY]') THEN regexp_extract(trim(value_raw), '^(?:esd|sd|d)?([OBAFGKMLTY])', 1) END AS class FROM (SELECT DISTINCT selected_fact_id, value_raw FROM selected_facts WHERE {SPELLED})""")
def spectral_class(t):
    f = spelled(t, "spectral_type").select("selected_fact_id", "value_raw").distinct()
    return f.select("selected_fact_id", C.class_from_spectral_type(F.col("value_raw")).alias("class"))


@query("""SELECT p_partkey, CASE WHEN h IS NULL OR s IS NULL THEN 512 ELSE CAST(pow(2, h * 3 + s) AS INTEGER) END AS bit FROM (SELECT p_partkey, CASE WHEN r >= 6 THEN 2 WHEN r >= 2 THEN 1 WHEN r IS NOT NULL THEN 0 WHEN m >= 50 THEN 2 WHEN m >= 10 THEN 1 WHEN m IS NOT NULL THEN 0 END AS s, CASE WHEN k >= 320 THEN 2 WHEN k >= 200 THEN 1 WHEN k IS NOT NULL THEN 0 END AS h FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size / 5.0 END AS r, CASE WHEN p_size % 3 = 0 THEN p_size * 2.0 END AS m, CASE WHEN p_size % 5 <> 0 THEN p_retailprice / 5 END AS k FROM part))""")
def planet_category(t):
    n = F.col("p_size")
    return t("part").select("p_partkey", C.planet_bit(F.when(n % 2 == 0, n / 5.0), F.when(n % 3 == 0, n * 2.0), F.when(n % 5 != 0, F.col("p_retailprice") / 5)).alias("bit"))


# Space ----------------------------------------------------------------------


SKY = "SELECT o_orderkey AS id, (o_orderkey * 37) % 3600 / 10.0 AS ra, (o_orderkey * 17) % 1700 / 10.0 - 85 AS dec FROM orders"
SKY2 = "SELECT o_orderkey AS id, (o_orderkey * 37) % 3600 / 10.0 + (o_orderkey % 7) / 3600.0 AS ra, (o_orderkey * 17) % 1700 / 10.0 - 85 + (o_orderkey % 5) / 3600.0 AS dec FROM orders"


@query(f"""WITH a AS ({SKY}), b AS ({SKY2}), p AS (SELECT a.id AS left_id, b.id AS right_id, degrees(acos(least(1.0, greatest(-1.0, sin(radians(a.dec)) * sin(radians(b.dec)) + cos(radians(a.dec)) * cos(radians(b.dec)) * cos(radians(a.ra) - radians(b.ra)))))) * 3600 AS sep FROM a JOIN b ON b.ra BETWEEN a.ra - 0.01 AND a.ra + 0.01 AND b.dec BETWEEN a.dec - 0.01 AND a.dec + 0.01) SELECT left_id, count(*) AS n_close FROM p WHERE sep <= 8 GROUP BY 1""")
def sky_neighbours(t):
    """Neighbour counts on plain bins of right ascension and declination; positions here keep off the seam and the poles (``sky_crossmatch`` has none)."""
    k = F.col("o_orderkey")
    sky = lambda off: t("orders").select(k.alias("id"), ((k * 37) % 3600 / 10.0 + (off * (k % 7)) / 3600.0).alias("ra"), ((k * 17) % 1700 / 10.0 - 85 + (off * (k % 5)) / 3600.0).alias("dec"))
    a = sky(0).withColumns({"bx": F.floor(F.col("ra") * 20), "by": F.floor((F.col("dec") + 90) * 20)})
    b = R.neighbour_bins(sky(1), bx=F.floor(F.col("ra") * 20), by=F.floor((F.col("dec") + 90) * 20)).withColumnsRenamed({"id": "rid", "ra": "ra2", "dec": "dec2"})
    near = a.join(b, ["bx", "by"]).where(A.separation_arcsec(F.col("ra"), F.col("dec"), F.col("ra2"), F.col("dec2")) <= 8)
    return near.groupBy(F.col("id").alias("left_id")).agg(F.count("*").alias("n_close"))


@query(f"""WITH a AS (SELECT *, (id % 13) * 0.25 AS mag, id % 29 AS pm FROM ({SKY})), b AS (SELECT id, ra, dec + 1 / 3600.0 AS dec, (id % 7) * 0.5 AS mag, id % 31 AS pm FROM (SELECT min(id) AS id, ra, dec FROM ({SKY}) GROUP BY 2, 3)),
p AS (SELECT a.id AS left_id, b.id AS right_id, degrees(acos(least(1.0, greatest(-1.0, sin(radians(a.dec)) * sin(radians(b.dec)) + cos(radians(a.dec)) * cos(radians(b.dec)) * cos(radians(a.ra) - radians(b.ra)))))) * 3600 AS sep, abs(a.mag - b.mag) AS dmag, abs(a.pm - b.pm) AS dpm FROM a JOIN b ON b.ra BETWEEN a.ra - 0.1 AND a.ra + 0.1 AND b.dec BETWEEN a.dec - 0.01 AND a.dec + 0.01 WHERE a.id % 10 <> 0),
w AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(sep, 3), dmag, right_id) AS rn FROM p WHERE sep <= 8),
s AS (SELECT left_id, right_id, CAST(CASE WHEN sep <= 2 THEN 70 WHEN sep <= 5 THEN 55 WHEN sep <= 15 THEN 35 ELSE 15 END + CASE WHEN dmag <= 0.5 THEN 20 WHEN dmag <= 1.5 THEN 10 ELSE 0 END + CASE WHEN dpm <= 5 THEN 15 WHEN dpm <= 20 THEN 8 ELSE 0 END AS INTEGER) AS score FROM w WHERE rn = 1)
SELECT left_id, right_id, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 55 THEN 'medium' WHEN score >= 30 THEN 'low' ELSE 'reject' END AS tier FROM s""")
def sky_crossmatch(t):
    """The nearest neighbour of every position not already matched by an id, with its confidence."""
    k = F.col("o_orderkey")
    sky = t("orders").select(k.alias("id"), ((k * 37) % 3600 / 10.0).alias("ra"), ((k * 17) % 1700 / 10.0 - 85).alias("dec"))
    a = sky.withColumn("mag", (F.col("id") % 13) * 0.25)
    b = sky.groupBy("ra", "dec").agg(F.min("id").alias("id")).withColumns({"dec": F.col("dec") + 1 / 3600.0, "mag": (F.col("id") % 7) * 0.5})
    m = P.sky_crossmatch(a, b, 8.0, matched=sky.where("id % 10 = 0").select("id"))
    score = C.crossmatch_score(F.col("sep_arcsec"), F.col("dmag"), F.abs(F.col("left_id") % 29 - F.col("right_id") % 31))
    return m.select("left_id", "right_id", score.alias("score")).withColumn("tier", C.crossmatch_tier(F.col("score")))


POINTS = "SELECT o_orderkey AS id, (o_orderkey * 7919) % 1999 - 999.0 AS x, (o_orderkey * 104729) % 1999 - 999.0 AS y, (o_custkey * 1299709) % 1999 - 999.0 AS z FROM orders"


def _points(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t("orders").select(k.alias("id"), ((k * 7919) % 1999 - 999.0).alias("x"), ((k * 104729) % 1999 - 999.0).alias("y"), ((c * 1299709) % 1999 - 999.0).alias("z"))


def _bits(v: str, depth: int, shift: int) -> str:
    return " + ".join(f"((({v} >> {i}) & 1) << {3 * i + shift})" for i in range(depth))


@query(f"""SELECT id, {_bits('cx', 21, 0)} + {_bits('cy', 21, 1)} + {_bits('cz', 21, 2)} AS morton FROM (SELECT id, CAST(round((x + 1000) / 2000 * 2097151) AS BIGINT) AS cx, CAST(round((y + 1000) / 2000 * 2097151) AS BIGINT) AS cy, CAST(round((z + 1000) / 2000 * 2097151) AS BIGINT) AS cz FROM ({POINTS}))""")
def morton_key(t):
    return A.with_morton_key(_points(t)).select("id", "morton")


def _cell(depth: int) -> str:
    n = 1 << depth
    return " + ".join(_bits(f"CAST(least({n - 1}, greatest(0, floor(({v} + 1024) / 2048 * {n}))) AS BIGINT)", depth, s) for s, v in enumerate("xyz"))


@query(f"""WITH c AS (SELECT id, {_cell(2)} AS c2, {_cell(3)} AS c3, {_cell(1)} AS c1 FROM ({POINTS})), n AS (SELECT *, count(*) OVER (PARTITION BY c2) AS n FROM c)
SELECT id, CAST(CASE WHEN n > 240 THEN 3 ELSE 2 END AS INTEGER) AS depth, CASE WHEN n > 240 THEN c3 ELSE c2 END AS tile, CASE WHEN n > 240 THEN c2 ELSE c1 END AS parent FROM n""")
def octree_tiles(t):
    return P.octree_tiles(_points(t), 240, 2).select("id", "depth", "tile", "parent")


@query()
def tile_sample(t):
    tiles = P.octree_tiles(_points(t), 240, 2).withColumn("score", F.col("id") % 101)
    return P.tile_sample(tiles, "tile", "score", "id", 16)


@query("""SELECT id, round(d * cos(radians(dec)) * cos(radians(ra)), 6) AS x, round(d * cos(radians(dec)) * sin(radians(ra)), 6) AS y, round(d * sin(radians(dec)), 6) AS z FROM (SELECT o_orderkey AS id, (o_orderkey * 37) % 360 + 0.25 AS ra, (o_orderkey * 17) % 170 - 85.0 AS dec, o_totalprice / 1000 AS d FROM orders)""")
def spherical_to_cartesian(t):
    k = F.col("o_orderkey")
    x, y, z = A.cartesian((k * 37) % 360 + 0.25, (k * 17) % 170 - 85.0, F.col("o_totalprice") / 1000)
    return t("orders").select(k.alias("id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


@query("""WITH keep AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM keep))""")
def public_slice(t):
    """Retention of objects carried down to their dependent rows."""
    keep = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = t("orders").join(keep, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return t("lineitem").join(orders, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


# Graphs ---------------------------------------------------------------------


EDGES = "SELECT o_orderkey AS s, o_orderkey // 2 + o_orderkey % 3 AS d, 0.5 + (o_orderkey % 50) / 100.0 AS w, o_orderstatus AS st FROM orders"


def _edges(t):
    k = F.col("o_orderkey")
    return t("orders").select(k.alias("s"), (F.floor(k / 2) + k % 3).alias("d"), (0.5 + (k % 50) / 100.0).alias("w"), F.col("o_orderstatus").alias("st"))


@query(f"""WITH RECURSIVE e AS ({EDGES}), r AS (SELECT DISTINCT s AS node FROM e WHERE st = 'P' UNION SELECT d FROM r JOIN e ON s = node) SELECT node FROM r""")
def reachability(t):
    e = _edges(t)
    return G.reachable(e, e.where("st = 'P'").select(F.col("s").alias("node")), "s", "d", "node").select("node")


@query(f"""WITH RECURSIVE e AS (SELECT s, d, max(w) AS w, min(st) AS st FROM ({EDGES}) GROUP BY 1, 2), r AS (SELECT s AS root, d AS node, w AS c, 1 AS depth FROM e WHERE st = 'P' UNION ALL SELECT root, d, least(c, w), depth + 1 FROM r JOIN e ON s = node WHERE depth < 8) SELECT root, node, max(c) AS confidence FROM r GROUP BY 1, 2""")
def hierarchy_walk(t):
    e = _edges(t)
    return G.walk_best(e, e.where("st = 'P'").select(F.col("s").alias("node")), "s", "d", "w", "node", 8)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, (s_suppkey * 7) % 90 AS b FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, a AS c FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.c = u.a) SELECT a AS node, min(c) AS component FROM r GROUP BY 1""")
def connected_components(t):
    e = t("supplier").select(F.col("s_suppkey").alias("a"), ((F.col("s_suppkey") * 7) % 90).alias("b"))
    return G.components(e, "a", "b")


@query("""SELECT DISTINCT child_node_key AS node FROM hierarchy_edges WHERE child_node_key IS NOT NULL AND child_node_key NOT IN (SELECT parent_node_key FROM hierarchy_edges WHERE parent_node_key IS NOT NULL)""")
def terminal_leaves(t):
    e = t("hierarchy_edges").where("child_node_key IS NOT NULL")
    return G.leaves(e, "parent_node_key", "child_node_key")


# Search and tags ------------------------------------------------------------


@query("""WITH d AS (SELECT c_custkey, lower(c_name) AS term FROM customer), x AS (SELECT *, CASE WHEN term = '0000012' THEN 0 WHEN starts_with(term, '0000012') THEN 1 WHEN contains(term, '0000012') THEN 2 WHEN abs(length(term) - 7) <= 2 AND levenshtein(term, '0000012') <= 2 THEN 3 END AS tier FROM d) SELECT c_custkey, CAST(tier AS INTEGER) AS tier FROM x WHERE tier = (SELECT min(tier) FROM x)""")
def search_tiers(t):
    terms = t("customer").select("c_custkey", F.lower("c_name").alias("term"))
    return S.search_tier(terms, "0000012").select("c_custkey", "tier")


@query("""SELECT c_custkey FROM customer WHERE abs(length(lower(c_name)) - 18) <= 3 AND levenshtein(lower(c_name), 'custemer#000001024') <= 3""")
def search_fuzzy(t):
    terms = t("customer").select("c_custkey", F.lower("c_name").alias("term"))
    return S.search_tier(terms, "custemer#000001024").where("tier = 3").select("c_custkey")


@query("""WITH g AS (SELECT DISTINCT c_custkey, substr(n, CAST(i AS BIGINT), 3) AS gram FROM (SELECT c_custkey, n, unnest(range(1, length(n) - 1)) AS i FROM (SELECT c_custkey, lower(c_name) AS n FROM customer) WHERE length(n) >= 3)) SELECT c_custkey, count(*) AS shared FROM g WHERE gram IN ('000', '001', '012', '123') GROUP BY 1 HAVING count(*) >= 2""")
def search_trigram(t):
    postings = S.trigram_postings(t("customer").select("c_custkey", F.lower("c_name").alias("n")), "c_custkey", "n")
    return S.trigram_candidates(postings, "000123", "c_custkey", 2)


@query("""SELECT o_custkey AS c_custkey FROM (SELECT c_custkey AS o_custkey FROM customer) c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.o_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AND (SELECT count(DISTINCT o_orderpriority) FROM orders o WHERE o.o_custkey = c.o_custkey AND o_orderpriority IN ('3-MEDIUM', '5-LOW')) = 2 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.o_custkey AND o_orderpriority = '4-NOT SPECIFIED')""")
def tag_filter(t):
    tags = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("tag"))
    return S.filter_tags(t("customer").select("c_custkey"), tags, "c_custkey", "tag", ["1-URGENT", "2-HIGH"], ["3-MEDIUM", "5-LOW"], ["4-NOT SPECIFIED"])


@query("""SELECT c_nationkey, o_orderpriority AS tag, count(*) AS n, min(o_orderkey) AS first_target, CAST(bit_or(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END) AS INTEGER) AS evidence, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def tag_rollup(t):
    s = F.col("o_orderstatus")
    m = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return m.groupBy("c_nationkey", F.col("o_orderpriority").alias("tag")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_target"), F.bit_or(F.when(s == "F", 1).when(s == "O", 2).otherwise(4)).alias("evidence"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query()
def tag_hero(t):
    c = t("orders").select("o_custkey", F.concat("o_orderpriority", F.lit("/"), "o_orderkey").alias("tag"), F.round("o_totalprice", 0).alias("score"), F.col("o_orderstatus").alias("family"), F.substring("o_orderpriority", 1, 1).alias("grp"))
    return S.greedy_tags(c, "o_custkey", {"F": 1, "O": 2, "P": 1}, 4)


# Scores and audits ----------------------------------------------------------


SCORE = "SELECT c_custkey AS id, coalesce(n, 0) AS n, coalesce(p, 0) AS p, abs(c_acctbal) AS d FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS p FROM orders GROUP BY 1) ON c_custkey = o_custkey"
RANKED = f"SELECT id, s, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank FROM (SELECT id, %s * least(greatest(n - 1, 0), 4) / 4.0 + %s * p / (SELECT max(o_totalprice) FROM orders) + 0.2 / (1 + (d / 2000) * (d / 2000)) AS s FROM ({SCORE}))"


def _scores(t, a: float, b: float):
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("p"))
    top = t("orders").agg(F.max("o_totalprice").alias("top"))
    x = t("customer").select("c_custkey", F.abs("c_acctbal").alias("d")).join(o, "c_custkey", "left").crossJoin(F.broadcast(top))
    parts = {
        "size": (F.least(F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)), F.lit(4)) / 4.0, a),
        "price": (F.coalesce("p", F.lit(0.0)) / F.col("top"), b),
        "near": (1 / (1 + (F.col("d") / 2000) * (F.col("d") / 2000)), 0.2),
    }
    return x.select(F.col("c_custkey").alias("id"), C.weighted_score(parts).alias("s"))


def _ranked(t, a: float, b: float):
    from skyloom.operators.hierarchy import dense_index
    from skyloom.storage import Scratch

    s = _scores(t, a, b).withColumn("neg", -F.round("s", 9))
    return dense_index(Scratch(s.sparkSession, "rank"), s, "neg", "id", name="rank").select("id", "s", (F.col("rank") + 1).alias("rank"))


@query(f"""SELECT id, round(100 * s, 4) AS score, rank FROM ({RANKED % (0.5, 0.3)})""")
def score_rank(t):
    return _ranked(t, 0.5, 0.3).select("id", F.round(100 * F.col("s"), 4).alias("score"), "rank")


@query(f"""WITH a AS ({RANKED % (0.5, 0.3)}), b AS ({RANKED % (0.3, 0.5)}), j AS (SELECT id, abs(a.rank - b.rank) AS d, a.rank AS ra, b.rank AS rb FROM a JOIN b USING (id)) SELECT count(*) AS n, median(d) AS median_delta, round(quantile_cont(d, 0.95), 6) AS p95_delta, max(d) AS max_delta, count(*) FILTER (WHERE ra <= 100 AND rb <= 100) AS top100_overlap FROM j""")
def ab_rank_audit(t):
    from skyloom.storage import Scratch

    a = _ranked(t, 0.5, 0.3).select("id", F.col("rank").alias("ra"))
    b = _ranked(t, 0.3, 0.5).select("id", F.col("rank").alias("rb"))
    scratch = Scratch(a.sparkSession, "audit")
    j = scratch.write(a.join(b, "id").withColumn("d", F.abs(F.col("ra") - F.col("rb"))))
    middle = R.exact_quantiles(scratch, j.withColumn("all", F.lit(0)), ["all"], "d", {"median_delta": 0.5, "p95_delta": 0.95})
    counts = j.agg(F.count("*").alias("n"), F.max("d").alias("max_delta"), F.count_if((F.col("ra") <= 100) & (F.col("rb") <= 100)).alias("top100_overlap"))
    return counts.crossJoin(F.broadcast(middle)).select("n", "median_delta", F.round("p95_delta", 6).alias("p95_delta"), "max_delta", "top100_overlap")


@query("""SELECT tag, n, least(28.0, round_even(-log10(n / CAST(total AS DOUBLE)) * 7.0, 0)) AS rarity FROM (SELECT event_type || '-' || (event_id % 100 // 30) AS tag, count(*) AS n, (SELECT count(*) FROM events) AS total FROM events GROUP BY 1)""")
def tag_rarity(t):
    tag = F.concat("event_type", F.lit("-"), F.floor(F.col("event_id") % 100 / 30))
    total = t("events").agg(F.count("*").alias("total"))
    g = t("events").groupBy(tag.alias("tag")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    return g.select("tag", "n", C.rarity(F.col("n") / F.col("total"), 7.0).alias("rarity"))


QUERIES, ORACLES = reg.queries, reg.oracles
