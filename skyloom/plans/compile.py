"""Queries on typed records: measurements, bundles, solutions, impact, contributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import classify as C
from skyloom.functions import text as X
from skyloom.operators import records as D
from skyloom.operators import tags as T
from skyloom.plans.registry import Registry

reg = Registry()
query = reg.query

MEASURES = [D.Measure("quantity", "l_quantity", None, "e", "lim", "ref", "d"), D.Measure("price", "l_extendedprice", "l_tax", "l_discount", None, None, "eur", "V")]
WIDE = "SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS e, CAST(l_linenumber % 4 AS INTEGER) - 2 AS lim, CASE l_returnflag WHEN 'R' THEN ' ' ELSE l_returnflag END AS ref FROM lineitem"


@query(f"""WITH w AS ({WIDE}) SELECT l_orderkey, l_linenumber, 'quantity' AS quantity_key, l_quantity AS value, abs(e) AS error_low, abs(e) AS error_high, CASE WHEN lim > 0 THEN 'upper' WHEN lim < 0 THEN 'lower' END AS bound, nullif(trim(ref), '') AS reference, 'd' AS unit, NULL AS band FROM w UNION ALL SELECT l_orderkey, l_linenumber, 'price', l_extendedprice, abs(l_tax), abs(l_discount), NULL, NULL, 'eur', 'V' FROM w""")
def measures(t):
    """Wide rows as measurements with errors, limits, references, units and bands, in one pass."""
    n = F.col("l_linenumber")
    wide = t("lineitem").withColumns({"e": F.when(n % 3 != 0, F.col("l_discount")), "lim": (n % 4 - 2).cast("int"), "ref": F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag"))})
    return D.unpivot_measures(wide, ["l_orderkey", "l_linenumber"], MEASURES)


@query("""SELECT p_partkey, x AS a_star, y AS a_galaxy, z AS b_star FROM (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size / 50.0 END AS x, CASE WHEN p_size % 3 <> 0 THEN 1 - p_size / 50.0 END AS y, CASE WHEN p_size % 2 = 0 THEN 0.5 END::DOUBLE AS z FROM part) WHERE x IS NOT NULL OR z IS NOT NULL""")
def probability_bundles(t):
    """Published probabilities of several models as one checked JSON object, read back."""
    n = F.col("p_size")
    df = t("part").select("p_partkey", F.when(n % 3 != 0, n / 50.0).alias("x"), F.when(n % 3 != 0, 1 - n / 50.0).alias("y"), F.when(n % 2 == 0, 0.5).alias("z"))
    b = D.probability_bundle(df, "p_partkey", {"a": {"star": "x", "galaxy": "y"}, "b": {"star": "z"}})
    at = lambda p: F.get_json_object("bundle", p).cast("double")
    return b.select("p_partkey", at("$.a.star").alias("a_star"), at("$.a.galaxy").alias("a_galaxy"), at("$.b.star").alias("b_star"))


SOLUTIONS = "SELECT l_partkey AS object, l_shipmode AS type, l_quantity AS significance, l_extendedprice AS period FROM (SELECT l_partkey, CASE CAST(l_linenumber % 3 AS INTEGER) WHEN 0 THEN 'Orbital' WHEN 1 THEN 'SB1' ELSE 'other' END AS l_shipmode, CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice FROM lineitem)"


@query(f"""SELECT object, type, significance, period, n AS n_solutions FROM (SELECT *, count(*) OVER (PARTITION BY object) AS n, row_number() OVER (PARTITION BY object ORDER BY significance DESC NULLS LAST, CASE type WHEN 'Orbital' THEN 1 WHEN 'SB1' THEN 2 ELSE 3 END, period, type) AS rn FROM ({SOLUTIONS})) WHERE rn = 1""")
def best_solutions(t):
    n = F.col("l_linenumber")
    s = t("lineitem").select(F.col("l_partkey").alias("object"), F.when(n % 3 == 0, "Orbital").when(n % 3 == 1, "SB1").otherwise("other").alias("type"), F.when(n % 5 != 0, F.col("l_quantity")).alias("significance"), F.col("l_extendedprice").alias("period"))
    return D.best_solutions(s, "object", {"Orbital": 1, "SB1": 2})


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS pair, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p, (o_orderkey % 13) / 12.0 AS e FROM orders), r AS (SELECT c_custkey AS pair, CASE WHEN c_custkey % 4 <> 0 THEN abs(c_acctbal) * 20 END AS q FROM customer WHERE c_custkey % 9 <> 0),
j AS (SELECT o.*, r.pair IS NOT NULL AS known, q, CASE WHEN coalesce(p <= 0 OR e < 0 OR e >= 1, false) THEN 'impossible' WHEN p IS NULL THEN 'no_period' WHEN r.pair IS NULL THEN 'no_pair' WHEN q IS NULL THEN 'first_period' WHEN abs(p - q) <= q * 0.05 THEN 'agrees' ELSE 'conflict' END AS reason FROM o LEFT JOIN r ON o.pair = r.pair)
SELECT reason, CASE WHEN reason IN ('impossible', 'conflict') THEN 'quarantined' WHEN reason IN ('no_period', 'no_pair') THEN 'excluded' ELSE 'accepted' END AS status, count(*) AS n FROM j GROUP BY 1, 2""")
def orbit_reconciliation(t):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    o = t("orders").select(F.col("o_custkey").alias("pair"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("period"), ((k % 13) / 12.0).alias("eccentricity"))
    r = t("customer").where(c % 9 != 0).select(c.alias("pair"), F.when(c % 4 != 0, F.abs("c_acctbal") * 20).alias("period"))
    return D.reconcile_orbits(o, r, "pair").groupBy("reason", "status").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT 'src.' || event_type AS source, CASE min(event_id) % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'missing' END AS change FROM events GROUP BY 1), l AS (SELECT 'src.' || event_type AS source, user_id AS row_id FROM events), n AS (SELECT source, count(DISTINCT row_id) AS n_rows FROM l GROUP BY 1)
SELECT source, change, n_rows, CASE WHEN change = 'missing' OR n_rows > 0.5 * (SELECT sum(n_rows) FROM n) THEN 'full' ELSE 'incremental' END AS plan FROM d JOIN n USING (source)""")
def impact_plan(t):
    source = F.concat(F.lit("src."), "event_type")
    low = F.min("event_id") % 3
    d = t("events").groupBy(source.alias("source")).agg(F.when(low == 0, "new").when(low == 1, "changed").otherwise("missing").alias("change"))
    return D.impact_plan(d, t("events").select(source.alias("source"), F.col("user_id").alias("row_id")))


@query("""WITH n AS (SELECT lower(trim(stable_object_key)) AS object_key, source_id, count(*) AS n FROM selected_facts WHERE stable_object_key IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2) SELECT object_key, count(*) AS n_sources, string_agg(source_id, ',' ORDER BY source_id) AS sources, arg_min(source_id, struct_pack(n := -n, s := source_id)) AS main_source FROM n GROUP BY 1""")
def source_contributions(t):
    f = t("selected_facts").where("stable_object_key IS NOT NULL").select(F.lower(F.trim("stable_object_key")).alias("object_key"), "source_id")
    return D.contributions(f, "object_key", "source_id")


@query("""SELECT l_partkey, round(m, 4) AS mean, round(m - s, 4) AS mean_low, round(m + s, 4) AS mean_high, n, greatest(abs(hi - m), abs(m - lo)) <= 0.9 * abs(m) AS agree FROM (SELECT l_partkey, sum(l_quantity / (e * e)) / sum(1 / (e * e)) AS m, sqrt(1 / sum(1 / (e * e))) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM (SELECT *, l_tax * 10 AS e FROM lineitem) WHERE e > 0 GROUP BY 1)""")
def agreeing_means(t):
    m = D.agreeing_mean(t("lineitem"), ["l_partkey"], F.col("l_quantity"), F.col("l_tax") * 10, 0.9)
    return m.select("l_partkey", *[F.round(c, 4).alias(c) for c in ("mean", "mean_low", "mean_high")], "n", "agree")


@query("""WITH RECURSIVE n AS (SELECT hierarchy_node_key AS k, min(node_kind) AS kind FROM hierarchy_nodes WHERE hierarchy_node_key IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT parent_node_key AS p, child_node_key AS c FROM hierarchy_edges WHERE parent_node_key IN (SELECT k FROM n) AND child_node_key IN (SELECT k FROM n)),
m AS (SELECT c, any_value(p) AS p FROM e GROUP BY c HAVING count(*) = 1), r AS (SELECT k, k AS root, 0 AS depth FROM n WHERE k NOT IN (SELECT c FROM e) UNION ALL SELECT m.c, root, depth + 1 FROM r JOIN m ON m.p = r.k),
s AS (SELECT m.p AS k, count(*) AS n_stars FROM m JOIN r ON r.k = m.c JOIN n ON n.k = m.c WHERE kind = 'star' GROUP BY 1 HAVING count(*) >= 2) SELECT root, k AS key, n_stars FROM s JOIN r USING (k) WHERE depth > 0""")
def nested_groups(t):
    """Groups within a system: nodes below the root with at least two stars under them."""
    from skyloom.plans.catalog import _forest

    f = _forest(t)
    up = f.ids.select(F.col("id").alias("up"), F.col("key").alias("parent"))
    places = f.places.where("depth >= 0").join(up, "up", "left").select("key", "root", "depth", "parent")
    kinds = t("hierarchy_nodes").where("hierarchy_node_key IS NOT NULL").groupBy(F.col("hierarchy_node_key").alias("key")).agg(F.min("node_kind").alias("kind"))
    return D.nested_groups(places, kinds.where("kind = 'star'"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 500)""")
def sample_scope(t):
    """The rows of the first systems by id: a scope for trial runs, which is the feature."""
    scope = D.first_scope(t("orders"), "o_orderkey", 500).withColumnRenamed("o_orderkey", "l_orderkey")
    return t("lineitem").join(F.broadcast(scope), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT event_id, list_sort(json_keys(props)) AS keys, lower(json_type(props)) AS kind FROM events WHERE props IS NOT NULL""")
def json_shapes(t):
    keys, kind = D.json_shape(F.col("props"))
    return t("events").where("props IS NOT NULL").select("event_id", keys.alias("keys"), kind.alias("kind"))


@query("""SELECT doc_id FROM documents WHERE false""")
def gzip_round_trip(t):
    """Texts that gzip payloads do not restore (none)."""
    d = t("documents").where("text IS NOT NULL").select("doc_id", "text", D.gunzip_text(D.gzip_text("text")).alias("back"))
    return d.where("text <> back").select("doc_id")


@query("""SELECT s_suppkey, round(s, 6) AS score, CASE WHEN d <= 2.5 AND s >= 0.72 THEN 'high' WHEN d <= 8 AND s >= 0.45 THEN 'medium' ELSE 'low' END AS tier FROM (SELECT s_suppkey, d, coalesce(greatest(0, 1 - least(d, 15) / 15.0), 0) * 0.46 + least(1, snr / 60.0) * 0.2 + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0.45 END * 0.18 + least(1, greatest(0, c / 1.2)) * 0.08 + coalesce(least(1, m / 0.6), 0) * 0.08 AS s FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 8 <> 0 THEN s_suppkey % 16 END AS d, s_suppkey % 70 AS snr, (s_suppkey % 9) / 4.0 - 0.5 AS c, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey / 20.0 END AS m FROM supplier))""")
def infrared_candidates(t):
    k = F.col("s_suppkey")
    d = F.when(k % 8 != 0, k % 16)
    s = C.infrared_score(d, 15.0, k % 70, k % 3 == 0, (k % 9) / 4.0 - 0.5, F.when(k % 2 == 0, F.col("s_nationkey") / 20.0))
    return t("supplier").select("s_suppkey", F.round(s, 6).alias("score"), C.infrared_tier(d, s).alias("tier"))


@query("""SELECT s_suppkey, round(15 * (h + m / 60.0 + s / 3600.0), 9) AS ra, round(CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END * (d + m / 60.0 + s / 3600.0), 9) + 0.0 AS dec, 'x' || s_suppkey AS token, round(pow(10, d / 10.0), 6) AS power FROM (SELECT s_suppkey, s_suppkey % 24 AS h, s_suppkey % 60 AS m, (s_suppkey * 7) % 60 AS s, s_suppkey % 90 AS d FROM supplier)""")
def compact_coordinates(t):
    k = F.col("s_suppkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(two(k % 24), two(k % 60), two(k * 7 % 60), F.when(k % 2 == 0, "-").otherwise("+"), two(k % 90), two(k % 60), two(k * 7 % 60))
    ra, dec = X.compact_position(text)
    return t("supplier").select("s_suppkey", F.round(ra, 9).alias("ra"), F.round(dec, 9).alias("dec"), X.first_token(F.concat(F.lit("  x"), k, F.lit(" rest"))).alias("token"), F.round(X.power_of_ten((k % 90 / 10.0).cast("string")), 6).alias("power"))


@query("""SELECT p_partkey, CASE WHEN r IS NULL AND m IS NULL THEN NULL WHEN r IS NOT NULL THEN CASE WHEN r >= 6 THEN 2 WHEN r >= 2 THEN 1 ELSE 0 END ELSE CASE WHEN m >= 50 THEN 2 WHEN m >= 10 THEN 1 ELSE 0 END END AS size FROM (SELECT p_partkey, coalesce(CASE WHEN p_size % 5 = 0 THEN p_size / 4.0 END, CASE WHEN p_size % 5 = 1 THEN p_size / 40.0 * 11.209 END) AS r, coalesce(CASE WHEN p_size % 5 = 2 THEN p_size * 2.0 END, CASE WHEN p_size % 5 = 3 THEN p_size / 100.0 * 317.83 END) AS m FROM part)""")
def planet_sizes(t):
    n = F.col("p_size")
    only = lambda r, v: F.when(n % 5 == r, v)
    return t("part").select("p_partkey", C.planet_size(only(0, n / 4.0), only(1, n / 40.0), only(2, n * 2.0), only(3, n / 100.0)).alias("size"))


@query("""SELECT c_custkey, round(sqrt(x * x + y * y), 6) AS distance FROM (SELECT c_custkey, c_acctbal / 100 AS x, c_nationkey * 2.0 AS y FROM customer) WHERE sqrt(x * x + y * y) <= 60 ORDER BY sqrt(x * x + y * y), c_custkey LIMIT 300""")
def map_systems(t):
    """The nearest systems within a distance, up to a limit, which is the feature."""
    d = F.sqrt(F.col("c_acctbal") / 100 * (F.col("c_acctbal") / 100) + F.col("c_nationkey") * 2.0 * (F.col("c_nationkey") * 2.0))
    return t("customer").select("c_custkey", d.alias("d")).where("d <= 60").orderBy("d", "c_custkey").limit(300).select("c_custkey", F.round("d", 6).alias("distance"))


RULES = [
    T.Rule("single", "equals", "n", {"value": 1}), T.Rule("rich", "at_least", "n", {"value": 15}), T.Rule("near", "at_most", "dist", {"value": 20.0}), T.Rule("middle", "above_to", "dist", {"low": 20.0, "high": 60.0}),
    T.Rule("hot", "class_in", "class", {"values": ["O", "B", "A"]}), T.Rule("quick", "below", "period", {"value": 30.0, "status": "status", "allowed": ["confirmed", "known", "published"]}),
]


@query("""SELECT system_id, tag FROM (SELECT system_id, unnest([CASE WHEN n = 1 THEN 'single' END, CASE WHEN n >= 15 THEN 'rich' END, CASE WHEN dist <= 20 THEN 'near' END, CASE WHEN dist > 20 AND dist <= 60 THEN 'middle' END, CASE WHEN class IN ('O', 'B', 'A') THEN 'hot' END, CASE WHEN period < 30 AND status = 'confirmed' THEN 'quick' END]) AS tag FROM (SELECT c_custkey AS system_id, count(o_orderkey) AS n, max(abs(c_acctbal)) / 100 AS dist, substr('OBAFGKM', CAST(c_custkey % 7 AS INTEGER) + 1, 1) AS class, max(c_nationkey) * 2.0 AS period, CASE WHEN c_custkey % 3 = 0 THEN 'confirmed' WHEN c_custkey % 3 = 1 THEN 'candidate' ELSE 'confirmed' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)) WHERE tag IS NOT NULL""")
def tag_assignments(t):
    """Count, numeric, range, class and planet rules of a tag registry in one pass over the systems."""
    k = F.col("c_custkey")
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    x = t("customer").join(n, "c_custkey", "left").select(
        k.alias("system_id"), F.coalesce("n", F.lit(0)).alias("n"), (F.abs("c_acctbal") / 100).alias("dist"), F.lit("obafgkm").substr((k % 7 + 1).cast("int"), F.lit(1)).alias("class"),
        (F.col("c_nationkey") * 2.0).alias("period"), F.when(k % 3 == 1, "candidate").when(k % 3 == 0, "Confirmed").alias("status"),
    )
    return T.evaluate(x, "system_id", RULES)


QUERIES, ORACLES = reg.queries, reg.oracles
