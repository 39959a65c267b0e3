"""More queries on names, identifiers, evidence, bindings, hierarchies and serving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions import classify as C
from skyloom.functions import text as X
from skyloom.operators import graph as G
from skyloom.operators import identity as I
from skyloom.operators import relational as R
from skyloom.operators import search as S
from skyloom.operators import tags as T
from skyloom.plans.domain import SPELLED, spelled
from skyloom.plans.registry import Registry

reg = Registry()
query = reg.query


@query("""WITH n AS (SELECT l_partkey AS id, l_suppkey AS s, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS bucket, 'name ' || l_suppkey AS name FROM lineitem), r AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY min(bucket), length(name), name) AS rn FROM n GROUP BY id, name)
SELECT id, max(name) FILTER (WHERE rn = 1) AS display_name, coalesce(string_agg(name, '|' ORDER BY rn) FILTER (WHERE rn BETWEEN 2 AND 9), '') AS alternates FROM r GROUP BY id""")
def name_choice(t):
    """The best-ranked name per object and up to eight alternates in order."""
    f = F.col("l_returnflag")
    n = t("lineitem").select(F.col("l_partkey").alias("id"), F.when(f == "R", 0).when(f == "A", 1).otherwise(2).alias("bucket"), F.concat(F.lit("name "), "l_suppkey").alias("name"))
    per = n.groupBy("id", "name").agg(F.min("bucket").alias("bucket"))
    top = R.bounded_top(per.withColumn("len", F.length("name")), ["id"], 9, F.col("bucket"), F.col("len"), F.col("name"))
    names = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("bucket", "len", "name"))).alias("l"))
    return names.select("id", F.element_at("l", 1)["name"].alias("display_name"), F.array_join(F.transform(F.slice("l", 2, 8), lambda s: s["name"]), "|").alias("alternates"))


@query("""SELECT c_nationkey, arg_min(c_name, struct_pack(r := r, n := c_name)) AS name, min(r) AS rank FROM (SELECT c_nationkey, c_name, CASE WHEN regexp_matches(c_name, '0$') THEN 10 WHEN regexp_matches(c_name, '[1-4]$') THEN 20 WHEN c_name = '' THEN 99 ELSE 50 END AS r FROM customer) GROUP BY 1""")
def prefix_rank(t):
    n = F.col("c_name")
    r = F.when(n.rlike("0$"), 10).when(n.rlike("[1-4]$"), 20).when(n == "", 99).otherwise(50)
    return t("customer").select("c_nationkey", n, r.alias("r")).groupBy("c_nationkey").agg(F.min(F.struct("r", "c_name"))["c_name"].alias("name"), F.min("r").alias("rank"))


HASHED = "SELECT o_orderkey, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)) AS h FROM orders"


@query(f"""WITH a AS ({HASHED}) SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM a JOIN a AS b USING (h)""")
def content_hash_join(t):
    h = t("orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"), 256).alias("h"))
    return h.select(F.col("o_orderkey").alias("left_key"), "h").join(h.select(F.col("o_orderkey").alias("right_key"), "h"), "h").drop("h")


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON lower(regexp_replace(c_name, '[^0-9A-Za-z]+', '', 'g')) = 'customer' || lower(regexp_replace(replace(s_name, 'Supplier', ''), '[^0-9A-Za-z]+', '', 'g'))""")
def stripped_id_join(t):
    c = t("customer").select("c_custkey", X.strip_id(F.col("c_name")).alias("k"))
    s = t("supplier").select("s_suppkey", F.concat(F.lit("customer"), X.strip_id(F.regexp_replace("s_name", "Supplier", ""))).alias("k"))
    return c.join(s, "k").drop("k")


@query("""SELECT md5(concat_ws('|', source_table, raw_row)) AS row_hash, count(*) AS n_copies, min(native_row_id) AS first_row FROM evidence_lake_native WHERE raw_row IS NOT NULL GROUP BY 1""")
def evidence_records(t):
    """Source rows as records: content hash, number of copies, first occurrence."""
    rows = t("evidence_lake_native").where("raw_row IS NOT NULL")
    return rows.groupBy(F.md5(F.concat_ws("|", "source_table", "raw_row")).alias("row_hash")).agg(F.count("*").alias("n_copies"), F.min("native_row_id").alias("first_row"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND (EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 5) OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal < 0))""")
def external_membership(t):
    """A row predicate and membership in any of several external targets: one semi join per namespace on the union of keys."""
    line = t("lineitem").where("l_quantity > 40").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    a = t("part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("a"))
    b = t("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("b"))
    return line.join(a, "l_partkey", "left").join(b, "l_suppkey", "left").where("a OR b").select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment ELSE o_orderstatus END AS label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)""")
def update_and_delete(t):
    """An update from another table and a delete, as a rewrite: left join with coalesce, then an anti join."""
    c = t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    gone = t("lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").join(c, "o_custkey", "left").join(gone, "o_orderkey", "left_anti").select("o_orderkey", F.coalesce("c_mktsegment", "o_orderstatus").alias("label"))


@query("""WITH a AS (SELECT o_custkey AS k, 'urgent' AS basis FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT o_custkey AS k, 'any' AS basis FROM orders WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = o_custkey) GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM b""")
def guarded_insert(t):
    """A stage adds only keys that the stages before it have not resolved."""
    o = t("orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    a = o.where("o_orderpriority = '1-URGENT'").select("k").distinct()
    return a.withColumn("basis", F.lit("urgent")).unionByName(o.select("k").distinct().join(a, "k", "left_anti").withColumn("basis", F.lit("any")))


@query("""SELECT id, round(d, 6) AS distance FROM (SELECT vec_id AS id, sqrt(pow(coalesce(CAST(embedding[1] AS DOUBLE), 0) - 0.1, 2) + pow(coalesce(CAST(embedding[2] AS DOUBLE), 0) + 0.1, 2) + pow(coalesce(CAST(embedding[3] AS DOUBLE), 0), 2)) AS d FROM embeddings) WHERE d BETWEEN 0.05 AND 1.5""")
def origin_distance(t):
    axis = lambda i, o: F.pow(F.coalesce(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0)) - o, F.lit(2.0))
    d = F.sqrt(axis(0, 0.1) + axis(1, -0.1) + axis(2, 0.0))
    return t("embeddings").select(F.col("vec_id").alias("id"), d.alias("d")).where("d BETWEEN 0.05 AND 1.5").select("id", F.round("d", 6).alias("distance"))


@query("""SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def not_in_subquery(t):
    return t("customer").join(t("nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_anti").select("c_custkey")


@query("""SELECT DISTINCT reference_raw AS bibcode, CAST(substr(reference_raw, 1, 4) AS INTEGER) AS year, rtrim(regexp_extract(reference_raw, '^[0-9]{4}([A-Za-z&.]+)', 1), '.') AS journal FROM stellar_parameter_evidence WHERE regexp_matches(reference_raw, '^[0-9]{4}[A-Za-z&.]')""")
def citations(t):
    r = F.col("reference_raw")
    cited = t("stellar_parameter_evidence").where(r.rlike("^[0-9]{4}[A-Za-z&.]")).select("reference_raw").distinct()
    return cited.select(r.alias("bibcode"), F.substring(r, 1, 4).cast("int").alias("year"), F.regexp_replace(F.regexp_extract(r, "^[0-9]{4}([A-Za-z&.]+)", 1), r"\.+$", "").alias("journal"))


@query("""SELECT object_key, CASE WHEN n_missing = 0 THEN 'full' WHEN n_missing < 3 THEN 'partial' ELSE 'none' END AS readiness, missing FROM (SELECT l_orderkey AS object_key, CAST(a IS NULL AS INTEGER) + CAST(b IS NULL AS INTEGER) + CAST(c IS NULL AS INTEGER) AS n_missing, concat_ws(',', CASE WHEN a IS NULL THEN 'a' END, CASE WHEN b IS NULL THEN 'b' END, CASE WHEN c IS NULL THEN 'c' END) AS missing
 FROM (SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, max(l_quantity) FILTER (WHERE l_returnflag = 'N') AS b, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY 1))""")
def readiness(t):
    flags = {"a": "A", "b": "N", "c": "R"}
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("object_key")).agg(*[F.max(F.when(F.col("l_returnflag") == v, F.col("l_quantity"))).alias(k) for k, v in flags.items()])
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in flags]))
    return g.select("object_key", F.when(F.size(missing) == 0, "full").when(F.size(missing) < 3, "partial").otherwise("none").alias("readiness"), F.array_join(missing, ",").alias("missing"))


@query("""SELECT p_partkey, CASE WHEN p - e <= 0 THEN 'missing' WHEN p + e >= 25 OR greatest(0, 1000 / p - 5) <= 40 THEN 'accepted' ELSE 'excluded' END AS outcome, round(1000 / (p + e), 6) AS near_pc, CASE WHEN p > e THEN round(1000 / (p - e), 6) END AS far_pc FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p, p_size % 4 + 0.5 AS e FROM part)""")
def interval_overlap(t):
    p, e = F.col("p_size").cast("double"), F.col("p_size") % 4 + 0.5
    outcome = F.when(p - e <= 0, "missing").when((p + e >= 25) | (F.greatest(F.lit(0.0), 1000 / p - 5) <= 40), "accepted").otherwise("excluded")
    return t("part").select("p_partkey", outcome.alias("outcome"), F.round(1000 / (p + e), 6).alias("near_pc"), F.when(p > e, F.round(1000 / (p - e), 6)).alias("far_pc"))


@query(f"""WITH f AS (SELECT DISTINCT lower(trim(stable_object_key)) AS k, substr(trim(value_raw), 1, 1) AS c, coalesce(authority_rank, 99) AS r FROM selected_facts WHERE {SPELLED} AND regexp_matches(trim(value_raw), '^[OBAFGKM]') AND stable_object_key IS NOT NULL) SELECT k, arg_min(c, struct_pack(r := r, c := c)) AS winner, string_agg(DISTINCT c, ',' ORDER BY c) AS classes FROM f GROUP BY k HAVING count(DISTINCT c) > 1""")
def class_conflicts(t):
    v = F.trim("value_raw")
    f = spelled(t, "spectral_type").where(v.rlike("^[OBAFGKM]") & F.col("stable_object_key").isNotNull())
    f = f.select(F.lower(F.trim("stable_object_key")).alias("k"), F.substring(v, 1, 1).alias("c"), F.coalesce("authority_rank", F.lit(99)).alias("r"))
    g = f.groupBy("k").agg(F.min(F.struct("r", "c"))["c"].alias("winner"), F.sort_array(F.collect_set("c")).alias("cs"))
    return g.where(F.size("cs") > 1).select("k", "winner", F.array_join("cs", ",").alias("classes"))


@query("""SELECT o_orderkey, round(s, 6) AS score, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.45 THEN 'medium' WHEN s >= 0.2 THEN 'low' ELSE 'reject' END AS tier FROM (SELECT o_orderkey, 0.46 * greatest(0, least(1, 1 - (o_orderkey % 50) / 40.0)) + 0.20 * greatest(0, least(1, o_totalprice / 300000)) + 0.34 * (CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.5 END) AS s FROM orders)""")
def weighted_tiers(t):
    k = F.col("o_orderkey")
    parts = {"near": (C.clamp01(1 - (k % 50) / 40.0), 0.46), "strong": (C.clamp01(F.col("o_totalprice") / 300000), 0.20), "flags": (F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.5), 0.34)}
    s = C.weighted_score(parts)
    return t("orders").select("o_orderkey", F.round(s, 6).alias("score"), C.ladder(s, [(0.7, "high"), (0.45, "medium"), (0.2, "low")], "reject").alias("tier"))


@query("""SELECT quantity_key, unit, CAST(count(*) AS BIGINT) AS n, round(avg(CASE unit WHEN 'h' THEN v / 24 WHEN 'y' THEN v * 365.25 ELSE v END), 4) AS mean_days FROM (SELECT 'period' AS quantity_key, CASE CAST(o_orderkey % 3 AS INTEGER) WHEN 0 THEN 'd' WHEN 1 THEN 'h' ELSE 'y' END AS unit, o_totalprice / 100 AS v FROM orders) GROUP BY 1, 2""")
def period_units(t):
    k = F.col("o_orderkey")
    unit = F.when(k % 3 == 0, "d").when(k % 3 == 1, "h").otherwise("y")
    v = F.col("o_totalprice") / 100
    days = F.when(unit == "h", v / 24).when(unit == "y", v * 365.25).otherwise(v)
    return t("orders").select(F.lit("period").alias("quantity_key"), unit.alias("unit"), days.alias("days")).groupBy("quantity_key", "unit").agg(F.count("*").alias("n"), F.round(F.avg("days"), 4).alias("mean_days"))


@query("""SELECT s_suppkey, round(sqrt(a * a + b * b), 6) AS pm, round(ra + a * 10 / 3600000 / cos(radians(d)), 9) AS ra, round(d + b * 10 / 3600000, 9) AS dec FROM (SELECT s_suppkey, s_acctbal / 10 AS a, s_nationkey * 3.0 AS b, s_suppkey % 360 + 0.5 AS ra, s_suppkey % 80 - 40.0 AS d FROM supplier)""")
def epoch_propagation(t):
    a, b, d = F.col("s_acctbal") / 10, F.col("s_nationkey") * 3.0, F.col("s_suppkey") % 80 - 40.0
    return t("supplier").select("s_suppkey", F.round(F.sqrt(a * a + b * b), 6).alias("pm"), F.round(F.col("s_suppkey") % 360 + 0.5 + a * 10 / 3600000 / F.cos(F.radians(d)), 9).alias("ra"), F.round(d + b * 10 / 3600000, 9).alias("dec"))


@query("""WITH s AS (SELECT split_part(k, ':', 1) AS a, split_part(k, ':', 2) AS b, k FROM (SELECT DISTINCT l_suppkey || ':' || l_linenumber AS k FROM lineitem)), c AS (SELECT CAST(s_suppkey AS VARCHAR) AS a, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) SELECT k, CASE WHEN b > '5' THEN 'excluded' WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'accepted' ELSE 'ambiguous' END AS outcome FROM s LEFT JOIN c USING (a)""")
def composite_id_bind(t):
    k = t("lineitem").select(F.concat_ws(":", "l_suppkey", "l_linenumber").alias("k")).distinct()
    k = k.select("k", F.split_part("k", F.lit(":"), F.lit(1)).alias("a"), F.split_part("k", F.lit(":"), F.lit(2)).alias("b"))
    c = t("supplier").where("s_acctbal > 0").groupBy(F.col("s_suppkey").cast("string").alias("a")).agg(F.count("*").alias("n"))
    return k.join(c, "a", "left").select("k", F.when(F.col("b") > "5", "excluded").when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "accepted").otherwise("ambiguous").alias("outcome"))


@query("""WITH p AS (SELECT o_custkey AS id, CASE CAST(o_orderkey % 3 AS INTEGER) WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS x, CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'D' END AS y FROM orders) SELECT id, least(x, y) AS lo, greatest(x, y) AS hi, count(*) AS n FROM p WHERE x <> y GROUP BY 1, 2, 3""")
def pair_labels(t):
    k = F.col("o_orderkey")
    x = F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C")
    y = F.when(k % 5 == 0, "A").when(k % 5 == 1, "B").otherwise("D")
    p = t("orders").where(x != y).select(F.col("o_custkey").alias("id"), F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    return p.groupBy("id", "lo", "hi").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT DISTINCT 'Customer#' || lpad(CAST(s_suppkey * 7 AS VARCHAR), 9, '0') AS q FROM supplier) SELECT q, count(c_custkey) AS n, CASE count(c_custkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'accepted' ELSE 'ambiguous' END AS status FROM q LEFT JOIN customer ON c_name = q GROUP BY 1""")
def exact_identifier(t):
    """Exact identifiers resolve or fail; they never fall through to fuzzy search."""
    asked = t("supplier").select(F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 7).cast("string"), 9, "0")).alias("q")).distinct()
    return S.resolve_exact(asked, t("customer").select(F.col("c_name").alias("term"), "c_custkey"), "q", "term")


@query("""WITH o AS (SELECT o_custkey AS id, 'overlay' AS src, o_orderpriority AS badge FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT o_custkey AS id, 'core' AS src, o_orderpriority AS badge FROM orders WHERE o_custkey NOT IN (SELECT id FROM o)) SELECT id, src, string_agg(DISTINCT badge, ',' ORDER BY badge) AS badges FROM (SELECT * FROM o UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def badges(t):
    """Badges of an object from the overlay if it has any, else from the base layer."""
    o = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("badge"), "o_orderstatus")
    over = o.where("o_orderstatus = 'P'").withColumn("src", F.lit("overlay"))
    base = o.join(over.select("id").distinct(), "id", "left_anti").withColumn("src", F.lit("core"))
    return over.unionByName(base).groupBy("id", "src").agg(F.array_join(F.sort_array(F.collect_set("badge")), ",").alias("badges"))


@query("""WITH s AS (SELECT c_custkey AS id, 'customer' AS kind, lower(c_name) AS term, 1 AS p FROM customer UNION ALL SELECT s_suppkey, 'supplier', lower(s_name), 2 FROM supplier UNION ALL SELECT p_partkey, 'part', lower(p_name), 3 FROM part) SELECT kind, id, min(p) AS priority FROM s WHERE contains(term, '00000001') GROUP BY 1, 2 ORDER BY 3, 2 LIMIT 40""")
def object_search(t):
    s = t("customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.lower("c_name").alias("term"), F.lit(1).alias("p"))
    s = s.unionByName(t("supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.lower("s_name").alias("term"), F.lit(2).alias("p")))
    s = s.unionByName(t("part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.lower("p_name").alias("term"), F.lit(3).alias("p")))
    return s.where(F.contains("term", F.lit("00000001"))).groupBy("kind", "id").agg(F.min("p").alias("priority")).orderBy("priority", "id").limit(40)


OWNERS = "SELECT o_orderkey AS s, o_orderkey // 3 AS d FROM orders WHERE o_orderkey > 0"


@query(f"""WITH RECURSIVE e AS (SELECT d AS p, s AS c FROM ({OWNERS})), r AS (SELECT p AS owner, c AS node, 1 AS depth FROM e WHERE p BETWEEN 10 AND 20 UNION ALL SELECT owner, c, depth + 1 FROM r JOIN e ON node = p WHERE depth < 8 AND NOT (node BETWEEN 10 AND 20)) SELECT node, min(owner) AS owner, count(DISTINCT owner) AS n_owners FROM r GROUP BY 1""")
def owner_propagation(t):
    """Owners handed down to all below them, stopping at nodes that are owners themselves."""
    k = F.col("o_orderkey")
    e = t("orders").where("o_orderkey > 0").select(F.floor(k / 3).alias("p"), k.alias("c"))
    inner = e.where("NOT (p BETWEEN 10 AND 20)").withColumn("w", F.lit(1.0))
    first = e.where("p BETWEEN 10 AND 20").select(F.col("p").alias("owner"), F.col("c").alias("start"))
    below = G.walk_best(inner, first.select(F.col("start").alias("node")).distinct(), "p", "c", "w", "node", 7).select(F.col("root").alias("start"), "node")
    reached = first.select("owner", F.col("start").alias("node")).unionByName(first.join(below, "start").select("owner", "node"))
    return reached.groupBy("node").agg(F.min("owner").alias("owner"), F.countDistinct("owner").alias("n_owners"))


TREE = """RECURSIVE n AS (SELECT DISTINCT hierarchy_node_key AS k FROM hierarchy_nodes WHERE hierarchy_node_key IS NOT NULL),
e AS (SELECT DISTINCT parent_node_key AS p, child_node_key AS c FROM hierarchy_edges WHERE parent_node_key IN (SELECT k FROM n) AND child_node_key IN (SELECT k FROM n)),
m AS (SELECT c, any_value(p) AS p FROM e GROUP BY c HAVING count(*) = 1),
good AS (SELECT k, 0 AS depth, k AS root, k AS path FROM n WHERE k NOT IN (SELECT c FROM e) UNION ALL SELECT m.c, depth + 1, root, path || '/' || m.c FROM good JOIN m ON m.p = good.k),
up AS (SELECT k, k AS a, depth FROM good UNION ALL SELECT up.k, m.p, up.depth - 1 FROM up JOIN m ON m.c = up.a)"""


@query(f"""WITH {TREE} SELECT a AS key, count(*) AS n_leaves FROM up WHERE k NOT IN (SELECT p FROM m) GROUP BY a""")
def leaf_rollup(t):
    """Leaves at or below every node of a hierarchy: their weights are summed along the tour."""
    return _forest(t).places.where("depth >= 0").select("key", "n_leaves")


@query(f"""WITH {TREE} SELECT d.a AS key, d.k AS descendant, good.depth FROM up d JOIN good ON good.k = d.k WHERE d.a <> d.k AND d.a IN (SELECT child_node_key FROM hierarchy_edges WHERE hierarchy_edge_id % 50 = 0)""")
def hierarchy_descendants(t):
    """All descendants of the stated query nodes (children of links whose id is divisible by 50), by the intervals of the tour."""
    return _forest(t).descendants_of(t("hierarchy_edges").where("hierarchy_edge_id % 50 = 0").select("child_node_key"))


@query(f"""WITH {TREE} SELECT k AS key, a AS ancestor, depth FROM up WHERE a <> k AND k IN (SELECT child_node_key FROM hierarchy_edges WHERE hierarchy_edge_id % 50 = 0)""")
def hierarchy_ancestors(t):
    """All ancestors of the stated query nodes (children of links whose id is divisible by 50), by the intervals of the tour."""
    return _forest(t).ancestors_of(t("hierarchy_edges").where("hierarchy_edge_id % 50 = 0").select("child_node_key"))


def _forest(t):
    from skyloom.operators.hierarchy import Forest

    return Forest(t("hierarchy_nodes"), t("hierarchy_edges"), "hierarchy_node_key", "parent_node_key", "child_node_key")


@query("""SELECT key, change FROM (SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'missing' WHEN a.h <> b.h THEN 'changed' END AS change FROM (SELECT o_custkey AS k, md5(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS h FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, md5(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS h FROM orders WHERE o_custkey % 9 <> 1 GROUP BY 1) b ON a.k = b.k) WHERE change IS NOT NULL""")
def source_delta(t):
    digest = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")).alias("h")
    snap = lambda cond: t("orders").where(cond).groupBy(F.col("o_custkey").alias("key")).agg(digest)
    return R.source_delta(snap("o_orderkey % 7 <> 0"), snap("o_custkey % 9 <> 1"), "key", "h")


@query("""SELECT before, after, count(*) AS n FROM (SELECT CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 0 THEN 'mid' ELSE 'low' END AS before, CASE WHEN c_acctbal * 1.2 >= 5000 THEN 'high' WHEN c_acctbal * 1.2 >= 100 THEN 'mid' ELSE 'low' END AS after FROM customer) GROUP BY 1, 2""")
def class_transitions(t):
    b = F.col("c_acctbal")
    return t("customer").select(C.ladder(b, [(5000.0, "high"), (0.0, "mid")], "low").alias("before"), C.ladder(b * 1.2, [(5000.0, "high"), (100.0, "mid")], "low").alias("after")).groupBy("before", "after").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT o_orderkey, o_custkey AS l, o_custkey % 97 AS r FROM orders), ok AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0) SELECT o_orderkey, CASE WHEN l = r THEN 'invalid' WHEN l IN (SELECT c_custkey FROM ok) AND r IN (SELECT c_custkey FROM ok) THEN 'accepted' ELSE 'unresolved' END AS status FROM e""")
def relation_endpoints(t):
    """A relation is accepted only if both of its ends are bound."""
    e = t("orders").select("o_orderkey", F.col("o_custkey").alias("l"), (F.col("o_custkey") % 97).alias("r"))
    ok = t("customer").where("c_acctbal > 0").select("c_custkey")
    a = ok.select(F.col("c_custkey").alias("l"), F.lit(True).alias("a"))
    b = ok.select(F.col("c_custkey").alias("r"), F.lit(True).alias("b"))
    return e.join(a, "l", "left").join(b, "r", "left").select("o_orderkey", F.when(F.col("l") == F.col("r"), "invalid").when(F.col("a") & F.col("b"), "accepted").otherwise("unresolved").alias("status"))


@query("""SELECT part, quantity_key, value, supp FROM (SELECT l_partkey AS part, l_suppkey AS supp, 'q' AS quantity_key, max(l_quantity) AS value, count(*) AS n FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_partkey, l_suppkey, 't', max(l_tax), count(*) FROM lineitem WHERE l_tax > 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY part, quantity_key ORDER BY n DESC, value DESC, supp) = 1""")
def ranked_candidates(t):
    """Candidates of several quantities compete per object and quantity."""
    l = t("lineitem")
    sides = [l.groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).agg(F.max("l_quantity").alias("value"), F.count("*").alias("n")).withColumn("quantity_key", F.lit("q")),
             l.where("l_tax > 0").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).agg(F.max("l_tax").alias("value"), F.count("*").alias("n")).withColumn("quantity_key", F.lit("t"))]
    both = reduce(lambda a, b: a.unionByName(b), sides)
    w = Window.partitionBy("part", "quantity_key").orderBy(F.desc("n"), F.desc("value"), "supp")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("part", "quantity_key", "value", "supp")


@query("""SELECT user_id, string_agg(DISTINCT canonical, ',' ORDER BY canonical) AS keys FROM (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'a:' || user_id ELSE 'b:' || (user_id % 10) END AS canonical FROM events WHERE user_id IS NOT NULL) GROUP BY 1""")
def canonical_groups(t):
    u = F.col("user_id")
    e = t("events").where("user_id IS NOT NULL").select("user_id", I.canonical_key(("a:", F.when(u % 4 == 0, u)), ("b:", u % 10)).alias("c"))
    return e.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("c")), ",").alias("keys"))


RULES = [
    T.Rule("large", "at_least", "p_size", {"value": 40}), T.Rule("small", "at_most", "p_size", {"value": 5}), T.Rule("mid_price", "between", "p_retailprice", {"low": 950.0, "high": 1050.0}),
    T.Rule("brand", "one_of", "p_brand", {"values": ["Brand#11", "Brand#23"]}), T.Rule("odd", "bit", "p_size", {"mask": 1}), T.Rule("ends_in_7", "matches", "p_name", {"pattern": "7$"}),
]


@query("""SELECT p_partkey, tag FROM (SELECT p_partkey, unnest([CASE WHEN p_size >= 40 THEN 'large' END, CASE WHEN p_size <= 5 THEN 'small' END, CASE WHEN p_retailprice >= 950 AND p_retailprice < 1050 THEN 'mid_price' END, CASE WHEN p_brand IN ('Brand#11', 'Brand#23') THEN 'brand' END, CASE WHEN p_size & 1 <> 0 THEN 'odd' END, CASE WHEN regexp_matches(p_name, '7$') THEN 'ends_in_7' END]) AS tag FROM part) WHERE tag IS NOT NULL""")
def tag_evaluate(t):
    return T.evaluate(t("part"), "p_partkey", RULES)


@query("""SELECT l_suppkey, tag, count(DISTINCT l_partkey) AS n_members, min(l_partkey) AS first_member FROM lineitem JOIN (SELECT p_partkey AS l_partkey, unnest([CASE WHEN p_size >= 40 THEN 'large' END, CASE WHEN p_size & 1 <> 0 THEN 'odd' END]) AS tag FROM part) USING (l_partkey) WHERE tag IS NOT NULL GROUP BY 1, 2""")
def tag_member_rollup(t):
    tags = T.evaluate(t("part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", [RULES[0], RULES[4]])
    return T.rollup(tags, t("lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey", "l_suppkey")


@query("""SELECT c_custkey, string_agg(p, ',' ORDER BY p) AS policies FROM (SELECT c_custkey, 'rich' AS p FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT c_custkey, 'named' FROM customer WHERE c_name LIKE '%7') GROUP BY 1""")
def representation_sets(t):
    c = t("customer").select("c_custkey", "c_acctbal", "c_name")
    u = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return T.representation({"rich": c.where("c_acctbal > 5000"), "urgent": u, "named": c.where("c_name LIKE '%7'")}, "c_custkey")


QUERIES, ORACLES = reg.queries, reg.oracles
