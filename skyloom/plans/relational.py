"""Queries on the generic operators: projection, joins, aggregation, windows, pages, diffs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions import text as X
from skyloom.operators import relational as R
from skyloom.plans.registry import Registry

reg = Registry()
query = reg.query


@query("""SELECT event_id, CASE WHEN lower(trim(t)) IN ('1','true','t','yes','y','on') THEN true WHEN lower(trim(t)) IN ('0','false','f','no','n','off') THEN false END AS flag,
 TRY_CAST(nullif(trim(k), '') AS BIGINT) AS k FROM (SELECT event_id, CASE CAST(event_id % 7 AS BIGINT) WHEN 0 THEN ' Yes' WHEN 1 THEN 'off' WHEN 2 THEN 'T' WHEN 3 THEN '0' WHEN 4 THEN '' WHEN 5 THEN 'maybe' END AS t, json_extract_string(props, '$.k') AS k FROM events)""")
def typed_projection(t):
    raw = F.when(F.col("event_id") % 7 == 0, " Yes").when(F.col("event_id") % 7 == 1, "off").when(F.col("event_id") % 7 == 2, "T").when(F.col("event_id") % 7 == 3, "0").when(F.col("event_id") % 7 == 4, "").when(F.col("event_id") % 7 == 5, "maybe")
    return t("events").select("event_id", X.boolish(raw).alias("flag"), X.empty_to_null(F.get_json_object("props", "$.k")).try_cast("bigint").alias("k"))


@query("""SELECT 'src:tpch:' || c_custkey AS node_key, CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') AND c_acctbal > 0 THEN 1 WHEN c_acctbal > 5000 THEN 2 WHEN c_acctbal IS NOT NULL THEN 9 END AS authority_rank FROM customer""")
def policy_case(t):
    """A list of rules folded into one expression: first rule that holds gives the rank."""
    policy = [(1, F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 0)), (2, F.col("c_acctbal") > 5000), (9, F.col("c_acctbal").isNotNull())]
    rank = F
    for value, condition in policy:
        rank = rank.when(condition, value)
    return t("customer").select(F.concat(F.lit("src:tpch:"), F.col("c_custkey")).alias("node_key"), rank.alias("authority_rank"))


@query("""SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 20 AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) < 60 AND (CAST(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS BIGINT) & 5) = 0""")
def json_predicates(t):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return t("events").where((k >= 20) & (k < 60) & (k.cast("bigint").bitwiseAND(5) == 0)).select("event_id")


@query("""SELECT o_orderkey FROM orders WHERE CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END & 3 <> 0 AND o_totalprice BETWEEN 50000 AND 200000""")
def bitmask_filter(t):
    mask = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4)
    return t("orders").where((mask.bitwiseAND(3) != 0) & F.col("o_totalprice").between(50000, 200000)).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount NOT IN (0.05, 0.1) AND l_discount <> 0 THEN round(l_discount, 6) END AS value FROM lineitem""")
def missing_values(t):
    d = F.col("l_discount")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.when(~d.isin(0.05, 0.1) & (d != 0), F.round(d, 6)).alias("value"))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def semi_anti_join(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return t("customer").join(o.where("o_totalprice > 100000"), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti").select("c_custkey")


@query("""WITH a AS (SELECT c_nationkey * 1000 + CAST(floor(c_acctbal / 10) AS BIGINT) AS k, min(c_custkey) AS c FROM customer GROUP BY 1 HAVING count(*) = 1), b AS (SELECT s_nationkey * 1000 + CAST(floor(s_acctbal / 10) AS BIGINT) AS k, min(s_suppkey) AS s FROM supplier GROUP BY 1 HAVING count(*) = 1) SELECT k, c, s FROM a JOIN b USING (k)""")
def unique_key_join(t):
    key = lambda n, b: F.col(n) * 1000 + F.floor(F.col(b) / 10)
    a = t("customer").select(key("c_nationkey", "c_acctbal").cast("bigint").alias("k"), F.col("c_custkey").alias("c"))
    b = t("supplier").select(key("s_nationkey", "s_acctbal").cast("bigint").alias("k"), F.col("s_suppkey").alias("s"))
    return R.unique_join(a, b, "k", "c", "s")


@query("""WITH p AS (SELECT p_partkey, p_size AS a, CAST(floor(p_retailprice) AS BIGINT) AS b FROM part), s AS (SELECT s_suppkey, s_suppkey % 50 + 1 AS x, CAST(floor(abs(s_acctbal)) AS BIGINT) AS y FROM supplier)
SELECT p_partkey, s_suppkey, min(basis) AS basis FROM (SELECT p_partkey, s_suppkey, 0 AS basis FROM p JOIN s ON a = x UNION ALL SELECT p_partkey, s_suppkey, 1 FROM p JOIN s ON b = y) GROUP BY 1, 2""")
def or_join_rewrite(t):
    p = t("part").select("p_partkey", F.col("p_size").cast("bigint").alias("a"), F.floor("p_retailprice").alias("b"))
    s = t("supplier").select("s_suppkey", (F.col("s_suppkey") % 50 + 1).alias("x"), F.floor(F.abs("s_acctbal")).alias("y"))
    return R.or_join(p, s, [("a", "x"), ("b", "y")], "p_partkey", "s_suppkey")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice AS p FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS k2, o_custkey, o_totalprice AS h FROM orders WHERE o_orderkey % 2 = 1),
m AS (SELECT a.o_orderkey, k2, count(*) OVER (PARTITION BY a.o_orderkey) AS n FROM a JOIN b USING (o_custkey) WHERE abs(p - h) <= greatest(100, h * 0.1)) SELECT o_orderkey, k2 FROM m WHERE n = 1""")
def period_tolerance_match(t):
    """A near join inside an equi join; only unambiguous partners."""
    a = t("orders").where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("p"))
    b = t("orders").where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("k2"), "o_custkey", F.col("o_totalprice").alias("h"))
    near = R.near_join(a, b, "o_custkey", "p", "h", 100.0, 0.1)
    return near.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("k2").alias("k2")).where("n = 1").select("o_orderkey", "k2")


@query("""SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, nc, ns, (nc IS NOT NULL) AS in_c, (ns IS NOT NULL) AS in_s FROM (SELECT c_nationkey, count(*) AS nc FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON c_nationkey = s_nationkey""")
def full_join_presence(t):
    a = t("customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("nc"))
    b = t("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("ns"))
    return a.join(b, "nationkey", "full").select("nationkey", "nc", "ns", F.col("nc").isNotNull().alias("in_c"), F.col("ns").isNotNull().alias("in_s"))


@query("""SELECT o_orderkey, CAST(i AS BIGINT) AS i FROM (SELECT o_orderkey, unnest(range(1, 1 + CAST(o_orderkey % 4 AS BIGINT))) AS i FROM orders)""")
def range_expansion(t):
    n = F.col("o_orderkey") % 4
    return t("orders").where(n > 0).select("o_orderkey", F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("i"))


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey), -1) AS last_order FROM customer""")
def correlated_counts(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("m"))
    return t("customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("m", F.lit(-1)).alias("last_order"))


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("""SELECT l_orderkey, l_linenumber, q AS quantity_key, round(v, 6) AS value FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice), ('l_discount', l_discount), ('l_tax', l_tax)) x(q, v) WHERE v IS NOT NULL""")
def eav_unpivot(t):
    rows = R.unpivot(t("lineitem"), ["l_orderkey", "l_linenumber"], {m: F.col(m) for m in MEASURES})
    return rows.withColumn("value", F.round("value", 6))


@query("""SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_linenumber = 1) AS q1, max(l_quantity) FILTER (WHERE l_linenumber = 2) AS q2, max(l_quantity) FILTER (WHERE l_linenumber = 3) AS q3 FROM lineitem GROUP BY 1""")
def eav_pivot(t):
    lines = t("lineitem").select("l_orderkey", F.concat(F.lit("q"), "l_linenumber").alias("k"), "l_quantity")
    return R.pivot(lines, ["l_orderkey"], "k", "l_quantity", ["q1", "q2", "q3"])


@query("""SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_linenumber = 1) AS q1, max(l_quantity) FILTER (WHERE l_linenumber = 2) AS q2 FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber IN (1, 2)) = 2 AND min(l_discount) > 0""")
def pivot_having_complete(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(
        F.max(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("q1"), F.max(F.when(F.col("l_linenumber") == 2, F.col("l_quantity"))).alias("q2"), F.min("l_discount").alias("d"),
        F.max(F.col("l_linenumber") == 1).alias("a"), F.max(F.col("l_linenumber") == 2).alias("b"),
    )
    return lines.where("a AND b AND d > 0").select("l_orderkey", "q1", "q2")


@query("""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_edges(t):
    return R.keep_one(t("lineitem"), ["l_partkey", "l_suppkey"], F.desc_nulls_last("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("""SELECT least(a, b) AS lo, greatest(a, b) AS hi, max(w) AS weight, count(*) AS n FROM (SELECT l_partkey AS a, l_suppkey AS b, l_quantity AS w FROM lineitem) GROUP BY 1, 2""")
def undirected_pairs(t):
    return t("lineitem").groupBy(F.least("l_partkey", "l_suppkey").alias("lo"), F.greatest("l_partkey", "l_suppkey").alias("hi")).agg(F.max("l_quantity").alias("weight"), F.count("*").alias("n"))


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, count(DISTINCT o_orderstatus) AS n_status FROM orders GROUP BY 1""")
def ordered_lists(t):
    return t("orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.countDistinct("o_orderstatus").alias("n_status"))


@query("""SELECT o_custkey, arg_min(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS cheapest, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS dearest, bool_or(o_orderstatus = 'P') AS any_p, bool_and(o_totalprice > 1000) AS all_big FROM orders GROUP BY 1""")
def arg_extremes(t):
    pair = F.struct("o_totalprice", "o_orderkey")
    return t("orders").groupBy("o_custkey").agg(F.min(pair)["o_orderkey"].alias("cheapest"), F.max(pair)["o_orderkey"].alias("dearest"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_p"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_big"))


@query("""SELECT o_custkey, CAST(bit_or(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 4 WHEN '4-NOT SPECIFIED' THEN 8 ELSE 16 END) AS INTEGER) AS mask FROM orders GROUP BY 1""")
def bitmask_rollup(t):
    p = F.col("o_orderpriority")
    bit = F.when(p == "1-URGENT", 1).when(p == "2-HIGH", 2).when(p == "3-MEDIUM", 4).when(p == "4-NOT SPECIFIED", 8).otherwise(16)
    return t("orders").groupBy("o_custkey").agg(F.bit_or(bit).alias("mask"))


@query("""SELECT count(*) AS n_rows, bit_xor(h) AS hash_xor, min(h) AS hash_min, max(h) AS hash_max FROM (SELECT CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM orders)""")
def table_fingerprint(t):
    return R.fingerprint(t("orders"), F.col("o_orderkey"))


WORDS = ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS HUGEINT)), 0) AS VARCHAR)" for i in range(8))


@query(f"""WITH r AS (SELECT sha256(to_json(struct_pack({', '.join(f'{c} := {c}' for c in ('event_id', 'event_type', 'user_id'))}))) AS h FROM events) SELECT count(*) AS n_rows, sha256(concat_ws('|', CAST(coalesce(bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)), 0) AS VARCHAR), {WORDS})) AS digest FROM r""")
def events_digest(t):
    return R.table_digest(t("events").select("event_id", "event_type", "user_id"))


@query()
def table_digest(t):
    return R.table_digest(t("lineitem"))


@query("""SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS top FROM events GROUP BY 1""")
def quantiles(t):
    """Exact quantiles of groups of any size, by the places of their values."""
    from skyloom.storage import Scratch

    e = t("events")
    q = R.exact_quantiles(Scratch(e.sparkSession, "quantiles"), e, ["event_type"], "value", {"med": 0.5, "p95": 0.95})
    return q.join(e.groupBy("event_type").agg(F.max("value").alias("top")), "event_type").select("event_type", F.round("med", 6).alias("med"), F.round("p95", 6).alias("p95"), "top")


@query("""SELECT o_custkey, round(sum(o_totalprice ORDER BY o_orderkey), 4) AS total FROM orders GROUP BY 1""")
def ordered_float_sum(t):
    return R.ordered_sum(t("orders"), ["o_custkey"], "o_orderkey", "o_totalprice", "total").withColumn("total", F.round("total", 4))


@query("""SELECT 'text' AS column_name, count(text) AS n_present, round(100.0 * count(text) / count(*), 6) AS pct FROM documents UNION ALL SELECT 'lang', count(lang), round(100.0 * count(lang) / count(*), 6) FROM documents UNION ALL SELECT 'n_chars', count(n_chars), round(100.0 * count(n_chars) / count(*), 6) FROM documents""")
def coverage_summary(t):
    return R.coverage(t("documents"), ["text", "lang", "n_chars"])


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE a) AS by_order, count(*) FILTER (WHERE b) AS by_event, count(*) FILTER (WHERE a OR b) AS by_any FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) AS a, c_custkey IN (SELECT user_id FROM events WHERE user_id IS NOT NULL AND value > 90) AS b FROM customer)""")
def overlap_summary(t):
    a = t("orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("a", F.lit(True))
    b = t("events").where("value > 90").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("b", F.lit(True))
    m = t("customer").select("c_custkey").join(a, "c_custkey", "left").join(b, "c_custkey", "left")
    return m.agg(F.count("*").alias("n"), F.count("a").alias("by_order"), F.count("b").alias("by_event"), F.count_if(F.col("a").isNotNull() | F.col("b").isNotNull()).alias("by_any"))


@query("""SELECT bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS bucket FROM part) GROUP BY 1""")
def group_share(t):
    b = F.when(F.col("p_size") < 10, "S").when(F.col("p_size") < 30, "M").otherwise("L")
    g = t("part").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("bucket", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))


@query("""SELECT l_partkey, round(sum(l_extendedprice / ((0.01 + l_tax) * (0.01 + l_tax))) / sum(1 / ((0.01 + l_tax) * (0.01 + l_tax))), 4) AS mean, round(sqrt(1 / sum(1 / ((0.01 + l_tax) * (0.01 + l_tax)))), 8) AS error FROM lineitem GROUP BY 1""")
def weighted_mean(t):
    w = 1 / ((0.01 + F.col("l_tax")) * (0.01 + F.col("l_tax")))
    return t("lineitem").groupBy("l_partkey").agg(F.round(F.sum(F.col("l_extendedprice") * w) / F.sum(w), 4).alias("mean"), F.round(F.sqrt(1 / F.sum(w)), 8).alias("error"))


@query("""SELECT p_partkey, best, runner_up, CAST(n AS BIGINT) AS n FROM (SELECT l_partkey AS p_partkey, l_suppkey AS best, lead(l_suppkey) OVER w AS runner_up, count(*) OVER (PARTITION BY l_partkey) AS n, row_number() OVER w AS rn FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey)) WHERE rn = 1""")
def runner_up(t):
    from skyloom.operators.evidence import select_sets

    g = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return select_sets(g, "l_partkey", "l_suppkey", F.desc("q")).select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("best"), "runner_up", F.col("n_sets").alias("n"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS surrogate_id FROM orders""")
def surrogate_keys(t):
    """A dense key in a total order without a one-partition window."""
    from skyloom.operators.hierarchy import dense_index
    from skyloom.storage import Scratch

    o = t("orders").select("o_orderkey", (-F.col("o_totalprice")).alias("p"))
    return dense_index(Scratch(o.sparkSession, "keys"), o, "p", "o_orderkey", name="surrogate_id").select("o_orderkey", "surrogate_id")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey > 100) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def keyset_page(t):
    cursor = R.encode_cursor({"o_totalprice": 150000, "o_orderkey": 100})
    return R.keyset_page(t("orders"), [("o_totalprice", True, -1e18), ("o_orderkey", False, 2**63 - 1)], 50, cursor).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40""")
def offset_page(t):
    return t("orders").orderBy("o_orderdate", "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("""SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 5""")
def top_per_group(t):
    return R.bounded_top(t("customer"), ["c_nationkey"], 5, F.desc("c_acctbal"), F.col("c_custkey")).select("c_custkey", "c_nationkey")


@query("""SELECT o_orderkey FROM orders ORDER BY (o_orderstatus = 'P') DESC, md5(o_orderkey || '|seed-1') LIMIT 200""")
def seeded_sample(t):
    return t("orders").orderBy((F.col("o_orderstatus") == "P").desc(), F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.lit("seed-1")))).limit(200).select("o_orderkey")


@query("""SELECT nationkey, 'both' AS side FROM (SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT nationkey, 'customer' FROM (SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9500 EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT nationkey, 'any' FROM (SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9500 UNION SELECT s_nationkey FROM supplier)""")
def set_operations(t):
    c = t("customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("nationkey"))
    s = t("supplier").select(F.col("s_nationkey").alias("nationkey"))
    mark = lambda df, side: df.withColumn("side", F.lit(side))
    return mark(c.intersect(s), "both").unionByName(mark(c.subtract(s), "customer")).unionByName(mark(c.union(s).distinct(), "any"))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN (SELECT min(event_type) FROM events) THEN 0 WHEN value > 50 THEN 1 ELSE 2 END AS stage FROM events WHERE user_id IS NOT NULL) SELECT user_id, event_id, CAST(stage AS INTEGER) AS stage FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY stage, event_id) AS rn FROM e) WHERE rn = 1""")
def waterfall_union(t):
    e = t("events").where("user_id IS NOT NULL")
    first = e.agg(F.min("event_type").alias("event_type"))
    a = e.join(F.broadcast(first), "event_type", "left_semi")
    rest = e.join(F.broadcast(first), "event_type", "left_anti")
    stages = [x.select("user_id", "event_id") for x in (a, rest.where("value > 50"), rest.where("value IS NULL OR value <= 50"))]
    return R.waterfall(stages, "user_id", F.col("event_id"))


CHANGED = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 15 = 4 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 5 UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 100 = 7"


@query(f"""WITH b AS ({CHANGED}), j AS (SELECT a.o_orderkey AS ak, b.o_orderkey AS bk, a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS ds, a.o_totalprice IS DISTINCT FROM b.o_totalprice AS dp FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT count(*) FILTER (WHERE ak IS NULL) AS added, count(*) FILTER (WHERE bk IS NULL) AS removed, count(*) FILTER (WHERE ak IS NOT NULL AND bk IS NOT NULL AND (ds OR dp)) AS changed, count(*) FILTER (WHERE ak IS NOT NULL AND bk IS NOT NULL AND NOT (ds OR dp)) AS unchanged, count(*) FILTER (WHERE ak IS NOT NULL AND bk IS NOT NULL AND ds) AS changed_o_orderstatus, count(*) FILTER (WHERE ak IS NOT NULL AND bk IS NOT NULL AND dp) AS changed_o_totalprice FROM j""")
def table_delta(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    new = o.where(k % 11 != 5).withColumns({"o_orderstatus": F.when(k % 10 == 3, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(k % 15 == 4, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    new = new.unionByName(o.where(k % 100 == 7).withColumn("o_orderkey", k + 1000000000))
    return R.table_delta(o, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("""SELECT o_custkey, min(first_seen) AS first_seen, max(last_seen) AS last_seen, arg_max(o_orderstatus, struct_pack(l := last_seen, s := o_orderstatus)) AS o_orderstatus FROM (SELECT o_custkey, o_orderdate AS first_seen, o_orderdate AS last_seen, o_orderstatus FROM orders) GROUP BY 1""")
def history_append(t):
    o = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"), "o_orderstatus")
    keep = ["o_custkey", "first_seen", "last_seen", "o_orderstatus"]
    old = R.append_history(o.where("o_orderkey % 2 = 0").select(*keep), o.where("1 = 0").select(*keep), ["o_custkey"], "first_seen", "last_seen", ["o_orderstatus"])
    return R.append_history(old, o.where("o_orderkey % 2 = 1").select(*keep), ["o_custkey"], "first_seen", "last_seen", ["o_orderstatus"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000000, 0.0 FROM customer WHERE c_custkey % 5 = 0""")
def upsert_rows(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0)).unionByName(c.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 1000000000).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")))
    return R.upsert(c, new, ["c_custkey"])


@query("""SELECT o_orderkey, json_extract_string(j, '$.status') AS status, CAST(json_extract_string(j, '$.items[1]') AS BIGINT) AS second, (json_extract(j, '$.missing') IS NOT NULL) AS has_missing, CAST(json_array_length(j, '$.items') AS BIGINT) AS n_items FROM (SELECT o_orderkey, json_object('status', o_orderstatus, 'items', json_array(o_orderkey, o_custkey)) AS j FROM orders)""")
def json_build(t):
    j = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.array("o_orderkey", "o_custkey").alias("items")), {"ignoreNullFields": "false"})
    return t("orders").select("o_orderkey", j.alias("j")).select(
        "o_orderkey", F.get_json_object("j", "$.status").alias("status"), F.get_json_object("j", "$.items[1]").cast("bigint").alias("second"),
        F.get_json_object("j", "$.missing").isNotNull().alias("has_missing"), F.json_array_length(F.get_json_object("j", "$.items")).cast("bigint").alias("n_items"))


@query("""SELECT vec_id, round(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: CAST(x AS DOUBLE))), 4) AS positive, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n_positive, CAST(len(list_distinct(list_transform(embedding, lambda x: CAST(floor(x) AS BIGINT)))) AS BIGINT) AS n_cells FROM embeddings""")
def list_operations(t):
    e = F.col("embedding")
    pos = F.filter(e, lambda x: x > 0)
    return t("embeddings").select("vec_id", F.round(F.aggregate(pos, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("positive"), F.size(pos).cast("bigint").alias("n_positive"), F.size(F.array_distinct(F.transform(e, lambda x: F.floor(x)))).cast("bigint").alias("n_cells"))


@query("""SELECT o_custkey, CAST(len(b) AS BIGINT) AS n, b[1].k AS first_key, round(b[len(b)].p, 4) AS last_price FROM (SELECT o_custkey, list(struct_pack(k := o_orderkey, p := o_totalprice) ORDER BY o_orderkey) AS b FROM orders GROUP BY 1)""")
def struct_bundle(t):
    b = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p")))).alias("b"))
    return b.select("o_custkey", F.size("b").cast("bigint").alias("n"), F.element_at("b", 1)["k"].alias("first_key"), F.round(F.element_at("b", -1)["p"], 4).alias("last_price"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02'), 0) AS INTEGER) AS age_days, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02'), 0) > CASE o_orderstatus WHEN 'F' THEN 730 WHEN 'O' THEN 365 ELSE 45 END AS stale FROM orders""")
def staleness_days(t):
    age = F.greatest(F.datediff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate")), F.lit(0))
    window = F.when(F.col("o_orderstatus") == "F", 730).when(F.col("o_orderstatus") == "O", 365).otherwise(45)
    return t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), age.alias("age_days"), (age > window).alias("stale"))


QUERIES, ORACLES = reg.queries, reg.oracles
