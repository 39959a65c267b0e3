"""Policies, facts, the identity graph, interest and faceted search on literal cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyloom.functions import astro as A
from skyloom.operators import facts as K
from skyloom.operators import identity as I
from skyloom.operators import interest as N
from skyloom.operators import policy as Y
from skyloom.operators import relational as R
from skyloom.operators import search as S
from skyloom.storage import Scratch


def test_conditions(spark):
    df = spark.createDataFrame([(1, '{"a": 5, "s": "x", "b": true}'), (2, '{"a": "no", "s": null}'), (3, None), (4, "not json"), (5, '{"a": 6.5}')], "i int, q string")
    ids = lambda *c: [r["i"] for r in df.where(Y.holds(c)).orderBy("i").collect()]
    c = lambda path, op, v=None, kind="number": Y.Condition("q", path, op, v, kind)
    assert ids(c("$.a", "gte", 5)) == [1, 5] and ids(c("$.a", "lt", 6)) == [1] and ids(c("$.a", "eq", 6.5)) == [5] and ids(c("$.a", "ne", 5)) == [5]
    assert ids(c("$.a", "not_null")) == [1, 2, 5] and ids(c("$.s", "ne_or_null", "x", "string")) == [2, 3, 4, 5] and ids(c("$.b", "eq", True, "boolean")) == [1]
    assert ids(c("$.a", "bitmask_none", 2)) == [1] and ids() == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        Y.condition(c("$.a", "like", 1))


def test_missing_values(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, -2.0, 0.0, -9999.0, float("nan"), None, 0.01)], "v double")
    got = [r[0] for r in df.select(Y.present(F.col("v"), [-9999], True, 0.1, True)).collect()]
    assert got == [1.0, 2.0, None, None, None, None, None]
    assert [r[0] for r in df.select(Y.present(F.col("v"), minimum=0.0)).collect()] == [1.0, None, 0.0, None, None, None, 0.01]


def test_bindings(spark, rows):
    records = spark.createDataFrame([("r1", "a", "star"), ("r1", "a", "star"), ("r2", "a", "star"), ("r2", "b", "star"), ("r3", None, "star"), ("r4", "gone", "star"), ("r5", "a", "component"), ("r6", "bad", "star"), (None, "a", "star")], "source_record_id string, object_key string, scope string")
    objects = spark.createDataFrame([("a",), ("b",), ("bad",), (None,)], "object_key string")
    out = K.bind_records(records, objects, objects.where("object_key = 'bad'"), F.col("scope") == "component")
    assert rows(out) == [("r1", "a", "accepted"), ("r2", None, "ambiguous"), ("r3", None, "unresolved"), ("r4", None, "missing"), ("r5", None, "excluded"), ("r6", None, "quarantined")]


def test_competition_order(spark, rows):
    row = lambda s, q, rank, score=None, up=None, ref=None, sem=None: ("o", "g", f"{s}-{q}", s, q, ref, sem, 10.0, up, up, rank, "why", score)
    schema = "object_key string, quantity_group string, evidence_id string, parameter_set_id string, quantity_key string, reference_raw string, bound_semantics string, normalized_value double, uncertainty_lower double, uncertainty_upper double, authority_rank int, authority_reason string, quality_score double"
    df = spark.createDataFrame([row("s1", "q1", 1, 5.0), row("s1", "q2", 1, 5.0, 1.0), row("s2", "q1", 1, 9.0), row("s2", "q2", 1, 9.0), row("s3", "q1", 0), row("s1", "q2", 1, 5.0, 1.0, sem="endpoint")], schema)
    d = K.compete(df).first()
    assert (d["parameter_set_id"], d["runner_up"], d["candidate_count"], d["quantity_count"]) == ("s3", "s1", 3, 1)
    d = K.compete(df.where("authority_rank = 1"))
    assert [(r["parameter_set_id"], r["runner_up"], r["uncertainty_count"]) for r in d.collect()] == [("s1", "s2", 1)]
    got = rows(K.facts_of(df, d), "evidence_id", "value_lower", "value_upper")
    assert got == [("s1-q1", None, None), ("s1-q2", 1.0, 1.0), ("s1-q2", 9.0, 11.0)]
    assert K.compete(df.limit(0)).count() == 0


def test_identity_graph(spark, rows):
    a = spark.createDataFrame([(1, " g1 ", "h1", "Alpha"), (2, None, "h1", "Beta"), (3, "", "h2", None), (1, None, None, "Aleph"), (None, "g9", None, "x")], "k int, gaia string, hip string, name string")
    b = spark.createDataFrame([(7, "g1"), (8, "g3")], "k int, gaia string")
    nodes = I.source_nodes({"a": a, "b": b}, [I.NodeRule("a", "star", "k", {"gaia": "gaia", "hip": "hip"}, "name"), I.NodeRule("b", "part", "k", {"gaia": "gaia"})])
    assert {r["node_key"]: (r["name"], r["ids"]) for r in nodes.collect()} == {
        "src:a:1": ("Aleph", {"gaia": "g1", "hip": "h1"}), "src:a:2": ("Beta", {"hip": "h1"}), "src:a:3": (None, {"hip": "h2"}), "src:b:7": (None, {"gaia": "g1"}), "src:b:8": (None, {"gaia": "g3"}),
    }
    edges = I.identity_edges(nodes, [I.EdgeRule("x", "star", "part", "gaia", 1.0, "exact"), I.EdgeRule("twin", "star", "star", "hip", 0.5, "weak"), I.EdgeRule("only", "star", "star", "hip", 0.9, "strong", unique=True)])
    assert rows(edges, "left_key", "right_key", "relation") == [("src:a:1", "src:a:2", "twin"), ("src:a:1", "src:b:7", "x")]
    objects = I.canonical_objects(I.bridge_identifiers(nodes, "hip", "gaia"), [("gaia", 1.0), ("hip", 0.9)])
    assert rows(objects, "node_key", "canonical_key", "method") == [("src:a:1", "gaia:g1", "gaia"), ("src:a:2", "gaia:g1", "gaia"), ("src:a:3", "hip:h2", "hip"), ("src:b:7", "gaia:g1", "gaia"), ("src:b:8", "gaia:g3", "gaia")]
    ids, remap, terms = I.emit_canonical(Scratch(spark, "t"), objects)
    assert rows(ids, "object_id", "canonical_key", "n_nodes") == [(0, "gaia:g1", 3), (1, "gaia:g3", 1), (2, "hip:h2", 1)]
    assert remap.count() == 5 and rows(terms.where("object_id = 0"), "term") == [("aleph",), ("beta",), ("gaia g1",)]


def test_features_of_a_lone_system(spark):
    systems = spark.createDataFrame([(1, None), (2, 20.0)], "system_id int, dist_ly double")
    stars = spark.createDataFrame([(2, "O", 4.0, 2.0), (2, "?", None, 0.0)], "system_id int, class string, pm double, exotic double")
    planets = spark.createDataFrame([(2, True, True)] * 4, "system_id int, nice boolean, weird boolean")
    x = {r["system_id"]: r for r in N.system_features(systems, stars, planets).collect()}
    assert [x[1][f] for f in N.FEATURES if f != "proximity"] == [0.0] * 7 and x[1]["proximity"] == pytest.approx(1 / (1 + 500**2))
    assert [x[2][f] for f in N.FEATURES] == [1.0, 1.0, 0.25, 1.0, 1.0, 0.5, pytest.approx(min((math.log(3) / math.log(5) + math.log(5) / math.log(11)) / 2 + 0.2, 1)), 1.0]
    ranked = N.rank_systems(N.system_features(systems, stars, planets), dict.fromkeys(N.FEATURES, 0.125))
    assert [(r["system_id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [(2, 1), (1, 2)]
    with pytest.raises(ValueError):
        N.rank_systems(systems, {"exotic": 1.0})


def test_severity(spark):
    df = spark.createDataFrame([(0, 0, None), (1, 9, None), (0, 1, 2)], "planets int, names int, hd int")
    got = [tuple(r) for r in df.select(*N.severity({"repeated_key": F.col("planets"), "name_conflict": F.col("names"), "hd_conflict": F.col("hd")})).collect()]
    assert got == [(0, "watch", "low"), (143, "adjudication", "high"), (87, "adjudication", "medium")]


def test_b1950(spark):
    ra, dec = A.b1950_to_icrs(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(ra.alias("a"), dec.alias("d")).first()
    assert row["a"] == pytest.approx(0.640691, abs=2e-4) and row["d"] == pytest.approx(0.278350, abs=2e-4)


def test_exact_quantiles(spark):
    rng = random.Random(3)
    data = [("a", rng.choice([1.0, 2.5, rng.random()])) for _ in range(501)] + [("b", 7.0), ("c", None), ("c", float("nan")), ("d", 1.0), ("d", 2.0)]
    got = {r["k"]: (r["m"], r["p"]) for r in R.exact_quantiles(Scratch(spark, "t"), spark.createDataFrame(data, "k string, v double"), ["k"], "v", {"m": 0.5, "p": 0.93}).collect()}
    a = sorted(v for k, v in data if k == "a")
    at = 500 * 0.93
    assert got["a"] == (a[250], pytest.approx(a[int(at)] * (1 - at % 1) + a[int(at) + 1] * (at % 1)))
    assert got["b"] == (7.0, 7.0) and got["d"] == (1.5, pytest.approx(1.93)) and "c" not in got


def test_near_join(spark):
    rng = random.Random(6)
    a = [(rng.randrange(3), rng.uniform(0, 5000)) for _ in range(150)] + [(0, 1000.0), (1, 0.0)]
    b = [(rng.randrange(3), 10 ** rng.uniform(0, 4)) for _ in range(150)] + [(0, 1100.0), (1, 100.0), (0, 900.0)]
    got = R.near_join(spark.createDataFrame(a, "k int, x double"), spark.createDataFrame(b, "k int, y double"), "k", "x", "y", 100.0, 0.1)
    want = sorted((k, x, y) for k, x in a for j, y in b if k == j and abs(x - y) <= max(100.0, y * 0.1))
    assert sorted(tuple(r) for r in got.select("k", "x", "y").collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_search_pages_hold_every_hit(spark):
    items = spark.createDataFrame([(i, f"n{i % 7}", f"n{i % 7}", "A", None, None, None, float(i % 5), float(i % 3), i % 4, i % 2, None) for i in range(100)], "id int, name string, term string, class string, x double, y double, z double, dist double, interest double, n_stars int, n_planets int, temperature double")
    tags = spark.createDataFrame([(i, "t") for i in range(0, 100, 2)], "id int, tag string")
    for order, keys in S.ORDERS.items():
        seen, cursor = [], None
        for _ in range(4):
            page = S.facet_search(items, tags, S.SearchSpec(within=3.0, any_of=("t",), order=order, size=17, cursor=cursor)).collect()
            seen += [r["id"] for r in page]
            if not page:
                break
            cursor = R.encode_cursor({**{c: (page[-1][c] if page[-1][c] is not None else s) for c, _, s in keys}, "id": page[-1]["id"]})
        assert sorted(seen) == [i for i in range(0, 100, 2) if i % 5 <= 3] and len(seen) == len(set(seen))
    assert S.facet_search(items, tags, S.SearchSpec(none_of=("t",), at_most={"dist": 0.0})).count() == 10
    with pytest.raises(ValueError):
        S.facet_search(items, tags, S.SearchSpec(order="colour"))


def test_hosts_and_endpoints(spark, rows):
    stars = spark.createDataFrame([("s1", "g1", "Alpha"), ("s2", "g2", "Alpha"), ("s2", "g2", "Beta"), ("s3", None, None)], "star string, g string, h string")
    planets = spark.createDataFrame([("p1", "g1", "Beta"), ("p2", None, "Alpha"), ("p3", "x", "Beta"), ("p1", None, "Beta"), (None, "g1", "Beta")], "planet string, gaia string, host string")
    assert rows(I.host_match(planets, stars, [("gaia", "g", 1.0), ("host", "h", 0.8)])) == [("p1", "s1", "gaia", 1.0), ("p2", None, "unmatched", 0.0), ("p3", "s2", "host", 0.8)]
    relations = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, "a", "two"), (4, "a", None), (5, None, None)], "relation_id int, left_key string, right_key string")
    targets = spark.createDataFrame([("a", "A"), ("b", "B"), ("two", "X"), ("two", "Y"), (None, "N")], "key string, object string")
    assert rows(I.bind_endpoints(relations, targets)) == [(1, "A", "B", "accepted"), (2, None, None, "invalid"), (3, None, None, "ambiguous"), (4, None, None, "unresolved"), (5, None, None, "unresolved")]
