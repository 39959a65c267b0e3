"""Generic operators, functions, graphs, search, identity and evidence."""

import math
import random

import pytest
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


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_text(spark):
    lit = F.lit
    assert one(spark, X.normalize_name(lit("  NGC-12 / b ")), X.normalize_name(lit("--")), X.boolish(lit(" Yes")), X.boolish(lit("maybe"))) == ["ngc 12 b", None, True, None]
    assert one(spark, X.trigrams(lit("abca")), X.trigrams(lit("ab"))) == [["abc", "bca"], []]
    assert one(spark, X.identifier_kind(lit("HIP 12")), X.identifier_number(lit("HIP 12")), X.identifier_kind(lit("Sirius")), X.identifier_kind(lit("12345678901"))) == ["hip", "12", None, "gaia"]
    assert one(spark, X.candidate_designation(lit("toi 0123.1")), X.candidate_designation(lit("TOI-7")), X.candidate_designation(lit("tic 0042")), X.candidate_designation(lit("TOI-0")), X.candidate_reason(lit("tic x")), X.candidate_reason(lit("toi 9.00")), X.candidate_reason(lit("tide")), X.deep_sky_designation(lit("Messier 031"))) == ["TOI-123.01", "TOI-7", "TIC 42", None, "malformed_identifier", "identifier_out_of_range", None, "m 31"]
    assert one(spark, X.sexagesimal_degrees(lit("-00 30 00")), X.sexagesimal_degrees(lit("12:00:00"), True), X.sexagesimal_degrees(lit("x"))) == [-0.5, 180.0, None]
    assert one(spark, X.masked_vector(lit("[1.0 -- 3]")), *[X.ordinal_label(lit(n)) for n in (0, 27, 701, 702, 18277, 18278, -1)]) == [[1.0, None, 3.0], "a", "ab", "zz", "aaa", "zzz", "aaaa", None]
    assert one(spark, X.match_rank(lit("alpha cen b"), "cen alpha"), X.match_rank(lit("alpha"), "alpha"), X.match_rank(lit("alphab"), "alpha")) == [2, 0, 1]


def test_morton_and_mixed_hash(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(-999, 999), rng.uniform(-999, 999), rng.uniform(-999, 999)) for i in range(200)]
    got = {r["id"]: r for r in A.with_octree_cells(A.with_morton_key(spark.createDataFrame(pts, "id long, x double, y double, z double")), {"a": 2, "b": 4}).collect()}
    for i, *p in pts:
        cells = [int((v + 1000) / 2000 * 2097151 + 0.5) for v in p]
        assert got[i]["morton"] == sum(((cells[a] >> k) & 1) << (3 * k + a) for a in range(3) for k in range(21))
        for name, depth in (("a", 2), ("b", 4)):
            cells4 = [int((v + 1024) / 2048 * (1 << depth)) for v in p]
            assert got[i][name] == sum(((cells4[a] >> k) & 1) << (3 * k + a) for a in range(3) for k in range(depth))
    with pytest.raises(Exception, match="Morton"):
        A.with_morton_key(spark.createDataFrame([(1001.0, 0.0, 0.0)], "x double, y double, z double")).collect()
    mask = (1 << 64) - 1

    def mix(z):
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        return z ^ (z >> 31)

    ids = [0, 1, 2**62, -1, -(2**63), *[rng.getrandbits(63) for _ in range(100)]]
    for r in A.with_mixed_hash(spark.createDataFrame([(i,) for i in ids], "id long"), "id", "h").collect():
        assert int(r["h"]) == mix(r["id"] & mask)


@pytest.mark.parametrize("value,want", [(30000.0, "O"), (29999.9, "B"), (2400.0, "M"), (2399.0, "L"), (0.0, None), (None, None)])
def test_class_boundaries(spark, value, want):
    assert one(spark, C.class_from_temperature(F.lit(value).cast("double"))) == [want]


def test_spectral_types(spark):
    types = ["G2V", "sdM4", "DA3", "WN5", "PSR J1", "neutron star", "esdK7", "x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(types)], "i int, t string").select("i", C.class_from_spectral_type(F.col("t")).alias("c")).orderBy("i")
    assert [r["c"] for r in df.collect()] == ["G", "M", "WD", "WR", "PSR", "NS", "K", None, None]


def test_digest_ignores_order_and_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("s"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit(1.5)).alias("d"))
    a, b = R.table_digest(df).first(), R.table_digest(df.repartition(5).orderBy(F.desc("id"))).first()
    assert a == b and a["n_rows"] == 1000 and a != R.table_digest(df.where("id <> 5")).first()


def test_pages_cover_everything(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i % 4)) for i in range(23)], "k long, v double")
    order, seen, cursor = [("v", True, -1e18), ("k", False, 2**62)], [], None
    while True:
        page = R.keyset_page(df, order, 5, cursor).collect()
        if not page:
            break
        seen += [r["k"] for r in page]
        cursor = R.encode_cursor({"v": -1e18 if page[-1]["v"] is None else page[-1]["v"], "k": page[-1]["k"]})
    assert sorted(seen) == list(range(23)) and len(seen) == 23


def test_or_join_has_no_nested_loop(spark, rows):
    l = spark.createDataFrame([(1, 10, None), (2, None, 5), (3, 7, 7)], "i int, a int, b int")
    r = spark.createDataFrame([(1, 10, 5), (2, 8, 7)], "j int, x int, y int")
    out = R.or_join(l, r, [("a", "x"), ("b", "y")], "i", "j")
    assert rows(out) == [(1, 1, 0), (2, 1, 1), (3, 2, 1)]
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_or_join_lists_pairs_without_exchanging_them(spark, rows):
    rng = random.Random(5)
    some = lambda: rng.choice([None, 1, 2, 3, 4])
    left, right = [(i, 1 if i % 2 else some(), some()) for i in range(80)] + [(None, 1, 3)], [(i, 1 if i % 3 else some(), some()) for i in range(50)]
    twice = (left + [(5, 2, 2), (5, None, 4), (5, 2, 2), (None, 4, 4)], right + [(7, 3, None), (7, 1, 1), (7, 1, 1)])
    for l, r, group in ((left, right, False), (*twice, True)):
        want = {}
        for i, a, b in l:
            for j, x, y in r:
                if a is not None and a == x or b is not None and b == y:
                    want[i, j] = min(want.get((i, j), 1), 0 if a is not None and a == x else 1)
        for task in (10**6, 100):  # as one join; in blocks, of which either side is dealt out
            out = R.or_join(spark.createDataFrame(l, "i int, a int, b int"), spark.createDataFrame(r, "j int, x int, y int"), [("a", "x"), ("b", "y")], "i", "j", task)
            assert rows(out) == sorted([(i, j, k) for (i, j), k in want.items()], key=repr)
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert ("Aggregate [l" in plan) == group
        assert out.rdd.getNumPartitions() > 20


def test_json_merge_and_source_delta(spark, rows):
    assert one(spark, R.merge_json(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":null,"c":"3"}'))) == ['{"a":"1","c":"3"}']
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "k string, d string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "k string, d string")
    assert rows(R.source_delta(a, b, "k", "d")) == [("w", "new"), ("y", "changed"), ("z", "missing")]


def test_expected_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "o string")
    R.expect_counts(df, "o", {"a": 2, "b": 1})
    with pytest.raises(ValueError):
        R.expect_counts(df, "o", {"a": 3})
    many = spark.range(12_000).select(F.col("id").cast("string").alias("o"))
    R.expect_counts(many, "o", {str(i): 1 for i in range(12_000)})
    assert [tuple(r) for r in R.count_differences(df.unionByName(spark.createDataFrame([(None,)], "o string")), "o", {"a": 2, "c": 4}).orderBy("outcome").collect()] == [("b", 0, 1), ("c", 4, 0), ("null", 0, 1)]
    R.expect_counts(df.limit(0), "o", {})


def test_reachability_and_components(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "q"), ("y", "z"), ("l", "l")], "s string, d string")
    seeds = spark.createDataFrame([("a",)], "n string")
    assert rows(G.reachable(e, seeds, "s", "d", "n")) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(G.reachable(e, seeds, "s", "d", "n", rounds=1)) == [("a", 0), ("b", 1)]
    assert rows(G.components(e, "s", "d")) == [("a", "a"), ("b", "a"), ("c", "a"), ("l", "l"), ("x", "x"), ("y", "x"), ("z", "x")]
    assert rows(G.leaves(e.where("s IS NOT NULL"), "s", "d")) == [("z",)]


def test_crossmatch_against_brute_force(spark):
    rng = random.Random(8)
    places = [(rng.uniform(10, 10.5), rng.uniform(-5, -4.5)) for _ in range(60)] + [(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(60)]
    # Across the seam of right ascension, and around both poles.
    places += [(rng.uniform(-0.005, 0.005) % 360, rng.uniform(-40, 40)) for _ in range(60)] + [(rng.uniform(0, 360), s * rng.uniform(89.99, 90)) for s in (1, -1) for _ in range(40)]
    left = [(i, a, d) for i, (a, d) in enumerate(places)]
    right = [(i, (a + rng.uniform(-0.01, 0.01)) % 360, max(-90.0, min(90.0, d + rng.uniform(-0.01, 0.01)))) for i, a, d in left]
    schema = "id int, ra double, dec double"
    got = {r["left_id"]: r["right_id"] for r in P.sky_crossmatch(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 30.0).collect()}

    def sep(p, q):
        a, d, b, e = map(math.radians, (p[1], p[2], q[1], q[2]))
        return math.degrees(math.acos(min(1, math.sin(d) * math.sin(e) + math.cos(d) * math.cos(e) * math.cos(a - b)))) * 3600

    want = {}
    for p in left:
        near = min((sep(p, q), q[0]) for q in right)
        if near[0] <= 30:
            want[p[0]] = near[1]
    assert got == want and len(want) > 150
    empty = spark.createDataFrame([(1, None, 2.0)], schema)
    assert P.sky_crossmatch(empty, spark.createDataFrame(right, schema), 30.0).count() == 0 and P.sky_crossmatch(empty, empty, 30.0).count() == 0


def test_crossmatch_ties_and_matched(spark):
    a = spark.createDataFrame([(1, 359.9999, 0.0, 5.0), (2, 40.0, 89.9999, 5.0), (3, 7.0, 7.0, None)], "id int, ra double, dec double, mag double")
    b = spark.createDataFrame([(10, 0.0001, 0.0, 9.0), (11, 0.0001, 0.0, 5.5), (12, 220.0, 89.9999, None), (13, 7.0, 7.0, 1.0)], "id int, ra double, dec double, mag double")
    got = {r["left_id"]: (r["right_id"], r["dmag"]) for r in P.sky_crossmatch(a, b, 8.0).collect()}
    assert got == {1: (11, 0.5), 2: (12, None), 3: (13, None)}
    left = {r["left_id"] for r in P.sky_crossmatch(a, b, 8.0, matched=a.where("id = 1").select("id")).collect()}
    assert left == {2, 3}


def test_tiers_stop_at_the_first_hit(spark):
    terms = spark.createDataFrame([(t,) for t in ("vega", "vegan", "las vegas", "viga", "sirius")], "term string")
    assert [r["term"] for r in S.tiered_search(terms, "vega").collect()] == ["vega"]
    assert [r["term"] for r in S.tiered_search(terms, "veg").collect()] == ["vega", "vegan"]
    assert [r["term"] for r in S.tiered_search(terms, "egas").collect()] == ["las vegas"]
    assert [r["term"] for r in S.tiered_search(terms, "vegx").collect()] == ["vega"]


def test_greedy_tags_leave_the_group_of_a_rejected_one_free(spark, rows):
    c = spark.createDataFrame([("o", "t1", 9.0, "f", "g1"), ("o", "t2", 8.0, "f", "g2"), ("o", "t3", 7.0, "h", "g2"), ("o", "t4", 6.0, "h", "g1"), ("o", "t5", 5.0, "h", "g3")], "k string, tag string, score double, family string, grp string")
    assert rows(S.greedy_tags(c, "k", {"f": 1}, 2)) == [("o", 0, "t1"), ("o", 1, "t3")]


@pytest.mark.parametrize("left,right,want", [(0, 1, "missing"), (1, 1, "accepted"), (1, 2, "ambiguous_split"), (2, 1, "ambiguous_merge"), (2, 2, "ambiguous")])
def test_binding_states(spark, left, right, want):
    assert one(spark, I.binding_state(F.lit(left), F.lit(right), F.lit(False), F.lit(False))) == [want]


def test_priority_resolution(spark, rows):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("y", "2")], "s string, t string")
    b = spark.createDataFrame([("x", "9"), ("y", "3"), ("z", "3")], "s string, t string")
    assert rows(I.resolve_by_priority([a, b], "s", "t")) == [("x", "1", 0, "accepted"), ("y", None, 0, "ambiguous"), ("z", "3", 1, "accepted")]


def test_integrity(spark):
    report = E.integrity({"none": spark.range(0), "two": spark.range(2)})
    with pytest.raises(ValueError, match="two"):
        E.require_clean(report)
