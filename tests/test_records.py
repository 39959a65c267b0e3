"""Typed records, classes and labels on literal cases."""

import pytest
from pyspark.sql import functions as F

from skyloom.functions import classify as C
from skyloom.functions import text as X
from skyloom.operators import records as D
from skyloom.operators import tags as T


def test_measures_and_bundles(spark, rows):
    df = spark.createDataFrame([(1, 5.0, -0.5, 1, " r ", 2.0), (2, None, 1.0, 0, "", float("nan")), (3, 1.0, None, -1, None, None)], "id int, v double, e double, lim int, ref string, w double")
    out = D.unpivot_measures(df, ["id"], [D.Measure("v", "v", None, "e", "lim", "ref", "K"), D.Measure("w", "w", band="V")])
    assert rows(out) == [(1, "v", 5.0, 0.5, 0.5, "upper", "r", "K", None), (1, "w", 2.0, None, None, None, None, None, "V"), (3, "v", 1.0, None, None, "lower", None, "K", None)]
    p = spark.createDataFrame([(1, 0.2, 0.8), (2, None, None), (3, None, 1.0)], "id int, a double, b double")
    assert rows(D.probability_bundle(p, "id", {"m": {"a": "a"}, "n": {"b": "b"}})) == [(1, '{"m":{"a":0.2},"n":{"b":0.8}}'), (3, '{"n":{"b":1.0}}')]
    with pytest.raises(Exception, match="outside"):
        D.probability_bundle(spark.createDataFrame([(1, 1.2)], "id int, a double"), "id", {"m": {"a": "a"}}).collect()


def test_orbits(spark, rows):
    o = spark.createDataFrame([("a", 100.0, 0.1), ("a", 104.0, None), ("a", 106.0, 0.1), ("b", 5.0, 0.0), ("c", 5.0, 0.0), ("a", None, 0.1), ("a", 100.0, 1.0), ("a", -1.0, 0.1)], "k string, period double, eccentricity double")
    r = spark.createDataFrame([("a", 100.0), ("b", None)], "k string, period double")
    assert [x[1:] for x in rows(D.reconcile_orbits(o, r, "k"))] == [
        ("accepted", "agrees"), ("accepted", "agrees"), ("excluded", "no_period"), ("quarantined", "conflict"), ("quarantined", "impossible"), ("quarantined", "impossible"), ("accepted", "first_period"), ("excluded", "no_pair"),
    ]
    s = spark.createDataFrame([("x", "B", None, 1.0), ("x", "A", 3.0, 9.0), ("x", "Z", 3.0, 1.0)], "k string, type string, significance double, period double")
    assert rows(D.best_solutions(s, "k", {"A": 1}), "k", "type", "n_solutions") == [("x", "A", 3)]


def test_impact_and_weights(spark, rows):
    delta = spark.createDataFrame([("a", "changed"), ("b", "missing"), ("c", "new"), ("d", "changed")], "source string, change string")
    lineage = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), *[("d", i) for i in range(9)]], "source string, row_id int")
    assert rows(D.impact_plan(delta, lineage)) == [("a", "changed", 2, "incremental"), ("b", "missing", 1, "full"), ("c", "new", 0, "incremental"), ("d", "changed", 9, "full")]
    assert D.weight_changes({"x": 1.0, "y": 2.0}, {"x": 1.0, "z": 0.5}, "xyz") == {"y": (2.0, None), "z": (None, 0.5)}
    for bad in ({"q": 1.0}, {"x": -1.0}, {}, {"x": 0.0}):
        with pytest.raises(ValueError):
            D.weight_changes({"x": 1.0}, bad, "xyz")


def test_gzip_and_json(spark):
    texts = ["", "a" * 100_000, "ünï\u2028code", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.gzip_text("t").alias("z"))
    assert [(r["t"], r["back"]) for r in df.select("t", D.gunzip_text("z").alias("back")).collect()] == [(t, t) for t in texts]
    shapes = spark.createDataFrame([(t,) for t in (' {"b": 1, "a": 2}', "[1]", '"x"', "1.5", "true", "null", "what", None)], "t string").select(*D.json_shape(F.col("t")))
    assert [tuple(r) for r in shapes.collect()] == [(["a", "b"], "object"), (None, "array"), (None, "string"), (None, "number"), (None, "boolean"), (None, "null"), (None, None), (None, None)]


def test_classes_and_labels(spark):
    types = spark.createDataFrame([(t,) for t in ("Black Hole", "magnetar candidate", "PSR B1919", "neutron star", "dM4", "sdB", "usdK5", "WN6", "DA2", "WD", "g2v", "??", None, "Wolf-Rayet")], "t string")
    assert [r[0] for r in types.select(C.class_from_spectral_type(F.col("t"))).collect()] == ["BH", "MAG", "PSR", "NS", "M", "B", "K", "WR", "WD", "WD", "G", None, None, "WR"]
    kinds = spark.createDataFrame([("G2V", "white_dwarf"), (None, "pulsar"), ("K1", None)], "t string, k string")
    assert [r[0] for r in kinds.select(C.class_from_spectral_type(F.col("t"), F.col("k"))).collect()] == ["WD", "PSR", "K"]
    pairs = spark.createDataFrame([(t,) for t in ("", None, "Aa1,2", "AB", "A,B", "Aa-Ab", "ABC")], "t string")
    assert [tuple(r) for r in pairs.select(*X.pair_labels(F.col("t"))).collect()] == [("A", "B"), ("A", "B"), ("Aa1", "Aa2"), ("A", "B"), ("A", "B"), ("Aa", "Ab"), (None, None)]
    places = spark.createDataFrame([("123456.7-001530",), ("12345+4530",), ("x",), (None,)], "t string").select(*X.compact_position(F.col("t"))).collect()
    assert [(None if r[0] is None else round(r[0], 6), None if r[1] is None else round(r[1], 6)) for r in places] == [(188.73625, -0.258333), (188.625, 45.5), (None, None), (None, None)]


def test_tag_rules_of_a_registry(spark, rows):
    df = spark.createDataFrame([(1, 1, 20.0, " o ", 5.0, None), (2, 2, 20.1, "G", 5.0, "Candidate"), (3, None, None, None, None, None)], "k int, n int, d double, c string, p double, s string")
    rules = [T.Rule("one", "equals", "n", {"value": 1}), T.Rule("far", "above_to", "d", {"low": 20.0, "high": 60.0}), T.Rule("hot", "class_in", "c", {"values": ["O"]}), T.Rule("quick", "below", "p", {"value": 30.0, "status": "s", "allowed": ["confirmed"]})]
    assert rows(T.evaluate(df, "k", rules)) == [(1, "hot"), (1, "one"), (1, "quick"), (2, "far")]
