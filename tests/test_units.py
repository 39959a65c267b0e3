"""Numbers and units in text, changepoints, resolution of units (p4)."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions.numbers import with_stated
from skyloom.functions.units import unit_form
from skyloom.operators import units as U
from skyloom.operators.changepoint import Level, history_segments, optimal_segments, unit_path

STATED = [
    ("5.172", 5.172, ""), ("  0.0014767 ", 0.0014767, ""), ("1.7992e+30KG", 1.7992e30, "KG"), ("<3.2 km/s", 3.2, "km/s"), ("~-0.07 dex(sol)", -0.07, "dex(sol)"),
    ("ca. 1.0127e+01", 10.127, ""), ("about 5 K", 5.0, "K"), ("1,041,032", 1041032.0, ""), ("−0.5 Dex", -0.5, "Dex"), ("1.003 x 10^0", 1.003, ""), ("1.084×10^-1 g/cc", 0.1084, "g/cc"),
    ("10087.6 ± 742", 10087.6, ""), ("1.02e+30 ± 1.6e+28 kg", 1.02e30, "kg"), ("8.25 10^3 K", 8.25, "10^3 K"), ("0.9 (log10(cm s-2))", 0.9, "(log10(cm s-2))"), ("+12.5 ± 0.3 (d)", 12.5, "(d)"),
    ("n/a", None, ""), ("...", None, ""), ("--", None, ""), ("", None, ""), ("   ", None, ""), ("NaN", None, ""), ("-9999", None, ""), ("-999.99", None, ""), ("1e+99", None, ""), ("-9999.0", None, ""),
    ("2.4e60", None, ""), ("9.9e59", 9.9e59, ""), (None, None, None),
]


def test_stated_numbers(spark):
    df = with_stated(spark.createDataFrame([(i, s[0]) for i, s in enumerate(STATED)], "i int, s string"), "s", "n", "r").orderBy("i")
    for (text, number, rest), row in zip(STATED, df.collect()):
        assert row["n"] == (pytest.approx(number) if number is not None else None), text
        if number is not None:
            assert row["r"] == rest


def test_very_long_text_states_its_number(spark):
    text = "1.5 " + "x" * 200_000
    row = with_stated(spark.createDataFrame([(text,), ("9" * 400,), ("x" * 100_000,)], "s string"), "s").collect()
    assert row[0]["number"] == 1.5 and row[1]["number"] is None and row[2]["number"] is None


@pytest.mark.parametrize("a,b", [("km s^-1", "km.s**-1"), ("R⊙", "R_sun"), ("(dex(cm/s2))", "dex(cm/s2)"), ("M☉", "Msun"), ("a.u.", "AU"), ("10**3 K", "10^3 K"), ("Jupiter masses", "jupiter masses")])
def test_unit_forms_agree(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(unit_form(F.col("a")).alias("a"), unit_form(F.col("b")).alias("b")).first()
    assert row["a"] == row["b"]


def brute(n, s, q, penalty):
    m, best = len(n), {0: (-penalty, [])}
    for end in range(1, m + 1):
        options = []
        for start in range(end):
            a, b, c = n[start:end].sum(), s[start:end].sum(), q[start:end].sum()
            options.append((best[start][0] + c - b * b / a + penalty, [*best[start][1], (start, end)]))
        best[end] = min(options)
    return best[m][1]


def test_changepoints_are_exact():
    rng = np.random.default_rng(5)
    for _ in range(30):
        m = int(rng.integers(1, 25))
        n = rng.integers(1, 6, m).astype(float)
        level = np.repeat(rng.normal(0, 3, m), rng.integers(1, 8, m))[:m]
        s = n * level + rng.normal(0, 0.2, m)
        q = s * s / n + rng.random(m)
        assert optimal_segments(n, s, q, 1.0) == brute(n, s, q, 1.0)


def test_history_segments_find_a_unit_change(spark):
    data = [("a", datetime(2021, 1 + i // 20, 1 + i % 20), (5000.0 if i < 120 else 5.0) * (1 + 0.01 * (i % 5))) for i in range(200)]
    df = spark.createDataFrame([*data, ("a", None, 1.0), ("a", datetime(2021, 1, 1), None), ("b", datetime(2021, 1, 1), 7.0)], "src string, at timestamp, v double")
    bins = history_segments(df, ["src"], "at", "v")
    out = bins.groupBy("src", "segment").agg(F.sum("n_rows").alias("n"), F.max("segment_rows").alias("m"), F.max("shift").alias("shift"), F.count("*").alias("bins")).orderBy("src", "segment").collect()
    assert [(r["src"], r["segment"], r["n"], r["m"], r["bins"]) for r in out] == [("a", 0, 120, 120, 120), ("a", 1, 80, 80, 80), ("b", 0, 1, 1, 1)]
    assert out[1]["shift"] == pytest.approx(-3.0, abs=0.01) and out[0]["shift"] is None


def test_histories_run_release_by_release(spark):
    """Two releases of the same months in different units: time alone would mix them, the release order parts them."""
    rng = np.random.default_rng(1)
    data = [(r, datetime(2021, 1 + i % 12, 1 + i % 27), float(10 ** rng.normal(3.7 if r == "r1" else 0.7, 0.1))) for i in range(150) for r in ("r1", "r2")]
    df = spark.createDataFrame([("s", "q", *x) for x in data], "src string, q string, rel string, at timestamp, v double")
    units = {"q": [Level("K", 3.7, 0.1, 0.0), Level("kK", 0.7, 0.1, 3.0)]}
    out = history_segments(df, ["src", "q"], "at", "v", epoch="rel", units=("q", units))
    assert {(r["epoch"], r["segment"], r["unit_key"]) for r in out.collect()} == {("r1", 0, "K"), ("r2", 1, "kK")}


def test_unit_path_is_the_cheapest_sequence():
    from itertools import product

    from skyloom.operators.changepoint import LEVEL_TOLERANCE, SHIFT_TOLERANCE

    rng = np.random.default_rng(2)
    units = [Level("a", 0.0, 0.5, 0.0), Level("b", 3.0, 0.5, -3.0), Level("c", 0.4, 0.05, None)]
    for _ in range(20):
        levels, spreads = list(rng.normal(1, 2, 4)), list(rng.uniform(0.02, 0.6, 4))
        def cost(path):
            own = sum(((m - u.mean) / LEVEL_TOLERANCE) ** 2 + np.log(s / u.spread) ** 2 for m, s, u in zip(levels, spreads, path))
            return own + sum(min(((levels[i + 1] - levels[i] - path[i + 1].mean + path[i].mean) / SHIFT_TOLERANCE) ** 2, 50.0) for i in range(3))
        best = min(product(units, repeat=4), key=cost)
        for (unit, margin), chosen in zip(unit_path(levels, spreads, units), best):
            assert unit in (None, chosen.unit) and margin >= 0
    assert unit_path([0.1], [0.5], [Level("a", 0.0, 0.5, 0.0), Level("b", 0.01, 0.5, 0.0)])[0][0] is None  # two units fit alike
    assert unit_path([7.0], [0.5], units[:2])[0][0] is None and unit_path([1.0], [0.1], []) == [(None, 0.0)]


CONVERSIONS = [
    ("mass", "solMass", "solMass", "linear", 1.0, 0.0), ("mass", "jupMass", "solMass", "linear", 0.00095458, 0.0), ("effective_temperature", "K", "K", "linear", 1.0, 0.0),
    ("effective_temperature", "kK", "K", "linear", 1000.0, 0.0), ("effective_temperature", "degC", "K", "linear", 1.0, 273.15), ("effective_temperature", "dex_K", "K", "exp10", 1.0, 0.0), ("star.mass_msun", "solMass", "solMass", "linear", 1.0, 0.0),
    ("star.mass_msun", "jupMass", "solMass", "linear", 0.00095458, 0.0),
]
EVIDENCE = "evidence_id string, source_record_id string, quantity_key string, value_raw string, unit_raw string, normalized_value double, number string, unit_key int"


def tables(spark, evidence, records=(("r1", "s", "v1", datetime(2021, 1, 1)), ("r1", "s", "v1", datetime(2022, 1, 1)), ("r2", "s", "v2", datetime(2021, 1, 1)))):
    return (
        spark.createDataFrame(evidence, EVIDENCE),
        spark.createDataFrame(list(records), "source_record_id string, source_id string, release_id string, retrieved_at timestamp_ntz"),
        spark.createDataFrame(
            [("s", "v1", "effective_temperature", "see note", "temperature [unit: kK]"), ("s", "v2", "effective_temperature", None, "temperature, given in C"), ("s", "v1", "mass", " M_J ", None)],
            "source_id string, release_id string, source_field string, source_unit string, source_description string",
        ),
        spark.createDataFrame(CONVERSIONS, "quantity_key string, unit_key string, common_unit string, conversion string, factor double, shift double"),
    )


def test_units_from_value_field_and_source(spark):
    t = "effective_temperature"
    e, r, d, c = tables(spark, [
        ("a", "r1", t, "5.5", None, 5500.0, "clash", 1), ("b", "r1", t, "5500 K", "kK", 5500.0, None, None), ("c", "r1", t, "3.7", "[K]", 5011.87, None, None), ("d", "r2", t, "100", "-", 500.0, None, None),
        ("e", "r1", "mass", "10 ± 1", "", None, None, None), ("f", None, t, "5000", None, None, None, None), ("g", "r1", t, "n/a", "K", 1.0, None, None), ("h", "r1", "other", "1", "K", 1.0, None, None),
        ("i", "r1", t, "<5 ± 0.1 (kK)", None, float("nan"), None, None), ("a", "r1", t, "5.5", None, 5500.0, None, None), ("j", "r9", t, "1", None, None, None, None), (None, None, None, None, None, None, None, None),
    ])
    out = sorted((x["evidence_id"], x["unit_key"], x["unit_basis"], x["verdict"]) for x in U.resolve_units(e, r, d, c).fillna("", ["unit_key", "unit_basis"]).collect())
    assert out == [
        ("a", "kK", "declared", "right"), ("a", "kK", "declared", "right"), ("b", "K", "value", "right"), ("c", "dex_K", "unit", "right"), ("d", "degC", "declared", "wrong"),
        ("e", "jupMass", "declared", "missing"), ("f", "", "", "unknown"), ("i", "kK", "value", "missing"), ("j", "", "", "unknown"),
    ]


def stated_masses(n=60):
    """Masses whose own text names the unit: what tells the levels of the units of a mass."""
    return [(f"y{i}", None, "mass", f"{0.8 + 0.4 * i / n:.3f} Msun", None, 1.0, None, None) for i in range(n)]


def test_history_gives_the_unit_no_text_names(spark, rows):
    m = "mass"
    records = [(f"q{i}", "t", "v1", datetime(2021, 1 + i % 6, 1)) for i in range(60)]
    evidence = [(f"x{i}", f"q{i}", m, f"{1047 * (0.8 + 0.4 * i / 60):.1f}", None, 1.0, None, None) for i in range(60)]
    e, r, d, c = tables(spark, [*evidence, *stated_masses()], records)
    segments = U.unit_histories(e, r, c).collect()
    assert [(x["unit_key"], x["n_rows"], x["segment"]) for x in segments] == [("jupMass", 60, 0)]
    out = U.resolve_units(e, r, d, c).where("unit_basis <> 'value'")
    assert {(x["unit_key"], x["unit_basis"]) for x in out.collect()} == {("jupMass", "history")} and out.count() == 60
    # The field list confirms, or stands against, what the history says.
    fields = spark.createDataFrame([("t", "v1", m, "M_J", None)], d.schema)
    assert rows(U.inference_quality(e, r, fields, c)) == [(m, "jupMass", 60, 60, 60)]
    other = spark.createDataFrame([("t", "v1", m, "Msun", None)], d.schema)
    assert {(x["unit_key"], x["unit_basis"]) for x in U.resolve_units(e, r, other, c).where("unit_basis <> 'value'").collect()} == {("solMass", "declared")}


DESCRIBED = [
    ("see note", "x [unit: [cm/s2]]", "[cm/s2]"), (None, "x [unit: dex(cm/s2)]", "dex(cm/s2)"), (" ", "x; unit [cm s-2]", "[cms-2]"), (None, "x, given in log10(cm s-2)", "log10(cms-2)"), (None, "x (log(cm/s2))", "log(cm/s2)"),
    ("cgs dex", "x [unit: gal]", "cgsdex"), (None, "x, adopted value", None), (None, None, None),
]


def test_declared_units_from_descriptions(spark):
    from skyloom.functions.units import unit_lookup

    rows = [{"quantity_key": "g", "unit_key": u, "common_unit": "dex_cgs", "conversion": "linear", "factor": 1.0, "shift": 0.0} for u in ("dex_cgs", "cm_s2")]
    d = spark.createDataFrame([(f"s{i}", "1", "g", u, t) for i, (u, t, _) in enumerate(DESCRIBED)], "source_id string, release_id string, source_field string, source_unit string, source_description string")
    got = {r["source_id"]: r["declared_form"] for r in U.declared_units(d, unit_lookup(spark, rows)).collect()}
    assert [got.get(f"s{i}") for i in range(len(DESCRIBED))] == [form for _, _, form in DESCRIBED]


def test_claims(spark, rows):
    claim = "struct<claim_id:string,subject:string,predicate:string,value:string,unit:string>"
    p = "star.mass_msun"
    mk = lambda i, v, u: (i, "x", p, v, u)
    df = spark.createDataFrame([
        ("k1", "We adopt 12 M_J for the mass. mass = 3 solMass (this work).", ([mk("a", "12", None), mk("b", "3", ""), mk("c", "7", "Mjup"), mk("d", "7 M_J", None), mk("e", "9", None), mk("f", "many", "Mjup"), mk("g", None, "Mjup")],)),
        ("k2", None, ([mk("a", "12", None)],)), ("k3", None, (None,)), ("k4", "x", None),
    ], f"case_id string, source_excerpt string, expected struct<claims:array<{claim}>>")
    _, _, _, c = tables(spark, [])
    assert rows(U.claim_units(df, c)) == [("k1#a", "jupMass"), ("k1#c", "jupMass"), ("k1#d", "jupMass")]


def test_empty_tables(spark):
    e, r, d, c = tables(spark, [])
    none = r.limit(0)
    assert U.resolve_units(e, none, d.limit(0), c).count() == 0 and U.unit_histories(e, none, c).count() == 0
    assert U.resolve_units(e, none, d.limit(0), c.limit(0)).count() == 0 and U.inference_quality(e, none, d, c).count() == 0


def test_unknown_spelling_takes_the_unit_of_its_history(spark, rows):
    m = "mass"
    records = [(f"q{i}", "t", "v1", datetime(2021, 1 + i % 6, 1)) for i in range(60)]
    evidence = [(f"x{i}", f"q{i}", m, f"{1047 * (0.8 + 0.4 * i / 60):.1f}", None, 1.0, None, None) for i in range(60)]
    odd = [("e1", "q1", m, "1047", "heft", None, None, None), ("e2", "q1", m, "1047 heft", None, None, None, None), ("e3", "r1", m, "5.5 heft", None, None, None, None), ("e4", None, m, "5.5", "heft", None, None, None)]
    e, r, d, c = tables(spark, [*evidence, *odd, *stated_masses()], [*records, ("r1", "s", "v1", datetime(2021, 1, 1))])
    out = U.resolve_units(e, r, d, c, keep=("value_raw",)).where("evidence_id LIKE 'e%'")
    assert rows(out, "evidence_id", "unit_key", "unit_basis", "verdict", "value_raw") == [
        ("e1", "jupMass", "history", "missing", "1047"), ("e2", "jupMass", "history", "missing", "1047 heft"), ("e3", None, None, "unknown", "5.5 heft"), ("e4", None, None, "unknown", "5.5"),
    ]


@pytest.mark.parametrize("kind,factor,shift", [("linear", 1000.0, 0.0), ("linear", 1.0, 273.15), ("log10", 100.0, 0.5), ("exp10", 1e-9, 0.0)])
def test_conversions_can_be_reversed(spark, kind, factor, shift):
    from skyloom.functions.units import from_common, to_common

    df = spark.createDataFrame([(v, kind, factor, shift) for v in (0.5, 3.7, 10.1)], "v double, k string, f double, s double")
    args = [F.col(c) for c in ("k", "f", "s")]
    for r in df.select("v", from_common(to_common(F.col("v"), *args), *args).alias("w")).collect():
        assert r["w"] == pytest.approx(r["v"])
