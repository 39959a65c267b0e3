"""Attribute-value rows to wide tables (p5)."""

from datetime import datetime

from pyspark.sql import functions as F

from skyloom.operators import wide as W

CATALOG = [("age", "double", ["age_gyr"]), ("count", "bigint", ["n_obs"]), ("flag", "boolean", None), ("kind", "string", []), ("seen", "timestamp", ["last_obs"])]
FACTS = "selected_fact_id string, stable_object_key string, quantity_key string, value_raw string, normalized_value double, evidence_id string, authority_rank int, selected_at timestamp_ntz, kind string, position int"
T0, T1 = datetime(2021, 1, 1), datetime(2022, 1, 1)


def catalog(spark):
    return W.read_catalog(spark.createDataFrame([(a, b, c) for a, b, c in CATALOG], "quantity_key string, value_type string, other_names array<string>"))


def facts(spark, data):
    return spark.createDataFrame([(*d, "clash", 3) for d in data], FACTS)


def evidence(spark):
    return spark.createDataFrame([("e1", 4.5), ("e1", 4.5), ("e2", None), ("e3", -9999.0)], "evidence_id string, normalized_value double")


DATA = [
    ("f1", " Star:A ", "Age GYR", "x", None, "e1", 1, T0), ("f2", "star:a", "age", "7", -9999.0, "e2", 0, T0), ("f3", "STAR:A", "n-obs", " 12 ", None, None, None, T0), ("f4", "star:a", "COUNT", "13", None, None, 2, T0),
    ("f5", "star:a", "flag", " Yes", None, None, 1, None), ("f6", "star:a", "flag", "no", None, None, 1, T0), ("f7", "star:a", "flag", "f", None, None, 1, T1), ("f8", "star:b", "kind", " -- ", None, None, 1, T1),
    ("f9", "star:b", "unknown thing", "1", None, None, 1, T1), ("g1", "star:b", "last_obs", "2023-02-30", None, None, 0, T0), ("g2", "star:b", "seen", "2023-02-28T10:00:00Z", None, None, 1, T0),
    ("g3", "star:c", "age", "5", float("nan"), None, 1, T0), ("g4", "", "age", "5", 5.0, None, 1, T0), ("g5", None, "age", "5", 5.0, None, 1, T0), ("f7", "star:a", "flag", "f", None, None, 1, T1),
    ("g6", "star:d", "kind", "x", None, None, 1, T0), ("g0", "star:d", "kind", "y", None, None, 1, T0), ("g7", "star:d", "count", "3.7", None, None, 1, T0), ("g8", "star:d", None, None, None, None, None, None),
]


def test_cells(spark, rows):
    wide = W.wide_rows(facts(spark, DATA), evidence(spark), catalog(spark))
    assert rows(W.filled_cells(wide, catalog(spark))) == [
        ("star:a", "age", "f1"), ("star:a", "count", "f4"), ("star:a", "flag", "f7"), ("star:b", "seen", "g2"), ("star:d", "kind", "g0"),
    ]


def test_typed_columns(spark):
    table = W.typed_wide(W.wide_rows(facts(spark, DATA), evidence(spark), catalog(spark)), catalog(spark))
    assert dict(table.dtypes) == {"entity": "string", "age": "double", "count": "bigint", "flag": "boolean", "kind": "string", "seen": "timestamp"}
    got = {r["entity"]: r for r in table.collect()}
    assert set(got) == {"star:a", "star:b", "star:c", "star:d"}
    assert (got["star:a"]["age"], got["star:a"]["count"], got["star:a"]["flag"]) == (4.5, 13, False)
    assert all(v is None for v in list(got["star:c"])[1:]) and got["star:b"]["seen"] is not None


def test_empty(spark):
    none = facts(spark, DATA).limit(0)
    assert W.wide_rows(none, evidence(spark).limit(0), catalog(spark)).count() == 0
    assert W.wide_rows(facts(spark, DATA), evidence(spark).limit(0), []).where(F.col("entity") == "star:a").count() == 1


def test_long_text_and_hot_entity(spark):
    many = [(f"h{i}", "hot", "kind", "v" * (100_000 if i == 500 else 3), None, None, 1 if i else 0, T0) for i in range(1000)]
    got = W.filled_cells(W.wide_rows(facts(spark, many), evidence(spark), catalog(spark)), catalog(spark)).collect()
    assert [r["selected_fact_id"] for r in got] == ["h0"]
