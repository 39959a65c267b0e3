"""Separation of rows that fail to parse (p2)."""

import pytest

from skyloom.operators import rejects as R

SCHEMA = (
    "source_table string, layout_kind string, delimiter string, quote_char string, null_token string, header_lines int, comment_prefix string, field_position int, field_name string, "
    "field_type string, required boolean, min_value double, max_value double, allowed_values array<string>, start_byte int, end_byte int"
)


def layouts(spark):
    d = lambda t, kind, delim, quote, null, head: lambda pos, name, ft, req, lo=None, hi=None, ok=None, a=None, b=None: (t, kind, delim, quote, null, head, "#", pos, name, ft, req, None if lo is None else float(lo), None if hi is None else float(hi), ok, a, b)
    c, w, f, p = d("csv", "delimited", ",", '"', "", 1), d("ws", "whitespace", " ", None, "-", 0), d("fix", "fixed_width", None, None, "", 0), d("pipe", "delimited", "|", None, "", 0)
    return spark.createDataFrame([
        c(1, "name", "text", True), c(2, "n", "int", True, 0, 100), c(3, "day", "date", False), c(4, "kind", "enum", True, ok=["a", "b"]),
        w(1, "x", "float", True, -10, 10), w(2, "y", "float", False), f(1, "k", "int", True, 1, 999, None, 1, 3), f(2, "t", "text", False, None, None, None, 4, 8), p(1, "a", "text", False), p(2, "b", "int", False),
    ], SCHEMA)


CASES = [
    ("csv", 2, "bob,5,2024-02-29,a", None), ("csv", 2, '"bo,b",5,,b', None), ("csv", 2, '"b ""x"" b",5,,b', None), ("csv", 2, '"line\nbreak",5,,a', None), ("csv", 2, ' "bob" , 5 ,, a ', None),
    ("csv", 2, 'bo"b,5,,a', "quoting"), ("csv", 2, '"bob,5,,a', "quoting"), ("csv", 2, '"bob"x,5,,a', "quoting"), ("csv", 2, "bo\nb,5,,a", "quoting"), ("csv", 2, '"a""",5,,a', None), ("csv", 2, '"",5,,a', "invalid_value"),
    ("csv", 2, '""",5,,a', "quoting"), ("csv", 2, "bob,5,,a,", "column_count"), ("csv", 2, "bob,5", "column_count"), ("csv", 2, "bob,500,,a", "invalid_value"), ("csv", 2, "bob,5.0,,a", "invalid_value"),
    ("csv", 2, "bob,100,,a", None), ("csv", 2, "bob,5,2023-02-29,a", "invalid_value"), ("csv", 2, "bob,5,2023-2-1,a", "invalid_value"), ("csv", 2, "bob,5,,A", "invalid_value"), ("csv", 2, ",5,,a", "invalid_value"), ("csv", 2, "bob,٥,,a", "invalid_value"),
    ("csv", 1, "broken header", "header"), ("csv", 2, "# comment", "header"), ("csv", 2, "   ", "header"), ("csv", 2, None, "header"), ("csv", None, "bob,5", "column_count"),
    ("ws", 1, "  1.5    -3e0 ", None), ("ws", 1, "1.5\t2", None), ("ws", 1, "1 2 3", "column_count"), ("ws", 1, "- 2", "invalid_value"), ("ws", 1, "inf 2", "invalid_value"), ("ws", 1, "1 1e999", "invalid_value"), ("ws", 1, "10.0 -", None),
    ("fix", 1, " 12abc", None), ("fix", 1, "12", "column_count"), ("fix", 1, " 12abcde   ", None), ("fix", 1, " 12abcdeX", "column_count"), ("fix", 1, "   abc", "invalid_value"), ("fix", 1, "0  ", "invalid_value"),
    ("pipe", 1, 'a"b|5', None), ("pipe", 1, "|", None), ("pipe", 1, "a|b", "invalid_value"), ("pipe", 1, "a", "column_count"), ("nolayout", 1, "x", "header"),
]


def lines(spark, cases):
    schema = "native_row_id long, source_table string, source_line_number long, raw_row string, fields string, errors int, reason string, _broken string"
    return spark.createDataFrame([(i, t, n, raw, "f", 1, "r", "b") for i, (t, n, raw, _) in enumerate(cases)], schema)


def test_reasons(spark):
    got = {r["native_row_id"]: r for r in R.check_records(lines(spark, CASES), R.read_layouts(layouts(spark))).collect()}
    for i, (_, _, raw, want) in enumerate(CASES):
        if want == "header":
            assert i not in got, raw
        else:
            errors = got[i]["errors"]
            assert (errors[0].split(":")[0] if errors else None) == want, raw


def test_valid_rows_load_typed(spark, rows):
    all_layouts = R.read_layouts(layouts(spark))
    checked = R.check_records(lines(spark, CASES), all_layouts)
    csv = R.load_valid(checked, all_layouts[0], ["native_row_id"])
    assert dict(csv.dtypes) == {"native_row_id": "bigint", "name": "string", "n": "bigint", "day": "date", "kind": "string"}
    assert ('b "x" b',) in rows(csv, "name") and ("bo,b",) in rows(csv, "name") and ("line\nbreak",) in rows(csv, "name")
    assert csv.count() + sum(R.load_valid(checked, l, []).count() for l in all_layouts[1:]) + R.rejects(checked).count() == checked.count()


@pytest.mark.parametrize("raw,want", [('"' + "x" * 300_000 + '",5,,a', None), ('"' + '""' * 50_000 + '",5,,a', None), ('""' * 50_000, "column_count"), ("x" * 300_000, "column_count"), ("," * 100_000, "column_count")])
def test_very_long_records(spark, raw, want):
    got = R.check_records(lines(spark, [("csv", 2, raw, None)]), R.read_layouts(layouts(spark))).first()
    assert (got["errors"][0].split(":")[0] if got["errors"] else None) == want


def test_empty_tables(spark):
    assert R.check_records(lines(spark, CASES[:1]).limit(0), R.read_layouts(layouts(spark))).count() == 0
    assert R.check_records(lines(spark, CASES[:1]), R.read_layouts(layouts(spark).limit(0))).count() == 0


def test_repeated_lines_stay(spark):
    two = lines(spark, [CASES[5], CASES[5]])
    assert R.rejects(R.check_records(two, R.read_layouts(layouts(spark)))).count() == 2
