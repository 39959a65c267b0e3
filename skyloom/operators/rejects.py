"""Rows that fail to parse: typed rows on one side, rejects with reasons on the other.

Every field is first loaded as nullable text. Cast and constraint rules are
Column expressions, compiled from the declared layouts, that fill an array of
errors per row; a row with an empty array is valid. Nothing leaves the JVM and
nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numbers import once
from skyloom.functions.units import MAX_POLICY_ROWS

BLANKS = " \t"
#: Stands for a protected delimiter while a quoted record is taken apart; itself escaped if it occurs.
MARK = "﷐"
TYPES = {"int": "bigint", "float": "double", "date": "date", "enum": "string", "text": "string"}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool
    low: float | None
    high: float | None
    allowed: tuple[str, ...] | None
    start: int | None
    end: int | None


@dataclass(frozen=True)
class Layout:
    table: str
    kind: str
    delimiter: str | None
    quote: str | None
    null_token: str | None
    header_lines: int
    comment: str | None
    fields: tuple[Field, ...]


def read_layouts(layouts: DataFrame) -> list[Layout]:
    """The declared layouts; a fixed policy table of at most ``MAX_POLICY_ROWS`` rows."""
    rows = layouts.limit(MAX_POLICY_ROWS + 1).collect()
    if len(rows) > MAX_POLICY_ROWS:
        raise ValueError("the layout table is not a bounded policy table")
    by: dict[str, dict[int, object]] = {}
    for r in rows:
        by.setdefault(r["source_table"], {})[r["field_position"]] = r
    out = []
    for name, fields in sorted(by.items()):
        ordered = [fields[k] for k in sorted(fields)]
        first = ordered[0]
        out.append(Layout(
            name, first["layout_kind"], first["delimiter"], first["quote_char"] or None, first["null_token"], first["header_lines"] or 0, first["comment_prefix"] or None,
            tuple(Field(r["field_name"], r["field_type"], bool(r["required"]), r["min_value"], r["max_value"], None if r["allowed_values"] is None else tuple(r["allowed_values"]), r["start_byte"], r["end_byte"]) for r in ordered),
        ))
    return out


def _blank(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS)) == ""


def _broken_quoting(parts: Column, n: Column, layout: Layout) -> Column:
    """Split at the quote character, every second part is inside quotes. Outside
    parts must part fields: the first ends, the last begins with the delimiter,
    those between do both; an empty one between is a doubled quote. None may
    hold a line break. Linear in the length of the record, without recursion."""
    d = re.escape(layout.delimiter or ",")
    b = "[" + "".join(x for x in BLANKS if x != layout.delimiter) + "]*"

    def wrong(part: Column, i: Column) -> Column:
        outside = i % 2 == 0
        starts = part.rlike(rf"^{b}{d}") | (i == 0)
        ends = part.rlike(rf"{d}{b}$") | (i == n - 1)
        blank_edge = ((i == 0) | (i == n - 1)) & part.rlike(rf"^{b}$")
        doubled = (part == "") & (i > 0) & (i < n - 1)
        return outside & (part.rlike(r"[\r\n]") | ~((starts & ends) | blank_edge | doubled))

    return (n % 2 == 0) | F.exists(F.transform(parts, wrong), lambda x: x)


def _quoted_fields(parts: Column, n: Column, layout: Layout) -> Column:
    delimiter = layout.delimiter or ","

    def shield(part: Column, i: Column) -> Column:
        inside = F.replace(F.replace(part, F.lit(MARK), F.lit(MARK + "a")), F.lit(delimiter), F.lit(MARK + "b"))
        outside = F.when((part == "") & (i > 0) & (i < n - 1), F.lit(layout.quote)).otherwise(F.replace(part, F.lit(MARK), F.lit(MARK + "a")))
        return F.when(i % 2 == 1, inside).otherwise(outside)

    joined = F.array_join(F.transform(parts, shield), "")
    fields = F.split(joined, re.escape(delimiter), -1)
    return F.transform(fields, lambda x: F.replace(F.replace(x, F.lit(MARK + "b"), F.lit(delimiter)), F.lit(MARK + "a"), F.lit(MARK)))


def _fields(raw: Column, parts: Column, n: Column, layout: Layout) -> Column:
    """The record's fields as text without outer blanks; null for empty and null_token."""
    if layout.kind == "fixed_width":
        data = raw.cast("binary")
        fields = F.array(*[F.substring(data, f.start, f.end - f.start + 1).cast("string") for f in layout.fields])
    elif layout.kind == "whitespace":
        fields = F.split(F.trim(raw, F.lit(BLANKS)), rf"[{BLANKS}]+", -1)
    elif layout.quote:
        # Without any quote the record is split directly.
        plain = F.split(raw, re.escape(layout.delimiter), -1)
        fields = F.when(n == 1, plain).otherwise(_quoted_fields(parts, n, layout))
    else:
        fields = F.split(raw, re.escape(layout.delimiter), -1)
    empty = F.array(F.lit(""), F.lit(layout.null_token or ""))
    trimmed = F.transform(fields, lambda x: F.trim(x, F.lit(BLANKS)))
    return F.transform(trimmed, lambda x: F.when(~F.array_contains(empty, x), x))


def _column_count(raw: Column, fields: Column, layout: Layout) -> Column:
    if layout.kind != "fixed_width":
        return F.size(fields) != len(layout.fields)
    reach = max([f.end for f in layout.fields if f.required], default=0)
    end = max(f.end for f in layout.fields)
    data = raw.cast("binary")
    beyond = F.substring(data, end + 1, 2**31 - 1 - end).cast("string")
    return (F.octet_length(raw) < reach) | ~_blank(beyond)


def _invalid(value: Column, field: Field) -> Column:
    """Whether a present value breaks the rule of its field (never null)."""
    if field.kind in ("int", "float"):
        pattern = r"^[+-]?[0-9]+$" if field.kind == "int" else r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
        number = value.try_cast("double")
        good = value.rlike(pattern) & (F.abs(number) < float("inf"))
        if field.low is not None:
            good = good & (number >= field.low)
        if field.high is not None:
            good = good & (number <= field.high)
    elif field.kind == "date":
        good = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~value.startswith("0000") & value.try_cast("date").isNotNull()
    elif field.kind == "enum":
        good = value.isin(*field.allowed) if field.allowed else F.lit(False)
    else:
        good = F.lit(True)
    return ~F.coalesce(good, F.lit(False))


def _by_layout(layouts: list[Layout], make, table: str) -> Column:
    out = F
    for layout in layouts:
        out = out.when(F.col(table) == layout.table, make(layout))
    return out


KEPT = ("native_row_id", "source_id", "source_table", "source_member", "source_line_number", "raw_row", "ingested_at")


def check_records(lines: DataFrame, layouts: list[Layout], table: str = "source_table", raw: str = "raw_row", line: str = "source_line_number", keep: tuple[str, ...] = KEPT) -> DataFrame:
    """The records among ``lines`` with their ``fields`` (array of text) and ``errors``.

    Header lines, blank and null lines and comments are no records and are left
    out; so are lines of a table without a layout. A null line number is taken
    for a line after the header. ``errors`` holds ``quoting``, ``column_count``
    and ``invalid_value:<field>`` in this order; a record with broken quoting
    or a wrong number of fields is not looked at further, because its fields
    have no places. Repeated lines stay repeated. Of the columns those of
    ``keep`` that exist are kept; others, whatever their names, are not read.
    """
    lines = lines.select(*dict.fromkeys([*[c for c in keep if c in lines.columns], table, raw, line]))
    if not layouts:
        return lines.where(F.lit(False)).withColumns({"fields": F.lit(None).cast("array<string>"), "errors": F.lit(None).cast("array<string>")})
    r = F.col(raw)
    is_comment = _by_layout(layouts, lambda l: r.startswith(l.comment) if l.comment else F.lit(False), table)
    in_header = _by_layout(layouts, lambda l: F.coalesce(F.col(line) <= l.header_lines, F.lit(False)), table)
    records = lines.where(F.col(table).isin(*[l.table for l in layouts]) & r.isNotNull() & ~F.regexp_replace(r, r"\s+$", "").eqNullSafe("") & ~is_comment & ~in_header)
    # The parts between quotes are columns of their own: within a lambda they would be split again for every part.
    records = once(records, _parts=_by_layout(layouts, lambda l: F.split(r, re.escape(l.quote), -1) if l.kind == "delimited" and l.quote else F.lit(None).cast("array<string>"), table))
    records = once(records, _n=F.size("_parts"))
    parts, n = F.col("_parts"), F.col("_n")
    records = once(
        records,
        fields=_by_layout(layouts, lambda l: _fields(r, parts, n, l), table),
        _broken=_by_layout(layouts, lambda l: _broken_quoting(parts, n, l) if l.kind == "delimited" and l.quote else F.lit(False), table),
    ).drop("_parts", "_n")

    def errors(layout: Layout) -> Column:
        miss = _column_count(r, F.col("fields"), layout)
        each = []
        for i, f in enumerate(layout.fields):
            value = F.col("fields")[i] if layout.kind == "fixed_width" else F.get(F.col("fields"), i)
            bad = F.when(value.isNull(), F.lit(f.required)).otherwise(_invalid(value, f))
            each.append(F.when(bad, F.lit(f"invalid_value:{f.name}")))
        return F.when(F.col("_broken"), F.array(F.lit("quoting"))).when(miss, F.array(F.lit("column_count"))).otherwise(F.array_compact(F.array(*each)))

    return once(records, errors=_by_layout(layouts, errors, table)).drop("_broken")


def rejects(checked: DataFrame) -> DataFrame:
    """The records with errors and ``reason``, the kind of the first error."""
    return checked.where(F.size("errors") > 0).withColumn("reason", F.split_part(F.element_at("errors", 1), F.lit(":"), F.lit(1)))


def load_valid(checked: DataFrame, layout: Layout, keep: list[str], table: str = "source_table") -> DataFrame:
    """The valid records of one table in typed columns, named as the layout names them.

    A field whose name clashes with a kept column gets the suffix ``_field``.
    """
    columns = [F.get(F.col("fields"), i).try_cast(TYPES[f.kind]).alias(f"{f.name}_field" if f.name in keep else f.name) for i, f in enumerate(layout.fields)]
    return checked.where((F.col(table) == layout.table) & (F.size("errors") == 0)).select(*keep, *columns)
