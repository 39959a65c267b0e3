"""Readers of text sources: delimited, fixed-width, token and document files, layouts and sinks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FixedField:
    name: str
    start: int
    end: int
    kind: str = "string"


def fixed_width(lines: DataFrame, column: str, layout: list[FixedField], keep: list[str] = ()) -> DataFrame:
    """Columns cut from a text line by 1-based inclusive positions; blank or ill-typed values are null."""
    def cut(f: FixedField):
        text = F.trim(F.substring(column, f.start, f.end - f.start + 1))
        return (text if f.kind == "string" else F.nullif(text, F.lit("")).try_cast(f.kind)).alias(f.name)

    return lines.select(*keep, *[cut(f) for f in layout])


BYTE_LINE = re.compile(r"^\s*(?:(\d+)\s*-\s*)?(\d+)\s+([AIFE]\d+(?:\.\d+)?)\s+(\S+)\s+(\S+)")


def parse_byte_layout(text: str) -> list[FixedField]:
    """The layout that a published byte-by-byte description gives (start, end, format, unit, label)."""
    kinds = {"A": "string", "I": "bigint", "F": "double", "E": "double"}
    out = []
    for line in text.splitlines():
        if m := BYTE_LINE.match(line):
            start, end, form, _, name = m.groups()
            out.append(FixedField(name, int(start or end), int(end), kinds[form[0]]))
    return out


def read_all_text(spark: SparkSession, paths: list[str], delimiter: str = ",", quote: str = '"', header: bool = True) -> DataFrame:
    """Delimited files of one shape, every column text, failing on broken rows and differing headers."""
    frames = [spark.read.csv(p, header=header, sep=delimiter, quote=quote, escape=quote, inferSchema=False, mode="FAILFAST", multiLine=True) for p in paths]
    first = frames[0].columns
    for p, f in zip(paths, frames):
        if f.columns != first:
            raise ValueError(f"{p} has other columns than {paths[0]}")
        if len({c.lower() for c in f.columns}) != len(f.columns):
            raise ValueError(f"{p} repeats a column name")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in first])
    return spark.read.schema(schema).csv(paths, header=header, sep=delimiter, quote=quote, escape=quote, mode="FAILFAST", multiLine=True)


def read_lenient(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",") -> DataFrame:
    """Delimited text with missing trailing fields as nulls and empty texts as nulls."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, header=True, sep=delimiter, mode="PERMISSIVE")
    return df.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in columns])


def read_continued(spark: SparkSession, head: str, rest: list[str], delimiter: str = ",") -> DataFrame:
    """A file with a header and continuation files without one, with the file each row came from."""
    columns = spark.read.csv(head, header=True, sep=delimiter, inferSchema=False).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    first = spark.read.schema(schema).csv(head, header=True, sep=delimiter)
    both = first.unionByName(spark.read.schema(schema).csv(rest, header=False, sep=delimiter)) if rest else first
    return with_member(both)


def with_member(df: DataFrame, members: dict[str, str] | None = None) -> DataFrame:
    """Adds ``source_member``: the file name, or what ``members`` maps it to; an unmapped file is an error."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    if members is None:
        return df.withColumn("source_member", name)
    known = F.create_map(*[F.lit(x) for kv in sorted(members.items()) for x in kv])
    mapped = F.try_element_at(known, name)
    return df.withColumn("source_member", F.when(mapped.isNotNull(), mapped).otherwise(F.raise_error(F.concat(F.lit("unaccounted source member "), name))))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``source_member, source_line_number, text`` of text files, whole files split within the JVM."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_member"), "value")
    return whole.select("source_member", F.posexplode(F.split("value", r"\r?\n", -1)).alias("i", "text")).select("source_member", (F.col("i") + 1).cast("long").alias("source_line_number"), "text")


def read_tokens(lines: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """Blank-parted tokens of lines as text columns; missing ones are null, a surplus joins the last."""
    parts = F.split(F.trim(text), r"\s+", len(names))
    keep = [c for c in lines.columns if c != text]
    return lines.select(*keep, *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_blocks(lines: DataFrame, boundary: str, member: str = "source_member", line: str = "source_line_number", text: str = "text") -> DataFrame:
    """Lines of multi-line records with ``block``: how many boundary lines the member has had so far."""
    from pyspark.sql import Window

    w = Window.partitionBy(member).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(F.col(text).rlike(boundary).cast("int")).over(w))


def write_ordered(df: DataFrame, path: str, key: list[str], files: int | None = None) -> None:
    """Parquet sorted by key over the whole table, zstd-compressed."""
    ranged = df.repartitionByRange(files, *key) if files else df.repartitionByRange(*key)
    ranged.sortWithinPartitions(*key).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_per_quantity(df: DataFrame, path: str, key: str = "quantity_key") -> None:
    """One Parquet partition per quantity; names must be plain."""
    bad = df.where(~F.col(key).rlike("^[a-z0-9_]+$")).limit(1)
    if not bad.isEmpty():
        raise ValueError("a quantity name is not plain")
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def empty_relation(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def cut_bytes(line: Column, start: Column, end: Column) -> Column:
    """Bytes ``start`` to ``end`` (1-based, inclusive) of a line, trimmed; null where they cut a character or the layout gives no place."""
    part = F.encode(line, "UTF-8").substr(start, end - start + 1).cast("string")
    return F.trim(F.call_function("try_validate_utf8", part))
