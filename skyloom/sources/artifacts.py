"""Artifacts of a build: tables with manifests, serving tables, tile payloads, JSON tables."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.relational import table_digest


def write_artifact(df: DataFrame, path: str, key: list[str]) -> dict:
    """Writes a table sorted by key and ``manifest.json`` beside it: rows, logical digest, schema.

    The digest is taken from what was written and does not depend on file bytes.
    """
    df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/data")
    spark = df.sparkSession
    summary = table_digest(spark.read.parquet(f"{path}/data")).first()
    manifest = {"n_rows": summary["n_rows"], "digest": summary["digest"], "schema": json.loads(df.schema.json())}
    text = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """The table of an artifact; raises if it no longer agrees with its manifest."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    df = spark.read.parquet(f"{path}/data")
    found = table_digest(df).first()
    if (found["n_rows"], found["digest"]) != (manifest["n_rows"], manifest["digest"]):
        raise ValueError(f"{path} does not agree with its manifest")
    return df


def write_serving(df: DataFrame, path: str, facets: list[str], key: str) -> None:
    """A projection for serving: range-partitioned and sorted by facets and key, so that filters on them skip row groups."""
    df.repartitionByRange(*facets, key).sortWithinPartitions(*facets, key).write.mode("overwrite").parquet(path)


def read_json_table(spark: SparkSession, path: str, rows: str = "data", fields: str = "fields") -> DataFrame:
    """A JSON document with a block of column metadata (name, type) and a block of row arrays, as a typed table."""
    doc = spark.read.text(path, wholetext=True)
    meta = doc.select(F.from_json(F.get_json_object("value", f"$.{fields}"), "array<struct<name:string,type:string>>").alias("m")).first()["m"]
    kinds = {"int": "bigint", "long": "bigint", "float": "double", "double": "double", "boolean": "boolean"}
    each = doc.select(F.explode(F.from_json(F.get_json_object("value", f"$.{rows}"), "array<array<string>>")).alias("r"))
    return each.select(*[F.get("r", F.lit(i)).try_cast(kinds.get(m["type"], "string")).alias(m["name"]) for i, m in enumerate(meta)])


def tile_payloads(points: DataFrame, tile: str, key: str, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """``tile, n, payload``: the points of each tile as little-endian records (key int64, three float32), sorted by key.

    Tiles are bounded by their split, so a group fits a task.
    """
    def pack(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        data = b"".join(struct.pack("<qfff", *r) for r in pdf[["k", "x", "y", "z"]].itertuples(index=False))
        return pd.DataFrame([(name[0], len(pdf), data)], columns=["tile", "n", "payload"])

    slim = points.select(F.col(tile).cast("string").alias("tile"), F.col(key).cast("long").alias("k"), *[F.col(a).cast("double").alias(b) for a, b in ((x, "x"), (y, "y"), (z, "z"))])
    return slim.groupBy("tile").applyInPandas(pack, "tile string, n long, payload binary")
