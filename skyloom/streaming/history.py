"""Append-only history as a stream: the same merge as the batch operator, per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyloom.operators.relational import append_history


def first_and_last(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First and last observation per key and day of a stream, late rows within ``delay`` included."""
    seen = stream.withWatermark(time, delay)
    return seen.groupBy(F.window(time, "1 day").alias("day"), *keys).agg(F.min(time).alias("first_observed"), F.max(time).alias("last_observed"), F.count("*").alias("n_events"))


def history_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], first: str, last: str, payload: list[str]) -> StreamingQuery:
    """Merges every micro-batch into the history under ``path``, in a new version folder each.

    A batch that is run again writes the same version from the version before,
    so a restart after a failure changes nothing. Versions are named by batch.
    """
    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, first, last, *payload)
        before = spark.read.schema(rows.schema).parquet(f"{path}/v{n - 1}") if n else rows.limit(0)
        append_history(before, rows, keys, first, last, payload).write.mode("overwrite").parquet(f"{path}/v{n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
