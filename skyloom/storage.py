"""Cutting lineage with written tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='skyloom-')}"
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


class Scratch:
    """Written tables of one computation.

    A loop drops the table that its next round replaces; ``close`` drops all of
    them once nothing lazy reads them any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/skyloom/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        """Writes ``df`` once and returns a scan of it, free of the lineage."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._skyloom_path = path  # type: ignore[attr-defined]
        return out

    def write_buckets(self, df: DataFrame, keys: list[str], n: int) -> DataFrame:
        """Writes ``df``, which lies in ``n`` partitions by the hash of ``keys``; its scan keeps them, so groups of ``keys`` need no exchange."""
        self._n += 1
        name = f"skyloom_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(n, *keys).option("path", f"{self.root}/{self._n}").saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # an external table: only its name goes, the files stay
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that ``write`` made and nothing reads any more."""
        self._delete(df._skyloom_path)

    def close(self) -> None:
        """Deletes all tables of the computation."""
        self._delete(self.root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


#: Rows up to which a written side is broadcast.
BROADCAST_ROWS = 100_000


def sized(written: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast only if it has at most ``limit`` rows."""
    return F.broadcast(written) if written.count() <= limit else written


def small_side(scratch: Scratch, df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Writes ``df`` and returns its scan, marked for broadcast only if it has at most ``limit`` rows."""
    return sized(scratch.write(df), limit)
