"""Spark sessions and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", app: str = "skyloom") -> SparkSession:
    """A session for tests and single-host runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the layer kept in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Layer:
    """A directory of Parquet tables, optionally registered as prefixed temp views.

    ``exists`` and ``columns`` are the probes by which a reader copes with
    optional tables and columns.
    """

    def __init__(self, spark: SparkSession, path: str, alias: str | None = None):
        self.spark, self.path, self.alias = spark, path.rstrip("/"), alias

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.parquet")
        fs = target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return bool(fs.exists(target))

    def __getitem__(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    def columns(self, name: str) -> list[str]:
        return self[name].columns if self.exists(name) else []

    def attach(self, *names: str) -> list[str]:
        """Registers ``<alias>_<name>`` views and returns their names."""
        views = []
        for name in names:
            view = f"{self.alias}_{name}" if self.alias else name
            self[name].createOrReplaceTempView(view)
            views.append(view)
        return views
