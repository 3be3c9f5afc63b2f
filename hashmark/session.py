"""Sessions for tests and benches, and the one place that cuts lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the engine is written for; a cluster brings its own session instead."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))  # workers import the package from here
    os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hashmark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where nothing is named, gets a folder of its own; on a cluster that is an error, as
    executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hashmark-"))
    return spark.sparkContext.getCheckpointDir()


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system it lies on, whichever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


class Kept:
    """Intermediate results as tables in the shared folder: that cuts the lineage, survives lost executors and lets later steps read single columns.

    A result kept under a name that is taken replaces the one before, which is deleted once the new one is
    written; so an iteration holds two tables at most. The last tables stay, as lazy results read them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.at = f"{shared_folder(spark)}/tables-{uuid.uuid4()}"
        self.versions: dict[str, int] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        version = self.versions.get(name, 0) + 1
        path = f"{self.at}/{name}-{version}"
        df.write.parquet(path)
        self.drop(name)
        self.versions[name] = version
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete what is kept under the name; nothing may read it any more."""
        if version := self.versions.pop(name, 0):
            path, files = hadoop_path(self.spark, f"{self.at}/{name}-{version}")
            files.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own in the shared folder, its lineage cut."""
    return Kept(df.sparkSession).keep(df, "t")
