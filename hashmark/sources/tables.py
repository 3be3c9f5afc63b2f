"""The given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from hashmark.session import hadoop_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder; columns and filters reach the scan through Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


def register_views(spark: SparkSession, folder: str, *names: str) -> None:
    """Make tables of a folder known to ``spark.sql`` under their names; queries are pruned and pushed down as usual."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def table_or_empty(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The table, or none of its rows where it isn't there: columns are ``schema``'s either way."""
    path, files = hadoop_path(spark, f"{folder}/{name}.parquet")
    if not files.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int, ties: list[str] | None = None) -> DataFrame:
    """``n`` rows drawn by the hash of their key: the same rows whatever the partitions. ``ties`` put rows of one key in order."""
    return df.orderBy(F.md5(F.concat(F.col(key), F.lit(f"|{seed}")).cast("binary")).asc_nulls_first(), *(ties or [])).limit(n)


def in_weeks(df: DataFrame, numbers: list[int], keys: list[str]) -> DataFrame:
    """Rows whose season and week are among ``numbers`` (season * 100 + week) or ``keys`` ("2024-03").

    The weeks become pairs of season and week, so that a table partitioned by them is pruned.
    """
    pairs = {divmod(x, 100) for x in numbers} | {tuple(map(int, k.split("-"))) for k in keys}
    wanted = F.lit(False)
    for season in sorted({s for s, _ in pairs}):
        wanted = wanted | ((F.col("season") == season) & F.col("week").isin([w for s, w in sorted(pairs) if s == season]))
    return df.where(wanted)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with ``_rank``; Spark keeps only ``n`` a key before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)


#: Rows that a user's query gives out at most.
CAP = 200


def capped(df: DataFrame, n: int = CAP) -> DataFrame:
    """At most ``n`` rows of a result, whatever limit it has itself."""
    return df.limit(n)


def load(df: DataFrame, path: str, expected: int | None = None) -> int:
    """Write a table and count its rows in the same pass; a number other than ``expected`` is an error, and nothing is left there."""
    seen = Observation("loaded")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    n = seen.get["n"]
    if expected is not None and n != expected:
        where, files = hadoop_path(df.sparkSession, path)
        files.delete(where, True)
        raise ValueError(f"{n} rows loaded into {path}, {expected} expected")
    return n
