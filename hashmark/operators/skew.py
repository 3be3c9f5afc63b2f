"""Salts for keys that hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(counts: DataFrame, keys: list[str], parts: int = 1024, least: int = 50_000) -> DataFrame:
    """Keys that hold over ``1/parts`` of all rows (and over ``least``), with the number of salts to split each into.

    ``counts`` has ``keys`` and ``n``, the rows of each key. There can be at most ``parts`` such keys whatever
    the input's size, so the result may be broadcast; every salted group has at most about that share.
    """
    limit = F.greatest(counts.agg(F.sum("n")).scalar() / F.lit(parts), F.lit(least))
    return counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_salts"))


def salted(df: DataFrame, hot: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``df`` with ``_salt``: 0 for ordinary keys, else drawn from ``by``; null keys match null keys."""
    return _with_salts(df, hot, keys).withColumn("_salt", F.pmod(F.xxhash64(*by), F.col("_salts")).cast("int")).drop("_salts")


def replicated(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` once for every salt of its key, to meet the rows that ``salted`` spread."""
    return _with_salts(df, hot, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")


def _with_salts(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    known = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_salts")
    on = [df[k].eqNullSafe(known[f"_hot_{k}"]) for k in keys]
    joined = df.join(F.broadcast(known), on, "left").drop(*[f"_hot_{k}" for k in keys])
    return joined.withColumn("_salts", F.coalesce("_salts", F.lit(1)))
