"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashmark.session import cut


#: Groups whose quantiles may be broadcast.
FEW = 10_000


def exact(df: DataFrame, by: str, value: str, shares: dict[str, float], parts: int = 256) -> DataFrame:
    """``by``, one column for each of ``shares`` (the least value that at least that share of the group doesn't exceed), ``n``.

    Equal values are counted together; the counts of a group are cut at its quantiles and summed within the ranges and
    over them, so that no task sorts a whole group, whatever share of the rows it holds. Null values don't count; a
    group of nothing else has nulls and ``n`` counts its rows.
    """
    values = cut(df.groupBy(by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    known = values.where("_v IS NOT NULL")
    cuts = cut(known.groupBy(F.col(by).alias("_by")).agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)]).alias("_cuts"), F.sum("_n").alias("_all")))
    # few groups may be large ones, whose values then stay where they are; of many groups none is most of the rows, or Spark splits it
    ranged = known.join(F.broadcast(cuts) if cuts.count() <= FEW else cuts, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts", "_by")
    sums = ranged.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_r")).agg(F.sum("_n").alias("_in"))
    below = Window.partitionBy("_by").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_by", "_r", F.coalesce(F.sum("_in").over(below), F.lit(0)).alias("_below"))
    so_far = F.sum("_n").over(Window.partitionBy(by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_within", so_far).join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r"))).withColumn("_upto", F.col("_below") + F.col("_within"))
    found = placed.groupBy(F.col(by).alias("_by")).agg(*[F.min(F.when(F.col("_upto") >= F.ceil(share * F.col("_all")), F.col("_v"))).alias(name) for name, share in shares.items()])
    counted = values.groupBy(by).agg(F.sum("_n").alias("n"))
    return counted.join(found, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, *shares, "n")
