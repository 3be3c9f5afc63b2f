"""What a team's options on a down are worth, from hypothetical states that are scored together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Yards behind the line from which a kick is taken, the deepest spot a miss is given up at, and where the other side starts after a kick that counts.
KICK_SPOT, MISS_DEEPEST, AFTER_KICK = 7, 80, 75
OPTIONS = ["go", "kick", "punt"]


def next_possession(plays: DataFrame) -> DataFrame:
    """Each play with ``next_team``, ``next_yardline`` and ``next_margin`` (the score as its own side then sees it); null at a game's last."""
    w = Window.partitionBy("game_id").orderBy("play_id", "play_key")
    margin = F.lead("score_differential").over(w)
    return plays.withColumns(
        {
            "next_team": F.lead("posteam").over(w),
            "next_yardline": F.lead("yardline_100").over(w),
            "next_margin": F.when(F.lead("posteam").over(w) == F.col("posteam"), margin).otherwise(-margin),
        }
    )


def binned_means(df: DataFrame, x: str, y: str, width: int, n_bins: int, least: int) -> DataFrame:
    """``bin`` 0 .. n_bins - 1, its ``n`` rows, ``value``: the mean of ``y`` in the nearest bin that holds ``least`` rows.

    Of two bins equally near the lower counts. Where no bin has enough rows, the value is the mean of all; without rows
    it is null. Rows outside the bins, or with a null, aren't counted.
    """
    sound = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.floor(F.col(x) / width).cast("int").alias("bin"), F.col(y).cast("double").alias("y"))
    sums = sound.where((F.col("bin") >= 0) & (F.col("bin") < n_bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    every = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(sums), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # the bins are few and fixed, so one window over them all is small whatever the rows
    up, down = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    kept = F.when(F.col("n") >= least, F.struct("bin", (F.col("s") / F.col("n")).alias("mean")))
    near = every.withColumns({"lower": F.last(kept, True).over(up), "upper": F.first(kept, True).over(down), "overall": F.sum("s").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())})
    is_lower = F.col("upper").isNull() | (F.col("bin") - F.col("lower.bin") <= F.col("upper.bin") - F.col("bin"))
    return near.select("bin", "n", F.coalesce(F.when(is_lower, F.col("lower.mean")).otherwise(F.col("upper.mean")), F.col("upper.mean"), "overall").alias("value"))


def _state(yard: Column, margin: Column, togo: Column, seconds: int) -> list[Column]:
    clock = F.greatest(F.col("game_seconds_remaining") - seconds, F.lit(0.0))
    return [F.lit(1).cast("double").alias("down"), togo.cast("double").alias("ydstogo"), yard.cast("double").alias("yardline_100"), clock.alias("game_seconds_remaining"), margin.cast("double").alias("score_differential"), F.col("qtr").cast("double").alias("qtr")]


def _own(yard: Column, margin: Column) -> list[Column]:
    return _state(yard, margin, F.least(F.lit(10), yard), 6)


def option_values(states: DataFrame, key: str, value: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``key``, ``go``, ``kick``, ``punt`` (chances to win), ``best`` and ``edge`` over the second best.

    ``states``: one row a key with down, ydstogo, yardline_100, game_seconds_remaining, score_differential, qtr, and
    ``p_convert``, ``p_kick`` and ``landing`` (where the other side starts after a punt). ``value`` adds ``p``, the
    chance to win of the side that has the ball. The five hypothetical states of every row are scored in one
    pass; those in which the other side has the ball count as one minus its chance. A tie goes to going
    for it, then to the kick.
    """
    y, margin = F.col("yardline_100"), F.col("score_differential")
    mirrored = F.least(F.greatest(100 - y, F.lit(1)), F.lit(99))
    outcomes = [
        ("go", F.col("p_convert"), False, _own(F.greatest(y - F.col("ydstogo"), F.lit(1)), margin)),
        ("go", 1 - F.col("p_convert"), True, _own(mirrored, -margin)),
        ("kick", F.col("p_kick"), True, _own(F.lit(AFTER_KICK), -(margin + 3))),
        ("kick", 1 - F.col("p_kick"), True, _own(F.least(F.greatest(100 - (y + KICK_SPOT), F.lit(1)), F.lit(MISS_DEEPEST)), -margin)),
        ("punt", F.lit(1.0), True, _own(F.col("landing"), -margin)),
    ]
    rows = F.array(*[F.struct(F.lit(o).alias("option"), w.cast("double").alias("weight"), F.lit(other).alias("other_side"), *state) for o, w, other, state in outcomes])
    scored = value(states.select(key, F.explode(rows).alias("_s")).select(key, "_s.*"))
    worth = F.col("weight") * F.when(F.col("other_side"), 1 - F.col("p")).otherwise(F.col("p"))
    by = scored.groupBy(key).agg(*[F.sum(F.when(F.col("option") == o, worth)).alias(o) for o in OPTIONS])
    ranked = F.array_sort(F.array(*[F.struct((-F.col(o)).alias("v"), F.lit(i).alias("i"), F.lit(o).alias("option")) for i, o in enumerate(OPTIONS)]))
    return by.withColumn("_r", ranked).select(key, *OPTIONS, F.col("_r")[0]["option"].alias("best"), (F.col("_r")[1]["v"] - F.col("_r")[0]["v"]).alias("edge"))


def audit(valued: DataFrame, chosen: Column) -> DataFrame:
    """One row a chosen option: decisions, share that agrees with the best, share in which going was best, mean chance given away."""
    taken = F.when(chosen == "go", F.col("go")).when(chosen == "kick", F.col("kick")).otherwise(F.col("punt"))
    return valued.groupBy(chosen.alias("chosen")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("best") == chosen).cast("double")).alias("agreement"),
        F.avg((F.col("best") == "go").cast("double")).alias("go_rate"),
        F.avg(F.greatest("go", "kick", "punt") - taken).alias("mean_regret"),
    )
