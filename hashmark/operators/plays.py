"""Row-local labels of plays, and the tables built from them: games, drives, team-games, players, seasons, tendencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashmark.functions.compat import bucket, is_true, max_by_known, min_by_known, ratio
from hashmark.operators.drift import label

#: Bounds of the situational labels, inclusive.
DISTANCE = [(2, "short"), (6, "medium"), (10, "long")]
ZONE = [(20, "red_zone"), (40, "opponent_territory"), (60, "midfield"), (80, "own_territory")]
SCORE = [(-17, "trailing_big"), (-9, "trailing_two_scores"), (-1, "trailing_one_score"), (0, "tied"), (8, "leading_one_score"), (16, "leading_two_scores")]


def with_labels(plays: DataFrame) -> DataFrame:
    """Distance, field zone, score state, situation flags and drive key of each play; null where a label has no meaning."""
    clock = F.col("game_seconds_remaining")
    half = F.col("half_seconds_remaining") if "half_seconds_remaining" in plays.columns else F.when(clock > 1800, clock - 1800).otherwise(clock)
    return plays.withColumns(
        {
            "distance": F.when(F.col("down").isNotNull(), bucket(F.col("ydstogo"), DISTANCE, "very_long")),
            "zone": bucket(F.col("yardline_100"), ZONE, "backed_up"),
            "score_state": bucket(F.col("score_differential"), SCORE, "leading_big"),
            "early_down": F.col("down").isin(1, 2),
            "two_minute": half <= 120,
            "is_home": (F.col("posteam") == F.col("home_team")) if {"posteam", "home_team"} <= set(plays.columns) else F.lit(None).cast("boolean"),
            "neutral": is_true(F.col("wp").between(0.2, 0.8) & (F.col("qtr") <= 3) & (half > 120)),
            "garbage": is_true(~F.col("wp").between(0.05, 0.95) & (F.col("qtr") >= 4)),
            "drive_key": F.concat("game_id", F.lit("-"), F.col("fixed_drive").cast("string")),
            "kind": label(F.col("play_type")),
        }
    )


def with_outcomes(plays: DataFrame) -> DataFrame:
    """``posteam_won``, ``is_designed_play`` and ``is_pass_call`` from what was delivered.

    ``result`` is the home side's margin: a tie, an unknown margin or an unknown team has no winner. A play is designed if it is
    a run or a pass on a known down and none of the flags that exclude it is set; an unknown flag isn't set. A pass
    is called only where a play is designed.
    """
    won = F.when(F.col("result") != 0, (F.col("result") > 0) == (F.col("posteam") == F.col("home_team")))
    excluded = [F.coalesce(F.col(c), F.lit(False)) for c in ("qb_kneel", "qb_spike", "aborted_play", "play_deleted", "special_teams")]
    designed = (F.col("pass_play") | F.col("rush_play")) & F.col("down").isNotNull()
    for flag in excluded:
        designed = designed & ~flag
    out = plays.withColumns({"posteam_won": won, "is_designed_play": designed})
    return out.withColumn("is_pass_call", F.when(F.col("is_designed_play"), F.col("pass_play")))


def latest_plays(plays: DataFrame) -> DataFrame:
    """One row a play_key, the one loaded last (ties: the greatest row), so that a redelivery replaces what it repeats."""
    rest = [c for c in plays.columns if c not in ("play_key", "loaded_at")]
    newest = plays.groupBy("play_key").agg(F.max(F.struct("loaded_at", *rest)).alias("_row"))
    return newest.select(*[F.col("play_key") if c == "play_key" else F.col(f"_row.{c}").alias(c) for c in plays.columns])


def drives(plays: DataFrame) -> DataFrame:
    """One row a drive: plays, yards, first and last clock and score, points gained."""
    at = F.col("play_id")
    return (
        plays.where(F.col("fixed_drive").isNotNull())
        .groupBy("game_id", "fixed_drive")
        .agg(
            F.count(F.lit(1)).alias("n_plays"),
            F.sum("yards_gained").alias("yards"),
            min_by_known(F.col("game_seconds_remaining"), at).alias("start_clock"),
            max_by_known(F.col("game_seconds_remaining"), at).alias("end_clock"),
            min_by_known(F.col("yardline_100"), at).alias("start_yardline"),
            F.max("qtr").alias("last_qtr"),
            F.count_if(F.col("is_pass_call")).alias("n_passes"),
        )
    )


def team_games(plays: DataFrame) -> DataFrame:
    """One row a game and team in possession: volume, efficiency, pass rate, fourth downs."""
    designed = is_true(F.col("is_designed_play"))
    return (
        plays.where("posteam IS NOT NULL")
        .groupBy("game_id", "posteam")
        .agg(
            F.count(F.lit(1)).alias("n_plays"),
            F.count_if(designed).alias("n_designed"),
            F.avg(F.when(designed, F.col("epa"))).alias("epa_per_play"),
            F.avg(F.when(designed, (F.col("epa") > 0).cast("double"))).alias("success_rate"),
            ratio(F.count_if(designed & F.col("is_pass_call")), F.count_if(designed)).alias("pass_rate"),
            F.sum(F.when(F.col("down") == 4, 1).otherwise(0)).alias("n_fourth"),
        )
    )


def tendencies(plays: DataFrame) -> DataFrame:
    """One row a team and season: overall and neutral tendencies, neutral ones null where no neutral play is."""
    designed = plays.where(is_true(F.col("is_designed_play")) & F.col("posteam").isNotNull() & F.col("season").isNotNull())
    keys = ["posteam", "season"]
    overall = designed.groupBy(*keys).agg(F.count(F.lit(1)).alias("designed_plays"), F.avg(F.col("is_pass_call").cast("double")).alias("pass_rate"), F.avg("epa").alias("epa_per_play"))
    neutral = designed.where(is_true(F.col("is_neutral_script"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("neutral_plays"), F.avg(F.col("is_pass_call").cast("double")).alias("neutral_pass_rate"))
    fourth = plays.where((F.col("down") == 4) & F.col("posteam").isNotNull() & F.col("season").isNotNull()).groupBy(*keys).agg(
        ratio(F.count_if(is_true(F.col("is_designed_play"))), F.count(F.lit(1))).alias("go_rate")
    )
    return overall.join(neutral, keys, "left").join(fourth, keys, "left")


def player_games(plays: DataFrame) -> DataFrame:
    """One row a game, player and role: the three roles stacked."""

    def of(role: str, yards) -> DataFrame:
        return plays.where(F.col(f"{role}_player_id").isNotNull()).select("game_id", F.col(f"{role}_player_id").alias("player_id"), F.lit(role).alias("role"), F.col("epa"), yards.alias("yards"))

    stacked = of("passer", F.col("yards_gained")).unionByName(of("rusher", F.col("yards_gained"))).unionByName(of("receiver", F.col("yards_gained")))
    return stacked.groupBy("game_id", "player_id", "role").agg(F.count(F.lit(1)).alias("n_plays"), F.sum("yards").alias("yards"), F.sum("epa").alias("epa"))


def credited_players(plays: DataFrame, dim_player: DataFrame) -> DataFrame:
    """Every player id seen in a play or known to the dimension: credited plays, position, commonest season."""
    roles = [plays.select(F.col(f"{r}_player_id").alias("player_id"), "season") for r in ("passer", "rusher", "receiver")]
    seen = roles[0].unionByName(roles[1]).unionByName(roles[2]).where("player_id IS NOT NULL")
    by_season = seen.groupBy("player_id", "season").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("player_id").orderBy(F.desc("n"), F.col("season").asc_nulls_last())
    mode = by_season.withColumn("total", F.sum("n").over(Window.partitionBy("player_id"))).withColumn("r", F.row_number().over(first)).where("r = 1")
    known = dim_player.groupBy("player_id").agg(F.max("player_position").alias("player_position"))
    counted = mode.select("player_id", F.col("total").alias("credited_plays"), F.col("season").alias("main_season"))
    return counted.join(known, "player_id", "full_outer").select("player_id", F.coalesce("credited_plays", F.lit(0)).alias("credited_plays"), "main_season", "player_position")
