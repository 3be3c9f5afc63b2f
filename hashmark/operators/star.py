"""The star schema built from plays: seasons, games, players, facts, and the views people ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashmark.functions.compat import is_true, max_by_known, min_by_known, ratio
from hashmark.functions.ids import game_key, player_key, team_aliases
from hashmark.operators.drift import label
from hashmark.operators.plays import latest_plays

#: What every play of a game repeats, so that it is stored with the game.
GAME_FIELDS = [
    "season_type", "week", "game_date", "home_team", "away_team", "home_score", "away_score", "home_margin", "total_points", "spread_line",
    "total_line", "div_game", "roof", "surface", "temp", "wind", "stadium", "home_coach", "away_coach",
]
#: The regular season has 17 weeks, and 18 from 2021 on; rounds by their distance from its last week.
WEEKS, WEEKS_FROM_2021 = 17, 18
ROUNDS = ["wild_card", "divisional", "conference", "super_bowl"]
ROLES = ["passer", "rusher", "receiver"]


def staged(plays: DataFrame, dim_game: DataFrame, dim_team: DataFrame) -> DataFrame:
    """The wide plays: one row a play (the one loaded last) with ``game_key`` and what is known last of its game.

    Games are found by the id rule. Plays of games that aren't known are left out, as they belong to no season's schedule.
    """
    aliases = team_aliases(dim_team)
    rest = [c for c in GAME_FIELDS if c in dim_game.columns]
    known = dim_game.select(game_key(F.col("game_id"), aliases).alias("game_key"), F.struct("loaded_at", *rest).alias("_row")).where("game_key IS NOT NULL")
    games = known.groupBy("game_key").agg(F.max("_row").alias("_row")).select("game_key", *[F.col(f"_row.{c}").alias(c) for c in rest])
    return latest_plays(plays).withColumn("game_key", game_key(F.col("game_id"), aliases)).join(games, "game_key")


def _weeks(season: Column) -> Column:
    return F.when(season >= 2021, WEEKS_FROM_2021).otherwise(WEEKS)


def seasons(stg: DataFrame) -> DataFrame:
    """One row a season: its weeks by rule and by its games, games, teams, dates, plays."""
    of = lambda kind, c: F.when(F.col("season_type") == kind, F.col(c))
    return stg.groupBy("season").agg(
        _weeks(F.col("season")).alias("regular_season_weeks"),
        F.countDistinct(of("REG", "game_key")).alias("regular_season_games"),
        F.countDistinct(of("POST", "game_key")).alias("postseason_games"),
        F.countDistinct("posteam").alias("teams"),
        F.max(of("REG", "week")).alias("last_regular_season_week"),
        F.min("game_date").alias("first_game_date"),
        F.max("game_date").alias("last_game_date"),
        F.count(F.lit(1)).alias("plays"),
    )


def games(stg: DataFrame) -> DataFrame:
    """One row a game, from its plays: what they all repeat (the greatest, where they don't), and the playoff round."""
    each = stg.groupBy("game_key").agg(*[F.max(c).alias(c) for c in ["season", *(c for c in GAME_FIELDS if c in stg.columns)]])
    away = F.col("week") - _weeks(F.col("season"))
    playoff = F.coalesce(*[F.when(away == i + 1, r) for i, r in enumerate(ROUNDS)])
    return each.withColumn("playoff_round", F.when((F.col("season_type") == "POST") & F.col("season").isNotNull(), playoff))


def facts(stg: DataFrame) -> DataFrame:
    """The plays without what is stored with their games."""
    return stg.drop(*GAME_FIELDS)


def wide_plays(fact: DataFrame, game: DataFrame, columns: list[str]) -> DataFrame:
    """Plays and games put together again, in the agreed order of columns."""
    return fact.join(game.drop("season", "playoff_round"), "game_key").select(*columns)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``side``, ``n``: rows, repeats counted, that only one of the two holds."""
    count = lambda x, side: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.exceptAll(b), "lost").unionByName(count(b.exceptAll(a), "added"))


def game_list(fact: DataFrame, game: DataFrame) -> DataFrame:
    """Games with the number of their plays."""
    return game.join(fact.groupBy("game_key").agg(F.count(F.lit(1)).alias("plays")), "game_key")


def _sum_flag(df: DataFrame, c: str, name: str) -> list[Column]:
    return [F.sum(F.col(c).cast("int")).alias(name)] if c in df.columns else []


def drive_table(fact: DataFrame, game: DataFrame) -> DataFrame:
    """One row a drive. ``end_game_seconds_remaining`` keeps the meaning it has had (the clock at the drive's first play);
    ``last_game_seconds_remaining`` is the clock at its last. Result and first downs are there if the plays have them."""
    at, clock = F.col("play_id"), F.col("game_seconds_remaining")
    held = fact.where("fixed_drive IS NOT NULL AND posteam IS NOT NULL").withColumn("drive_id", F.concat("game_key", F.lit("-"), F.col("fixed_drive").cast("string")))
    result = [F.max("fixed_drive_result").alias("drive_result"), (F.coalesce(F.max("fixed_drive_result"), F.lit("")) == "Touchdown").alias("scored_touchdown")] if "fixed_drive_result" in fact.columns else []
    each = held.groupBy("drive_id").agg(
        F.max("game_key").alias("game_key"),
        *[F.max(c).alias(c) for c in ("season", "posteam", "defteam")],
        F.max("fixed_drive").alias("drive_number"),
        F.min("qtr").alias("start_quarter"),
        min_by_known(F.col("yardline_100"), at).alias("start_yardline_100"),
        max_by_known(F.col("yardline_100"), at).alias("end_yardline_100"),
        min_by_known(clock, at).alias("end_game_seconds_remaining"),
        max_by_known(clock, at).alias("last_game_seconds_remaining"),
        F.count(F.lit(1)).alias("plays"),
        F.count_if("is_designed_play").alias("designed_plays"),
        F.sum("yards_gained").alias("yards_gained"),
        F.sum("epa").alias("epa"),
        F.avg("epa").alias("epa_per_play"),
        *_sum_flag(fact, "first_down", "first_downs"),
        *result,
    )
    return each.join(game.select("game_key", "season_type", "week"), "game_key")


def team_game_table(fact: DataFrame, game: DataFrame) -> DataFrame:
    """One row a game and team, from its side of the ball. What the plays hold no flag for isn't there."""
    designed, pass_ = is_true(F.col("is_designed_play")), is_true(F.col("is_pass_call"))
    neutral = is_true(F.col("is_neutral_script"))
    called, success = F.col("is_pass_call").cast("double"), (F.col("epa") > 0).cast("double")
    counted = {"touchdown": "touchdowns", "interception": "interceptions", "fumble_lost": "fumbles_lost", "third_down_converted": "third_down_conversions", "fourth_down_converted": "fourth_down_conversions"}
    each = fact.where("posteam IS NOT NULL").groupBy("game_key", F.col("posteam").alias("team")).agg(
        F.max("defteam").alias("opponent"),
        F.max("season").alias("season"),
        F.count(F.lit(1)).alias("plays"),
        F.count_if(designed).alias("designed_plays"),
        F.avg(F.when(designed, called)).alias("pass_rate"),
        F.avg(F.when(designed & neutral, called)).alias("neutral_pass_rate"),
        F.avg(F.when(designed, F.col("epa"))).alias("epa_per_play"),
        F.avg(F.when(designed & pass_, F.col("epa"))).alias("pass_epa_per_play"),
        F.avg(F.when(designed & ~pass_, F.col("epa"))).alias("rush_epa_per_play"),
        F.avg(F.when(designed, success)).alias("success_rate"),
        F.sum(F.when(designed, F.col("yards_gained"))).alias("yards_gained"),
        F.count_if(designed & (F.col("down") == 3)).alias("third_down_attempts"),
        F.count_if(designed & (F.col("down") == 4)).alias("fourth_down_attempts"),
        *[x for c, name in counted.items() for x in _sum_flag(fact, c, name)],
    )
    of_game = game.select("game_key", "season_type", "week", "playoff_round", "home_team")
    return each.join(of_game, "game_key").withColumn("is_home", F.col("team") == F.col("home_team")).drop("home_team")


def player_game_table(fact: DataFrame, game: DataFrame, players: DataFrame) -> DataFrame:
    """One row a game, player and role. Two-point tries aren't plays, sacks are plays without yards, a touchdown counts for the role
    that scored it; these rules, and completions, hold where the plays have the flags. Ids count by the id rule."""
    has = lambda c: c in fact.columns
    flag = lambda c: is_true(F.col(c)) if has(c) else F.lit(False)
    played = fact.where(~flag("two_point_attempt"))

    def of(role: str) -> DataFrame:
        yards = F.when(~flag("sack"), F.col("yards_gained")) if role == "passer" else F.col("yards_gained")
        scored = "rush_touchdown" if role == "rusher" else "pass_touchdown"
        caught = F.lit(None).cast("int") if role == "rusher" or not has("complete_pass") else flag("complete_pass").cast("int")
        return played.select(
            "game_key", "season", F.col("posteam").alias("team"), F.lit(role).alias("role"), player_key(F.col(f"{role}_player_id")).alias("player_id"), yards.alias("yards"),
            (flag(scored).cast("int") if has(scored) else F.lit(None).cast("int")).alias("scored"), caught.alias("caught"), "epa",
        ).where("player_id IS NOT NULL")

    stacked = of("passer").unionByName(of("rusher")).unionByName(of("receiver"))
    optional = [F.sum(c).alias(name) for c, name, when in (("scored", "touchdowns", has("pass_touchdown")), ("caught", "completions", has("complete_pass"))) if when]
    each = stacked.groupBy("game_key", "season", "team", "role", "player_id").agg(F.count(F.lit(1)).alias("plays"), F.coalesce(F.sum("yards"), F.lit(0)).alias("yards"), F.avg("epa").alias("epa_per_play"), *optional)
    of_game = game.select("game_key", "season_type", "week", "playoff_round")
    return each.join(of_game, "game_key").join(players.select("player_id", "full_name"), "player_id", "left")


def player_table(plays: DataFrame, dim_player: DataFrame) -> DataFrame:
    """Everyone known or credited: names and position as known last, short name used most (the first, if tied), plays credited."""
    roster = dim_player.select(player_key(F.col("player_id")).alias("player_id"), "loaded_at", "full_name", "player_position", "short_name").where("player_id IS NOT NULL")
    last = roster.groupBy("player_id").agg(F.max(F.struct("loaded_at", "full_name", "player_position")).alias("_row")).select("player_id", "_row.full_name", "_row.player_position")
    uses = roster.where("short_name IS NOT NULL").groupBy("player_id", "short_name").agg(F.count(F.lit(1)).alias("n"))
    short = uses.groupBy("player_id").agg(F.min_by("short_name", F.struct(-F.col("n"), "short_name")).alias("short_name"))
    ids = F.explode(F.array(*[player_key(F.col(f"{r}_player_id")) for r in ROLES]))
    credited = plays.select(ids.alias("player_id")).where("player_id IS NOT NULL").groupBy("player_id").agg(F.count(F.lit(1)).alias("credited_plays"))
    joined = last.join(short, "player_id", "left").join(credited, "player_id", "full_outer")
    return joined.select("player_id", "full_name", "player_position", "short_name", F.coalesce("credited_plays", F.lit(0)).alias("credited_plays"))


def tendency_table(fact: DataFrame) -> DataFrame:
    """One row a team and season: tendencies of designed plays, the neutral ones apart, and fourth downs gone for."""
    designed, neutral = is_true(F.col("is_designed_play")), is_true(F.col("is_neutral_script"))
    called = F.col("is_pass_call").cast("double")
    early = neutral & F.col("down").isin(1, 2)
    keys = [F.col("posteam").alias("team"), F.col("season")]
    held = fact.where(F.col("posteam").isNotNull() & F.col("season").isNotNull())
    overall = held.where(designed).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("designed_plays"),
        F.avg(called).alias("pass_rate"),
        F.avg("epa").alias("epa_per_play"),
        F.avg((F.col("epa") > 0).cast("double")).alias("success_rate"),
        *([F.avg("pass_oe").alias("pass_rate_over_expected")] if "pass_oe" in fact.columns else []),
        F.count_if(neutral).alias("neutral_plays"),
        F.avg(F.when(neutral, called)).alias("neutral_pass_rate"),
        F.avg(F.when(early, called)).alias("neutral_early_down_pass_rate"),
        F.avg(F.when(neutral, F.col("epa"))).alias("neutral_epa_per_play"),
    )
    kicks = label(F.col("play_type")).isin("punt", "field_goal")
    fourth = held.where("down = 4").groupBy(*keys).agg(F.count_if(designed).alias("fourth_down_go_attempts"), F.count_if(designed | is_true(kicks)).alias("decisions"))
    return overall.join(fourth, ["team", "season"], "left").withColumn("fourth_down_go_rate", ratio(F.col("fourth_down_go_attempts"), F.col("decisions"))).drop("decisions")


def leaders(player_games: DataFrame, role: str) -> DataFrame:
    """Each game's player with most yards in a role (ties: the least id)."""
    first = Window.partitionBy("game_key").orderBy(F.desc("yards"), "player_id")
    one = player_games.where(F.col("role") == role).withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return one.select("game_key", F.coalesce("full_name", "player_id").alias(f"{role}"), F.col("yards").alias(f"{role}_yards"))


def game_documents(game: DataFrame, player_games: DataFrame) -> DataFrame:
    """``doc_id``, ``grain``, ``game_id``, ``season``, ``week``, ``teams``, ``title``, ``body``: a game told in sentences; what isn't known is left out."""
    s = lambda c: F.col(c).cast("string")
    margin = F.abs(F.col("home_score") - F.col("away_score"))
    points = F.when(margin == 1, F.lit("1 point")).otherwise(F.concat(margin.cast("string"), F.lit(" points")))
    home_won = F.col("home_score") > F.col("away_score")
    winner, loser = F.when(home_won, F.col("home_team")).otherwise(F.col("away_team")), F.when(home_won, F.col("away_team")).otherwise(F.col("home_team"))
    high, low = F.greatest("home_score", "away_score").cast("string"), F.least("home_score", "away_score").cast("string")
    told = game
    for role in ROLES:
        told = told.join(leaders(player_games, role), "game_key", "left")
    stage = F.when(F.col("playoff_round").isNotNull(), F.concat(F.replace("playoff_round", F.lit("_"), F.lit(" ")), F.lit(" round"))).otherwise(F.concat(F.lit("week "), s("week")))
    outcome = F.when(margin == 0, F.concat(F.lit("They tied at "), high, F.lit(" each."))).otherwise(F.concat(winner, F.lit(" beat "), loser, F.lit(" "), high, F.lit(" to "), low, F.lit(", by "), points, F.lit(".")))
    opening = F.concat(F.col("away_team"), F.lit(" played at "), F.col("home_team"), F.lit(" in the "), stage, F.lit(" of "), s("season"), F.lit("."))
    best = [F.concat(F.lit(f"Most yards as {role}: "), F.col(role), F.lit(", "), s(f"{role}_yards"), F.lit(".")) for role in ROLES]
    return told.select(
        F.concat(F.lit("game:"), "game_key").alias("doc_id"), F.lit("game").alias("grain"), F.col("game_key").alias("game_id"), "season", "week", F.array_sort(F.array("home_team", "away_team")).alias("teams"),
        F.concat_ws(" ", F.col("away_team"), F.lit("at"), F.col("home_team"), s("season")).alias("title"), F.concat_ws(" ", opening, outcome, *best).alias("body"),
    )


def drive_documents(drive: DataFrame, postseason_only: bool = True) -> DataFrame:
    """The same for drives, of the postseason only unless told otherwise."""
    s = lambda c: F.col(c).cast("string")
    kept = drive.where("season_type = 'POST'") if postseason_only else drive
    body = F.concat(
        F.col("posteam"), F.lit(" started "), F.coalesce(s("start_yardline_100"), F.lit("some")), F.lit(" yards from the goal in quarter "), s("start_quarter"), F.lit(" and gained "),
        F.coalesce(s("yards_gained"), F.lit("no")), F.lit(" yards in "), s("plays"), F.when(F.col("plays") == 1, " play.").otherwise(" plays."),
    )
    return kept.select(
        F.concat(F.lit("drive:"), "drive_id").alias("doc_id"), F.lit("drive").alias("grain"), F.col("game_key").alias("game_id"), "season", "week", F.array_sort(F.array("posteam", "defteam")).alias("teams"),
        F.concat_ws(" ", F.lit("Drive"), s("drive_number"), F.lit("of"), F.col("posteam")).alias("title"), body.alias("body"),
    )
