"""The star schema, the contract and the checks on small fixtures of our own."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hashmark.operators import contract, plays, quality, star

FACT = (
    "game_key string, game_id string, play_id int, season int, posteam string, defteam string, fixed_drive int, fixed_drive_result string, qtr int, down int, yardline_100 int, "
    "game_seconds_remaining double, yards_gained int, epa double, play_type string, is_designed_play boolean, is_pass_call boolean, is_neutral_script boolean, passer_player_id string, "
    "rusher_player_id string, receiver_player_id string, pass_touchdown boolean, rush_touchdown boolean, touchdown boolean, sack boolean, complete_pass boolean, two_point_attempt boolean, first_down boolean"
)
GAME = "game_key string, season int, season_type string, week int, playoff_round string, home_team string, away_team string, home_score int, away_score int"


def play(play_id, **known):
    given = dict(game_key="g", game_id="g", season=2021, posteam="AAA", defteam="BBB", qtr=1, yards_gained=5, epa=0.5, is_designed_play=True, is_pass_call=True, is_neutral_script=True, play_id=play_id)
    names = [x.split()[0] for x in FACT.split(", ")]
    return tuple((given | known).get(n) for n in names)


def game_of(spark, **known):
    given = dict(game_key="g", season=2021, season_type="POST", week=19, playoff_round="wild_card", home_team="AAA", away_team="BBB", home_score=20, away_score=19) | known
    return spark.createDataFrame([tuple(given[x.split()[0]] for x in GAME.split(", "))], GAME)


def test_drives_keep_the_named_clock_and_add_the_last(spark):
    rows = [play(7, fixed_drive=1, fixed_drive_result="Touchdown", game_seconds_remaining=900.0, yardline_100=None, first_down=True), play(9, fixed_drive=1, fixed_drive_result="Touchdown", game_seconds_remaining=840.0, yardline_100=30),
            play(11, fixed_drive=2, fixed_drive_result="Opp touchdown", game_seconds_remaining=None), play(12, fixed_drive=None), play(13, fixed_drive=3, posteam=None)]
    got = {r.drive_number: r for r in star.drive_table(spark.createDataFrame(rows, FACT), game_of(spark)).collect()}
    assert set(got) == {1, 2}
    one = got[1]
    assert (one.end_game_seconds_remaining, one.last_game_seconds_remaining, one.start_yardline_100, one.end_yardline_100) == (900.0, 840.0, 30, 30)
    assert (one.plays, one.yards_gained, one.first_downs, one.scored_touchdown, got[2].scored_touchdown, got[2].last_game_seconds_remaining) == (2, 10, 1, True, False, None)


def test_players_of_a_game(spark):
    """A sack is a play without yards, a two-point try none; an interception run back is no touchdown of the passer."""
    rows = [play(1, passer_player_id="p-1", receiver_player_id="r_1", complete_pass=True, pass_touchdown=True, touchdown=True, yards_gained=30), play(2, passer_player_id="P_1", sack=True, yards_gained=-7),
            play(3, passer_player_id="p_1", touchdown=True, yards_gained=0), play(4, passer_player_id="p_1", two_point_attempt=True, pass_touchdown=True), play(5, rusher_player_id="NA"), play(6, rusher_player_id="q_1", rush_touchdown=True)]
    names = spark.createDataFrame([("P_1", "Ann Example")], "player_id string, full_name string")
    got = {(r.role, r.player_id): r for r in star.player_game_table(spark.createDataFrame(rows, FACT), game_of(spark), names).collect()}
    assert set(got) == {("passer", "P_1"), ("receiver", "R_1"), ("rusher", "Q_1")}
    p = got["passer", "P_1"]
    assert (p.plays, p.yards, p.touchdowns, p.completions, p.full_name) == (3, 30, 1, 1, "Ann Example")
    assert got["rusher", "Q_1"].touchdowns == 1 and got["rusher", "Q_1"].completions is None


def test_teams_of_a_game(spark):
    rows = [play(1, epa=1.0), play(2, epa=-1.0, is_pass_call=False, down=3), play(3, is_designed_play=None, epa=9.0), play(4, posteam=None), play(5, down=4, is_neutral_script=None, epa=0.0, touchdown=True)]
    r = star.team_game_table(spark.createDataFrame(rows, FACT), game_of(spark)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.plays, r.designed_plays, r.epa_per_play, r.pass_epa_per_play, r.rush_epa_per_play, r.third_down_attempts, r.fourth_down_attempts, r.touchdowns, r.is_home) == (4, 3, 0.0, 0.5, -1.0, 1, 1, 1, True)
    assert r.pass_rate == pytest.approx(2 / 3) and r.neutral_pass_rate == 0.5 and r.success_rate == pytest.approx(1 / 3)


def test_rounds_and_seasons(spark):
    stg = spark.createDataFrame(
        [("a", 2020, "POST", 18, "AAA"), ("b", 2021, "POST", 22, "AAA"), ("c", 2021, "REG", 18, "BBB"), ("d", 2021, "POST", 30, "BBB"), ("e", None, "POST", 18, None), ("c", 2021, "REG", 18, "CCC")],
        "game_key string, season int, season_type string, week int, posteam string",
    ).withColumn("game_date", F.lit(dt.date(2021, 1, 1)))
    assert {r.game_key: r.playoff_round for r in star.games(stg).collect()} == {"a": "wild_card", "b": "super_bowl", "c": None, "d": None, "e": None}
    got = {r.season: r for r in star.seasons(stg).collect()}
    assert (got[2021].regular_season_weeks, got[2021].last_regular_season_week, got[2021].regular_season_games, got[2021].postseason_games, got[2021].teams, got[2021].plays) == (18, 18, 1, 2, 3, 4)
    assert got[2020].regular_season_weeks == 17


def test_documents_leave_out_what_is_unknown(spark):
    players = spark.createDataFrame([("g", "passer", "P_2", "Bo Longname", 100), ("g", "passer", "P_1", None, 100), ("h", "rusher", "P_9", "Nobody", 3)], "game_key string, role string, player_id string, full_name string, yards int")
    body = star.game_documents(game_of(spark), players).first().body
    assert body == "BBB played at AAA in the wild card round of 2021. AAA beat BBB 20 to 19, by 1 point. Most yards as passer: P_1, 100."
    tie = star.game_documents(game_of(spark, home_score=7, away_score=7, playoff_round=None, week=3), players.where("false")).first()
    assert tie.body == "BBB played at AAA in the week 3 of 2021. They tied at 7 each." and tie.teams == ["AAA", "BBB"]
    drives = star.drive_table(spark.createDataFrame([play(1, fixed_drive=4, yardline_100=20)], FACT), game_of(spark))
    assert star.drive_documents(drives).first().body == "AAA started 20 yards from the goal in quarter 1 and gained 5 yards in 1 play."
    assert star.drive_documents(drives.withColumn("season_type", F.lit("REG"))).count() == 0


def test_derived_outcomes(spark):
    """Who won, what was a designed play, whether it was called a pass; unknown flags don't exclude a play, an unknown down does."""
    cols = "result int, posteam string, home_team string, pass_play boolean, rush_play boolean, down int, qb_kneel boolean, qb_spike boolean, aborted_play boolean, play_deleted boolean, special_teams boolean"
    rows = [(4, "AAA", "AAA", True, False, 2, None, None, None, None, None), (-4, "AAA", "AAA", False, True, 1, False, False, False, False, False), (0, "AAA", "AAA", True, False, None, None, None, None, None, None),
            (None, "BBB", "AAA", False, True, 3, True, None, None, None, None), (3, "BBB", "AAA", False, False, 4, None, None, None, None, True), (3, None, "AAA", None, None, 1, None, None, None, None, None), (3, "AAA", "AAA", True, None, 1, None, None, None, True, None)]
    got = plays.with_outcomes(spark.createDataFrame(rows, cols)).collect()
    assert [r.posteam_won for r in got] == [True, False, None, None, False, None, True]
    assert [r.is_designed_play for r in got] == [True, True, False, False, False, None, False]
    assert [r.is_pass_call for r in got] == [True, False, None, None, None, None, None]


def test_failures_name_examples(spark):
    df = spark.createDataFrame([(7, "2020_01_AAA_BB", "pass"), (0, "x", "PASS"), (5, "x", None), (6, None, "Run"), (9, "y", "zz"), (9, "z", "zz")], "qtr int, game_id string, play_type string")
    got = {(r.check_name, r.column_name): (r.n_failed, list(r.examples), r.n_rows) for r in quality.failures(df, contract.checks(df.columns)).collect()}
    assert got == {
        ("not_null", "game_id"): (1, [], 6), ("not_null", "qtr"): (0, [], 6), ("in_range", "qtr"): (4, ["0", "7", "9"], 6), ("accepted_values", "play_type"): (4, ["PASS", "Run", "zz"], 6), ("matches", "game_id"): (4, ["x", "y", "z"], 6),
    }
    assert {r.n_failed for r in quality.failures(df.where("false"), contract.checks(df.columns)).collect()} == {0}


def test_freshness(spark):
    games = [("a", 2023, 1, "2023-09-10", 3), ("b", 2023, 2, "2023-09-17", 4), ("c", 2023, 3, "2023-09-24", None), ("d", 2022, 1, "2022-09-10", None)]
    df = spark.createDataFrame(games, "game_id string, season int, week int, game_date string, home_margin int")
    held = spark.createDataFrame([("a",), (None,)], "game_id string")
    at = lambda day: {r.week: r.stale for r in quality.freshness(df, held, F.to_date(F.lit(day))).collect()}
    assert at("2023-09-25") == {1: None, 2: "not ingested", 3: None}
    assert at("2023-09-26") == {1: None, 2: "not ingested", 3: "source is behind"}
    assert at("2023-12-01") == {1: None, 2: None, 3: None} and at("2030-01-01") == {}
    days = spark.createDataFrame([("2024-02-29",), ("2024-03-01",)], "d string").select(quality.current_season(F.to_date("d")).alias("s")).collect()
    assert [r.s for r in days] == [2023, 2024]
