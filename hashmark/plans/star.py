"""Queries of the star schema: its tables, their documents, its incremental build, the declared contract and the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashmark.operators import contract, quality, star
from hashmark.plans.data_care import ALIASES_CTE, game_sql, player_sql
from hashmark.plans.registry import Registry
from hashmark.plans.warehouse import LATEST
from hashmark.session import Kept
from hashmark.sources import store
from hashmark.sources.tables import table, tables

registry = Registry()
q = registry.query

_FIELDS = ", ".join(star.GAME_FIELDS)
_STAGED = f"""{LATEST}, {ALIASES_CTE},
known AS (SELECT * FROM (SELECT {game_sql('game_id')} AS game_key, loaded_at, {_FIELDS} FROM dim_game, aliases) WHERE game_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY game_key ORDER BY loaded_at DESC NULLS LAST, {', '.join(f'{c} DESC NULLS LAST' for c in star.GAME_FIELDS)}) = 1),
stg AS (SELECT l.*, {', '.join(f'known.{c}' for c in star.GAME_FIELDS)} FROM (SELECT latest.*, {game_sql('game_id')} AS game_key FROM latest, aliases) l JOIN known USING (game_key)),
games AS (SELECT game_key, max(season) AS season, {', '.join(f'max({c}) AS {c}' for c in star.GAME_FIELDS)} FROM stg GROUP BY 1),
game AS (SELECT *, CASE WHEN season_type = 'POST' AND season IS NOT NULL THEN CASE week - (CASE WHEN season >= 2021 THEN 18 ELSE 17 END) WHEN 1 THEN 'wild_card' WHEN 2 THEN 'divisional' WHEN 3 THEN 'conference'
  WHEN 4 THEN 'super_bowl' END END AS playoff_round FROM games),
fact AS (SELECT * EXCLUDE ({_FIELDS}) FROM stg)"""


def _staged(spark, d):
    return star.staged(*tables(spark, d, "fact_plays", "dim_game", "dim_team"))


def _star(spark, d):
    """Facts and games, both from the wide plays."""
    stg = _staged(spark, d)
    return star.facts(stg), star.games(stg)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 10) for c in columns})


_SEASONS = """seasons AS (SELECT season, CASE WHEN season >= 2021 THEN 18 ELSE 17 END AS regular_season_weeks, count(DISTINCT CASE WHEN season_type = 'REG' THEN game_key END) AS regular_season_games,
  count(DISTINCT CASE WHEN season_type = 'POST' THEN game_key END) AS postseason_games, count(DISTINCT posteam) AS teams, max(CASE WHEN season_type = 'REG' THEN week END) AS last_regular_season_week,
  min(game_date) AS first_game_date, max(game_date) AS last_game_date, count(*) AS plays FROM stg GROUP BY 1)"""


@q("star_seasons", f"WITH {_STAGED}, {_SEASONS} SELECT * FROM seasons")
def star_seasons(spark, d):
    """Seasons with the 17/18-week rule and what their games say."""
    return star.seasons(_staged(spark, d))


@q("star_games", f"WITH {_STAGED} SELECT game.*, plays FROM game JOIN (SELECT game_key, count(*) AS plays FROM fact GROUP BY 1) USING (game_key)")
def star_games(spark, d):
    """Games rebuilt from their plays, with the playoff round and the number of plays."""
    return star.game_list(*_star(spark, d))


@q(
    "star_plays",
    f"""WITH {_STAGED} SELECT season, season_type, playoff_round, week, count(*) AS n_plays, count(DISTINCT game_key) AS n_games, CAST(sum(yards_gained) AS BIGINT) AS yards, count(home_coach) AS n_coached, count(temp) AS n_temp
FROM fact JOIN game USING (game_key, season) GROUP BY 1, 2, 3, 4""",
)
def star_plays(spark, d):
    """The wide view of plays, measured by season and week."""
    fact, game = _star(spark, d)
    wide = fact.join(game.withColumnRenamed("season", "game_season"), "game_key").where("season = game_season")
    return wide.groupBy("season", "season_type", "playoff_round", "week").agg(
        F.count(F.lit(1)).alias("n_plays"), F.countDistinct("game_key").alias("n_games"), F.sum("yards_gained").alias("yards"), F.count("home_coach").alias("n_coached"), F.count("temp").alias("n_temp")
    )


_ALL = "game_key, play_key, play_id, loaded_at, season, posteam, yards_gained, epa, " + _FIELDS


@q(
    "lossless_star",
    f"""WITH {_STAGED}, wide AS (SELECT {_ALL} FROM fact JOIN (SELECT * EXCLUDE (season, playoff_round) FROM game) USING (game_key)), want AS (SELECT {_ALL} FROM stg)
SELECT 'lost' AS side, count(*) AS n FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM wide) UNION ALL SELECT 'added', count(*) FROM (SELECT * FROM wide EXCEPT ALL SELECT * FROM want)""",
)
def lossless_star(spark, d):
    """Plays split into facts and games and put together again: rows lost and added."""
    stg = _staged(spark, d)
    return star.differences(stg, star.wide_plays(star.facts(stg), star.games(stg), stg.columns))


@q(
    "star_drives",
    f"""WITH {_STAGED} SELECT f.game_key || '-' || fixed_drive AS drive_id, max(f.game_key) AS game_key, max(f.season) AS season, max(posteam) AS posteam, max(defteam) AS defteam, max(fixed_drive) AS drive_number, min(qtr) AS start_quarter,
  arg_min(yardline_100, play_id) AS start_yardline_100, arg_max(yardline_100, play_id) AS end_yardline_100, arg_min(game_seconds_remaining, play_id) AS end_game_seconds_remaining, arg_max(game_seconds_remaining, play_id) AS last_game_seconds_remaining,
  count(*) AS plays, count(*) FILTER (WHERE is_designed_play) AS designed_plays, CAST(sum(yards_gained) AS BIGINT) AS yards_gained, round(sum(epa), 10) AS epa, round(avg(epa), 10) AS epa_per_play, max(game.season_type) AS season_type, max(game.week) AS week
FROM fact f JOIN game ON f.game_key = game.game_key WHERE fixed_drive IS NOT NULL AND posteam IS NOT NULL GROUP BY 1""",
)
def star_drives(spark, d):
    """One row a drive."""
    return rounded(star.drive_table(*_star(spark, d)), "epa", "epa_per_play")


_RATES = ["pass_rate", "neutral_pass_rate", "epa_per_play", "pass_epa_per_play", "rush_epa_per_play", "success_rate"]


@q(
    "star_team_games",
    f"""WITH {_STAGED}, f AS (SELECT *, coalesce(is_designed_play, false) AS dp, coalesce(is_pass_call, false) AS pc, coalesce(is_neutral_script, false) AS ns FROM fact WHERE posteam IS NOT NULL)
SELECT f.game_key, posteam AS team, max(defteam) AS opponent, max(f.season) AS season, count(*) AS plays, count(*) FILTER (WHERE dp) AS designed_plays, round(avg(is_pass_call::INT) FILTER (WHERE dp), 10) AS pass_rate,
  round(avg(is_pass_call::INT) FILTER (WHERE dp AND ns), 10) AS neutral_pass_rate, round(avg(epa) FILTER (WHERE dp), 10) AS epa_per_play, round(avg(epa) FILTER (WHERE dp AND pc), 10) AS pass_epa_per_play,
  round(avg(epa) FILTER (WHERE dp AND NOT pc), 10) AS rush_epa_per_play, round(avg((epa > 0)::INT) FILTER (WHERE dp), 10) AS success_rate, CAST(sum(yards_gained) FILTER (WHERE dp) AS BIGINT) AS yards_gained,
  count(*) FILTER (WHERE dp AND down = 3) AS third_down_attempts, count(*) FILTER (WHERE dp AND down = 4) AS fourth_down_attempts, max(game.season_type) AS season_type, max(game.week) AS week, max(playoff_round) AS playoff_round,
  posteam = max(home_team) AS is_home FROM f JOIN game ON f.game_key = game.game_key GROUP BY 1, 2""",
)
def star_team_games(spark, d):
    """One row a game and team, from its side of the ball."""
    return rounded(star.team_game_table(*_star(spark, d)), *_RATES)


_CREDITED = f"""roles AS (SELECT game_key, season, posteam AS team, 'passer' AS role, {player_sql('passer_player_id')} AS player_id, yards_gained AS y, epa FROM fact
  UNION ALL SELECT game_key, season, posteam, 'rusher', {player_sql('rusher_player_id')}, yards_gained, epa FROM fact
  UNION ALL SELECT game_key, season, posteam, 'receiver', {player_sql('receiver_player_id')}, yards_gained, epa FROM fact),
roster AS (SELECT {player_sql('player_id')} AS player_id, loaded_at, full_name, player_position, short_name FROM dim_player),
named AS (SELECT player_id, full_name, player_position FROM roster WHERE player_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY loaded_at DESC NULLS LAST, full_name DESC NULLS LAST, player_position DESC NULLS LAST) = 1),
short AS (SELECT player_id, short_name FROM roster WHERE player_id IS NOT NULL AND short_name IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, short_name) = 1)"""
_PLAYER_GAMES = """pg AS (SELECT roles.game_key, roles.season, team, role, roles.player_id, count(*) AS plays, CAST(coalesce(sum(y), 0) AS BIGINT) AS yards, round(avg(epa), 10) AS epa_per_play, max(game.season_type) AS season_type, max(game.week) AS week,
  max(playoff_round) AS playoff_round, max(full_name) AS full_name FROM roles JOIN game ON roles.game_key = game.game_key LEFT JOIN named ON named.player_id = roles.player_id WHERE roles.player_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


def _player_games(spark, d):
    fact, game = _star(spark, d)
    return star.player_game_table(fact, game, star.player_table(*tables(spark, d, "fact_plays", "dim_player")))


@q("star_player_games", f"WITH {_STAGED}, {_CREDITED}, {_PLAYER_GAMES} SELECT * FROM pg")
def star_player_games(spark, d):
    """One row a game, player and role."""
    return rounded(_player_games(spark, d), "epa_per_play")


@q(
    "star_players",
    f"""WITH {_STAGED}, {_CREDITED}, c AS (SELECT player_id, count(*) AS credited_plays FROM (SELECT unnest([{player_sql('passer_player_id')}, {player_sql('rusher_player_id')}, {player_sql('receiver_player_id')}]) AS player_id FROM fact_plays)
  WHERE player_id IS NOT NULL GROUP BY 1)
SELECT coalesce(named.player_id, c.player_id) AS player_id, full_name, player_position, short_name, coalesce(credited_plays, 0) AS credited_plays FROM named LEFT JOIN short USING (player_id) FULL JOIN c ON c.player_id = named.player_id""",
)
def star_players(spark, d):
    """Everyone known or credited."""
    return star.player_table(*tables(spark, d, "fact_plays", "dim_player"))


@q("named_players", f"WITH {_STAGED}, {_CREDITED} SELECT player_id, full_name, player_position FROM named WHERE full_name IS NOT NULL")
def named_players(spark, d):
    """Players with a full name: the roster that names are looked up in."""
    return star_players(spark, d).where("full_name IS NOT NULL").select("player_id", "full_name", "player_position")


@q(
    "star_tendencies",
    f"""WITH {_STAGED}, d AS (SELECT *, coalesce(is_designed_play, false) AS dp, coalesce(is_neutral_script, false) AS ns, translate(lower(trim(play_type)), ' -', '__') AS kind FROM fact WHERE posteam IS NOT NULL AND season IS NOT NULL),
o AS (SELECT posteam AS team, season, count(*) AS designed_plays, round(avg(is_pass_call::INT), 10) AS pass_rate, round(avg(epa), 10) AS epa_per_play, round(avg((epa > 0)::INT), 10) AS success_rate, count(*) FILTER (WHERE ns) AS neutral_plays,
  round(avg(is_pass_call::INT) FILTER (WHERE ns), 10) AS neutral_pass_rate, round(avg(is_pass_call::INT) FILTER (WHERE ns AND down IN (1, 2)), 10) AS neutral_early_down_pass_rate, round(avg(epa) FILTER (WHERE ns), 10) AS neutral_epa_per_play
  FROM d WHERE dp GROUP BY 1, 2),
f AS (SELECT posteam AS team, season, count(*) FILTER (WHERE dp) AS fourth_down_go_attempts, count(*) FILTER (WHERE dp OR kind IN ('punt', 'field_goal')) AS n FROM d WHERE down = 4 GROUP BY 1, 2)
SELECT o.*, fourth_down_go_attempts, round(fourth_down_go_attempts::DOUBLE / nullif(n, 0), 10) AS fourth_down_go_rate FROM o LEFT JOIN f USING (team, season)""",
)
def star_tendencies(spark, d):
    """Tendencies of teams and seasons."""
    means = ["pass_rate", "epa_per_play", "success_rate", "neutral_pass_rate", "neutral_early_down_pass_rate", "neutral_epa_per_play", "fourth_down_go_rate"]
    return rounded(star.tendency_table(_star(spark, d)[0]), *means)


@q("star_teams", "SELECT t.team, team_name, conference, division, (SELECT list_sort(list(o.team)) FROM dim_team o WHERE o.division = t.division AND o.conference = t.conference AND o.team <> t.team) AS rivals FROM dim_team t")
def star_teams(spark, d):
    """Clubs, each with the other clubs of its division: grouped lists that are looked up."""
    t = table(spark, d, "dim_team")
    by_division = t.groupBy("conference", "division").agg(F.array_sort(F.collect_set("team")).alias("clubs"))
    return t.join(by_division, ["conference", "division"]).select("team", "team_name", "conference", "division", F.array_remove("clubs", F.col("team")).alias("rivals"))


_BUCKET = "CASE WHEN ydstogo <= 2 THEN 1 WHEN ydstogo <= 6 THEN 2 WHEN ydstogo <= 10 THEN 3 ELSE 4 END"


@q(
    "predictability",
    f"""WITH {_STAGED}, c AS (SELECT posteam, season, down, {_BUCKET} AS togo, is_pass_call::INT AS called, epa FROM fact WHERE is_designed_play AND is_pass_call IS NOT NULL AND down IS NOT NULL AND ydstogo IS NOT NULL AND posteam IS NOT NULL),
usual AS (SELECT down, togo, (avg(called) >= 0.5)::INT AS guess FROM c WHERE season < 2014 GROUP BY 1, 2),
t AS (SELECT posteam AS team, season, count(*) AS n, avg((called = guess)::INT) AS share, avg(epa) FILTER (WHERE NOT isnan(epa)) AS epa FROM c JOIN usual USING (down, togo) WHERE season >= 2014 GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT count(*) AS n_groups, round(avg(share), 6) AS mean_share, round(min(share), 6) AS least, round(max(share), 6) AS most, CASE WHEN count(*) >= 3 THEN round(corr(share, epa), 6) END AS r FROM t""",
)
def predictability(spark, d):
    """How often the call usual for a down and distance in earlier seasons is what a team did later, and whether predictable teams do worse."""
    fact = _star(spark, d)[0].where("is_designed_play AND is_pass_call IS NOT NULL AND down IS NOT NULL AND ydstogo IS NOT NULL AND posteam IS NOT NULL")
    togo = F.when(F.col("ydstogo") <= 2, 1).when(F.col("ydstogo") <= 6, 2).when(F.col("ydstogo") <= 10, 3).otherwise(4)
    calls = fact.select(F.col("posteam").alias("team"), "season", "down", togo.alias("togo"), F.col("is_pass_call").cast("int").alias("called"), F.nanvl("epa", F.lit(None).cast("double")).alias("epa"))
    usual = calls.where("season < 2014").groupBy("down", "togo").agg((F.avg("called") >= 0.5).cast("int").alias("guess"))
    by_team = calls.where("season >= 2014").join(usual, ["down", "togo"]).groupBy("team", "season").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("called") == F.col("guess")).cast("int")).alias("share"), F.avg("epa").alias("epa")
    )
    r = F.when(F.count(F.lit(1)) >= 3, F.round(F.corr("share", "epa"), 6))
    return by_team.where("n >= 20").agg(
        F.count(F.lit(1)).alias("n_groups"), F.round(F.avg("share"), 6).alias("mean_share"), F.round(F.min("share"), 6).alias("least"), F.round(F.max("share"), 6).alias("most"), r.alias("r")
    )


# --- documents


def _leader_sql(role: str) -> str:
    return f"""{role}s AS (SELECT game_key, coalesce(full_name, player_id) AS {role}, yards AS {role}_yards FROM pg WHERE role = '{role}' QUALIFY row_number() OVER (PARTITION BY game_key ORDER BY yards DESC, player_id) = 1)"""


@q(
    "game_documents",
    f"""WITH {_STAGED}, {_CREDITED}, {_PLAYER_GAMES}, {', '.join(map(_leader_sql, star.ROLES))}
SELECT 'game:' || game_key AS doc_id, 'game' AS grain, game_key AS game_id, season, week, list_sort([home_team, away_team]) AS teams, concat_ws(' ', away_team, 'at', home_team, season) AS title,
  concat_ws(' ', away_team || ' played at ' || home_team || ' in the ' || CASE WHEN playoff_round IS NOT NULL THEN replace(playoff_round, '_', ' ') || ' round' ELSE 'week ' || week END || ' of ' || season || '.',
    CASE WHEN home_score = away_score THEN 'They tied at ' || home_score || ' each.' ELSE CASE WHEN home_score > away_score THEN home_team ELSE away_team END || ' beat ' || CASE WHEN home_score > away_score THEN away_team ELSE home_team END
      || ' ' || greatest(home_score, away_score) || ' to ' || least(home_score, away_score) || ', by ' || CASE WHEN abs(home_score - away_score) = 1 THEN '1 point' ELSE abs(home_score - away_score) || ' points' END || '.' END,
    {', '.join(f"'Most yards as {r}: ' || {r} || ', ' || {r}_yards || '.'" for r in star.ROLES)}) AS body
FROM game {' '.join(f'LEFT JOIN {r}s USING (game_key)' for r in star.ROLES)}""",
)
def game_documents(spark, d):
    """Games told in sentences, with their leaders."""
    return star.game_documents(_star(spark, d)[1], _player_games(spark, d))


@q(
    "drive_documents",
    f"""WITH {_STAGED}, d AS (SELECT f.game_key || '-' || fixed_drive AS drive_id, max(f.game_key) AS game_key, max(f.season) AS season, max(posteam) AS posteam, max(defteam) AS defteam, max(fixed_drive) AS drive_number, min(qtr) AS start_quarter,
  arg_min(yardline_100, play_id) AS start_yardline_100, count(*) AS plays, CAST(sum(yards_gained) AS BIGINT) AS yards_gained, max(game.season_type) AS season_type, max(game.week) AS week
  FROM fact f JOIN game ON f.game_key = game.game_key WHERE fixed_drive IS NOT NULL AND posteam IS NOT NULL GROUP BY 1)
SELECT 'drive:' || drive_id AS doc_id, 'drive' AS grain, game_key AS game_id, season, week, list_sort([posteam, defteam]) AS teams, concat_ws(' ', 'Drive', drive_number, 'of', posteam) AS title,
  posteam || ' started ' || coalesce(start_yardline_100::VARCHAR, 'some') || ' yards from the goal in quarter ' || start_quarter || ' and gained ' || coalesce(yards_gained::VARCHAR, 'no') || ' yards in ' || plays || CASE WHEN plays = 1 THEN ' play.' ELSE ' plays.' END AS body
FROM d WHERE season_type = 'POST'""",
)
def drive_documents(spark, d):
    """Drives of the postseason told in sentences."""
    return star.drive_documents(star.drive_table(*_star(spark, d)))


# --- the incremental build

#: The stored build holds what had arrived before this moment; the rest comes as an update.
STORED_UNTIL = "2024-01-01"
_PLAY_COLUMNS = ["play_key", "game_id", "play_id", "season", "posteam", "yards_gained", "epa", "loaded_at"]


@q(
    "incremental_plays",
    f"""WITH {LATEST}, changed AS (SELECT DISTINCT season FROM fact_plays WHERE loaded_at >= '{STORED_UNTIL}')
SELECT latest.season, count(*) AS n_plays, count(DISTINCT game_id) AS n_games, CAST(sum(yards_gained) AS BIGINT) AS yards, round(sum(epa) FILTER (WHERE NOT isnan(epa)), 4) AS epa, bool_or(changed.season IS NOT NULL OR (latest.season IS NULL AND EXISTS
  (SELECT 1 FROM changed WHERE season IS NULL))) AS was_rebuilt FROM latest LEFT JOIN changed ON latest.season = changed.season GROUP BY 1""",
)
def incremental_plays(spark, d):
    """The stored build of what had arrived so far, and of the rest only the seasons whose content changed built anew: the same as a full build."""
    plays = table(spark, d, "fact_plays")
    latest = lambda df: star.latest_plays(df).select(*_PLAY_COLUMNS)
    kept = Kept(spark)
    path = f"{kept.at}/plays"
    store.write_partitions(latest(plays.where(F.col("loaded_at") < STORED_UNTIL)), path, ["season"])
    # a row that replaces another of its key may have another season: both are changed
    stored = spark.read.parquet(path).select(*_PLAY_COLUMNS)
    arrived = lambda df: df.groupBy("season").agg(F.sum(store.row_hash(["play_key", "loaded_at"])).alias("h"))
    changed = kept.keep(store.changed_partitions(arrived(plays.where(F.col("loaded_at") < STORED_UNTIL)), arrived(plays), "season"), "changed")
    moved = stored.join(plays.where(F.col("loaded_at") >= STORED_UNTIL).select("play_key").distinct(), "play_key", "left_semi").select("season").distinct()
    redo = kept.keep(changed.select("season").union(moved).distinct(), "redo")
    fresh = latest(plays).join(F.broadcast(redo.withColumnRenamed("season", "_s")), F.col("season").eqNullSafe(F.col("_s")), "left_semi")
    store.write_partitions(fresh, path, ["season"])
    built = spark.read.parquet(path)
    by = built.groupBy("season").agg(
        F.count(F.lit(1)).alias("n_plays"), F.countDistinct("game_id").alias("n_games"), F.sum("yards_gained").alias("yards"), F.round(F.sum(F.nanvl("epa", F.lit(None).cast("double"))), 4).alias("epa")
    )
    flagged = changed.select(F.col("season").alias("_s"), F.lit(True).alias("was_rebuilt"))
    return by.join(F.broadcast(flagged), F.col("season").eqNullSafe(F.col("_s")), "left").select(*by.columns, F.coalesce("was_rebuilt", F.lit(False)).alias("was_rebuilt"))


# --- contract and checks


@q("contract_plays", contract.report_sql("fact_plays"))
def contract_plays(spark, d):
    """All of the contract's checks on the plays in one pass, each with up to three of the values that fail."""
    df = table(spark, d, "fact_plays")
    return quality.failures(df, contract.checks(df.columns))


@q("contract_games", contract.report_sql("dim_game"))
def contract_games(spark, d):
    """The same for games."""
    df = table(spark, d, "dim_game")
    return quality.failures(df, contract.checks(df.columns))


@q(
    "season_rules",
    f"""WITH {_STAGED}, {_SEASONS} SELECT 'every season has 32 teams' AS rule, season FROM seasons WHERE teams <> 32 UNION ALL SELECT 'finished seasons are full', season FROM seasons WHERE postseason_games > 0 AND regular_season_games < 256
UNION ALL SELECT 'weeks match the schedule', season FROM seasons WHERE postseason_games > 0 AND last_regular_season_week <> regular_season_weeks""",
)
def season_rules(spark, d):
    """Seasons that break a rule of the schedule."""
    s = star.seasons(_staged(spark, d))
    after = F.col("postseason_games") > 0
    rules = {"every season has 32 teams": F.col("teams") != 32, "finished seasons are full": after & (F.col("regular_season_games") < 256), "weeks match the schedule": after & (F.col("last_regular_season_week") != F.col("regular_season_weeks"))}
    broken = F.filter(F.array(*[F.when(fails, F.lit(name)) for name, fails in rules.items()]), lambda x: x.isNotNull())
    return s.select(F.explode(broken).alias("rule"), "season")


@q(
    "constant_in_game",
    """WITH g AS (SELECT game_id, list_filter([CASE WHEN count(DISTINCT coalesce(season::VARCHAR, '<null>')) > 1 THEN 'season' END, CASE WHEN count(DISTINCT coalesce(posteam_won::VARCHAR, '<null>')) > 1 THEN 'posteam_won' END,
  CASE WHEN count(DISTINCT coalesce(loaded_at::VARCHAR, '<null>')) > 1 THEN 'loaded_at' END], lambda x: x IS NOT NULL) AS c FROM fact_plays GROUP BY 1) SELECT game_id, unnest(c) AS column_name FROM g""",
)
def constant_in_game(spark, d):
    """Games whose plays don't agree on what should be the same in all, nulls counting as a value."""
    return quality.not_constant(table(spark, d, "fact_plays"), "game_id", ["season", "posteam_won", "loaded_at"], nulls=True)


@q(
    "unseen_players",
    f"""SELECT DISTINCT p.player_id FROM (SELECT {player_sql('player_id')} AS player_id FROM dim_player) p WHERE player_id IS NOT NULL AND player_id NOT IN (SELECT unnest([{player_sql('passer_player_id')}, {player_sql('rusher_player_id')}, {player_sql('receiver_player_id')}]) AS k
  FROM fact_plays EXCEPT SELECT NULL)""",
)
def unseen_players(spark, d):
    """Players of the dimension that no play credits (an anti join)."""
    players = star_players(spark, d)
    known = table(spark, d, "dim_player").select(star.player_key(F.col("player_id")).alias("player_id")).distinct()
    return players.where("credited_plays = 0").join(known, "player_id", "left_semi").select("player_id")


@q(
    "week_volume",
    f"""WITH {_STAGED}, g AS (SELECT season, week, game_key, count(*) AS n FROM fact_plays_keyed JOIN known USING (game_key) GROUP BY 1, 2, 3),
first AS (SELECT season, week, count(*) AS first_rows FROM (SELECT k.*, known.week FROM fact_plays_keyed k JOIN known USING (game_key) QUALIFY k.loaded_at = min(k.loaded_at) OVER (PARTITION BY k.season, known.week)) GROUP BY 1, 2)
SELECT g.season, g.week, count(*) AS n_games, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE n < 100) AS n_small, count(*) FILTER (WHERE n > 300) AS n_large, sum(n)::DOUBLE / count(*) BETWEEN 145 AND 225 AS mean_in_band,
  abs(sum(n)::DOUBLE / first_rows - 1) <= 0.05 AS like_first_delivery FROM g JOIN first ON g.season IS NOT DISTINCT FROM first.season AND g.week IS NOT DISTINCT FROM first.week GROUP BY g.season, g.week, first_rows""".replace(
        "known AS (", f"fact_plays_keyed AS (SELECT fact_plays.*, {game_sql('game_id')} AS game_key FROM fact_plays, aliases), known AS (", 1
    ),
)
def week_volume(spark, d):
    """Rows of each week against the bands for games, for the mean, and for what was delivered first."""
    plays, games, teams = tables(spark, d, "fact_plays", "dim_game", "dim_team")
    aliases = star.team_aliases(teams)
    weeks = games.select(star.game_key(F.col("game_id"), aliases).alias("game_key"), F.struct("loaded_at", "week").alias("w")).where("game_key IS NOT NULL").groupBy("game_key").agg(F.max("w.week").alias("week"))
    keyed = plays.select("season", "loaded_at", star.game_key(F.col("game_id"), aliases).alias("game_key")).join(weeks, "game_key")
    return quality.volume(keyed, ["season", "week"], "game_key", "loaded_at")


@q(
    "freshness",
    """WITH today AS (SELECT CAST(max(game_date) AS DATE) + 2 AS d FROM dim_game), season_now AS (SELECT CASE WHEN month(d) >= 3 THEN year(d) ELSE year(d) - 1 END AS s FROM today),
g AS (SELECT * FROM dim_game, season_now WHERE season = s), bounds AS (SELECT CAST(min(game_date) AS DATE) AS a, CAST(max(game_date) AS DATE) AS b FROM g),
p AS (SELECT DISTINCT game_id FROM fact_plays), w AS (SELECT week, CAST(max(game_date) AS DATE) AS last_game, bool_and(home_margin IS NOT NULL) AS complete, count(*) FILTER (WHERE home_margin IS NULL AND CAST(game_date AS DATE) <= d - 2) AS overdue,
  bool_or(p.game_id IS NOT NULL) AS ingested FROM g CROSS JOIN today LEFT JOIN p ON p.game_id = g.game_id GROUP BY 1)
SELECT s AS season, week, last_game, complete, overdue, ingested, d BETWEEN a - 7 AND b + 7 AS in_season, CASE WHEN NOT d BETWEEN a - 7 AND b + 7 THEN NULL WHEN complete AND last_game <= d - 2 AND NOT ingested THEN 'not ingested' WHEN overdue > 0 THEN 'source is behind' END AS stale
FROM w, today, season_now, bounds""",
)
def freshness(spark, d):
    """Weeks of the season under way two days after the last game: played and not ingested, or without results when they are due."""
    games, plays = tables(spark, d, "dim_game", "fact_plays")
    return quality.freshness(games, plays.select("game_id").distinct(), games.agg(F.date_add(F.max("game_date").cast("date"), 2)).scalar())
