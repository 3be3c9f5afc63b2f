"""Queries of the reference's analyses: shapes users ask for, decisions on fourth down, replay, schedules, metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hashmark.operators import decisions, models, quality, retrieval
from hashmark.plans.registry import Registry
from hashmark.plans.warehouse import LATEST, latest, r6
from hashmark.session import cut
from hashmark.sources.tables import table
from hashmark.streaming import replay

registry = Registry()
q = registry.query

_KIND = "translate(lower(trim(play_type)), ' -', '__')"


def _kinds(spark, d):
    return latest(spark, d).withColumn("kind", F.translate(F.lower(F.btrim("play_type")), " -", "__"))


# --- shapes users ask for


@q(
    "leader_min_volume",
    f"""WITH {LATEST} SELECT * FROM (SELECT posteam, count(*) AS n, round(avg(epa), 6) AS mean_epa FROM latest WHERE is_designed_play AND NOT isnan(epa) GROUP BY 1 HAVING count(*) >= 20) ORDER BY mean_epa DESC, posteam LIMIT 10""",
)
def leader_min_volume(spark, d):
    """The ten best teams by mean, among those with enough plays."""
    by = latest(spark, d).where("is_designed_play AND NOT isnan(epa)").groupBy("posteam").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("epa")).alias("mean_epa"))
    return by.where("n >= 20").orderBy(F.desc("mean_epa"), "posteam").limit(10)


@q("extreme_rows", f"WITH {LATEST} SELECT play_key, season, yards_gained FROM latest WHERE yards_gained IS NOT NULL ORDER BY yards_gained DESC, play_key LIMIT 20")
def extreme_rows(spark, d):
    """The twenty longest plays."""
    return latest(spark, d).where("yards_gained IS NOT NULL").orderBy(F.desc("yards_gained"), "play_key").limit(20).select("play_key", "season", "yards_gained")


@q(
    "winners",
    """SELECT game_id, loaded_at, CASE WHEN home_score > away_score THEN home_team WHEN away_score > home_score THEN away_team END AS winner, CASE WHEN home_score > away_score THEN away_team WHEN away_score > home_score THEN home_team END AS loser,
  abs(home_score - away_score) AS margin FROM dim_game WHERE season_type = 'REG'""",
)
def winners(spark, d):
    """Winner and loser of each game, null on a tie."""
    g = table(spark, d, "dim_game").where("season_type = 'REG'")
    home, away = F.col("home_score") > F.col("away_score"), F.col("away_score") > F.col("home_score")
    return g.select(
        "game_id", "loaded_at", F.when(home, F.col("home_team")).when(away, F.col("away_team")).alias("winner"), F.when(home, F.col("away_team")).when(away, F.col("home_team")).alias("loser"), F.abs(F.col("home_score") - F.col("away_score")).alias("margin")
    )


@q(
    "season_trend",
    f"WITH {LATEST} SELECT season, count(*) AS n, round(avg(is_pass_call::INT), 6) AS pass_rate FROM latest WHERE is_designed_play AND season IS NOT NULL GROUP BY 1",
)
def season_trend(spark, d):
    """The share of passes by season."""
    return latest(spark, d).where("is_designed_play AND season IS NOT NULL").groupBy("season").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("is_pass_call").cast("int"))).alias("pass_rate")).orderBy("season")


@q("rank_in_season", "SELECT season, team, rank() OVER (PARTITION BY season ORDER BY round(epa_per_play, 6) DESC NULLS LAST) AS place FROM mart_team_season_tendencies")
def rank_in_season(spark, d):
    """Places within a season; equal means share one."""
    w = Window.partitionBy("season").orderBy(r6(F.col("epa_per_play")).desc_nulls_last())
    return table(spark, d, "mart_team_season_tendencies").select("season", "team", F.rank().over(w).alias("place"))


@q(
    "usual_position",
    """SELECT player_id, player_position FROM (SELECT player_id, player_position, count(*) AS n FROM dim_player WHERE player_position IS NOT NULL GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY n DESC, player_position) = 1""",
)
def usual_position(spark, d):
    """A player's commonest position, the first by name where several are."""
    n = table(spark, d, "dim_player").where("player_position IS NOT NULL").groupBy("player_id", "player_position").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("player_id").agg(F.min_by("player_position", F.struct(-F.col("n"), "player_position")).alias("player_position"))


# --- schedules and replay


@q(
    "week_completeness",
    """WITH played AS (SELECT DISTINCT game_id FROM fact_plays WHERE game_id IS NOT NULL), g AS (SELECT season, week, game_id, bool_or(removed_at IS NULL) AS there FROM dim_game GROUP BY 1, 2, 3)
SELECT season, week, count(*) AS n_games, count(*) FILTER (WHERE p.game_id IS NULL) AS n_missing, bool_and(p.game_id IS NOT NULL) AS complete FROM g LEFT JOIN played p USING (game_id) WHERE there GROUP BY 1, 2""",
)
def week_completeness(spark, d):
    """Weeks of the schedule and how many of their games have no plays."""
    played = table(spark, d, "fact_plays").where("game_id IS NOT NULL").select("game_id", F.lit(True).alias("played")).distinct()
    g = table(spark, d, "dim_game").groupBy("season", "week", "game_id").agg(F.bool_or(F.col("removed_at").isNull()).alias("there")).where("there")
    has = F.coalesce("played", F.lit(False))
    return g.join(played, "game_id", "left").groupBy("season", "week").agg(F.count(F.lit(1)).alias("n_games"), F.count_if(~has).alias("n_missing"), F.bool_and(has).alias("complete"))


_GAMES = "games AS (SELECT game_id, arg_max(home_team, loaded_at) AS home_team, arg_max(home_score - away_score, loaded_at) AS margin FROM dim_game GROUP BY 1)"


@q(
    "replay_events",
    f"""WITH {LATEST}, {_GAMES}, e AS (SELECT l.game_id, l.play_key, l.play_id, row_number() OVER w - 1 AS sequence, game_seconds_remaining AS clock, lag(game_seconds_remaining) OVER w AS before,
  CASE WHEN posteam = home_team THEN wp ELSE 1 - wp END AS home_wp, false AS is_final FROM latest l JOIN games USING (game_id) WHERE wp IS NOT NULL AND NOT isnan(wp) WINDOW w AS (PARTITION BY l.game_id ORDER BY l.play_id, l.play_key))
SELECT game_id, play_id, sequence, round(least(greatest(coalesce(before - clock, 0), 0), 5), 6) AS wait, round(home_wp, 4) AS home_wp, is_final FROM e
UNION ALL SELECT game_id, -1, max(sequence) + 1, 0, CASE WHEN any_value(margin) > 0 THEN 1.0 WHEN any_value(margin) < 0 THEN 0.0 ELSE 0.5 END, true FROM e JOIN games USING (game_id) GROUP BY 1""",
)
def replay_events(spark, d):
    """A game's plays in order with the home side's chance and the pause before each (at most five seconds), then its result."""
    games = table(spark, d, "dim_game").groupBy("game_id").agg(F.max_by(F.struct("home_team", (F.col("home_score") - F.col("away_score")).alias("margin")), "loaded_at").alias("g")).select("game_id", "g.*")
    w = Window.partitionBy("game_id").orderBy("play_id", "play_key")
    clock = F.col("game_seconds_remaining")
    events = latest(spark, d).where("wp IS NOT NULL AND NOT isnan(wp)").join(games, "game_id").select(
        "game_id",
        "play_id",
        (F.row_number().over(w) - 1).cast("long").alias("sequence"),
        F.round(F.least(F.greatest(F.coalesce(F.lag(clock).over(w) - clock, F.lit(0.0)), F.lit(0.0)), F.lit(5.0)), 6).alias("wait"),
        F.round(F.when(F.col("posteam") == F.col("home_team"), F.col("wp")).otherwise(1 - F.col("wp")), 4).alias("home_wp"),
        F.lit(False).alias("is_final"),
        "margin",
    )
    won = F.when(F.col("margin") > 0, 1.0).when(F.col("margin") < 0, 0.0).otherwise(0.5)
    finals = events.groupBy("game_id", "margin").agg(F.max("sequence").alias("last")).select("game_id", F.lit(-1).alias("play_id"), (F.col("last") + 1).alias("sequence"), F.lit(0.0).alias("wait"), won.alias("home_wp"), F.lit(True).alias("is_final"))
    return events.drop("margin").unionByName(finals)


# --- decisions


@q(
    "punt_table",
    f"""WITH {LATEST}, n AS (SELECT {_KIND} AS kind, posteam, yardline_100, lead(posteam) OVER w AS next_team, lead(yardline_100) OVER w AS next_yardline FROM latest WINDOW w AS (PARTITION BY game_id ORDER BY play_id, play_key)),
p AS (SELECT yardline_100 // 5 AS bin, next_yardline AS y FROM n WHERE kind = 'punt' AND next_team <> posteam AND yardline_100 BETWEEN 0 AND 99 AND next_yardline IS NOT NULL),
b AS (SELECT bin, count(*) AS n, avg(y) AS m FROM p GROUP BY 1), bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20)),
near AS (SELECT bins.bin, b.m FROM bins, b WHERE b.n >= 25 QUALIFY row_number() OVER (PARTITION BY bins.bin ORDER BY abs(b.bin - bins.bin), b.bin) = 1)
SELECT bin, coalesce(b.n, 0) AS n, round(coalesce(near.m, (SELECT avg(y) FROM p)), 6) AS value FROM bins LEFT JOIN b USING (bin) LEFT JOIN near USING (bin)""",
)
def punt_table(spark, d):
    """Where the other side starts after a punt, by where it is kicked from; thin places take the nearest's."""
    return _punt_table(_kinds(spark, d)).select("bin", "n", r6(F.col("value")).alias("value"))


def _punt_table(plays):
    punts = decisions.next_possession(plays).where("kind = 'punt' AND next_team <> posteam")
    return decisions.binned_means(punts, "yardline_100", "next_yardline", 5, 20, 25)


@q("fourth_down_audit")
def fourth_down_audit(spark, d):
    """What was chosen on fourth down against the options' values by models of earlier seasons."""
    plays = cut(_kinds(spark, d))
    earlier = plays.where("season < 2016")
    win = models.fit(models.design(earlier, "posteam_won", models.PRE_SNAP), models.PRE_SNAP)
    near = ["ydstogo", "yardline_100"]
    tries = earlier.where("down >= 3 AND kind IN ('pass', 'run')").withColumn("converted", F.col("yards_gained") >= F.col("ydstogo"))
    kicks = decisions.next_possession(earlier).where("kind = 'field_goal'").withColumn("made", (F.col("next_margin") - F.col("score_differential")) > 0)
    states = plays.where("season >= 2016 AND down = 4 AND kind IN ('pass', 'run', 'field_goal', 'punt')").na.drop(subset=models.PRE_SNAP)
    scored = models.score(models.fit(models.design(tries, "converted", near), near), states).withColumn("p_convert", F.col("p")).drop("raw", "features", "rawPrediction", "probability", "prediction", "p")
    scored = models.score(models.fit(models.design(kicks, "made", ["yardline_100"]), ["yardline_100"]), scored).withColumn("p_kick", F.col("p"))
    landing = _punt_table(earlier).select("bin", F.col("value").alias("landing"))
    keyed = scored.withColumn("bin", F.floor(F.col("yardline_100") / 5).cast("int")).join(F.broadcast(landing), "bin")
    chosen = F.when(F.col("kind") == "punt", "punt").when(F.col("kind") == "field_goal", "kick").otherwise("go")
    valued = decisions.option_values(keyed.select("play_key", *models.PRE_SNAP, "p_convert", "p_kick", "landing"), "play_key", lambda s: models.score(win, s))
    return decisions.audit(valued.join(keyed.select("play_key", chosen.alias("choice")), "play_key"), F.col("choice"))


# --- checks and windows of event time


@q(
    "table_measures",
    """SELECT unnest([{'check_name': 'mean_between', 'column_name': 'epa', 'value': round(avg(epa) FILTER (WHERE NOT isnan(epa)), 6)}, {'check_name': 'null_rate_below', 'column_name': 'season', 'value': round(avg((season IS NULL)::INT), 6)},
  {'check_name': 'rows_between', 'column_name': '', 'value': count(*)::DOUBLE}], recursive := true), unnest([coalesce(avg(epa) FILTER (WHERE NOT isnan(epa)) BETWEEN -0.5 AND 0.5, false), avg((season IS NULL)::INT) <= 0.01, count(*) >= 1]) AS passed FROM fact_plays""",
)
def table_measures(spark, d):
    """Means, shares of nulls and the number of rows against their bounds, in one pass."""
    sound = table(spark, d, "fact_plays").select("season", F.nanvl("epa", F.lit(None).cast("double")).alias("epa"))
    wanted = [quality.mean_between("epa", -0.5, 0.5), quality.null_rate_below("season", 0.01), quality.rows_between(1, 1 << 60)]
    return quality.measures(sound, wanted).withColumn("value", r6(F.col("value")))


@q("failed_examples", "SELECT 'in_range' AS check_name, 'ydstogo' AS column_name, min(ydstogo::VARCHAR) AS least, max(ydstogo::VARCHAR) AS greatest FROM fact_plays WHERE ydstogo NOT BETWEEN 1 AND 10")
def failed_examples(spark, d):
    """What fails a check, by its extremes."""
    return quality.examples(table(spark, d, "fact_plays"), [quality.in_range("ydstogo", 1, 10)])


@q("daily_event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_event_windows(spark, d):
    """Windows of a day by the function that streams use too."""
    return replay.windowed(table(spark, d, "events"), "ts", "1 day", ["event_type"], "value").withColumn("total", F.round("total", 4))


# --- metrics

_SCORED = "x AS (SELECT least(greatest(wp, 0), 1) AS p, posteam_won::INT::DOUBLE AS label FROM fact_plays WHERE wp IS NOT NULL AND posteam_won IS NOT NULL AND NOT isnan(wp))"


@q(
    "calibration_error",
    f"WITH {_SCORED}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS predicted, avg(label) AS observed FROM x GROUP BY 1) SELECT round(sum(n * abs(predicted - observed)) / sum(n), 6) AS ece FROM b",
)
def calibration_error(spark, d):
    """The expected calibration error of the recorded win probability."""
    p = table(spark, d, "fact_plays").where("wp IS NOT NULL AND posteam_won IS NOT NULL AND NOT isnan(wp)")
    scored = p.select(F.least(F.greatest("wp", F.lit(0.0)), F.lit(1.0)).alias("p"), F.col("posteam_won").cast("double").alias("label"))
    return models.calibration_error(scored).select(r6(F.col("ece")).alias("ece"))


_SCANNED = ["down", "ydstogo", "yardline_100", "score_differential", "game_seconds_remaining", "yards_gained", "epa", "wp"]


@q(
    "leakage_scan",
    f"""WITH x AS (SELECT posteam_won::INT::DOUBLE AS y, unnest({_SCANNED}) AS feature, unnest([{', '.join(f'{c}::DOUBLE' for c in _SCANNED)}]) AS v FROM fact_plays WHERE posteam_won IS NOT NULL),
r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS k FROM x WHERE v IS NOT NULL AND NOT isnan(v)),
a AS (SELECT feature, count(*) AS n, (sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY 1) SELECT feature, n, round(greatest(auc, 1 - auc), 6) AS auc FROM a""",
)
def leakage_scan(spark, d):
    """How well each column alone tells the winner: those that tell too much leak the outcome."""
    return models.feature_auc(table(spark, d, "fact_plays"), _SCANNED, "posteam_won").select("feature", "n", r6(F.col("auc")).alias("auc"))


@q(
    "retrieval_scores",
    """WITH s AS (SELECT a.vec_id AS query, a.label AS ql, b.label AS bl, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), f AS (SELECT query, min(rank) FILTER (WHERE ql = bl) AS first FROM s WHERE rank <= 10 GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(coalesce(first = 1, false)::INT), 6) AS hit_at_1, round(avg((first IS NOT NULL)::INT), 6) AS recall_at_k, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f""",
)
def retrieval_scores(spark, d):
    """How soon a stated set of queries finds a row of its own label: hit at one, recall at ten, mean reciprocal rank."""
    e = table(spark, d, "embeddings")
    ranked = retrieval.block_rank(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)
    named = ranked.join(e.select("vec_id", F.col("label").alias("found_label")), "vec_id").join(e.select(F.col("vec_id").alias("query"), "label"), "query")
    return retrieval.ranking_scores(named, F.col("label") == F.col("found_label"), 10).select("n_queries", *[r6(F.col(c)).alias(c) for c in ("hit_at_1", "recall_at_k", "mrr")])


@q("hashed_vectors")
def hashed_vectors(spark, d):
    """Texts as hashed bags of words of length one: the embedder that needs no model."""
    return retrieval.hashed(table(spark, d, "documents"), "doc_id", "text")
