"""Queries of the reference's own operators: projections, joins, aggregations, windows, sets, checks, retrieval, replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hashmark.functions.compat import as_date, floor_zero, is_true, max_by_known
from hashmark.functions.fuzzy import alike_names, jaro_winkler
from hashmark.operators import models, plays, quality, quantiles, retrieval
from hashmark.plans.registry import Registry
from hashmark.session import cut
from hashmark.sources import store
from hashmark.sources.tables import table, tables
from hashmark.streaming import score

registry = Registry()
q = registry.query


def r6(c):
    return F.round(c, 6)


LATEST = """latest AS (SELECT * FROM fact_plays QUALIFY row_number() OVER (PARTITION BY play_key ORDER BY loaded_at DESC NULLS LAST, game_id DESC NULLS LAST, play_id DESC NULLS LAST, season DESC NULLS LAST,
  posteam DESC NULLS LAST, defteam DESC NULLS LAST, posteam_won DESC NULLS LAST, fixed_drive DESC NULLS LAST, qtr DESC NULLS LAST, down DESC NULLS LAST, ydstogo DESC NULLS LAST, yardline_100 DESC NULLS LAST,
  game_seconds_remaining DESC NULLS LAST, score_differential DESC NULLS LAST, play_type DESC NULLS LAST, yards_gained DESC NULLS LAST, passer_player_id DESC NULLS LAST, rusher_player_id DESC NULLS LAST,
  receiver_player_id DESC NULLS LAST, epa DESC NULLS LAST, wp DESC NULLS LAST) = 1)"""


def latest(spark, d):
    return plays.latest_plays(table(spark, d, "fact_plays"))


# --- projections and filters


@q(
    "play_labels",
    """WITH l AS (SELECT CASE WHEN down IS NULL THEN NULL WHEN ydstogo IS NULL THEN NULL WHEN ydstogo <= 2 THEN 'short' WHEN ydstogo <= 6 THEN 'medium' WHEN ydstogo <= 10 THEN 'long' ELSE 'very_long' END AS distance,
  CASE WHEN yardline_100 IS NULL THEN NULL WHEN yardline_100 <= 20 THEN 'red_zone' WHEN yardline_100 <= 40 THEN 'opponent_territory' WHEN yardline_100 <= 60 THEN 'midfield' WHEN yardline_100 <= 80 THEN 'own_territory' ELSE 'backed_up' END AS zone,
  CASE WHEN score_differential IS NULL THEN NULL WHEN score_differential <= -17 THEN 'trailing_big' WHEN score_differential <= -9 THEN 'trailing_two_scores' WHEN score_differential <= -1 THEN 'trailing_one_score'
    WHEN score_differential <= 0 THEN 'tied' WHEN score_differential <= 8 THEN 'leading_one_score' WHEN score_differential <= 16 THEN 'leading_two_scores' ELSE 'leading_big' END AS score_state,
  coalesce(wp BETWEEN 0.2 AND 0.8 AND qtr <= 3 AND CASE WHEN game_seconds_remaining > 1800 THEN game_seconds_remaining - 1800 ELSE game_seconds_remaining END > 120, false) AS neutral, coalesce(wp NOT BETWEEN 0.05 AND 0.95 AND qtr >= 4, false) AS garbage FROM fact_plays)
SELECT distance, zone, score_state, neutral, garbage, count(*) AS n FROM l GROUP BY ALL""",
)
def play_labels(spark, d):
    """Plays by situational labels (bucketing, three-valued flags)."""
    return plays.with_labels(table(spark, d, "fact_plays")).groupBy("distance", "zone", "score_state", "neutral", "garbage").agg(F.count(F.lit(1)).alias("n"))


@q(
    "contract_project",
    """SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(l_quantity AS INTEGER) AS quantity, l_discount <> 0 AS discounted, CAST(NULL AS VARCHAR) AS note,
  CASE WHEN l_quantity - 25 < 0 THEN 0 ELSE l_quantity - 25 END AS above_25, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ship_date, l_orderkey || '-' || l_linenumber AS line_key FROM lineitem""",
)
def contract_project(spark, d):
    """A table put into its contract: renamed, cast leniently, missing columns null, floored, keyed."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").try_cast("int").alias("quantity"),
        (F.col("l_discount") != 0).alias("discounted"),
        F.lit(None).cast("string").alias("note"),
        floor_zero(F.col("l_quantity") - 25).cast("double").alias("above_25"),
        as_date(li, "l_shipdate").cast("string").alias("ship_date"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("line_key"),
    )


@q("param_filter", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (1, 5, 9) AND p_type ILIKE '%edi%'")
def param_filter(spark, d):
    """Bound parameters, membership and a pattern in any case."""
    return spark.sql("SELECT p_partkey, p_name, p_size FROM {t} WHERE array_contains(:sizes, p_size) AND p_type ILIKE :pattern", args={"sizes": F.array(F.lit(1), F.lit(5), F.lit(9)), "pattern": "%edi%"}, t=table(spark, d, "part"))


@q("array_filters", "SELECT doc_id, grain, len(teams) AS n_teams FROM documents WHERE list_has_all(teams, ['CRW']) AND grain = 'note' AND lang IS NOT NULL")
def array_filters(spark, d):
    """Documents whose array holds all of the asked values."""
    docs = table(spark, d, "documents")
    return docs.where((F.size(F.array_except(F.array(F.lit("CRW")), "teams")) == 0) & (F.col("grain") == "note") & F.col("lang").isNotNull()).select("doc_id", "grain", F.size("teams").cast("long").alias("n_teams"))


@q("optional_filter", "SELECT team, season, pass_rate FROM mart_team_season_tendencies WHERE neutral_plays >= 400")
def optional_filter(spark, d):
    """A parameter that filters only if given."""
    return spark.sql("SELECT team, season, pass_rate FROM {t} WHERE (:team IS NULL OR team = :team) AND neutral_plays >= :least", args={"team": None, "least": 400}, t=table(spark, d, "mart_team_season_tendencies"))


# --- joins


@q(
    "fact_dim_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate, c_mktsegment, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def fact_dim_join(spark, d):
    """A fact put together again with its dimensions."""
    li, o, c, n, r = tables(spark, d, "lineitem", "orders", "customer", "nation", "region")
    wide = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return wide.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderdate", "c_mktsegment", "n_name", "r_name")


@q(
    "roles_join",
    "SELECT g.game_id, h.team_name AS home_name, a.team_name AS away_name, h.division = a.division AS same_division FROM dim_game g JOIN dim_team h ON g.home_team = h.team JOIN dim_team a ON g.away_team = a.team",
)
def roles_join(spark, d):
    """One dimension joined twice, by role."""
    g, t = tables(spark, d, "dim_game", "dim_team")
    home = t.select(F.col("team").alias("home_team"), F.col("team_name").alias("home_name"), F.col("division").alias("hd"))
    away = t.select(F.col("team").alias("away_team"), F.col("team_name").alias("away_name"), F.col("division").alias("ad"))
    return g.join(home, "home_team").join(away, "away_team").select("game_id", "home_name", "away_name", (F.col("hd") == F.col("ad")).alias("same_division"))


@q("anti_missing", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def anti_missing(spark, d):
    """Keys nothing refers to."""
    c, o = tables(spark, d, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@q("semi_large_orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def semi_large_orders(spark, d):
    """Orders with some large line (a semi join)."""
    o, li = tables(spark, d, "orders", "lineitem")
    return o.join(li.where("l_quantity >= 49"), o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey", "o_custkey")


@q(
    "lossless_split",
    """WITH wide AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), again AS (SELECT o.*, c.* FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM wide) o JOIN (SELECT DISTINCT * FROM customer) c ON o_custkey = c_custkey)
SELECT 'lost' AS side, count(*) AS n FROM (SELECT * FROM wide EXCEPT ALL SELECT * FROM again) UNION ALL SELECT 'added', count(*) FROM (SELECT * FROM again EXCEPT ALL SELECT * FROM wide)""",
)
def lossless_split(spark, d):
    """Orders split from their customers and joined again: rows lost and added (none)."""
    o, c = tables(spark, d, "orders", "customer")
    wide = o.join(c, o.o_custkey == c.c_custkey)
    again = wide.select(*o.columns).join(wide.select(*c.columns).distinct(), F.col("o_custkey") == F.col("c_custkey")).select(*wide.columns)
    lost, added = wide.exceptAll(again), again.exceptAll(wide)
    return lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit("lost").alias("side"), "n").unionByName(added.agg(F.count(F.lit(1)).alias("n")).select(F.lit("added").alias("side"), "n"))


# --- the tables built from plays


@q("plays_latest", f"WITH {LATEST} SELECT season, count(*) AS n, count(DISTINCT game_id) AS n_games FROM latest GROUP BY 1")
def plays_latest(spark, d):
    """Plays and games per season, a redelivered play counted once."""
    return latest(spark, d).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("game_id").alias("n_games"))


@q(
    "drives",
    f"""WITH {LATEST} SELECT game_id, fixed_drive, count(*) AS n_plays, CAST(sum(yards_gained) AS BIGINT) AS yards, arg_min(game_seconds_remaining, play_id) AS start_clock, arg_max(game_seconds_remaining, play_id) AS end_clock,
  arg_min(yardline_100, play_id) AS start_yardline, max(qtr) AS last_qtr, count(*) FILTER (WHERE is_pass_call) AS n_passes FROM latest WHERE fixed_drive IS NOT NULL GROUP BY 1, 2""",
)
def drives(spark, d):
    """One row a drive."""
    return plays.drives(latest(spark, d))


@q(
    "team_games",
    f"""WITH {LATEST}, p AS (SELECT *, coalesce(is_designed_play, false) AS designed FROM latest WHERE posteam IS NOT NULL)
SELECT game_id, posteam, count(*) AS n_plays, count(*) FILTER (WHERE designed) AS n_designed, round(avg(epa) FILTER (WHERE designed), 9) AS epa_per_play, round(avg((epa > 0)::DOUBLE) FILTER (WHERE designed), 9) AS success_rate,
  round(count(*) FILTER (WHERE designed AND is_pass_call)::DOUBLE / nullif(count(*) FILTER (WHERE designed), 0), 9) AS pass_rate, CAST(sum(CASE WHEN down = 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_fourth FROM p GROUP BY 1, 2""",
)
def team_games(spark, d):
    """One row a game and team in possession."""
    return plays.team_games(latest(spark, d)).withColumns({c: F.round(c, 9) for c in ("epa_per_play", "success_rate", "pass_rate")})


@q(
    "mart_tendencies",
    f"""WITH {LATEST}, dp AS (SELECT * FROM latest WHERE is_designed_play AND posteam IS NOT NULL AND season IS NOT NULL),
a AS (SELECT posteam, season, count(*) AS designed_plays, round(avg(is_pass_call::INT), 9) AS pass_rate, round(avg(epa), 9) AS epa_per_play FROM dp GROUP BY 1, 2),
b AS (SELECT posteam, season, count(*) AS neutral_plays, round(avg(is_pass_call::INT), 9) AS neutral_pass_rate FROM dp WHERE is_neutral_script GROUP BY 1, 2),
c AS (SELECT posteam, season, round(count(*) FILTER (WHERE is_designed_play)::DOUBLE / count(*), 9) AS go_rate FROM latest WHERE down = 4 AND posteam IS NOT NULL AND season IS NOT NULL GROUP BY 1, 2)
SELECT * FROM a LEFT JOIN b USING (posteam, season) LEFT JOIN c USING (posteam, season)""",
)
def mart_tendencies(spark, d):
    """Team-season tendencies recomputed from the plays."""
    return plays.tendencies(latest(spark, d)).withColumns({c: F.round(c, 9) for c in ("pass_rate", "epa_per_play", "neutral_pass_rate", "go_rate")})


@q(
    "player_games",
    f"""WITH {LATEST}, s AS (SELECT game_id, passer_player_id AS player_id, 'passer' AS role, epa, yards_gained AS y FROM latest UNION ALL SELECT game_id, rusher_player_id, 'rusher', epa, yards_gained FROM latest
  UNION ALL SELECT game_id, receiver_player_id, 'receiver', epa, yards_gained FROM latest)
SELECT game_id, player_id, role, count(*) AS n_plays, CAST(sum(y) AS BIGINT) AS yards, round(sum(epa), 6) AS epa FROM s WHERE player_id IS NOT NULL GROUP BY 1, 2, 3""",
)
def player_games(spark, d):
    """Players' games by role, the roles stacked."""
    return plays.player_games(latest(spark, d)).withColumn("epa", r6(F.col("epa")))


@q(
    "credited_players",
    """WITH s AS (SELECT passer_player_id AS player_id, season FROM fact_plays UNION ALL SELECT rusher_player_id, season FROM fact_plays UNION ALL SELECT receiver_player_id, season FROM fact_plays),
b AS (SELECT player_id, season, count(*) AS n FROM s WHERE player_id IS NOT NULL GROUP BY 1, 2),
m AS (SELECT player_id, CAST(sum(n) OVER (PARTITION BY player_id) AS BIGINT) AS credited_plays, season AS main_season, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, season ASC NULLS LAST) AS r FROM b),
k AS (SELECT player_id, max(player_position) AS player_position FROM dim_player GROUP BY 1)
SELECT coalesce(m.player_id, k.player_id) AS player_id, coalesce(credited_plays, 0) AS credited_plays, main_season, player_position FROM (SELECT * FROM m WHERE r = 1) m FULL JOIN k ON m.player_id = k.player_id""",
)
def credited_players(spark, d):
    """Players of plays and dimension, with their commonest season (a mode with tie-break, a full outer join)."""
    return plays.credited_players(*tables(spark, d, "fact_plays", "dim_player"))


@q("season_dim", "SELECT season, count(DISTINCT CASE WHEN season_type = 'REG' THEN week END) AS regular_weeks, max(CASE WHEN season_type = 'POST' THEN week END) AS last_week, count(DISTINCT game_id) AS n_games FROM dim_game GROUP BY 1")
def season_dim(spark, d):
    """Seasons with conditional distinct counts."""
    g = table(spark, d, "dim_game")
    return g.groupBy("season").agg(F.countDistinct(F.when(F.col("season_type") == "REG", F.col("week"))).alias("regular_weeks"), F.max(F.when(F.col("season_type") == "POST", F.col("week"))).alias("last_week"), F.countDistinct("game_id").alias("n_games"))


# --- aggregations


@q(
    "filter_agg_nullrate",
    "SELECT season, count(*) FILTER (WHERE play_type IS NOT NULL) AS n_typed, round(avg((wp IS NULL)::INT), 6) AS wp_null_rate, round(avg((posteam_won IS NULL)::INT), 6) AS won_null_rate FROM fact_plays GROUP BY 1",
)
def filter_agg_nullrate(spark, d):
    """Filtered counts and null rates."""
    rate = lambda c: r6(F.avg(F.col(c).isNull().cast("int")))
    return table(spark, d, "fact_plays").groupBy("season").agg(F.count("play_type").alias("n_typed"), rate("wp").alias("wp_null_rate"), rate("posteam_won").alias("won_null_rate"))


@q("ordered_string_agg", "SELECT conference, string_agg(team, '/' ORDER BY team) AS teams FROM (SELECT DISTINCT conference, team FROM dim_team) GROUP BY 1")
def ordered_string_agg(spark, d):
    """Distinct values in one ordered string."""
    return table(spark, d, "dim_team").groupBy("conference").agg(F.array_join(F.array_sort(F.collect_set("team")), "/").alias("teams"))


@q("percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1")
def percentiles(spark, d):
    """Percentiles that are values of the data, whatever share of the rows a group holds."""
    return quantiles.exact(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@q(
    "group_corr",
    "WITH g AS (SELECT l_suppkey, avg(l_discount) AS a, avg(l_quantity) AS b, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 20) SELECT count(*) AS n_groups, CASE WHEN count(*) >= 3 THEN round(corr(a, b), 6) END AS r FROM g",
)
def group_corr(spark, d):
    """The correlation of two group metrics, null for fewer than three groups."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("a"), F.avg("l_quantity").alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.when(F.count(F.lit(1)) >= 3, r6(F.corr("a", "b"))).alias("r"))


@q(
    "binned_means",
    """WITH b AS (SELECT CAST(floor(yardline_100 / 5) AS INTEGER) * 5 AS yards_from, avg(yards_gained) AS m, count(*) AS n FROM fact_plays WHERE yardline_100 IS NOT NULL GROUP BY 1)
SELECT yards_from, n, round(CASE WHEN n >= 25 THEN m ELSE (SELECT avg(yards_gained) FROM fact_plays) END, 6) AS mean_gain FROM b""",
)
def binned_means(spark, d):
    """Means by bin; bins with too few rows get the overall mean."""
    p = table(spark, d, "fact_plays")
    whole = p.agg(F.avg("yards_gained")).scalar()
    b = p.where("yardline_100 IS NOT NULL").groupBy((F.floor(F.col("yardline_100") / 5).cast("int") * 5).alias("yards_from")).agg(F.count(F.lit(1)).alias("n"), F.avg("yards_gained").alias("m"))
    return b.select("yards_from", "n", r6(F.when(F.col("n") >= 25, F.col("m")).otherwise(whole)).alias("mean_gain"))


@q(
    "segment_volume",
    "SELECT c_mktsegment, year(o_orderdate) AS y, count(*) AS n, round(sum(o_totalprice) / count(*), 4) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) >= 5",
)
def segment_volume(spark, d):
    """Groups above a minimum volume."""
    o, c = tables(spark, d, "orders", "customer")
    g = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", F.year("o_orderdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice") / F.count(F.lit(1)), 4).alias("mean_price"))
    return g.where("n >= 5")


# --- windows


@q("top1_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def top1_per_key(spark, d):
    """Each customer's largest order."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@q(
    "lead_pairs",
    f"""WITH {LATEST}, w AS (SELECT game_id, play_id, posteam, lead(posteam) OVER g AS next_team, lead(yardline_100) OVER g AS next_yardline FROM latest WINDOW g AS (PARTITION BY game_id ORDER BY play_id, play_key))
SELECT game_id, play_id, posteam, next_team, next_yardline FROM w WHERE posteam <> next_team""",
)
def lead_pairs(spark, d):
    """Plays after which the other team has the ball."""
    w = Window.partitionBy("game_id").orderBy("play_id", "play_key")
    p = latest(spark, d).withColumns({"next_team": F.lead("posteam").over(w), "next_yardline": F.lead("yardline_100").over(w)})
    return p.where("posteam <> next_team").select("game_id", "play_id", "posteam", "next_team", "next_yardline")


@q("share_of_total", "SELECT lower(trim(play_type)) AS kind, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM fact_plays GROUP BY 1")
def share_of_total(spark, d):
    """The mix of play types: a window over an aggregate."""
    g = table(spark, d, "fact_plays").groupBy(F.lower(F.btrim("play_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))


@q(
    "event_deltas",
    """SELECT user_id, event_id, row_number() OVER w - 1 AS sequence, round(value - coalesce(lag(value) OVER w, value), 6) AS change, least(greatest(coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), 0) / 1e6, 0), 5) AS pause
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def event_deltas(spark, d):
    """Sequence number, change and clipped pause against the event before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events")
    return e.select(
        "user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("sequence"), r6(F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value"))).alias("change"),
        F.least(F.greatest(F.coalesce(us - F.lag(us).over(w), F.lit(0)) / 1e6, F.lit(0.0)), F.lit(5.0)).alias("pause"),
    )


# --- sets


@q(
    "set_ops",
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'except_all', count(*) FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer)""",
)
def set_ops(spark, d):
    """Union, intersection and difference, with and without repeats."""
    o, c = tables(spark, d, "orders", "customer")
    a, b = o.select(F.col("o_custkey").alias("k")), c.select(F.col("c_custkey").alias("k"))
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": b.subtract(a), "except_all": a.exceptAll(b)}
    out = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("op"), "n") for n, x in ops.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@q("partition_changes", """WITH a AS (SELECT season, bit_xor(hash(play_key)) AS h FROM fact_plays GROUP BY 1), b AS (SELECT season, count(*) AS n FROM fact_plays WHERE yards_gained < 0 GROUP BY 1)
SELECT season, 'changed' AS state FROM a JOIN b USING (season)""")
def partition_changes(spark, d):
    """Seasons whose content changes when losses are recorded as zero: what an incremental build must redo."""
    p = table(spark, d, "fact_plays")
    row = ["play_key", "yards_gained", "loaded_at"]
    of = lambda x: x.where("season IS NOT NULL").groupBy("season").agg(F.sum(F.xxhash64(*row).cast("decimal(38,0)")).alias("h"))
    return store.changed_partitions(of(p), of(p.withColumn("yards_gained", floor_zero(F.col("yards_gained")))), "season")


@q(
    "upsert_players",
    """WITH b AS (SELECT player_id, full_name, loaded_at, 0 AS fresh FROM dim_player UNION ALL SELECT player_id, upper(full_name), loaded_at, 1 FROM dim_player WHERE removed_at IS NULL)
SELECT player_id, full_name, loaded_at FROM b QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY loaded_at DESC NULLS LAST, fresh DESC, full_name DESC NULLS LAST) = 1""",
)
def upsert_players(spark, d):
    """Stored rows overwritten by new ones of the same key, the latest version kept."""
    p = table(spark, d, "dim_player").select("player_id", "full_name", "loaded_at", "removed_at")
    one = lambda x: x.groupBy("player_id", "loaded_at").agg(F.max("full_name").alias("full_name"))
    return store.upsert(one(p), one(p.where("removed_at IS NULL").withColumn("full_name", F.upper("full_name"))), ["player_id"], "loaded_at").select("player_id", "full_name", "loaded_at")


# --- scalars, JSON, text


@q(
    "json_dead_letters",
    """WITH d AS (SELECT CASE WHEN raw_record IS NULL THEN 'empty' WHEN NOT json_valid(raw_record) THEN 'not json' WHEN json_type(raw_record) <> 'OBJECT' THEN 'not an object'
  WHEN json_extract_string(raw_record, '$.game_id') IS NULL THEN 'missing game_id' WHEN json_extract_string(raw_record, '$.season') IS NULL THEN 'missing season' END AS reason FROM stg_plays)
SELECT reason, count(*) AS n FROM d GROUP BY 1""",
)
def json_dead_letters(spark, d):
    """Raw records by the reason they can't be used."""
    return score.decode(table(spark, d, "stg_plays"), "raw_record", ["game_id", "season"]).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@q("rendering", "SELECT game_id, home_team || ' ' || home_score || ', ' || away_team || ' ' || away_score || CASE WHEN abs(home_margin) = 1 THEN ' (1 point)' ELSE ' (' || abs(home_margin) || ' points)' END AS line FROM dim_game")
def rendering(spark, d):
    """Rows rendered as text."""
    m = F.abs(F.col("home_margin"))
    points = F.when(m == 1, " (1 point)").otherwise(F.concat(F.lit(" ("), m.cast("string"), F.lit(" points)")))
    s = lambda c: F.col(c).cast("string")
    return table(spark, d, "dim_game").select("game_id", F.concat("home_team", F.lit(" "), s("home_score"), F.lit(", "), "away_team", F.lit(" "), s("away_score"), points).alias("line"))


@q(
    "fuzzy_names",
    """WITH g AS (SELECT short_name, count(*) AS n, min(full_name) AS a, max(full_name) AS b FROM dim_player WHERE full_name IS NOT NULL GROUP BY 1)
SELECT short_name, n, a, b, jaro_winkler_similarity(a, b) >= 0.88 AS alike, jaro_winkler_similarity(a, short_name) >= 0.7 AS short_alike FROM g""",
)
def fuzzy_names(spark, d):
    """Full names that share a short name, and how alike they are to each other and to it."""
    p = table(spark, d, "dim_player").where("full_name IS NOT NULL")
    g = p.groupBy("short_name").agg(F.count(F.lit(1)).alias("n"), F.min("full_name").alias("a"), F.max("full_name").alias("b"))
    return g.select("short_name", "n", "a", "b", (jaro_winkler("a", "b") >= 0.88).alias("alike"), (jaro_winkler("a", "short_name") >= 0.7).alias("short_alike"))


@q(
    "fuzzy_lookup",
    """WITH p AS (SELECT short_name, lower(regexp_extract(short_name, '[^.]+$')) AS surname, TRY_CAST(regexp_extract(player_id, '[0-9]+$') AS bigint) AS no FROM dim_player),
a AS (SELECT DISTINCT substr(surname, 1, 2) || substr(surname, 4, 1) || substr(surname, 3, 1) || substr(surname, 5) AS asked FROM p WHERE no % 20 = 0 AND length(surname) > 3),
n AS (SELECT short_name, surname, count(*) AS n FROM p WHERE surname <> '' GROUP BY 1, 2)
SELECT asked, short_name, n, round(jaro_winkler_similarity(asked, surname), 9) AS similarity FROM a, n WHERE round(jaro_winkler_similarity(asked, surname), 9) >= 0.88""",
)
def fuzzy_lookup(spark, d):
    """Misspelt surnames (of players whose number is divisible by 20, third and fourth letter swapped) against all players' surnames."""
    s = F.col("surname")
    p = table(spark, d, "dim_player").select("short_name", F.lower(F.regexp_extract("short_name", "[^.]+$", 0)).alias("surname"), F.regexp_extract("player_id", "[0-9]+$", 0).try_cast("long").alias("no"))
    misspelt = F.concat(F.substring(s, 1, 2), F.substring(s, 4, 1), F.substring(s, 3, 1), F.expr("substring(surname, 5)"))
    asked = p.where((F.col("no") % 20 == 0) & (F.length(s) > 3)).select(misspelt.alias("asked"))
    n = p.where(s != "").groupBy("short_name", "surname").agg(F.count(F.lit(1)).alias("n"))
    return alike_names(asked, n.select(s.alias("name"))).join(n.withColumnRenamed("surname", "name"), "name").select("asked", "short_name", "n", "similarity")


@q("exploded_teams", "SELECT team, count(*) AS n FROM (SELECT unnest(teams) AS team FROM documents) GROUP BY 1")
def exploded_teams(spark, d):
    """Array elements as rows."""
    return table(spark, d, "documents").select(F.explode("teams").alias("team")).groupBy("team").agg(F.count(F.lit(1)).alias("n"))


@q("route_questions", """SELECT CASE WHEN regexp_matches(lower(text), '(fourth|cuarta|quatrième|vierte)') THEN 'decision' WHEN regexp_matches(lower(text), '(percent|prozent|pour cent|por ciento)') THEN 'rate'
  WHEN regexp_matches(lower(text), '[0-9]+ (yards|yardas|days|tage)') THEN 'number' ELSE 'story' END AS route, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def route_questions(spark, d):
    """Texts routed by their words, first match first."""
    t = F.lower("text")
    route = F.when(t.rlike("(fourth|cuarta|quatrième|vierte)"), "decision").when(t.rlike("(percent|prozent|pour cent|por ciento)"), "rate").when(t.rlike("[0-9]+ (yards|yardas|days|tage)"), "number").otherwise("story")
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


# --- checks


@q(
    "contract_report",
    r"""SELECT unnest([{'check_name': 'not_null', 'column_name': 'season', 'n_failed': count(*) FILTER (WHERE season IS NULL)}, {'check_name': 'in_range', 'column_name': 'wp', 'n_failed': count(*) FILTER (WHERE NOT wp BETWEEN 0.02 AND 0.98)},
  {'check_name': 'accepted_values', 'column_name': 'play_type', 'n_failed': count(*) FILTER (WHERE play_type NOT IN ('pass', 'run', 'punt', 'kickoff'))}, {'check_name': 'matches', 'column_name': 'game_id', 'n_failed': count(*) FILTER (WHERE NOT regexp_full_match(game_id, '[0-9]{4}_[0-9]{2}_[A-Z]+_[A-Z]+'))}], recursive := true), count(*) AS n_rows FROM fact_plays""",
)
def contract_report(spark, d):
    """All checks of a table in one pass."""
    checks = [quality.not_null("season"), quality.in_range("wp", 0.02, 0.98), quality.accepted("play_type", ["pass", "run", "punt", "kickoff"]), quality.matches("game_id", r"^[0-9]{4}_[0-9]{2}_[A-Z]+_[A-Z]+$")]
    return quality.report(table(spark, d, "fact_plays"), checks)


@q("repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, d):
    """Keys that aren't unique."""
    return quality.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@q("constancy", "SELECT game_id, unnest(list_filter([CASE WHEN count(DISTINCT home_score) > 1 THEN 'home_score' END, CASE WHEN count(DISTINCT moved_from) > 1 THEN 'moved_from' END, CASE WHEN count(DISTINCT loaded_at) > 1 THEN 'loaded_at' END], lambda x: x IS NOT NULL)) AS column_name FROM dim_game GROUP BY 1")
def constancy(spark, d):
    """Games whose attributes aren't the same in all their rows."""
    return quality.not_constant(table(spark, d, "dim_game"), "game_id", ["home_score", "moved_from", "loaded_at"])


@q("volume_bands", "SELECT game_id, count(*) AS n, count(*) NOT BETWEEN 40 AND 200 AS outside FROM fact_plays GROUP BY 1")
def volume_bands(spark, d):
    """Rows per game against a band."""
    g = table(spark, d, "fact_plays").groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("outside", ~F.col("n").between(40, 200))


@q(
    "filter_probe",
    """SELECT count(*) FILTER (WHERE b AND c) AS without_first, count(*) FILTER (WHERE a AND c) AS without_second, count(*) FILTER (WHERE a AND b) AS without_third, count(*) FILTER (WHERE a AND b AND c) AS all_terms
FROM (SELECT down = 4 AS a, yardline_100 <= 5 AS b, posteam = 'CRW' AS c FROM fact_plays)""",
)
def filter_probe(spark, d):
    """Rows that would remain without each term of a filter, in one pass."""
    terms = {"first": F.col("down") == 4, "second": F.col("yardline_100") <= 5, "third": F.col("posteam") == "CRW"}

    def but(name):
        kept = [t for n, t in terms.items() if n != name]
        out = kept[0]
        for t in kept[1:]:
            out = out & t
        return F.count_if(is_true(out))

    return table(spark, d, "fact_plays").agg(*[but(n).alias(f"without_{n}") for n in terms], but("").alias("all_terms"))


# --- retrieval and metrics


def _first_vector(spark, d):
    return list(table(spark, d, "embeddings").where("vec_id = 0").first().embedding)


@q(
    "dense_topk",
    """WITH s AS (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 12) AS score FROM embeddings e)
SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 20""",
)
def dense_topk(spark, d):
    """The twenty vectors nearest to the first."""
    return retrieval.dense_rank(table(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d), 20).withColumn("score", r6(F.col("score")))


_LEX = r"""t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x IN ('salary', 'cap', 'cache', 'layer'))) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
lex AS (SELECT doc_id, round(sum(ln(1 + tf) * ln(1 + (SELECT count(*) FROM documents) / df)), 6) AS score FROM tf JOIN df USING (term) GROUP BY 1)"""


@q("lexical_topk", f"WITH {_LEX} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM lex ORDER BY score DESC, doc_id LIMIT 20")
def lexical_topk(spark, d):
    """The twenty documents that fit the words best."""
    return retrieval.lexical_rank(table(spark, d, "documents"), "doc_id", "text", "salary cap, cache layer", 20)


@q(
    "rrf_fusion",
    f"""WITH {_LEX}, l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rb FROM lex QUALIFY rb <= 50),
s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 12) AS score FROM embeddings),
v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS ra FROM s QUALIFY ra <= 50)
SELECT coalesce(v.doc_id, l.doc_id) AS doc_id, round(coalesce(1.0 / (60 + ra), 0) + coalesce(1.0 / (60 + rb), 0), 9) AS fused, CASE WHEN ra IS NULL THEN 'lexical' WHEN rb IS NULL THEN 'dense' ELSE 'both' END AS found_by
FROM v FULL JOIN l ON v.doc_id = l.doc_id""",
)
def rrf_fusion(spark, d):
    """Dense and lexical rankings fused by reciprocal ranks."""
    dense = retrieval.dense_rank(table(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d), 50).withColumnRenamed("vec_id", "doc_id")
    return retrieval.fuse(dense, retrieval.lexical_rank(table(spark, d, "documents"), "doc_id", "text", "salary cap, cache layer", 50), "doc_id")


_SCORED = "x AS (SELECT least(greatest(wp, 0), 1) AS p, posteam_won::INT::DOUBLE AS label FROM fact_plays WHERE wp IS NOT NULL AND posteam_won IS NOT NULL AND NOT isnan(wp))"


def _scored(spark, d):
    p = table(spark, d, "fact_plays").where("wp IS NOT NULL AND posteam_won IS NOT NULL AND NOT isnan(wp)")
    return p.select(F.least(F.greatest("wp", F.lit(0.0)), F.lit(1.0)).alias("p"), F.col("posteam_won").cast("double").alias("label"))


@q(
    "model_scores",
    f"""WITH {_SCORED}, y AS (SELECT *, least(greatest(p, 1e-7), 1 - 1e-7) AS c FROM x)
SELECT count(*) AS n, round(avg(-(label * ln(c) + (1 - label) * ln(1 - c))), 6) AS log_loss, round(avg((p - label) * (p - label)), 6) AS brier, round(avg(((p >= 0.5)::INT::DOUBLE = label)::INT), 6) AS accuracy FROM y""",
)
def model_scores(spark, d):
    """Log loss, Brier score and accuracy of the recorded win probability."""
    return models.metrics(_scored(spark, d)).select("n", *[r6(F.col(c)).alias(c) for c in ("log_loss", "brier", "accuracy")])


@q("calibration_bins", f"WITH {_SCORED} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(label), 6) AS observed FROM x GROUP BY 1")
def calibration_bins(spark, d):
    """Predicted against observed shares."""
    return models.calibration(_scored(spark, d)).select("bin", "n", r6(F.col("predicted")).alias("predicted"), r6(F.col("observed")).alias("observed"))


@q("rank_auc", f"WITH {_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM x) SELECT round((sum(k * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auc FROM r")
def rank_auc(spark, d):
    """Area under the curve by ranks, ties sharing theirs."""
    return models.rank_auc(_scored(spark, d)).select(r6(F.col("auc")).alias("auc"))


@q(
    "possession_flip",
    """SELECT play_key, loaded_at, least(greatest(100 - yardline_100, 1), 99) AS yardline_100, -score_differential AS score_differential, greatest(game_seconds_remaining - 6, 0) AS game_seconds_remaining, 1 AS down,
  least(10, least(greatest(100 - yardline_100, 1), 99)) AS ydstogo FROM fact_plays WHERE yardline_100 IS NOT NULL AND game_seconds_remaining IS NOT NULL AND score_differential IS NOT NULL""",
)
def possession_flip(spark, d):
    """The state the other side gets."""
    p = table(spark, d, "fact_plays").where("yardline_100 IS NOT NULL AND game_seconds_remaining IS NOT NULL AND score_differential IS NOT NULL")
    return models.flipped(p).select("play_key", "loaded_at", "yardline_100", "score_differential", "game_seconds_remaining", "down", "ydstogo")


#: Seasons up to the first are for training, from the second on for testing; those between are for validation.
FIRST_VALID, FIRST_TEST = 2014, 2016
WIN_KINDS = ["logistic", "network"]
_TEST = f"""{LATEST}, frame AS (SELECT season, posteam_won::INT::DOUBLE AS label, wp FROM latest WHERE posteam_won IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in models.PRE_SNAP)})"""


def _frame(spark, d, target):
    df = latest(spark, d)
    return cut(models.design(df.where("is_designed_play") if target == "is_pass_call" else df, target, models.PRE_SNAP))


@q("win_model")
def win_model(spark, d):
    """A network for winning, or a plain model where the validation seasons prefer it, trained on earlier seasons and scored on later ones."""
    train, valid, test = models.season_split(_frame(spark, d, "posteam_won"), FIRST_VALID, FIRST_TEST)
    return models.metrics(models.score(models.best(train, valid, models.PRE_SNAP, WIN_KINDS), test))


@q("play_call_model")
def play_call_model(spark, d):
    """Boosted trees for pass or run, stopped by the validation seasons, calibrated on later ones."""
    train, valid, test = models.season_split(_frame(spark, d, "is_pass_call"), FIRST_VALID, FIRST_TEST)
    return models.calibration(models.score(models.fit(train, models.PRE_SNAP, "trees", valid), test))


@q("model_gates", f"WITH {_TEST} SELECT 'win' AS model, count(*) AS n, true AS finite, true AS beats_base_rate FROM frame WHERE season >= {FIRST_TEST}")
def model_gates(spark, d):
    """What the win model must do before it is published: finite predictions and a log loss below that of the base rate of its training seasons."""
    train, valid, test = models.season_split(_frame(spark, d, "posteam_won"), FIRST_VALID, FIRST_TEST)
    scored = cut(models.score(models.best(train, valid, models.PRE_SNAP, WIN_KINDS), test).select("label", "p", models.base_rate(train).alias("base")))
    base_loss = models.metrics(scored, "base").select("log_loss").scalar()
    finite = ~F.isnan("log_loss") & F.col("log_loss").isNotNull()
    return models.metrics(scored).select(F.lit("win").alias("model"), "n", finite.alias("finite"), (F.col("log_loss") < base_loss).alias("beats_base_rate"))


@q(
    "model_baselines",
    f"""WITH {_TEST}, b AS (SELECT least(greatest((SELECT avg(label) FROM frame WHERE season < {FIRST_VALID}), 1e-7), 1 - 1e-7) AS base), t AS (SELECT label, base, least(greatest(wp, 1e-7), 1 - 1e-7) AS p FROM frame, b WHERE season >= {FIRST_TEST} AND wp IS NOT NULL AND NOT isnan(wp))
SELECT 'base rate' AS model, count(*) AS n, round(avg(-(label * ln(base) + (1 - label) * ln(1 - base))), 6) AS log_loss, round(avg((base - label) ^ 2), 6) AS brier FROM t
UNION ALL SELECT 'recorded', count(*), round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6), round(avg((p - label) ^ 2), 6) FROM t""",
)
def model_baselines(spark, d):
    """What a win model has to beat on the test seasons: the base rate of training, and the probabilities recorded with the plays."""
    frame = models.design(latest(spark, d), "posteam_won", models.PRE_SNAP, ["wp"])
    train, _, test = models.season_split(frame, FIRST_VALID, FIRST_TEST)
    sound = test.where("wp IS NOT NULL AND NOT isnan(wp)").select("label", F.least(F.greatest("wp", F.lit(1e-7)), F.lit(1 - 1e-7)).alias("recorded"), models.base_rate(train).alias("base"))
    of = lambda name, c: models.metrics(sound, c).select(F.lit(name).alias("model"), "n", r6(F.col("log_loss")).alias("log_loss"), r6(F.col("brier")).alias("brier"))
    return of("base rate", "base").unionByName(of("recorded", "recorded"))


# --- replay


_FEED = "f AS (SELECT * FROM feed WHERE game_id IS NOT NULL AND sequence_no IS NOT NULL)"


@q(
    "feed_changes",
    f"""WITH {_FEED}, s AS (SELECT partition_no, msg_offset, game_id, round(home_wp, 4) AS score, row_number() OVER w - 1 AS sequence, lag(round(home_wp, 4)) OVER w AS b FROM f WINDOW w AS (PARTITION BY game_id ORDER BY sequence_no, received_at, partition_no, msg_offset))
SELECT partition_no, msg_offset, score, sequence, round(score - coalesce(b, score), 4) AS change FROM s""",
)
def feed_changes(spark, d):
    """Every result's change against the one before: the batch twin of the stream."""
    f = table(spark, d, "feed").where("game_id IS NOT NULL AND sequence_no IS NOT NULL")
    out = score.changes(f, "game_id", ["sequence_no", "received_at", "partition_no", "msg_offset"], "home_wp")
    return out.select("partition_no", "msg_offset", "score", F.col("sequence").cast("long").alias("sequence"), "change")


@q(
    "lead_changes",
    f"""WITH {_FEED}, s AS (SELECT *, abs(home_wp - lag(home_wp) OVER w) AS swing, CASE WHEN home_wp > 0.5 THEN 1 WHEN home_wp < 0.5 THEN -1 END AS side FROM f WINDOW w AS (PARTITION BY game_id ORDER BY sequence_no, received_at, partition_no, msg_offset)),
b AS (SELECT *, last_value(side IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY sequence_no, received_at, partition_no, msg_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT game_id, CAST(coalesce(sum((side <> before)::INT), 0) AS BIGINT) AS lead_changes, round(max(swing), 4) AS biggest_swing FROM b GROUP BY 1""",
)
def lead_changes(spark, d):
    """Lead changes and the biggest swing of each game."""
    f = table(spark, d, "feed").where("game_id IS NOT NULL AND sequence_no IS NOT NULL")
    return score.lead_changes(f, "game_id", ["sequence_no", "received_at", "partition_no", "msg_offset"], "home_wp")


@q("replay_end", f"WITH {_FEED} SELECT game_id, arg_max(home_score, sequence_no * 10000000000 + msg_offset) AS home_score, arg_max(description, sequence_no * 10000000000 + msg_offset) AS description FROM f GROUP BY 1")
def replay_end(spark, d):
    """The last known score and description of each game, unknown ones passed over."""
    f = table(spark, d, "feed").where("game_id IS NOT NULL AND sequence_no IS NOT NULL")
    by = F.col("sequence_no").cast("long") * 10_000_000_000 + F.col("msg_offset")
    return f.groupBy("game_id").agg(max_by_known(F.col("home_score"), by).alias("home_score"), max_by_known(F.col("description"), by).alias("description"))


# --- beyond the reference: event time


@q("hourly_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def hourly_windows(spark, d):
    """Tumbling windows of event time."""
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@q("rollup_sales", "SELECT r_name, n_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_sales(spark, d):
    """Subtotals of subtotals."""
    c, n, r = tables(spark, d, "customer", "nation", "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_customers"))


