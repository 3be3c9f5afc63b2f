"""Queries of the operators that care for the data itself: orphans, copies, drift, differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashmark.operators import delivery, diff, drift, orphans
from hashmark.plans.registry import Registry
from hashmark.sources.tables import tables

registry = Registry()

#: The id rule in SQL: {c} is the id, the parts of a game id are looked up among former club codes.
_CLEAN = "upper(replace(trim({c}, ' ' || chr(9)), '-', '_'))"
ALIASES_CTE = f"""aliases AS (SELECT map(list(f), list(t)) AS m FROM (
  SELECT {_CLEAN.format(c='former_team')} AS f, min({_CLEAN.format(c='team')}) AS t FROM dim_team WHERE trim(former_team) <> '' GROUP BY 1))"""


def game_sql(c: str) -> str:
    clean = _CLEAN.format(c=c)
    return f"CASE WHEN {clean} <> '' THEN array_to_string(list_transform(string_split({clean}, '_'), lambda p: coalesce(m[p], p)), '_') END"


def player_sql(c: str) -> str:
    clean = _CLEAN.format(c=c)
    return f"CASE WHEN {clean} NOT IN ('', 'NA', 'NULL', 'NONE', 'UNKNOWN') THEN {clean} END"


_REFS = f"""WITH {ALIASES_CTE},
refs AS (
  SELECT play_key, season, loaded_at AS t, 'game_id' AS ref_field, 'game' AS target, {game_sql('game_id')} AS k FROM fact_plays, aliases
  UNION ALL SELECT play_key, season, loaded_at, 'passer_player_id', 'player', {player_sql('passer_player_id')} FROM fact_plays
  UNION ALL SELECT play_key, season, loaded_at, 'receiver_player_id', 'player', {player_sql('receiver_player_id')} FROM fact_plays),
parents AS (
  SELECT 'game' AS target, {game_sql('game_id')} AS k, loaded_at AS a, removed_at AS b FROM dim_game, aliases
  UNION ALL SELECT 'player', {player_sql('player_id')}, loaded_at, removed_at FROM dim_player),
judged AS (
  SELECT r.*, EXISTS (SELECT 1 FROM parents p WHERE p.target = r.target AND p.k = r.k AND p.a <= r.t AND (p.b IS NULL OR p.b > r.t)) AS there,
    EXISTS (SELECT 1 FROM parents p WHERE p.target = r.target AND p.k = r.k) AS known,
    EXISTS (SELECT 1 FROM parents p WHERE p.target = r.target AND p.k = r.k AND p.a <= r.t) AS begun
  FROM refs r WHERE k IS NOT NULL)
"""


@registry.query("p1_found", _REFS + "SELECT DISTINCT play_key, ref_field FROM judged WHERE NOT there")
def p1_found(spark, sf_dir):
    """References of plays to games and players that weren't there when the play arrived."""
    return orphans.orphan_cases(*tables(spark, sf_dir, "fact_plays", "dim_game", "dim_player", "dim_team"))


@registry.query(
    "p1_report",
    _REFS
    + """SELECT ref_field, season, CASE WHEN there THEN 'resolved' WHEN NOT known THEN 'never existed' WHEN begun THEN 'was removed' ELSE 'came later' END AS status,
  count(*) AS n_references FROM judged GROUP BY ALL""",
)
def p1_report(spark, sf_dir):
    """References per referring field, season and what became of their target."""
    return orphans.orphan_report(*tables(spark, sf_dir, "fact_plays", "dim_game", "dim_player", "dim_team"))


_FEED = f"""WITH {ALIASES_CTE},
named AS (SELECT feed.*, {game_sql('game_id')} AS game_key FROM feed, aliases),
marked AS (SELECT *, game_key IS NOT NULL AND sequence_no IS NOT NULL AND row_number() OVER (
  PARTITION BY game_key, sequence_no ORDER BY received_at DESC NULLS LAST, msg_offset DESC, partition_no DESC) > 1 AS is_copy FROM named)
"""


@registry.query("p4_found", _FEED + "SELECT partition_no, msg_offset FROM marked WHERE is_copy")
def p4_found(spark, sf_dir):
    """Deliveries of the feed that are copies of a later one."""
    return delivery.dropped(*tables(spark, sf_dir, "feed", "dim_team"))


@registry.query("p4_absorbed", _FEED + "SELECT partition_no, msg_offset, received_at >= '2018-01-01' AS is_new FROM marked WHERE NOT is_copy")
def p4_absorbed(spark, sf_dir):
    """The deliveries to keep, where those from 2018 on come as a batch to what is stored."""
    feed, teams = tables(spark, sf_dir, "feed", "dim_team")
    kept = delivery.feed_absorbed(feed.select("partition_no", "msg_offset", "game_id", "sequence_no", "received_at"), teams, "2018-01-01")
    return kept.select("partition_no", "msg_offset", (F.col("received_at") >= "2018-01-01").alias("is_new"))


@registry.query(
    "p4_games",
    _FEED + "SELECT game_key, count(*) AS n_results, count(*) FILTER (WHERE NOT coalesce(is_final, false)) AS n_plays FROM marked WHERE NOT is_copy GROUP BY 1",
)
def p4_games(spark, sf_dir):
    """Results and plays per game, every one counted once."""
    return delivery.feed_games(*tables(spark, sf_dir, "feed", "dim_team"))


@registry.query(
    "p4_summary",
    _FEED
    + f""", counted AS (SELECT game_key, count(*) FILTER (WHERE NOT coalesce(is_final, false)) AS n_plays FROM marked WHERE NOT is_copy GROUP BY 1),
told AS (SELECT {game_sql('game_id')} AS game_key, plays, summarized_at FROM summary, aliases),
latest AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY game_key ORDER BY summarized_at DESC NULLS LAST, plays DESC NULLS LAST) = 1)
SELECT game_key, plays AS reported_plays, coalesce(n_plays, 0) AS n_plays FROM latest LEFT JOIN counted USING (game_key) WHERE game_key IS NOT NULL""",
)
def p4_summary(spark, sf_dir):
    """Summary.plays as reported beside the plays of the cleaned feed."""
    return delivery.summary_corrections(*tables(spark, sf_dir, "summary", "feed", "dim_team"))


_DRIFT = f"""WITH {ALIASES_CTE},
recs AS (SELECT feed_name, file_name, line_no, CAST(raw_record AS JSON) AS j FROM stg_plays
  WHERE CASE WHEN json_valid(raw_record) THEN json_type(raw_record) = 'OBJECT' ELSE false END),
files AS (SELECT feed_name, file_name, row_number() OVER (PARTITION BY feed_name ORDER BY delivered_at, file_name) AS seq FROM (
  SELECT feed_name, file_name, min(delivered_at) AS delivered_at FROM stg_plays GROUP BY 1, 2)),
vals AS (SELECT feed_name, seq, {game_sql("j ->> '$.game_id'")} AS game, trim(j ->> '$.play_id', ' ' || chr(9)) AS play, field, j -> ('$."' || field || '"') AS v
  FROM (SELECT *, unnest(json_keys(j)) AS field FROM recs) JOIN files USING (feed_name, file_name), aliases WHERE field NOT IN ('game_id', 'play_id')),
typed AS (SELECT *, CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN 1 WHEN 'BIGINT' THEN 2 WHEN 'UBIGINT' THEN 2 WHEN 'HUGEINT' THEN 2 WHEN 'DOUBLE' THEN 3 ELSE 4 END AS kind,
  trim(v ->> '$', ' ' || chr(9) || chr(10) || chr(13)) AS txt FROM vals),
n AS (SELECT feed_name, seq, count(*) AS n FROM recs JOIN files USING (feed_name, file_name) GROUP BY 1, 2),
cnt AS (SELECT feed_name, seq, field, sum(c) AS c, arg_max(kind, hits * 10 - kind) FILTER (WHERE kind IS NOT NULL) AS kind FROM (
  SELECT feed_name, seq, field, kind, count(*) AS c, count(kind) AS hits FROM typed GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
belongs AS (SELECT cnt.*, seq - row_number() OVER (PARTITION BY feed_name, field ORDER BY seq) AS island FROM cnt JOIN n USING (feed_name, seq) WHERE 2 * c >= n),
cat AS (SELECT feed_name, seq, field, last_value(kind IGNORE NULLS) OVER (PARTITION BY feed_name, field, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS kind FROM belongs),
born AS (SELECT c.* FROM cat c ANTI JOIN cat p ON p.feed_name = c.feed_name AND p.field = c.field AND p.seq = c.seq - 1 WHERE c.seq > 1),
gone AS (SELECT p.feed_name, p.seq + 1 AS seq, p.field, p.kind FROM cat p SEMI JOIN files f ON f.feed_name = p.feed_name AND f.seq = p.seq + 1
  ANTI JOIN cat c ON p.feed_name = c.feed_name AND p.field = c.field AND c.seq = p.seq + 1),
ren AS (SELECT b.feed_name, b.seq, b.field AS new, g.field AS old, min(b.kind) AS k2, min(g.kind) AS k1, count(*) AS c
  FROM born b JOIN gone g USING (feed_name, seq)
  JOIN typed x ON x.feed_name = b.feed_name AND x.seq = b.seq AND x.field = b.field AND x.kind IS NOT NULL
  JOIN typed y ON y.feed_name = b.feed_name AND y.seq = b.seq - 1 AND y.field = g.field AND y.kind IS NOT NULL AND x.game = y.game AND x.play = y.play
  GROUP BY 1, 2, 3, 4 HAVING bool_and(x.txt = y.txt OR coalesce(try_cast(x.txt AS DOUBLE) = try_cast(y.txt AS DOUBLE), false))),
best AS (SELECT * FROM ren QUALIFY row_number() OVER (PARTITION BY feed_name, seq, new ORDER BY c DESC, old) = 1),
log AS (SELECT feed_name, seq, 'renamed' AS change_kind, new AS field_name FROM best
  UNION ALL SELECT feed_name, seq, 'retyped', new FROM best WHERE k1 <> k2
  UNION ALL SELECT feed_name, seq, 'added', field FROM born b ANTI JOIN ren ON ren.feed_name = b.feed_name AND ren.seq = b.seq AND ren.new = b.field
  UNION ALL SELECT feed_name, seq, 'removed', field FROM gone g ANTI JOIN ren ON ren.feed_name = g.feed_name AND ren.seq = g.seq AND ren.old = g.field
  UNION ALL SELECT c.feed_name, c.seq, 'retyped', c.field FROM cat c JOIN cat p ON p.feed_name = c.feed_name AND p.field = c.field AND p.seq = c.seq - 1 WHERE c.kind <> p.kind)
"""


@registry.query("p5_found", _DRIFT + "SELECT file_name, change_kind, field_name FROM log JOIN files USING (feed_name, seq)")
def p5_found(spark, sf_dir):
    """Changes of the raw files' fields, each file against the one before it in its feed."""
    return drift.change_cases(*tables(spark, sf_dir, "stg_plays", "dim_team"))


@registry.query(
    "p5_lifespans",
    _DRIFT
    + f"""SELECT feed_name, field, {drift.KINDS}[kind] AS type, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_files
FROM (SELECT *, seq - row_number() OVER (PARTITION BY feed_name, field, kind ORDER BY seq) AS stretch FROM cat) GROUP BY feed_name, field, kind, stretch""",
)
def p5_lifespans(spark, sf_dir):
    """Where each field of a feed has which type: the unbroken stretches of files."""
    stg, teams = tables(spark, sf_dir, "stg_plays", "dim_team")
    spans = drift.lifespans(drift.catalogue(drift.field_values(drift.records(stg, teams)), drift.files(stg)))
    return spans.withColumns({c: spans[c].cast("long") for c in ("first_seq", "last_seq")})


_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _held(name: str) -> str:
    """The first value that a record holds under one of the field's spellings, as text."""
    spelled = dict.fromkeys(map(drift.folded, drift.ALIASES[name][1]))
    return f"trim(coalesce({', '.join(f"list_filter(fs, lambda e: e.fold = '{x}' AND e.v IS NOT NULL)[1].v" for x in spelled)}), {_WS})"


def _cast(name: str) -> str:
    kind = drift.ALIASES[name][0]
    if kind == "int":
        return f"CASE WHEN try_cast({name} AS DOUBLE) = floor(try_cast({name} AS DOUBLE)) THEN try_cast(try_cast({name} AS DOUBLE) AS INTEGER) END AS {name}"
    if kind == "boolean":
        return f"CASE WHEN lower({name}) IN ('true', 'y', 'yes', 't', '1') THEN true WHEN lower({name}) IN ('false', 'n', 'no', 'f', '0') THEN false END AS {name}"
    return f"try_cast({name} AS DOUBLE) AS {name}" if kind == "double" else name


_LABEL = "nullif(regexp_replace(lower({c}), '[\\s-]+', '_', 'g'), '')"
_SPELLED = [drift.folded(x) for _, spelled in drift.ALIASES.values() for x in spelled] + [drift.folded(x) for x in drift.RECORD_ID]
_CONSISTENT = f"""WITH {ALIASES_CTE},
fields AS (SELECT feed_name, file_name, line_no, {game_sql("j ->> '$.game_id'")} AS game, trim(j ->> '$.play_id', ' ' || chr(9)) AS play,
  list_transform(list_sort(json_keys(j)), lambda k: {{'fold': lower(regexp_replace(k, '[^A-Za-z0-9]', '', 'g')), 'v': j ->> ('$."' || k || '"')}}) AS fs
  FROM (SELECT *, CAST(raw_record AS JSON) AS j FROM stg_plays WHERE CASE WHEN json_valid(raw_record) THEN json_type(raw_record) = 'OBJECT' ELSE false END), aliases),
texts AS (SELECT feed_name, file_name, line_no, game, play, {', '.join(f'{_held(n)} AS {n}' for n in drift.ALIASES)}, len(list_filter(fs, lambda e: e.fold NOT IN {tuple(_SPELLED)})) AS n_other FROM fields),
votes AS (SELECT CAST(c.code AS INTEGER) AS code, l.label, count(*) AS n FROM (SELECT game, play, try_cast(play_type AS DOUBLE) AS code FROM texts) c
  JOIN (SELECT game, play, {_LABEL.format(c='play_type')} AS label FROM texts WHERE try_cast(play_type AS DOUBLE) IS NULL AND play_type IS NOT NULL) l USING (game, play) WHERE c.code = floor(c.code) GROUP BY 1, 2),
codes AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, label DESC) = 1)
SELECT feed_name, file_name, line_no, game, play, {', '.join(_cast(n) for n in drift.ALIASES if n != 'play_type')},
  coalesce(codes.label, CASE WHEN try_cast(play_type AS DOUBLE) IS NULL THEN {_LABEL.format(c='play_type')} END) AS play_type, n_other
FROM texts LEFT JOIN codes ON try_cast(play_type AS DOUBLE) = codes.code"""


@registry.query("p5_plays", _CONSISTENT)
def p5_plays(spark, sf_dir):
    """All raw files in one table, one name and type per field; of the fields beyond those agreed on their number."""
    plays = drift.consistent_plays(*tables(spark, sf_dir, "stg_plays", "dim_team"))
    return plays.withColumn("n_other", F.size("other_fields").cast("long")).drop("other_fields")


def _side(name: str, version: str) -> str:
    fields = diff.PLAY_FIELDS
    texts = {"posteam", "play_type"}
    cols = ", ".join(f"trim({f}, ' ' || chr(9) || chr(10) || chr(13)) AS {f}" if f in texts else f"CASE WHEN isnan({f}::DOUBLE) THEN NULL ELSE {f}::DOUBLE END AS {f}" for f in fields)
    order = ", ".join(f"{f} DESC NULLS LAST" for f in [version, *fields])
    return f"SELECT play_key, {', '.join(fields)} FROM (SELECT play_key, {version}, {cols} FROM {name}) QUALIFY row_number() OVER (PARTITION BY play_key ORDER BY {order}) = 1"


_MART = ["designed_plays", "pass_rate", "epa_per_play", "success_rate", "pass_rate_over_expected", "neutral_plays", "neutral_pass_rate", "neutral_early_down_pass_rate", "neutral_epa_per_play", "fourth_down_go_attempts", "fourth_down_go_rate"]


def _mart_side(name: str) -> str:
    cols = ", ".join(f"CASE WHEN isnan({f}::DOUBLE) THEN NULL ELSE {f}::DOUBLE END AS {f}" for f in _MART)
    order = ", ".join(f"{f} DESC NULLS LAST" for f in ["built_at", *_MART])
    return f"""SELECT row_key, {', '.join(_MART)} FROM (SELECT coalesce((SELECT m FROM aliases)[upper(trim(team))], trim(team)) || '|' || season AS row_key, built_at, {cols} FROM {name})
  QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY {order}) = 1"""


def _unlike(f: str, text: bool) -> str:
    if text:
        return f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END"
    return f"CASE WHEN (a.{f} IS NULL) <> (b.{f} IS NULL) OR abs(a.{f} - b.{f}) > 1e-6 * greatest(1, abs(a.{f}), abs(b.{f})) THEN '{f}' END"


def _full(a: str, b: str, key: str, fields: list[str]) -> str:
    changed = ", ".join(_unlike(f, f in ("posteam", "play_type")) for f in fields)
    return f"""SELECT coalesce(a.{key}, b.{key}) AS row_key, CASE WHEN b.{key} IS NULL THEN ['only_in_primary'] WHEN a.{key} IS NULL THEN ['only_in_replica']
  ELSE list_filter([{changed}], lambda x: x IS NOT NULL) END AS found FROM {a} a FULL JOIN {b} b ON a.{key} = b.{key}"""


_DIFF = f"""WITH {ALIASES_CTE}, pa AS ({_side('fact_plays', 'loaded_at')}), pb AS ({_side('fact_plays_replica', 'synced_at')}),
ma AS ({_mart_side('mart_team_season_tendencies')}), mb AS ({_mart_side('mart_replica')}),
both_tables AS (SELECT 'fact_plays' AS table_name, * FROM ({_full('pa', 'pb', 'play_key', diff.PLAY_FIELDS)})
  UNION ALL SELECT 'mart_team_season_tendencies', * FROM ({_full('ma', 'mb', 'row_key', _MART)}))
SELECT table_name, row_key, unnest(found) AS field_name FROM both_tables"""


@registry.query("p6_found", _DIFF)
def p6_found(spark, sf_dir):
    """Rows and fields in which the second system's copies differ."""
    return diff.copy_differences(*tables(spark, sf_dir, "fact_plays", "fact_plays_replica", "mart_team_season_tendencies", "mart_replica", "dim_team"))


@registry.query("p6_report", f"SELECT table_name, field_name, count(*) AS n_differences FROM ({_DIFF}) GROUP BY 1, 2")
def p6_report(spark, sf_dir):
    """Differences per table and field."""
    return p6_found(spark, sf_dir).groupBy("table_name", "field_name").agg({"*": "count"}).withColumnRenamed("count(1)", "n_differences")
