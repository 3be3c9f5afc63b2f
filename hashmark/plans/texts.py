"""Queries on texts, names, logs, dates and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashmark.functions import names
from hashmark.operators import quality, quantiles, retrieval
from hashmark.plans.registry import Registry
from hashmark.plans.warehouse import r6
from hashmark.sources import tables as sources
from hashmark.sources.tables import table, tables

registry = Registry()
q = registry.query

_WORDS = r"regexp_extract_all(regexp_replace(regexp_replace(lower({c}), '[''’]s\b', '', 'g'), '[''’.]', '', 'g'), '[\p{{L}}\p{{N}}]+')"


def _name_key(c: str) -> str:
    return f"array_to_string(list_filter({_WORDS.format(c=c)}, lambda w: w NOT IN ({', '.join(map(repr, names.SUFFIXES))})), ' ')"


@q(
    "club_mentions",
    f"""WITH n AS (SELECT DISTINCT {_name_key('team_name')} AS name_key FROM dim_team), w AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL),
s AS ({' UNION ALL '.join(f"SELECT doc_id, i - 1 AS start, {k} AS size, array_to_string(w[i:i + {k - 1}], ' ') AS name_key FROM (SELECT *, unnest(range(1, len(w) - {k - 2})) AS i FROM w WHERE len(w) >= {k})" for k in (4, 3, 2))}),
f AS (SELECT s.* FROM s JOIN n USING (name_key)),
k AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE a.doc_id = b.doc_id AND a.start < b.start + b.size AND b.start < a.start + a.size AND (b.size > a.size OR (b.size = a.size AND b.start < a.start))))
SELECT name_key, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs FROM k GROUP BY 1""",
)
def club_mentions(spark, d):
    """How often documents name each club in full, whatever the spelling of points and apostrophes."""
    docs, teams = tables(spark, d, "documents", "dim_team")
    found = names.mentions(docs, "doc_id", "text", teams.select(names.name_key(F.col("team_name")).alias("name_key")))
    return found.groupBy("name_key").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs"))


_TENS = "['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC']"
_ONES = "['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX']"


@q("final_numerals", f"SELECT DISTINCT season, {_TENS}[CAST(floor((season - 1965) / 10) AS INTEGER) % 10 + 1] || {_ONES}[(season - 1965) % 10 + 1] AS numeral, season - 1965 AS number FROM dim_game WHERE season BETWEEN 1966 AND 2064")
def final_numerals(spark, d):
    """Seasons with the number of their final, written and read again in Roman numerals."""
    n = F.col("season") - names.ZEROTH_FINAL
    seasons = table(spark, d, "dim_game").where("season BETWEEN 1966 AND 2064").select("season").distinct().withColumn("numeral", names.roman(n))
    return seasons.withColumn("number", names.from_roman(F.col("numeral")))


@q(
    "season_of_dates",
    """SELECT season, count(*) AS n_games, count(*) FILTER (WHERE CASE WHEN month(game_date) >= 3 THEN year(game_date) ELSE year(game_date) - 1 END = season) AS n_alike, min(CAST(game_date AS DATE)) - 7 AS opens, max(CAST(game_date AS DATE)) + 7 AS closes
FROM dim_game GROUP BY 1""",
)
def season_of_dates(spark, d):
    """Games whose date lies in the season they are listed under (seasons change in March), and when a season opens and closes."""
    day = F.col("game_date").cast("date")
    return table(spark, d, "dim_game").groupBy("season").agg(
        F.count(F.lit(1)).alias("n_games"), F.count_if(quality.current_season(day) == F.col("season")).alias("n_alike"), F.date_sub(F.min(day), 7).alias("opens"), F.date_add(F.max(day), 7).alias("closes")
    )


_LEX_FILTERED = r"""kept AS (SELECT doc_id, text FROM documents WHERE grain = 'game' AND season IN (2012, 2014, 2018, 2024)), t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x IN ('release', 'court', 'während'))) AS term FROM kept),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), lex AS (SELECT doc_id, round(sum(ln(1 + tf) * ln(1 + (SELECT count(*) FROM kept) / df)), 6) AS score FROM tf JOIN df USING (term) GROUP BY 1)"""


@q("filtered_topk", f"WITH {_LEX_FILTERED} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM lex ORDER BY score DESC, doc_id LIMIT 20")
def filtered_topk(spark, d):
    """The twenty documents that fit the words best among those of a grain and some seasons: filters come before the ranking."""
    kept = retrieval.matching(table(spark, d, "documents"), grain="game", seasons=[2012, 2014, 2018, 2024])
    return retrieval.lexical_rank(kept, "doc_id", "text", "release court während", 20)


@q(
    "index_updates",
    """WITH stored AS (SELECT doc_id, md5(coalesce(CASE WHEN grain = 'note' THEN upper(text) ELSE text END, '')) AS digest FROM documents WHERE season < 2020 OR season IS NULL)
SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(256 AS BIGINT) AS size FROM documents d WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.doc_id = d.doc_id AND s.digest = md5(coalesce(d.text, '')))""",
)
def index_updates(spark, d):
    """What an index of the seasons before 2020, whose notes have been rewritten since, must embed: only that is embedded."""
    docs = table(spark, d, "documents")
    held = F.when(F.col("grain") == "note", F.upper("text")).otherwise(F.col("text"))
    stored = docs.where("season < 2020 OR season IS NULL").select("doc_id", F.md5(F.coalesce(held, F.lit("")).cast("binary")).alias("digest"))
    due = retrieval.index_updates(docs, stored, "doc_id", "text")
    return due.select("doc_id", "digest", F.size("vector").cast("long").alias("size"))


@q(
    "log_summary",
    """WITH a AS (SELECT event_type, count(*) AS n, round(avg((value < 10)::INT), 6) AS low_rate, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1),
s AS (SELECT event_type, list(event_id ORDER BY value DESC, event_id) AS slowest FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 3) GROUP BY 1)
SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share, low_rate, p50, p95, slowest FROM a JOIN s USING (event_type)""",
)
def log_summary(spark, d):
    """A log by kind: its share, how many values are low, percentiles, and the three largest."""
    e = table(spark, d, "events")
    rates = e.groupBy("event_type").agg(r6(F.avg((F.col("value") < 10).cast("int"))).alias("low_rate"))
    three = sources.top_per_key(e, ["event_type"], [F.desc("value"), F.asc("event_id")], 3)
    slowest = three.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "event_id"))), lambda x: x["event_id"]).alias("slowest"))
    whole = e.agg(F.count(F.lit(1))).scalar()
    parts = quantiles.exact(e, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return parts.join(rates, "event_type").join(slowest, "event_type").select("event_type", "n", r6(F.col("n") / whole).alias("share"), "low_rate", "p50", "p95", "slowest")


@q("sample_rows", "SELECT play_key, loaded_at, yards_gained FROM fact_plays ORDER BY md5(play_key || '|7'), loaded_at, yards_gained LIMIT 500")
def sample_rows(spark, d):
    """The same 500 rows whenever it is asked: a sample by seed."""
    drawn = sources.seeded_sample(table(spark, d, "fact_plays"), "play_key", 500, 7, ["loaded_at", "yards_gained"])
    return drawn.select("play_key", "loaded_at", "yards_gained")


@q("week_filter", "SELECT game_id, season, week, home_team FROM dim_game WHERE season * 100 + week IN (201207, 201420, 202021) OR season || '-' || lpad(week::VARCHAR, 2, '0') IN ('2024-10', '2018-03')")
def week_filter(spark, d):
    """Rows of some weeks, named by number or by padded key."""
    return sources.in_weeks(table(spark, d, "dim_game"), [201207, 201420, 202021], ["2024-10", "2018-03"]).select("game_id", "season", "week", "home_team")


@q("capped_rows", "SELECT play_key, season FROM fact_plays WHERE down = 4 ORDER BY play_key, season, loaded_at LIMIT 200")
def capped_rows(spark, d):
    """A user's query, of which at most 200 rows are given out."""
    asked = table(spark, d, "fact_plays").where("down = 4").orderBy("play_key", "season", "loaded_at").limit(1000)
    return sources.capped(asked).select("play_key", "season")
