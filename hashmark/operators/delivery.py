"""Messages delivered more than once: keep exactly one copy of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashmark.functions.ids import game_key, team_aliases
from hashmark.operators.skew import hot_keys, replicated, salted
from hashmark.session import cut


def mark_copies(messages: DataFrame, key: dict[str, Column], newest_first: list[str], parts: int = 1024, flag: str = "is_copy") -> DataFrame:
    """``messages`` with ``flag``: true for all but the newest message of each identifier.

    Identifiers are split by their aggregated frequency: messages of an identifier that occurs once pass
    directly, as do those with a null in any part of ``key`` (nobody's copies); only repeated groups are
    ranked, newest first by ``newest_first`` (nulls last). An identifier with a large share of the messages is
    ranked in salted parts and then once more among the winners of its parts. Columns of ``messages`` may
    have any names but those with a leading ``_dk_``; one named like the flag is replaced.
    """
    keys = [f"_dk_{k}" for k in key]
    held = [c for c in messages.columns if c != flag]
    # the message stays in one column on the way, so that its names can't clash with any made here
    named = messages.select(F.struct(*held).alias("_dk_row"), *[c.alias(f"_dk_{k}") for k, c in key.items()])
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    counts = named.where(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, keys, parts)
    repeated = replicated(counts.where(F.col("n") > 1).select(*keys), hot, keys)

    newest = [F.col(f"_dk_row.{c}") for c in newest_first]
    known = salted(named.where(whole), hot, keys, newest)
    at = [*keys, "_salt"]
    singles = known.join(repeated, at, "left_anti").withColumn("_dk_flag", F.lit(False))
    groups = known.join(repeated, at, "left_semi")
    order = [c.desc_nulls_last() for c in newest]
    ranked = groups.withColumn("_dk_rank", F.row_number().over(Window.partitionBy(*at).orderBy(*order)))

    split = F.broadcast(hot.select(*[F.col(k).alias(f"{k}_hot") for k in keys], F.lit(True).alias("_dk_split")))
    ranked = ranked.join(split, [ranked[k] == split[f"{k}_hot"] for k in keys], "left")
    undecided = (F.col("_dk_rank") == 1) & F.coalesce("_dk_split", F.lit(False))
    decided = ranked.where(~undecided).withColumn("_dk_flag", F.col("_dk_rank") > 1)
    finals = ranked.where(undecided).withColumn("_dk_flag", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)

    nobodys = named.where(~whole).withColumn("_dk_flag", F.lit(False))
    out = [nobodys, singles, decided, finals]
    whole_set = reduce(DataFrame.unionByName, [x.select("_dk_row", "_dk_flag") for x in out])
    return whole_set.select(*[F.col(f"_dk_row.{c}").alias(c) for c in held], F.col("_dk_flag").alias(flag))


def unmarked(messages: DataFrame, key: dict[str, Column], newest_first: list[str], parts: int = 1024) -> DataFrame:
    """The messages without copies, all their columns as they are."""
    return mark_copies(messages, key, newest_first, parts, "_dk_copy").where("NOT _dk_copy").drop("_dk_copy")


def absorbed(stored: DataFrame, new: DataFrame, key: dict[str, Column], newest_first: list[str], parts: int = 1024) -> DataFrame:
    """Stored messages, of which each identifier has one, and a batch of new ones as one set with one copy of each.

    Stored messages whose identifier the batch doesn't mention pass without being ranked, as do nobody's copies; only the
    others meet the batch. Both sides have the same columns. Absorbing batch by batch keeps what marking all at once keeps.
    """
    keys = [f"_dk_{k}" for k in key]
    named = lambda df: df.withColumns({f"_dk_{k}": c for k, c in key.items()})
    asked = named(new).select(*keys).where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_dk_n"))
    before = named(stored)
    untouched = before.join(asked, keys, "left_anti").select(*stored.columns)
    touched = before.join(asked, keys, "left_semi").select(*stored.columns)
    kept = unmarked(touched.unionByName(new), key, newest_first, parts)
    return untouched.unionByName(kept.select(*stored.columns))


def feed_absorbed(feed: DataFrame, dim_team: DataFrame, moment: str) -> DataFrame:
    """The deliveries to keep, those from ``moment`` on absorbed by what was stored before."""
    named = feed.withColumn("game_key", game_key(F.col("game_id"), team_aliases(dim_team)))
    key, order = {"game": F.col("game_key"), "sequence": F.col("sequence_no")}, ["received_at", "msg_offset", "partition_no"]
    early = F.coalesce(F.col("received_at") < moment, F.lit(True))
    return absorbed(cut(unmarked(named.where(early), key, order)), named.where(~early), key, order)


def feed_marked(feed: DataFrame, dim_team: DataFrame) -> DataFrame:
    """The feed with ``game_key`` and ``is_copy``: two results are copies if game and sequence_no are the same."""
    named = feed.withColumn("game_key", game_key(F.col("game_id"), team_aliases(dim_team)))
    return mark_copies(named, {"game": F.col("game_key"), "sequence": F.col("sequence_no")}, ["received_at", "msg_offset", "partition_no"])


def dropped(feed: DataFrame, dim_team: DataFrame) -> DataFrame:
    """``partition_no``, ``msg_offset`` of the deliveries to drop."""
    needed = feed.select("partition_no", "msg_offset", "game_id", "sequence_no", "received_at")
    return feed_marked(needed, dim_team).where("is_copy").select("partition_no", "msg_offset")


def feed_games(feed: DataFrame, dim_team: DataFrame) -> DataFrame:
    """Per game the results kept and the plays among them (those that aren't final), each counted once."""
    needed = feed.select("partition_no", "msg_offset", "game_id", "sequence_no", "received_at", "is_final")
    kept = feed_marked(needed, dim_team).where("NOT is_copy")
    return kept.groupBy("game_key").agg(F.count(F.lit(1)).alias("n_results"), F.count_if(~F.coalesce("is_final", F.lit(False))).alias("n_plays"))


def summary_corrections(summary: DataFrame, feed: DataFrame, dim_team: DataFrame) -> DataFrame:
    """What was reported per game (the latest report) beside the plays that the cleaned feed holds."""
    aliases = team_aliases(dim_team)
    latest = summary.select(game_key(F.col("game_id"), aliases).alias("game_key"), "plays", "summarized_at").groupBy("game_key").agg(
        F.max(F.struct("summarized_at", "plays")).alias("_last")
    )
    return (
        latest.where(F.col("game_key").isNotNull())
        .join(feed_games(feed, dim_team), "game_key", "left")
        .select("game_key", F.col("_last.plays").alias("reported_plays"), F.coalesce("n_plays", F.lit(0)).alias("n_plays"))
    )
