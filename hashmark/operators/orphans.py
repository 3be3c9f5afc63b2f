"""References to records that do not exist: a merge of references with the validity of their parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashmark.functions.ids import game_key, player_key, team_aliases
from hashmark.operators.skew import hot_keys, replicated, salted

#: What is said of a reference.
RESOLVED, NEVER, REMOVED, LATER = "resolved", "never existed", "was removed", "came later"


def classify(references: DataFrame, parents: DataFrame, parts: int = 1024) -> DataFrame:
    """Each reference with ``status``, by merging it with the lives of the records it may point to.

    ``references``: ``target``, ``ref_key`` (not null), ``ref_time`` and any columns more, which are kept.
    ``parents``: ``target``, ``ref_key``, ``valid_from``, ``valid_to``; several rows a key are several stays.

    Both are brought together by key, sorted by time and read once: a running count of open stays tells
    whether a reference is resolved (valid_from <= ref_time < valid_to, null valid_to being open), the
    number of stays begun so far whether the target was removed or is yet to come. Keys with a large share
    of the references are salted and their parents, few, repeated for each salt.

    Ties: at one moment removals come first, then arrivals, then references. A null valid_from never begins;
    a stay that ends before or as it begins holds no moment. A null ref_time lies before all others. Empty
    parents make every reference ``never existed``; repeated rows are kept as they are.
    """
    keys = ["target", "ref_key"]
    payload = [c for c in references.columns if c not in (*keys, "ref_time")]
    hot = hot_keys(references.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, parts)

    holds = F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))
    nothing = F.lit(None).cast("timestamp")

    def event(at: Column, order: int, open_: int, begun: int) -> Column:
        return F.struct(at.alias("at"), F.lit(order).alias("order"), F.lit(open_).alias("open"), F.lit(begun).alias("begun"))

    lives = (
        replicated(parents.where(F.col("ref_key").isNotNull()), hot, keys)
        .withColumn(
            "_events",
            F.filter(
                F.array(
                    event(nothing, 0, 0, 0),
                    F.when(holds & F.col("valid_to").isNotNull() & F.col("valid_from").isNotNull(), event(F.col("valid_to"), 1, -1, 0)),
                    F.when(F.col("valid_from").isNotNull(), F.when(holds, event(F.col("valid_from"), 2, 1, 1)).otherwise(event(F.col("valid_from"), 2, 0, 1))),
                ),
                lambda e: e.isNotNull(),
            ),
        )
        .select(*keys, "_salt", F.explode("_events").alias("_event"))
        .select(*keys, "_salt", "_event.*")
    )
    asked = salted(references, hot, keys, [*payload, "ref_time"] or ["ref_time"]).select(
        *keys, "_salt", F.col("ref_time").alias("at"), F.lit(3).alias("order"), F.lit(0).alias("open"), F.lit(0).alias("begun"), F.struct(F.lit(1).alias("_one"), *payload).alias("_row")
    )
    merged = lives.unionByName(asked, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_salt").orderBy(F.col("at").asc_nulls_first(), "order").rowsBetween(Window.unboundedPreceding, 0)
    return (
        merged.withColumn("_open", F.sum("open").over(so_far))
        .withColumn("_begun", F.sum("begun").over(so_far))
        .withColumn("_known", F.count(F.when(F.col("order") == 0, 1)).over(so_far))
        .where(F.col("order") == 3)
        .withColumn("status", F.when(F.col("_open") > 0, RESOLVED).when(F.col("_known") == 0, NEVER).when(F.col("_begun") > 0, REMOVED).otherwise(LATER))
        .select(*keys, F.col("at").alias("ref_time"), *[F.col(f"_row.{c}").alias(c) for c in payload], "status")
    )


def play_references(plays: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """What the plays refer to: one row for each play row and referring field that holds a reference."""
    fields = {
        "game_id": ("game", game_key(F.col("game_id"), aliases)),
        "passer_player_id": ("player", player_key(F.col("passer_player_id"))),
        "receiver_player_id": ("player", player_key(F.col("receiver_player_id"))),
    }
    held = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(t).alias("target"), k.alias("ref_key")) for f, (t, k) in fields.items()])
    return (
        plays.select("play_key", "season", F.col("loaded_at").alias("ref_time"), F.explode(held).alias("_ref"))
        .select("play_key", "season", "ref_time", "_ref.*")
        .where(F.col("ref_key").isNotNull())
    )


def play_parents(dim_game: DataFrame, dim_player: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """The stays of games and players under the ids that references are compared by."""
    stay = [F.col("loaded_at").alias("valid_from"), F.col("removed_at").alias("valid_to")]
    games = dim_game.select(F.lit("game").alias("target"), game_key(F.col("game_id"), aliases).alias("ref_key"), *stay)
    players = dim_player.select(F.lit("player").alias("target"), player_key(F.col("player_id")).alias("ref_key"), *stay)
    return games.unionByName(players)


def orphan_cases(plays: DataFrame, dim_game: DataFrame, dim_player: DataFrame, dim_team: DataFrame) -> DataFrame:
    """``play_key``, ``ref_field``: distinct references of some row of that key to a target not there when the row arrived.

    A play row that repeats counts once; a null play_key is a key like others.
    """
    aliases = team_aliases(dim_team)
    found = classify(play_references(plays, aliases), play_parents(dim_game, dim_player, aliases))
    return found.where(F.col("status") != RESOLVED).select("play_key", "ref_field").distinct()


def orphan_report(plays: DataFrame, dim_game: DataFrame, dim_player: DataFrame, dim_team: DataFrame) -> DataFrame:
    """References per referring field, season (null where unknown) and status, resolved ones included."""
    aliases = team_aliases(dim_team)
    found = classify(play_references(plays, aliases), play_parents(dim_game, dim_player, aliases))
    return found.groupBy("ref_field", "season", "status").agg(F.count(F.lit(1)).alias("n_references"))
