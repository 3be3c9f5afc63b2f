"""Differences between two copies of data, by content-defined chunks of key-sorted rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashmark.functions.ids import clean_id, current_team, team_aliases
from hashmark.session import cut

#: Relative tolerance of numbers, absolute below 1.
TOLERANCE = 1e-6
#: Rows a block holds at most on average; a block is sorted and cut into chunks by one task.
BLOCK_ROWS = 500_000
#: White space that padding may consist of.
BLANKS = " \t\r\n\f\x0b"


def plain_value(df: DataFrame, field: str) -> Column:
    """A field as it is compared: strings trimmed, NaN null, numbers as doubles, anything else as text."""
    kind, c = df.schema[field].dataType, F.col(field)
    if isinstance(kind, T.StringType):
        return F.btrim(c, F.lit(BLANKS))
    if isinstance(kind, T.NumericType):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return c.cast("string")


def differs(a: Column, b: Column, number: bool) -> Column:
    """Never null: whether two plain values differ; null equals only null."""
    if not number:
        return ~a.eqNullSafe(b)
    close = F.coalesce((a == b) | (F.abs(a - b) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))), F.lit(False))
    return ~((a.isNull() & b.isNull()) | close)


def _grid(c: Column, number: bool) -> Column:
    """What is hashed of a value: numbers on a grid of half the tolerance, so equal hashes mean equal enough."""
    if not number:
        return c
    on_grid = F.round(c / (TOLERANCE / 2))
    return F.when(F.abs(c) < 1e9, on_grid + 0.0).otherwise(c)


def _newest(df: DataFrame, key: list[Column], fields: list[str], version: str, blocks: int) -> DataFrame:
    """One row a key, the one of the latest version (ties: the greatest values), with its block and plain values."""
    values = F.struct(F.col(version).alias("_version"), *[plain_value(df, f).alias(f) for f in fields])
    keyed = df.select(*[k.alias(f"_key{i}") for i, k in enumerate(key)], values.alias("_row"))
    names = [f"_key{i}" for i in range(len(key))]
    best = keyed.groupBy(*names).agg(F.max("_row").alias("_row"))
    return best.select(F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int").alias("_block"), *names, *[F.col(f"_row.{f}").alias(f) for f in fields])


def difference(
    primary: DataFrame, replica: DataFrame, key: dict[str, Column], fields: list[str], version: tuple[str, str], chunk_rows: int = 16
) -> DataFrame:
    """Rows that one side lacks and fields that differ: the columns of ``key`` and ``field_name``.

    Both sides are spread over the same blocks by their keys and sorted by key within a block. A rolling
    hash of the last keys cuts the rows into chunks of ``chunk_rows`` on average, so a lost or added row moves
    no cuts but those beside it. Chunks whose fingerprint (rows, both ends, two 64-bit hashes of all keys and
    values) the other side has too are settled by an anti-join; only rows of the remaining chunks
    are brought together by key and compared field by field. The cut rows are stored, so that they are sorted once.

    ``key`` names the output columns and says how to compute them on either side. Of rows with the same key
    the latest ``version`` speaks. Null keys match null keys; null equals only null; NaN counts as null. Either
    side may be empty. ``field_name`` is ``only_in_primary``, ``only_in_replica`` or a field.
    """
    number = {f: all(isinstance(d.schema[f].dataType, T.NumericType) for d in (primary, replica)) for f in fields}
    if mixed := [f for f in fields if number[f] != any(isinstance(d.schema[f].dataType, T.NumericType) for d in (primary, replica))]:
        raise TypeError(f"{mixed}: a number on one side only")
    # the rows' number only sizes the blocks; it is read from the files' footers
    blocks = max(24, (primary.count() + replica.count()) // BLOCK_ROWS)
    names = [f"_key{i}" for i in range(len(key))]
    sides = [_newest(d, list(key.values()), fields, v, blocks).withColumn("_side", F.lit(i)) for i, (d, v) in enumerate(zip((primary, replica), version))]
    rows = sides[0].unionByName(sides[1]).repartition("_block")

    along = Window.partitionBy("_block", "_side").orderBy(*names)
    key_hash = F.xxhash64(*names)
    rolling = reduce(lambda a, b: a.bitwiseXOR(b), [F.shiftleft(F.coalesce(F.lag(key_hash, i).over(along), F.lit(0)), i) for i in (1, 2, 3)], key_hash)
    row = [*names, *[F.coalesce(_grid(F.col(f), number[f]).cast("string"), F.lit("\x00null")) for f in fields]]
    chunked = cut(
        rows.withColumn("_cut", (F.pmod(rolling, F.lit(chunk_rows)) == 0).cast("int"))
        .withColumn("_chunk", F.sum("_cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_h1", F.xxhash64(*row))
        .withColumn("_h2", F.xxhash64(F.lit("second"), *row))
    )
    at = ["_block", "_side", "_chunk"]
    ends = F.struct(*names)
    prints = cut(
        chunked.groupBy(*at).agg(F.struct(F.count(F.lit(1)).alias("n"), F.xxhash64(F.min(ends)).alias("a"), F.xxhash64(F.max(ends)).alias("b"), F.bit_xor("_h1").alias("h1"), F.bit_xor("_h2").alias("h2")).alias("_print"))
    )
    others = prints.select("_block", (1 - F.col("_side")).alias("_side"), "_print")
    unmatched = prints.join(others, ["_block", "_side", "_print"], "left_anti").select(*at)

    left = chunked.drop("_h1", "_h2", "_cut").join(unmatched, at, "left_semi")
    values = F.struct(*fields)
    pairs = left.groupBy("_block", *names).agg(F.max(F.when(F.col("_side") == 0, values)).alias("_a"), F.max(F.when(F.col("_side") == 1, values)).alias("_b"))
    changed = F.filter(
        F.array(*[F.when(differs(F.col(f"_a.{f}"), F.col(f"_b.{f}"), number[f]), F.lit(f)) for f in fields]), lambda f: f.isNotNull()
    )
    found = F.when(F.col("_b").isNull(), F.array(F.lit("only_in_primary"))).when(F.col("_a").isNull(), F.array(F.lit("only_in_replica"))).otherwise(changed)
    return pairs.select(*[F.col(n).alias(k) for n, k in zip(names, key)], F.explode(found).alias("field_name"))


#: What is compared of plays.
PLAY_FIELDS = ["season", "posteam", "down", "ydstogo", "play_type", "yards_gained", "epa", "wp"]


def copy_differences(plays: DataFrame, plays_replica: DataFrame, mart: DataFrame, mart_replica: DataFrame, dim_team: DataFrame) -> DataFrame:
    """``table_name``, ``row_key``, ``field_name`` for plays (by play_key as written) and tendencies (by present club and season)."""
    of_plays = difference(plays, plays_replica, {"row_key": F.col("play_key")}, PLAY_FIELDS, ("loaded_at", "synced_at"))
    aliases = team_aliases(dim_team)
    trimmed = F.btrim(F.col("team"), F.lit(BLANKS))
    club = F.coalesce(F.when(clean_id(trimmed).isin(list(aliases)), current_team(clean_id(trimmed), aliases)), trimmed)
    mart_fields = [c for c in mart.columns if c not in ("team", "season", "built_at")]
    of_mart = difference(mart, mart_replica, {"row_key": F.concat_ws("|", club, F.col("season").cast("string"))}, mart_fields, ("built_at", "built_at"))
    named = [d.select(F.lit(t).alias("table_name"), "row_key", "field_name") for t, d in (("fact_plays", of_plays), ("mart_team_season_tendencies", of_mart))]
    return named[0].unionByName(named[1])
