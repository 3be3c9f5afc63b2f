"""Declarative data checks, evaluated together in one pass over a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Check:
    """A row fails where ``fails`` is true; unknown doesn't fail."""

    name: str
    column: str
    fails: Column


def not_null(c: str) -> Check:
    return Check("not_null", c, F.col(c).isNull())


def in_range(c: str, low: float, high: float) -> Check:
    return Check("in_range", c, ~F.col(c).between(low, high))


def accepted(c: str, values: list) -> Check:
    return Check("accepted_values", c, ~F.col(c).isin(values))


def matches(c: str, pattern: str) -> Check:
    return Check("matches", c, ~F.col(c).rlike(pattern))


def expression(name: str, c: str, holds: Column) -> Check:
    return Check(name, c, ~holds)


@dataclass(frozen=True)
class Measure:
    """A whole table passes where ``value``, an aggregate, lies within the bounds; an unknown value fails."""

    name: str
    column: str
    value: Column
    low: float
    high: float


def mean_between(c: str, low: float, high: float) -> Measure:
    return Measure("mean_between", c, F.avg(c), low, high)


def null_rate_below(c: str, share: float) -> Measure:
    return Measure("null_rate_below", c, F.avg(F.col(c).isNull().cast("double")), 0.0, share)


def rows_between(low: int, high: int) -> Measure:
    return Measure("rows_between", "", F.count(F.lit(1)), low, high)


def measures(df: DataFrame, wanted: list[Measure]) -> DataFrame:
    """``check_name``, ``column_name``, ``value``, ``passed``: one row a measure, all taken in one pass."""
    taken = df.agg(*[m.value.cast("double").alias(f"m{i}") for i, m in enumerate(wanted)])
    rows = [
        F.struct(
            F.lit(m.name).alias("check_name"), F.lit(m.column).alias("column_name"), F.col(f"m{i}").alias("value"), F.coalesce(F.col(f"m{i}").between(m.low, m.high), F.lit(False)).alias("passed")
        )
        for i, m in enumerate(wanted)
    ]
    return taken.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def examples(df: DataFrame, checks: list[Check]) -> DataFrame:
    """``check_name``, ``column_name``, ``least``, ``greatest``: the extreme values, as text, among those that fail; null where none does."""
    fails = [F.when(c.fails, F.col(c.column).cast("string")) for c in checks]
    found = df.agg(*[F.min(f).alias(f"a{i}") for i, f in enumerate(fails)], *[F.max(f).alias(f"b{i}") for i, f in enumerate(fails)])
    rows = [F.struct(F.lit(c.name).alias("check_name"), F.lit(c.column).alias("column_name"), F.col(f"a{i}").alias("least"), F.col(f"b{i}").alias("greatest")) for i, c in enumerate(checks)]
    return found.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def failures(df: DataFrame, checks: list[Check], n_examples: int = 3) -> DataFrame:
    """``check_name``, ``column_name``, ``n_failed``, ``n_rows``, ``examples``: every check of a table, with the least few (as
    text) of the distinct values that fail it.

    All checks are counted in one pass. Another passes on what fails, of which every task keeps only the least few of a
    check, so that a table which breaks its contract everywhere isn't brought together.
    """
    counted = report(df, checks)
    hits = [F.when(F.coalesce(c.fails, F.lit(False)), F.struct(F.lit(c.name).alias("check_name"), F.lit(c.column).alias("column_name"), F.col(c.column).cast("string").alias("value"))) for c in checks]
    failing = df.select(F.explode(F.filter(F.array(*hits), lambda x: x["value"].isNotNull())).alias("f")).select("f.*").distinct()
    least = Window.partitionBy("check_name", "column_name").orderBy("value")
    few = failing.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= n_examples)
    shown = few.groupBy("check_name", "column_name").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    # a check and column have one row on either side
    joined = counted.join(F.broadcast(shown), ["check_name", "column_name"], "left")
    return joined.select("check_name", "column_name", "n_failed", "n_rows", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def volume(rows: DataFrame, by: list[str], group: str, arrived: str, small: int = 100, large: int = 300, mean: tuple[float, float] = (145, 225), change: float = 0.05) -> DataFrame:
    """Per ``by`` the groups with too few and too many rows, whether the mean lies in its band, and whether all that was
    delivered by now is within ``change`` of what came first."""
    first = rows.groupBy(*by).agg(F.min(arrived).alias("_first"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    marked = rows.alias("a").join(first.alias("b"), on).select("a.*", (F.col(arrived) == F.col("_first")).alias("_is_first"))
    groups = marked.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.count_if("_is_first").alias("n_first"))
    n = F.sum("n")
    return groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_games"),
        n.alias("n_rows"),
        F.count_if(F.col("n") < small).alias("n_small"),
        F.count_if(F.col("n") > large).alias("n_large"),
        (n / F.count(F.lit(1))).between(*mean).alias("mean_in_band"),
        (F.abs(n / F.sum("n_first") - 1) <= change).alias("like_first_delivery"),
    )


def current_season(day: Column) -> Column:
    """The season a day belongs to: a season is named for the year it begins in, and ends with February."""
    return F.year(day) - F.when(F.month(day) >= 3, 0).otherwise(1)


def freshness(games: DataFrame, ingested: DataFrame, today: Column, grace: int = 2, margin: int = 7) -> DataFrame:
    """One row a week of the season that ``today`` lies in: is it complete, how many results are overdue, do we hold any of it, and
    why it is stale (null: it isn't, or the season isn't on).

    ``games``: game_id, season, week, game_date, home_margin (null: no result); ``ingested``: the game_id of what is held.
    """
    day = F.col("game_date").cast("date")
    now = games.withColumn("_today", today).where(F.col("season") == current_season(F.col("_today")))
    bounds = Window.partitionBy("season")
    season = now.groupBy("season", "week", "_today").agg(F.min(day).alias("_from"), F.max(day).alias("last_game"), F.bool_and(F.col("home_margin").isNotNull()).alias("complete"), F.count_if(F.col("home_margin").isNull() & (day <= F.date_sub("_today", grace))).alias("overdue"))
    held = now.join(ingested.distinct(), "game_id", "left_semi").select("week", F.lit(True).alias("_held")).distinct()
    # a season has a few weeks only
    on = F.col("_today").between(F.date_sub(F.min("_from").over(bounds), margin), F.date_add(F.max("last_game").over(bounds), margin))
    known = season.withColumn("in_season", on).join(held, "week", "left").withColumn("ingested", F.coalesce("_held", F.lit(False)))
    late = F.col("complete") & (F.col("last_game") <= F.date_sub("_today", grace)) & ~F.col("ingested")
    stale = F.when(~F.col("in_season"), F.lit(None)).when(late, "not ingested").when(F.col("overdue") > 0, "source is behind")
    return known.select("season", "week", "last_game", "complete", "overdue", "ingested", "in_season", stale.alias("stale"))


def schema_differences(df: DataFrame, expected: T.StructType, strict: bool = True) -> list[str]:
    """How a table's columns differ from those agreed on, in words; columns beyond those count only if ``strict``, as does their order."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in expected}
    out = [f"{n}: missing" for n in want if n not in have]
    out += [f"{n}: {have[n].simpleString()} instead of {t.simpleString()}" for n, t in want.items() if n in have and have[n] != t]
    if strict:
        out += [f"{n}: not agreed on" for n in have if n not in want]
        if not out and list(have) != list(want):
            out.append("columns in another order")
    return out


def report(df: DataFrame, checks: list[Check]) -> DataFrame:
    """``check_name``, ``column_name``, ``n_failed``, ``n_rows``: one row a check, all counted in one pass."""
    fails = [F.count_if(F.coalesce(c.fails, F.lit(False))).alias(f"f{i}") for i, c in enumerate(checks)]
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *fails)
    rows = F.array(*[F.struct(F.lit(c.name).alias("check_name"), F.lit(c.column).alias("column_name"), F.col(f"f{i}").alias("n_failed")) for i, c in enumerate(checks)])
    return counted.select(F.explode(rows).alias("r"), "n_rows").select("r.*", "n_rows")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def not_constant(df: DataFrame, key: str, columns: list[str], nulls: bool = False) -> DataFrame:
    """Groups in which a column that should be the same throughout isn't; with ``nulls`` null is a value like others."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<null>")) if nulls else F.col(c)
    # the least and the greatest tell whether there are two: no set of values is held
    kinds = df.groupBy(key).agg(*[F.min(text(c)).alias(f"a{i}") for i, c in enumerate(columns)], *[F.max(text(c)).alias(f"b{i}") for i, c in enumerate(columns)])
    pairs = F.filter(F.array(*[F.when(F.col(f"a{i}") != F.col(f"b{i}"), F.lit(c)) for i, c in enumerate(columns)]), lambda x: x.isNotNull())
    return kinds.select(key, F.explode(pairs).alias("column_name"))


def require(df: DataFrame, checks: list[Check]) -> None:
    """Raise if any check fails: what stands between a build and its publication."""
    failed = report(df, checks).where("n_failed > 0").collect()
    if failed:
        raise ValueError("; ".join(f"{r.column_name} {r.check_name}: {r.n_failed} of {r.n_rows} rows" for r in failed))
