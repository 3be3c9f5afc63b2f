"""When two spellings name the same game, player or club."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A player id with one of these (any case) is no reference.
NO_PLAYER = ["NA", "NULL", "NONE", "UNKNOWN"]

#: The club aliases become a literal in the plan, so their number is bounded here; beyond it the call fails.
MAX_ALIASES = 10_000


def clean_id(c: Column) -> Column:
    """Case, surrounding blanks and tabs, and ``-`` for ``_`` don't matter; null stays null."""
    return F.upper(F.translate(F.btrim(c, F.lit(" \t")), "-", "_"))


def team_aliases(dim_team: DataFrame) -> dict[str, str]:
    """Former club code -> present code, both cleaned. Of two clubs claiming one former code the lesser wins."""
    rows = (
        dim_team.select(clean_id(F.col("former_team")).alias("former"), clean_id(F.col("team")).alias("team"))
        .where((F.length("former") > 0) & F.col("team").isNotNull())
        .groupBy("former")
        .agg(F.min("team").alias("team"))
        .limit(MAX_ALIASES + 1)
        .collect()
    )
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} club aliases: this table isn't a list of clubs")
    return {r.former: r.team for r in rows}


def current_team(c: Column, aliases: dict[str, str]) -> Column:
    """A cleaned club code, or its present code if a club bore it formerly."""
    if not aliases:
        return c
    pairs = F.create_map(*[F.lit(x) for pair in sorted(aliases.items()) for x in pair])
    return F.coalesce(F.try_element_at(pairs, c), c)


def game_key(c: Column, aliases: dict[str, str]) -> Column:
    """The game an id names: cleaned, each part a former club code replaced. Null, empty and blank give null."""
    cleaned = clean_id(c)
    parts = F.transform(F.split(cleaned, "_", -1), lambda p: current_team(p, aliases))
    return F.when(F.length(cleaned) > 0, F.array_join(parts, "_"))


def player_key(c: Column) -> Column:
    """The player an id names; null, blank and placeholder words give null, as they are no reference."""
    cleaned = clean_id(c)
    return F.when((F.length(cleaned) > 0) & ~cleaned.isin(NO_PLAYER), cleaned)
