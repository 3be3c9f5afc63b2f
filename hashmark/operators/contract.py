"""The contract of plays and games, declared once: ranges, labels, what is never null, how ids look."""

from __future__ import annotations

from hashmark.operators import quality

#: Inclusive bounds of numbers.
RANGES = {
    "season": (1999, 2100),
    "week": (1, 22),
    "play_id": (1, 10_000),
    "qtr": (1, 6),
    "down": (1, 4),
    "ydstogo": (0, 99),
    "yardline_100": (0, 100),
    "fixed_drive": (1, 60),
    "series": (1, 150),
    "quarter_seconds_remaining": (0, 900),
    "half_seconds_remaining": (0, 1800),
    "game_seconds_remaining": (0, 3600),
    "score_differential": (-80, 80),
    "posteam_score": (0, 100),
    "defteam_score": (0, 100),
    "home_score": (0, 100),
    "away_score": (0, 100),
    "posteam_timeouts_remaining": (0, 3),
    "defteam_timeouts_remaining": (0, 3),
    "yards_gained": (-100, 110),
    "air_yards": (-100, 110),
    "yards_after_catch": (-100, 110),
    "kick_distance": (-10, 100),
    "temp": (-40, 130),
    "wind": (0, 100),
    "spread_line": (-40, 40),
    "total_line": (20, 90),
    "wp": (0, 1),
    "def_wp": (0, 1),
    "vegas_wp": (0, 1),
    "cp": (0, 1),
    "xpass": (0, 1),
}
#: Labels that a column may hold.
ALLOWED = {
    "season_type": ["REG", "POST"],
    "posteam_type": ["home", "away"],
    "game_half": ["Half1", "Half2", "Overtime"],
    "play_type": ["pass", "run", "no_play", "kickoff", "punt", "extra_point", "field_goal", "qb_kneel", "qb_spike"],
    "field_goal_result": ["made", "missed", "blocked"],
    "roof": ["closed", "dome", "open", "outdoors"],
    "distance_bucket": ["short", "medium", "long", "very_long"],
    "field_zone": ["red_zone", "opponent_territory", "midfield", "own_territory", "backed_up"],
    "score_state": ["trailing_big", "trailing_two_scores", "trailing_one_score", "tied", "leading_one_score", "leading_two_scores", "leading_big"],
}
#: What is never null, and how a game's id looks.
NOT_NULL = ["game_id", "play_id", "season", "season_type", "week", "game_date", "home_team", "away_team", "drive_id", "qtr", "is_designed_play"]
GAME_ID = r"^\d{4}_\d{2}_[A-Z]{2,3}_[A-Z]{2,3}$"

#: The columns of the given tables, for the SQL that the checks are held against.
COLUMNS = {
    "fact_plays": ["game_id", "play_id", "season", "fixed_drive", "qtr", "down", "ydstogo", "yardline_100", "game_seconds_remaining", "score_differential", "play_type", "yards_gained", "wp", "is_designed_play"],
    "dim_game": ["game_id", "season", "season_type", "week", "game_date", "home_team", "away_team", "home_score", "away_score", "spread_line", "total_line", "roof", "temp", "wind"],
}


def checks(columns: list[str]) -> list[quality.Check]:
    """The contract's checks on those of its columns that a table has."""
    out = [quality.not_null(c) for c in NOT_NULL if c in columns]
    out += [quality.in_range(c, *bounds) for c, bounds in RANGES.items() if c in columns]
    out += [quality.accepted(c, labels) for c, labels in ALLOWED.items() if c in columns]
    return out + ([quality.matches("game_id", GAME_ID)] if "game_id" in columns else [])


def report_sql(table: str) -> str:
    """The same checks in SQL."""
    cols = COLUMNS[table]
    fails = [("not_null", c, f"{c} IS NULL") for c in NOT_NULL if c in cols]
    fails += [("in_range", c, f"NOT {c} BETWEEN {a} AND {b}") for c, (a, b) in RANGES.items() if c in cols]
    fails += [("accepted_values", c, f"{c} NOT IN ({', '.join(map(repr, labels))})") for c, labels in ALLOWED.items() if c in cols]
    fails += [("matches", "game_id", f"NOT regexp_matches(game_id, '{GAME_ID}')")]
    rows = [
        f"SELECT '{name}' AS check_name, '{c}' AS column_name, count(*) FILTER (WHERE {bad}) AS n_failed, count(*) AS n_rows, coalesce(list_sort(list(DISTINCT {c}::VARCHAR) FILTER (WHERE {bad} AND {c} IS NOT NULL))[1:3], []) AS examples FROM {table}"
        for name, c, bad in fails
    ]
    return " UNION ALL ".join(rows)
