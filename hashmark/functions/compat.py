"""Expressions whose meaning differs between engines, written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def max_by_known(value: Column, by: Column) -> Column:
    """The value at the greatest ``by`` among rows whose value isn't null."""
    return F.max_by(value, F.when(value.isNotNull(), by))


def min_by_known(value: Column, by: Column) -> Column:
    """The value at the least ``by`` among rows whose value isn't null."""
    return F.min_by(value, F.when(value.isNotNull(), by))


def ratio(part: Column, whole: Column) -> Column:
    """A quotient that is null where the whole is 0 or null."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def floor_zero(c: Column) -> Column:
    """Negative numbers become 0; null stays null."""
    return F.when(c < 0, F.lit(0)).otherwise(c)


def is_true(c: Column) -> Column:
    """A three-valued flag as a two-valued one: unknown is false."""
    return F.coalesce(c, F.lit(False))


def bucket(c: Column, bounds: list[tuple[float, str]], beyond: str) -> Column:
    """The label of the first bound that isn't exceeded; null stays null."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for limit, label in bounds:
        out = out.when(c <= limit, label)
    return out.otherwise(beyond)


def as_date(df: DataFrame, c: str) -> Column:
    """A column as a date: text is read as ISO dates, what isn't one becomes null; dates and times are cast."""
    return F.try_to_date(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("date")
