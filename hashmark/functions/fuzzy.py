"""How alike two strings are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _jaro_winkler(a: str, b: str) -> float:
    """Shared characters within half the longer length, less half the transpositions, raised by a shared beginning of up to four."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, f in zip(b, free) if not f]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity by Arrow batches; null where either string is."""
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


#: Names are spread over so many blocks; every name asked for visits all of them.
BLOCKS = 12


def _letters(c: str) -> Column:
    """A name's letters, each numbered among its like, so that the size of an intersection counts repeats."""
    each = F.split(F.col(c), "")
    return F.transform(each, lambda x, i: F.concat(x, F.size(F.filter(F.slice(each, 1, i + 1), lambda y: y == x)).cast("string")))


def alike_names(asked: DataFrame, names: DataFrame, at_least: float = 0.88) -> DataFrame:
    """``asked``, ``name``, ``similarity``: every pair of distinct values of the columns ``asked`` and ``name`` that is alike enough.

    What two names can reach at most follows from the letters they share and their common beginning; only pairs that may
    be alike enough by that are scored.
    """
    asking = asked.where("asked IS NOT NULL").distinct().withColumn("letters_a", _letters("asked")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    known = names.where("name IS NOT NULL").distinct().withColumn("letters_b", _letters("name")).withColumn("block", F.pmod(F.xxhash64("name"), F.lit(BLOCKS)).cast("int"))
    a, b = F.length("asked"), F.length("name")
    begins = [F.when(F.substring("asked", 1, n) == F.substring("name", 1, n), n) for n in (4, 3, 2, 1)]
    same = F.least(F.coalesce(*begins, F.lit(0)), a, b)
    shared = F.size(F.array_intersect("letters_a", "letters_b"))
    jaro = (shared / F.nullif(a, F.lit(0)) + shared / F.nullif(b, F.lit(0)) + 1) / 3
    reach = jaro + 0.1 * same * (1 - jaro)
    pairs = asking.join(known, "block").where((reach >= at_least - 1e-9) | (F.col("asked") == F.col("name")))
    scored = pairs.select("asked", "name", F.round(jaro_winkler("asked", "name"), 9).alias("similarity"))
    return scored.where(F.col("similarity") >= at_least)
