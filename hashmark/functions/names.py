"""Names in texts: words, keys without suffixes, windows of words, and numerals of seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What follows a name without being part of it.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]
#: Roman numerals of the hundreds, tens and ones.
ROMAN = {
    100: ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
    10: ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
    1: ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"],
}
#: Fixed value: the final of this season would have been the zeroth.
ZEROTH_FINAL = 1965
#: Windows of so many words are looked up, the longest first.
LONGEST, SHORTEST = 4, 2


def words(c: Column) -> Column:
    """The words of a text in lower case: apostrophes and points inside them don't part them, a possessive s is no part of them."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"['’]s\b", ""), r"['’.]", "")
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def name_key(c: Column) -> Column:
    """A name by its words, without suffixes; null stays null."""
    return F.array_join(F.filter(words(c), lambda w: ~w.isin(SUFFIXES)), " ")


def mentions(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """``key``, ``start``, ``size``, ``name_key``: where texts mention one of ``names`` (``name_key``).

    Windows of four to two words are held against the names by a join on the window. One that overlaps a longer
    mention, or one of its length that begins before it, is none.
    """
    worded = docs.where(F.col(text).isNotNull()).select(key, words(F.col(text)).alias("_w"))
    spans = []
    for size in range(LONGEST, SHORTEST - 1, -1):
        at = F.sequence(F.lit(0), F.size("_w") - size)
        spans.append(worded.where(F.size("_w") >= size).select(key, F.explode(_windows(at, size)).alias("s")))
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    found = every.select(key, "s.*").join(names.select("name_key").distinct(), "name_key")
    a, b = found.alias("a"), found.alias("b")
    ends = lambda t: F.col(f"{t}.start") + F.col(f"{t}.size")
    overlap = (F.col("a.start") < ends("b")) & (F.col("b.start") < ends("a"))
    first = (F.col("b.size") > F.col("a.size")) | ((F.col("b.size") == F.col("a.size")) & (F.col("b.start") < F.col("a.start")))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & overlap & first, "left_anti").select(key, "start", "size", "name_key")


def _windows(at: Column, size: int) -> Column:
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice("_w", i + 1, size), " ").alias("name_key")))


def roman(c: Column) -> Column:
    """A whole number from 1 to 999 in Roman numerals; null for any other."""
    digits = [F.get(F.array(*map(F.lit, signs)), (F.floor(c / place) % 10).cast("int")) for place, signs in ROMAN.items()]
    return F.when(c.between(1, 999), F.concat(*digits))


def from_roman(c: Column) -> Column:
    """The number that Roman numerals write, in any case; null for what isn't written by the rule."""
    n = F.upper(F.trim(c))
    value = F.lit(0)
    rest = n
    for place, signs in ROMAN.items():
        # of signs that fit, the longest
        by_length = sorted(range(1, 10), key=lambda d: -len(signs[d]))
        digit = F.coalesce(*[F.when(F.startswith(rest, F.lit(signs[d])), d) for d in by_length], F.lit(0))
        taken = F.length(F.get(F.array(*map(F.lit, signs)), digit))
        value, rest = value + digit * place, F.substring(rest, taken + 1, F.length(rest))
    return F.when((F.length(rest) == 0) & (F.length(n) > 0), value)
