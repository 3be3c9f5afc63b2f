"""Ranked retrieval: dense, lexical and fused rankings, and how good they are."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what is added to a rank before it is inverted.
FUSION = 60


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of numbers, summed in order; null where one is all zero."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def dense_rank(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The ``k`` rows most similar to one query vector, with ``rank`` from 1; ties go to the smaller key."""
    scored = vectors.select(F.col(key), F.round(cosine(F.col(vector), F.lit(query)), 12).alias("score")).where("score IS NOT NULL")
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def terms(c: Column) -> Column:
    """The words of a text, in lower case and whatever script."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1)


def lexical_rank(docs: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """The ``k`` best rows by summed log(1 + tf) * idf of the query's words, any of which may match."""
    asked = sorted({t for t in "".join(ch if ch.isalnum() else " " for ch in query.lower()).split() if len(t) > 1})
    hits = docs.select(F.col(key), F.explode(F.filter(terms(F.col(text)), lambda t: t.isin(asked))).alias("term"))
    tf = hits.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    scored = tf.join(F.broadcast(df), "term").withColumn("w", F.log1p("tf") * F.log(1 + n / F.col("df"))).groupBy(key).agg(F.round(F.sum("w"), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def matching(docs: DataFrame, grain: str | None = None, seasons: list[int] | None = None, teams: list[str] | None = None, week: int | None = None) -> DataFrame:
    """Documents that a search may find: of this grain and week, any of the seasons, all of the teams; what isn't given doesn't filter.

    It comes before any ranking, so that a ranking's places go to documents that may be found.
    """
    kept = docs
    if grain is not None:
        kept = kept.where(F.col("grain") == grain)
    if seasons is not None:
        kept = kept.where(F.col("season").isin(seasons))
    if week is not None:
        kept = kept.where(F.col("week") == week)
    if teams:
        kept = kept.where(F.size(F.array_except(F.array(*map(F.lit, teams)), "teams")) == 0)
    return kept


def hashed(docs: DataFrame, key: str, text: str, size: int = 256) -> DataFrame:
    """``key``, ``vector``: texts as hashed bags of words of length one (all zero without words): the embedder that needs no model."""
    words = docs.select(key, terms(F.coalesce(text, F.lit(""))).alias("_words"))
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size).transform(words)
    return Normalizer(inputCol="_tf", outputCol="_unit").transform(counted).select(key, vector_to_array("_unit", "float32").alias("vector"))


def index_updates(docs: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``digest``, ``vector`` of the documents that an index (``key``, ``digest``) lacks or holds with another text; others aren't embedded again."""
    now = docs.select(key, text, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"))
    due = now.join(index.select(key, "digest"), [key, "digest"], "left_anti")
    return due.select(key, "digest").join(hashed(due, key, text), key)


def require_space(index: dict, model: str, size: int) -> None:
    """Refuse to compare vectors of different models or sizes: ``index`` is what was noted when the index was built."""
    if (index.get("model"), index.get("size")) != (model, size):
        raise ValueError(f"the index holds {index.get('model')} vectors of {index.get('size')}, not {model} of {size}")


def fuse(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two ranked lists as one: the sum of 1 / (60 + rank), and where each row was found."""
    both = a.select(key, F.col("rank").alias("ra")).join(b.select(key, F.col("rank").alias("rb")), key, "full_outer")
    part = lambda r: F.coalesce(1.0 / (FUSION + F.col(r)), F.lit(0.0))
    found = F.when(F.col("ra").isNull(), "lexical").when(F.col("rb").isNull(), "dense").otherwise("both")
    return both.select(key, F.round(part("ra") + part("rb"), 9).alias("fused"), found.alias("found_by"))


def block_rank(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, blocks: int = 256) -> DataFrame:
    """``query``, ``key``, ``score``, ``rank``: the ``k`` most similar other rows of each row of a stated set of queries.

    The rows are spread over blocks and every query visits each block, where the best are kept, so that
    only ``k`` rows a query and block are ranked in the end. Ties go to the smaller key; rows whose vector is null or all
    zero, or differs in length from the query's, have no rank.
    """

    def normed(df: DataFrame) -> DataFrame:
        x = F.transform(F.col(vector), lambda v: v.cast("double"))
        size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))
        return df.select(F.col(key), x.alias("_x"), F.nullif(size, F.lit(0.0)).alias("_size")).where("_size IS NOT NULL")

    rows = normed(vectors).withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    asked = normed(queries).select(F.col(key).alias("query"), F.col("_x").alias("_q"), F.col("_size").alias("_q_size"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    dot = F.aggregate(F.zip_with("_q", "_x", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    scored = rows.join(asked, "_block").where(F.col(key) != F.col("query")).select("query", F.col(key), "_block", F.round(dot / (F.col("_q_size") * F.col("_size")), 12).alias("score"))
    order = [F.desc("score"), F.asc(key)]
    in_block = Window.partitionBy("query", "_block").orderBy(*order)
    best = scored.where("score IS NOT NULL").withColumn("_r", F.row_number().over(in_block)).where(F.col("_r") <= k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", key, "score", "rank")


def ranking_scores(ranked: DataFrame, relevant: Column, k: int) -> DataFrame:
    """One row: queries, ``hit_at_1``, ``recall_at_k`` (queries with any relevant row among the first ``k``), ``mrr`` (0 where none)."""
    first = ranked.where(F.col("rank") <= k).groupBy("query").agg(F.min(F.when(relevant, F.col("rank"))).alias("first"))
    return first.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.coalesce(F.col("first") == 1, F.lit(False)).cast("double")).alias("hit_at_1"),
        F.avg(F.col("first").isNotNull().cast("double")).alias("recall_at_k"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )
