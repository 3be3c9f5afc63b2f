"""From raw messages to a feed and back: decoding, dead letters, sinks that repeat harmlessly, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashmark.streaming.score import decode

#: The version that messages carry; others are dead letters.
VERSION = 1


def encode(events: DataFrame, kind: str, payload: str = "value") -> DataFrame:
    """Rows as JSON messages with their kind and the version; nulls are written, so that readers can tell them from missing fields."""
    body = F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(kind).alias("kind"), *events.columns), {"ignoreNullFields": "false"})
    return events.select(body.alias(payload))


def judged(raw: DataFrame, payload: str, kinds: list[str], required: list[str]) -> DataFrame:
    """``raw`` with ``reason``: null for a sound message of a known kind and version, else why it is a dead letter."""
    v = F.try_parse_json(payload)
    version, kind = F.try_variant_get(v, "$.version", "int"), F.try_variant_get(v, "$.kind", "string")
    later = F.when(~version.eqNullSafe(F.lit(VERSION)), "other version").when(~F.coalesce(kind.isin(kinds), F.lit(False)), "unknown kind")
    return decode(raw, payload, ["version", "kind", *required]).withColumn("reason", F.coalesce("reason", later))


def sound(raw: DataFrame, payload: str, schema: T.StructType | str, kinds: list[str], required: list[str]) -> DataFrame:
    """The fields of sound messages, by ``schema``; fields it doesn't name are ignored."""
    good = judged(raw, payload, kinds, required).where("reason IS NULL")
    return good.select(F.from_json(payload, schema).alias("_e")).select("_e.*")


def dead_letters(raw: DataFrame, payload: str, kinds: list[str], required: list[str]) -> DataFrame:
    """All other messages as they came, each with its ``reason``."""
    return judged(raw, payload, kinds, required).where("reason IS NOT NULL")


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch has a folder of its own, so that one done again after a loss replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def drain(stream: DataFrame, path: str, checkpoint: str, seconds: int = 600) -> bool:
    """Process what the source holds now, then stop; a later call goes on from the checkpoint. False if time ran out."""
    query = stream.writeStream.foreachBatch(batch_sink(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done = query.awaitTermination(seconds)
    if not done:
        query.stop()
    return done


def read_feed(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What a sink holds, one row a key: the one of the latest batch."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(F.col("batch_id").cast("long").alias("batch_id"), *rest)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def windowed(events: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling windows of event time: of a stream with a watermark of ``late``, of a table as they are."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    found = marked.groupBy(F.window(time, width).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("_w.start").alias("window_start"), *keys, "n", "total")
