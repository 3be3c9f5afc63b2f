"""Replayed events scored with state: decode, dead letters, change against the event before, idempotent output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Results are rounded as they are published, and the state keeps what was published.
DIGITS = 4


def decode(events: DataFrame, payload: str, required: list[str]) -> DataFrame:
    """``events`` with ``reason``: null for a sound JSON object with all required fields, else why it is a dead letter."""
    v = F.try_parse_json(payload)
    shape = F.schema_of_variant(v)
    reason: Column = F.when(F.col(payload).isNull(), "empty").when(v.isNull(), "not json").when(~shape.startswith("OBJECT"), "not an object")
    for f in required:
        reason = reason.when(F.try_variant_get(v, f"$.{f}", "string").isNull(), f"missing {f}")
    return events.withColumn("reason", reason)


def changes(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The batch twin of the stream: each event's value, rounded, and its change against the event before of its key (0 at first)."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.round(F.col(value), DIGITS)
    return events.withColumn("score", now).withColumn("change", F.round(now - F.coalesce(F.lag(now).over(w), now), DIGITS)).withColumn("sequence", F.row_number().over(w) - 1)


def stream_changes(events: DataFrame, key: str, order: str, value: str, final: str | None = None) -> DataFrame:
    """``key``, ``order``, ``score``, ``change`` of a stream: the state of a key is the value published last and survives restarts.

    Within a batch events are put in order by ``order``; across batches they must come in order. With ``final``, a
    boolean column, a key's state is given up once its last event is in.
    """
    kinds = dict(events.dtypes)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        df = pd.concat(list(frames)).sort_values(order, kind="stable")
        now = df[value].round(DIGITS)
        before = now.shift(1)
        if len(now):
            before.iloc[0] = now.iloc[0] if last is None else last
            state.update((float(now.iloc[-1]),))
        if final and df[final].fillna(False).astype(bool).any():
            state.remove()
        yield pd.DataFrame({key: df[key], order: df[order], "score": now, "change": (now - before).round(DIGITS)})

    return events.groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {order} {kinds[order]}, score double, change double", "last double", "append", GroupStateTimeout.NoTimeout
    )


def lead_changes(scored: DataFrame, key: str, order: list[str], p: str) -> DataFrame:
    """Per key how often the favourite changes (exactly even doesn't count) and the biggest swing after the first event."""
    w = Window.partitionBy(key).orderBy(*order)
    sided = scored.withColumn("swing", F.abs(F.col(p) - F.lag(p).over(w))).withColumn("side", F.when(F.col(p) > 0.5, 1).when(F.col(p) < 0.5, -1))
    before = F.last("side", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return sided.withColumn("turn", (F.col("side") != before).cast("int")).groupBy(key).agg(F.coalesce(F.sum("turn"), F.lit(0)).alias("lead_changes"), F.round(F.max("swing"), DIGITS).alias("biggest_swing"))
