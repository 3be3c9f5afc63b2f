"""Messages from encoding to the feed, through a stream that stops and goes on; checks of whole tables."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashmark.operators import quality
from hashmark.streaming import replay, score

SCHEMA = "game string, seq int, wp double, is_final boolean"


def test_messages(spark):
    events = spark.createDataFrame([("g", 1, 0.5, False), ("g", 2, None, True)], SCHEMA)
    raw = replay.encode(events, "play")
    assert sorted(map(tuple, replay.sound(raw, "value", SCHEMA, ["play"], ["game", "seq"]).collect())) == [("g", 1, 0.5, False), ("g", 2, None, True)]
    bad = [None, "", "{", "[1]", "3", '{"version": 2, "kind": "play", "game": "g", "seq": 1}', '{"version": 1, "kind": "x", "game": "g", "seq": 1}', '{"version": 1, "kind": "play", "game": "g"}', '{"kind": "play"}']
    dead = replay.dead_letters(spark.createDataFrame([(b,) for b in bad], "value string").union(raw), "value", ["play"], ["game", "seq"])
    assert {r.value: r.reason for r in dead.collect()} == dict(
        zip(bad, ["empty", "not json", "not json", "not an object", "not an object", "other version", "unknown kind", "missing seq", "missing version"])
    )
    assert replay.dead_letters(raw.where("false"), "value", ["play"], []).count() == 0


def test_feed_goes_on_after_a_stop(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def deliver(name, rows):
        lines = [json.dumps({"version": 1, "kind": "play", **dict(zip(("game", "seq", "wp", "is_final"), r))}) if isinstance(r, tuple) else r for r in rows]
        (src / name).write_text("\n".join(lines))

    def run():
        raw = spark.readStream.text(str(src))
        good = replay.sound(raw, "value", SCHEMA, ["play"], ["game", "seq"])
        assert replay.drain(score.stream_changes(good, "game", "seq", "wp", "is_final"), str(tmp_path / "feed"), str(tmp_path / "ck1"), 120)
        assert replay.drain(replay.dead_letters(raw, "value", ["play"], ["game", "seq"]), str(tmp_path / "dead"), str(tmp_path / "ck2"), 120)

    deliver("0.txt", [("a", 0, 0.5, False), ("a", 1, 0.6, False), "broken", ("b", 0, 0.4, False)])
    run()
    deliver("1.txt", [("a", 2, 1.0, True), ("b", 1, 0.45, False), "{}"])
    run()
    deliver("2.txt", [("a", 3, 0.5, False), ("b", 1, 0.25, False)])  # a new game under an old key; a result scored again
    run()
    got = {(r.game, r.seq): (r.score, r.change) for r in replay.read_feed(spark, str(tmp_path / "feed"), ["game", "seq"]).collect()}
    assert got == {("a", 0): (0.5, 0.0), ("a", 1): (0.6, 0.1), ("a", 2): (1.0, 0.4), ("a", 3): (0.5, 0.0), ("b", 0): (0.4, 0.0), ("b", 1): (0.25, pytest.approx(-0.2))}
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "dead")).collect()) == ["broken", "{}"]


def test_windows_of_a_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(minutes=10 * i), "k" if i % 3 else None, None if i == 4 else float(i)) for i in range(20)]
    events = spark.createDataFrame(rows, "ts timestamp, k string, v double")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = replay.windowed(stream, "ts", "1 hour", ["k"], "v").writeStream.format("memory").queryName("windows_seen").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    want = replay.windowed(events, "ts", "1 hour", ["k"], "v")
    assert sorted(map(str, spark.table("windows_seen").collect())) == sorted(map(str, want.collect()))


def test_measures(spark):
    df = spark.createDataFrame([(1, 2.0), (None, 4.0), (30, None)], "a int, b double")
    got = {(r.check_name, r.column_name): (r.value, r.passed) for r in quality.measures(df, [quality.mean_between("b", 0, 3), quality.null_rate_below("a", 0.1), quality.rows_between(1, 3)]).collect()}
    assert got == {("mean_between", "b"): (3.0, True), ("null_rate_below", "a"): (pytest.approx(1 / 3), False), ("rows_between", ""): (3.0, True)}
    empty = quality.measures(df.where("false"), [quality.mean_between("b", 0, 3), quality.rows_between(1, 3)]).collect()
    assert [r.passed for r in empty] == [False, False]
    bad = {r.column_name: (r.least, r.greatest) for r in quality.examples(df, [quality.in_range("a", 0, 5), quality.expression("even", "b", F.col("b") % 2 == 0)]).collect()}
    assert bad == {"a": ("30", "30"), "b": (None, None)}


def test_schema_differences(spark):
    df = spark.createDataFrame([], "a int, b string, c double")
    want = T.StructType().add("a", "integer").add("b", "integer").add("d", "string")
    assert quality.schema_differences(df, want) == ["d: missing", "b: string instead of int", "c: not agreed on"]
    assert quality.schema_differences(df.select("a"), T.StructType().add("a", "integer")) == []
    assert quality.schema_differences(df.select("b", "a"), T.StructType().add("a", "integer").add("b", "string")) == ["columns in another order"]
