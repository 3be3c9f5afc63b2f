"""Nulls, ties, repeats, empty tables, long texts and clashing names in the operators that care for the data."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hashmark.operators import delivery, diff, drift, orphans

T0 = datetime(2020, 1, 1)
TEAMS = "team string, team_name string, conference string, division string, former_team string"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def teams(spark):
    return spark.createDataFrame([("AAA", "A", "x", "y", "OLD"), ("BBB", None, None, None, None)], TEAMS)


PLAYS = "play_key string, game_id string, season int, passer_player_id string, receiver_player_id string, loaded_at timestamp, _salt int, status string"
STAYS = "loaded_at timestamp, removed_at timestamp"


def find(spark, plays, games, players):
    return {
        tuple(r)
        for r in orphans.orphan_cases(
            spark.createDataFrame(plays, PLAYS), spark.createDataFrame(games, "game_id string, " + STAYS), spark.createDataFrame(players, "player_id string, " + STAYS), teams(spark)
        ).collect()
    }


def test_orphans(spark):
    games = [("2020_01_OLD_BBB", day(5), None), ("g2", day(1), day(3)), ("g2", day(6), None), ("g3", None, None), ("g4", day(4), day(2))]
    players = [(" p-1", day(0), None), (None, day(0), None)]
    plays = [
        ("k1", "2020-01-aaa-bbb\t", 2020, "P_1", None, day(5), 1, "x"),  # there at the very moment
        ("k2", "2020_01_AAA_BBB", None, "none", " ", day(4), 1, "x"),  # came later; placeholders are no reference
        ("k3", "g2", 1, "p2", "p2", day(3), 1, "x"),  # removed at that moment
        ("k4", "g2", 1, None, None, day(7), 1, "x"),  # back again
        ("k5", "g3", 1, None, None, day(9), 1, "x"),  # never begun
        ("k6", "g4", 1, None, None, day(9), 1, "x"),  # a stay that holds no moment
        ("k7", "", 1, None, None, day(9), 1, "x"),
        ("k7", None, 1, "p9", None, None, 1, "x"),
        ("k3", "g2", 1, "p2", "p2", day(3), 1, "x"),  # repeated
    ]
    want = {("k2", "game_id"), ("k3", "game_id"), ("k3", "passer_player_id"), ("k3", "receiver_player_id"), ("k5", "game_id"), ("k6", "game_id"), ("k7", "passer_player_id")}
    assert find(spark, plays, games, players) == want
    assert find(spark, [], games, players) == set()
    assert ("k4", "game_id") in find(spark, plays, [], [])


def test_orphans_hot_key(spark):
    refs = spark.range(4000).select(F.lit("t").alias("target"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("ref_key"), F.timestamp_seconds("id").alias("ref_time"), "id")
    parents = spark.createDataFrame([("t", "hot", datetime(1970, 1, 1, 0, 10), datetime(1970, 1, 1, 0, 20))], "target string, ref_key string, valid_from timestamp, valid_to timestamp")
    import hashmark.operators.skew as skew

    least, skew.hot_keys.__defaults__ = skew.hot_keys.__defaults__, (1024, 5)
    try:
        got = orphans.classify(refs, parents, parts=50).where("ref_key = 'hot'").groupBy("status").count()
        assert {r.status: r["count"] for r in got.collect()} == {"resolved": 200, "came later": 200, "was removed": 934}
    finally:
        skew.hot_keys.__defaults__ = least


FEED = "partition_no int, msg_offset long, game_id string, sequence_no int, received_at timestamp, n string, is_copy string, _salt string"


def test_copies(spark):
    rows = [
        (0, 1, "g_1", 1, day(1), None, "a", "b"),
        (0, 2, "G-1 ", 1, day(2), None, "a", "b"),
        (1, 3, "g_1", 1, day(2), None, "a", "b"),
        (0, 4, "g_1", None, day(2), None, "a", "b"),
        (0, 5, None, 1, day(2), None, "a", "b"),
        (0, 6, "  ", 1, day(2), None, "a", "b"),
        (0, 7, "g_1", 2, None, None, "a", "b"),
        (0, 8, "g_1", 2, day(0), None, "a", "b"),
    ]
    got = delivery.dropped(spark.createDataFrame(rows, FEED), teams(spark)).collect()
    assert {tuple(r) for r in got} == {(0, 1), (0, 2), (0, 7)}
    assert delivery.dropped(spark.createDataFrame([], FEED), teams(spark)).count() == 0


def test_absorbing_batches_keeps_what_marking_at_once_keeps(spark):
    import random

    rng = random.Random(5)
    rows = [(0, i, rng.choice(["g_1", "G-1", "g_2", None, " "]), rng.choice([1, 2, 3, None]), rng.choice([day(d) for d in range(6)] + [None]), None, "a", "b") for i in range(120)]
    feed = spark.createDataFrame(rows, FEED)
    want = {(r.partition_no, r.msg_offset) for r in delivery.feed_marked(feed, teams(spark)).where("NOT is_copy").collect()}
    for moment in ("2000-01-01", str(day(2)), str(day(4)), "2100-01-01"):
        got = delivery.feed_absorbed(feed, teams(spark), moment).collect()
        assert {(r.partition_no, r.msg_offset) for r in got} == want and len(got) == len(want)


def test_copies_of_a_hot_message(spark):
    import hashmark.operators.skew as skew

    least, skew.hot_keys.__defaults__ = skew.hot_keys.__defaults__, (1024, 5)
    try:
        rows = spark.range(3000).select((F.col("id") % 4).cast("int").alias("partition_no"), F.col("id").alias("msg_offset"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id"))).alias("game_id"), F.lit(1).alias("sequence_no"), F.timestamp_seconds(F.col("id") % 1000).alias("received_at"))
        marked = delivery.mark_copies(rows, {"g": F.col("game_id"), "s": F.col("sequence_no")}, ["received_at", "msg_offset", "partition_no"], parts=40)
        assert marked.count() == 3000
        kept = marked.where("NOT is_copy AND game_id = 'hot'").collect()
        assert len(kept) == 1 and kept[0].msg_offset == 999
        assert marked.where("is_copy").count() == 999
    finally:
        skew.hot_keys.__defaults__ = least


def test_drift(spark):
    def file(feed, name, n, records):
        return [(feed, name, day(n), i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)]

    rows = [
        *file("f", "a", 0, [{"game_id": "g-1", "play_id": 1, "season": 2020, "x": 1, "b": True}, {"game_id": "g_2", "play_id": 2, "season": "2021 ", "x": None, "b": None}, "{broken", None, "[1]"]),
        *file("f", "b", 1, [{"game_id": "G_1", "play_id": "1", "yr": "2020", "x": 1.5, "b": None}, {"game_id": "g3", "play_id": 3, "yr": "2022", "x": 2.5, "b": None}, {"play_id": 4}]),
        *file("f", "c", 2, [{"game_id": "g4", "play_id": 4, "yr": 5, "n": None, "b": None}]),
        *file("g", "z", 5, [{"game_id": "g4", "play_id": 4, "Season": 5}]),
    ]
    stg = spark.createDataFrame(rows, "feed_name string, file_name string, delivered_at timestamp, line_no int, raw_record string")
    got = {tuple(r) for r in drift.change_cases(stg, teams(spark)).collect()}
    assert got == {("b", "renamed", "yr"), ("b", "retyped", "yr"), ("b", "retyped", "x"), ("c", "removed", "x"), ("c", "added", "n"), ("c", "retyped", "yr")}
    table = drift.consistent_plays(stg, teams(spark)).orderBy("feed_name", "file_name", "line_no").collect()
    assert [r.season for r in table] == [2020, 2021, 2020, 2022, None, 5, 5]
    empty = stg.where("false")
    assert drift.change_cases(empty, teams(spark)).count() == 0 and drift.consistent_plays(empty, teams(spark)).count() == 0


def test_drift_uses_proven_renames(spark):
    """Spellings that no list holds are followed along their feed, on from a known one and back from one, and only in it."""

    def file(feed, name, n, season, kind, types, **more):
        return [(feed, name, day(n), i, json.dumps({"game_id": f"g{i}", "play_id": i, season: 2020 + i, kind: types[i], **more})) for i in range(3)]

    spelled = ["pass", "run", "punt"]
    rows = [
        *file("f", "a", 0, "season", "play_type", spelled),
        *file("f", "b", 1, "saison", "art", spelled),
        *file("f", "c", 2, "jahr", "art", [1, 2, 3]),
        *file("g", "x", 0, "anno", "play_type", spelled),
        *file("g", "y", 1, "season", "play_type", spelled),
        *file("h", "z", 0, "season", "play_type", spelled, jahr="other"),
    ]
    stg = spark.createDataFrame(rows, "feed_name string, file_name string, delivered_at timestamp, line_no int, raw_record string")
    got = drift.consistent_plays(stg, teams(spark)).collect()
    assert len(got) == len(rows)
    assert all(r.season == 2020 + r.line_no and r.play_type == spelled[r.line_no] for r in got)
    assert all(r.other_fields == ({"jahr": "other"} if r.feed_name == "h" else {}) for r in got)


SIDE = "k string, v double, s string, at timestamp, _block int, field_name string"


def brute(a, b):
    def newest(rows):
        out = {}
        for r in sorted(rows, key=lambda r: r[3]):
            out[r[0]] = r
        return out

    x, y = newest(a), newest(b)
    found = set()
    for k in x.keys() | y.keys():
        if k not in y:
            found.add((k, "only_in_primary"))
        elif k not in x:
            found.add((k, "only_in_replica"))
        else:
            p, q = x[k], y[k]
            nan = lambda v: None if v is None or v != v else v
            u, w = nan(p[1]), nan(q[1])
            if (u is None) != (w is None) or (u is not None and abs(u - w) > 1e-6 * max(1, abs(u), abs(w))):
                found.add((k, "v"))
            t = lambda v: None if v is None else v.strip()
            if t(p[2]) != t(q[2]):
                found.add((k, "s"))
    return found


def test_differences(spark):
    a = [(f"k{i}", i * 1.1, f"s{i % 5}", day(1), 0, "f") for i in range(300)] + [("k7", 3.0, " s9", day(2), 0, "f"), ("n", None, None, day(1), 0, "f"), ("m", float("nan"), "", day(1), 0, "f")]
    b = [(f"k{i}", i * 1.1 * (1 + (3e-6 if i % 50 == 3 else 2e-7)), f" s{i % 5} " if i % 40 else "other", day(1), 0, "f") for i in range(5, 310)] + [("n", 1e-9, None, day(1), 0, "f"), ("m", None, " ", day(1), 0, "f"), ("m", None, " ", day(1), 0, "f")]
    left, right = spark.createDataFrame(a, SIDE), spark.createDataFrame(b, SIDE)

    def run(x, y):
        return {tuple(r) for r in diff.difference(x, y, {"key": F.col("k")}, ["v", "s"], ("at", "at")).collect()}

    assert run(left, right) == brute(a, b)
    assert run(left, left) == set()
    assert run(left.where("false"), right) == {(k, "only_in_replica") for k in {r[0] for r in b}}
    assert run(left.where("false"), right.where("false")) == set()
