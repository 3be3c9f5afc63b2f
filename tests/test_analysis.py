"""Decisions, rankings and metrics against brute force, with nulls, ties and empty tables."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from hashmark.operators import decisions, models, retrieval
from hashmark.sources.tables import register_views


def test_binned_means(spark):
    rows = [(0, 10.0)] * 3 + [(12, 20.0)] * 3 + [(29, 40.0)] + [(None, 5.0), (7, None), (100, 1.0), (-3, 1.0)]
    df = spark.createDataFrame(rows, "x int, y double")
    got = {r.bin: (r.n, r.value) for r in decisions.binned_means(df, "x", "y", 5, 8, 3).collect()}
    assert got[0] == (3, 10.0) and got[2] == (3, 20.0)
    assert got[1] == (0, 10.0)  # equally near: the lower
    assert got[5] == (1, 20.0) and got[7] == (0, 20.0)
    thin = {r.value for r in decisions.binned_means(df, "x", "y", 5, 8, 99).collect()}
    assert thin == {(30.0 + 60.0 + 40.0) / 7}
    assert {(r.n, r.value) for r in decisions.binned_means(df.where("false"), "x", "y", 5, 8, 3).collect()} == {(0, None)}


STATES = "k string, down int, ydstogo int, yardline_100 int, game_seconds_remaining double, score_differential int, qtr int, p_convert double, p_kick double, landing double"


def test_option_values(spark):
    states = spark.createDataFrame([("a", 4, 1, 30, 600.0, 0, 3, 0.9, 0.5, 80.0), ("b", 4, 15, 80, 600.0, -3, 4, 0.0, 0.0, 75.0), ("c", 4, 2, 3, 3.0, -2, 4, 0.5, 0.9, 90.0)], STATES)

    def value(s):  # the nearer the goal and the further ahead, the better
        return s.withColumn("p", 0.5 + F.col("score_differential") / 20 + (50 - F.col("yardline_100")) / 200)

    def p(yard, margin):
        return 0.5 + margin / 20 + (50 - yard) / 200

    got = {r.k: r for r in decisions.option_values(states, "k", value).collect()}
    for k, togo, y, m, pc, pk, landing in (("a", 1, 30, 0, 0.9, 0.5, 80), ("b", 15, 80, -3, 0.0, 0.0, 75), ("c", 2, 3, -2, 0.5, 0.9, 90)):
        go = pc * p(max(y - togo, 1), m) + (1 - pc) * (1 - p(100 - y, -m))
        kick = pk * (1 - p(75, -(m + 3))) + (1 - pk) * (1 - p(min(max(100 - (y + 7), 1), 80), -m))
        punt = 1 - p(landing, -m)
        r = got[k]
        assert (r.go, r.kick, r.punt) == pytest.approx((go, kick, punt))
        order = sorted([go, kick, punt], reverse=True)
        assert {"go": go, "kick": kick, "punt": punt}[r.best] == pytest.approx(order[0]) and r.edge == pytest.approx(order[0] - order[1])
    same = decisions.option_values(states, "k", lambda s: s.withColumn("p", F.lit(0.5)))
    assert {(r.best, r.edge) for r in same.collect()} == {("go", 0.0)}
    assert decisions.option_values(states.where("false"), "k", value).count() == 0
    audit = decisions.audit(decisions.option_values(states, "k", value), F.lit("punt")).first()
    assert audit.n == 3 and audit.mean_regret >= 0


def test_block_rank(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(100, None), (101, []), (102, [0.0] * 6), (103, [1.0, 2.0])]
    rows += [(60, rows[0][1]), (61, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    sound = {i: v for i, v in rows if v and len(v) == 6 and any(v)}

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b)), 5)

    got = {}
    for r in retrieval.block_rank(df.where("id % 20 = 0"), df, "id", "v", 5, blocks=7).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r
    assert set(got) == {0, 20, 40, 60}
    for query, found in got.items():
        best = sorted((-cos(sound[query], v), i) for i, v in sound.items() if i != query)[:5]
        assert [round(found[k].score, 5) for k in range(1, 6)] == pytest.approx([-s for s, _ in best], abs=2e-5)
    assert [got[0][k].id for k in (1, 2)] == [60, 61]  # ties go to the smaller key


def test_ranking_scores(spark):
    ranked = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, True), (3, 1, False), (3, 9, True)], "query int, rank int, good boolean")
    got = retrieval.ranking_scores(ranked, F.col("good"), 5).first()
    assert (got.n_queries, got.hit_at_1, got.recall_at_k, got.mrr) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(0.5))
    assert retrieval.ranking_scores(ranked.where("false"), F.col("good"), 5).first().n_queries == 0


def test_feature_auc(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.4, rng.choice([None, float("nan"), 1.0, 2.0, 2.0]), rng.gauss(0, 1)) for _ in range(400)] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "y boolean, a double, b double")
    got = {r.feature: r for r in models.feature_auc(df, ["a", "b"], "y", parts=8).collect()}
    for at, name in ((1, "a"), (2, "b")):
        held = [(r[0], r[at]) for r in rows if r[0] is not None and r[at] is not None and not math.isnan(r[at])]
        pos, neg = [v for y, v in held if y], [v for y, v in held if not y]
        auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        assert got[name].n == len(held) and got[name].auc == pytest.approx(max(auc, 1 - auc))
    assert models.feature_auc(df.where("y"), ["b"], "y").first().auc is None
    assert models.feature_auc(df.where("false"), ["a", "b"], "y").count() == 0


def test_views(spark, small):
    register_views(spark, small, "dim_team", "nation")
    assert spark.sql("SELECT count(*) FROM dim_team").first()[0] == 32
