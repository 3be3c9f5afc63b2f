"""Expressions, stores, checks, models and the stream on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashmark.functions.compat import as_date, bucket, floor_zero, max_by_known, min_by_known, ratio
from hashmark.functions.fuzzy import _jaro_winkler, alike_names
from hashmark.functions import names
from hashmark.functions.ids import game_key, player_key
from hashmark.operators import models, plays, quality, quantiles, retrieval
from hashmark.sources import store, tables
from hashmark.streaming import score


def test_ids(spark):
    df = spark.createDataFrame([("\t2020-01-old_bbb ",), ("  ",), (None,), ("none ",), ("00_0001",), ("2020_01_OLDX_BBB",)], "c string")
    got = df.select(game_key(F.col("c"), {"OLD": "AAA"}).alias("g"), player_key(F.col("c")).alias("p")).collect()
    assert [r.g for r in got] == ["2020_01_AAA_BBB", None, None, "NONE", "00_0001", "2020_01_OLDX_BBB"]
    assert [r.p for r in got][1:5] == [None, None, None, "00_0001"]


def test_dates_of_any_type(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("soon",), (None,)], "d string")
    assert [str(r.d) for r in df.select(as_date(df, "d").alias("d")).collect()] == ["2024-02-29", "None", "None", "None"]
    times = df.limit(1).select(F.lit("2024-05-06 07:08:09").cast("timestamp").alias("d"))
    assert str(times.select(as_date(times, "d").alias("d")).first().d) == "2024-05-06"


def test_known_extremes(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7), (4, None)], "t int, v int")
    r = df.agg(max_by_known(F.col("v"), F.col("t")).alias("a"), min_by_known(F.col("v"), F.col("t")).alias("b"), ratio(F.sum("v"), F.lit(0)).alias("c")).first()
    assert (r.a, r.b, r.c) == (7, 5, None)
    x = spark.createDataFrame([(-3,), (0,), (None,)], "v int").select(floor_zero(F.col("v")).alias("f"), bucket(F.col("v"), [(-1, "low"), (0, "zero")], "high").alias("b")).collect()
    assert [tuple(r) for r in x] == [(0, "low"), (0, "zero"), (None, None)]


def test_labels(spark):
    """Each label at its bound and just beyond it; null in, null out, but for the two-valued flags."""
    cols = "down int, ydstogo int, yardline_100 int, score_differential int, wp double, qtr int, game_seconds_remaining double"
    togo = {1: "short", 2: "short", 3: "medium", 6: "medium", 7: "long", 10: "long", 11: "very_long", 40: "very_long"}
    yard = {0: "red_zone", 20: "red_zone", 21: "opponent_territory", 40: "opponent_territory", 41: "midfield", 60: "midfield", 61: "own_territory", 80: "own_territory", 81: "backed_up", 99: "backed_up"}
    score = {-30: "trailing_big", -17: "trailing_big", -16: "trailing_two_scores", -9: "trailing_two_scores", -8: "trailing_one_score", -1: "trailing_one_score", 0: "tied", 1: "leading_one_score", 8: "leading_one_score",
             9: "leading_two_scores", 16: "leading_two_scores", 17: "leading_big"}
    rows = [(2, n, None, None, None, None, None) for n in togo] + [(None, None, n, None, None, None, None) for n in yard] + [(None, None, None, n, None, None, None) for n in score]
    df = spark.createDataFrame(rows, cols).withColumns({"game_id": F.lit("g"), "fixed_drive": F.lit(None).cast("int"), "play_type": F.lit(" Extra  Point ")})
    got = plays.with_labels(df).collect()
    assert {r.ydstogo: r.distance for r in got if r.down} == togo
    assert {r.yardline_100: r.zone for r in got if r.yardline_100 is not None} == yard
    assert {r.score_differential: r.score_state for r in got if r.score_differential is not None} == score
    assert got[-1].distance is None and got[-1].zone is None and got[0].score_state is None and not got[0].neutral and not got[0].garbage
    assert got[0].kind == "extra_point" and got[0].drive_key is None
    flags = {(0.2, 3, 500.0): (True, False), (0.19, 3, 500.0): (False, False), (0.8, 2, 1921.0): (True, False), (0.8, 2, 1920.0): (False, False), (0.5, 4, 500.0): (False, False), (0.96, 4, 5.0): (False, True), (0.95, 4, 5.0): (False, False),
             (0.04, 5, None): (False, True), (0.5, None, 500.0): (False, False)}
    df = spark.createDataFrame([(None, None, None, None, *k) for k in flags], cols).withColumns({"game_id": F.lit("g"), "fixed_drive": F.lit(3), "play_type": F.lit(None).cast("string")})
    assert {(r.wp, r.qtr, r.game_seconds_remaining): (r.neutral, r.garbage) for r in plays.with_labels(df).collect()} == flags


def test_store(spark, tmp_path):
    d = str(tmp_path)
    week = lambda n, v: spark.createDataFrame([(2020, n, v), (2020, n, v + 1)], "season int, week int, v int")
    store.write_partitions(week(1, 1).unionByName(week(2, 5)), d + "/p", ["season", "week"])
    store.write_partitions(week(2, 9), d + "/p", ["season", "week"])
    assert {(r.week, r.v) for r in spark.read.parquet(d + "/p").collect()} == {(1, 1), (1, 2), (2, 9), (2, 10)}
    store.publish(week(1, 1), d + "/t", "1")
    store.publish(week(1, 3), d + "/t", "2")
    assert {r.v for r in store.current(spark, d + "/t").collect()} == {3, 4}
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n{"a": \nnot json\n{"a": 2}\n')
    good, bad = store.read_json_lines(spark, d + "/log.jsonl", T.StructType([T.StructField("a", T.IntegerType())]))
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.count() == 2
    twice = lambda x: x.unionByName(x)
    assert store.content_hash(twice(week(1, 1)), ["v"]).collect() != store.content_hash(twice(week(1, 8)), ["v"]).collect()
    store.write_partitions(week(3, 7), d + "/p", ["season", "week"], whole=True)
    assert {r.week for r in spark.read.parquet(d + "/p").collect()} == {3}
    assert {tuple(r) for r in store.read_partitions(spark, d + "/p", "season=2020/week=3").select("season", "week", "v").collect()} == {(2020, 3, 7), (2020, 3, 8)}
    store.append_lines(week(1, 1), d + "/log")
    store.append_lines(week(2, 5), d + "/log")
    assert store.read_json_lines(spark, d + "/log", T.StructType([T.StructField("v", T.IntegerType())]))[0].count() == 4
    a, b = week(1, 1), week(1, 1).orderBy(F.desc("v"))
    assert store.content_hash(a, a.columns).collect() == store.content_hash(b, b.columns).collect() != store.content_hash(week(1, 2), a.columns).collect()
    (tmp_path / "t.csv").write_text("team,n\nAAA,1\n")
    assert store.read_csv(spark, d + "/t.csv", "team string, n int").first().n == 1


def test_what_must_be_built_again(spark):
    rows = spark.createDataFrame([(2020, 1), (2020, 2), (2021, 3), (None, 4)], "season int, v int")
    by = lambda df: store.content_hash(df, ["v"], ["season"])
    plan = lambda *a: store.rebuild_plan(*a, "season", True)[0]
    assert plan(None, by(rows)) == "full" and store.rebuild_plan(by(rows), by(rows), "season", False)[0] == "full"
    assert plan(by(rows), by(rows)) == "none" and plan(by(rows), by(rows.where("season = 2020 OR season IS NULL"))) == "full"
    assert plan(by(rows), by(rows.withColumn("v", F.when(F.col("season").isNull(), 9).otherwise(F.col("v"))))) == "incremental"
    noted, now = store.manifest({"a": rows, "b": rows}), store.manifest({"a": rows.orderBy(F.desc("v")), "c": rows})
    assert {tuple(r) for r in store.drifted(noted, now).collect()} == {("b", "removed"), ("c", "added")}


def test_kept_tables_replace_each_other(spark):
    from hashmark.session import Kept, hadoop_path

    kept = Kept(spark)
    once = kept.keep(spark.range(3), "x")
    twice = kept.keep(once.withColumn("id", F.col("id") + 10), "x")
    assert sorted(r.id for r in twice.collect()) == [10, 11, 12]
    where, files = hadoop_path(spark, kept.at)
    assert [s.getPath().getName() for s in files.listStatus(where)] == ["x-2"]


def test_no_folder_of_ones_own_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from hashmark.session import shared_folder

    def session(master, named=None, set_dir=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: set_dir))

    assert shared_folder(session("spark://a:1", named="hdfs://x")) == shared_folder(session("spark://a:1", set_dir="hdfs://x")) == "hdfs://x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://a:1"))


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 9), (None, None)], "k string, n int")
    got = {r.column_name + r.check_name: r.n_failed for r in quality.report(df, [quality.not_null("k"), quality.in_range("n", 0, 5), quality.accepted("k", ["a"])]).collect()}
    assert got == {"knot_null": 1, "nin_range": 1, "kaccepted_values": 1}
    with pytest.raises(ValueError, match="k not_null: 1 of 3 rows"):
        quality.require(df, [quality.not_null("k")])


def test_retrieval(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "i int, v array<double>")
    assert [(r.i, r["rank"]) for r in retrieval.dense_rank(vectors, "i", "v", [1.0, 0.0], 2).collect()] == [(1, 1), (2, 2)]
    docs = spark.createDataFrame([(1, "salary cap cap"), (2, "Salary"), (3, None), (4, "")], "i int, t string")
    assert [r.i for r in retrieval.lexical_rank(docs, "i", "t", "cap salary", 5).collect()] == [1, 2]


def test_models(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(1500):
        s, y = rng.randrange(-20, 20), rng.randrange(1, 99)
        rows.append((2000 + i % 4, s, y, rng.random() < 1 / (1 + 2.718 ** (-0.25 * s))))
    df = spark.createDataFrame(rows, "season int, score_differential int, yardline_100 int, posteam_won boolean")
    frame = models.design(df, "posteam_won", ["score_differential", "yardline_100"])
    train, _, test = models.season_split(frame, 2002, 2003)
    scored = models.score(models.fit(train, ["score_differential", "yardline_100"]), test)
    assert models.rank_auc(scored).first().auc > 0.8 and models.metrics(scored).first().log_loss < 0.55
    with pytest.raises(ValueError, match="only after the play"):
        models.design(df, "posteam_won", ["epa"])
    # of six pairs four are in order and one is tied
    v = spark.createDataFrame([(0.2, 0.0), (0.6, 0.0), (0.6, 1.0), (0.9, 1.0), (0.3, 1.0)], "p double, label double")
    assert models.rank_auc(v).first().auc == pytest.approx(4.5 / 6)
    assert models.rank_auc(v.where("label = 1")).first().auc is None
    with pytest.raises(ValueError, match="no rows"):
        models.fit(train.where("false"), ["score_differential", "yardline_100"])


def test_models_are_loaded_as_saved(spark, tmp_path):
    rows = [(2000, float(i % 7), float(i % 2 if i % 7 < 4 else 1)) for i in range(200)]
    train = spark.createDataFrame(rows, "season int, x double, label double")
    for kind in ("network", "trees"):
        model = models.fit(train, ["x"], kind, train.limit(50))
        models.save(model, str(tmp_path / kind))
        p = lambda m: [round(r.p, 9) for r in models.score(m, train.limit(20)).collect()]
        assert p(model) == p(models.load(str(tmp_path / kind)))
    assert models.best(train, train.limit(40), ["x"], ["network", "logistic"]).stages[-1].numClasses == 2 and models.best(train, train.where("false"), ["x"], ["logistic"]).stages[-1].numFeatures == 1
    rate = train.limit(1).select(models.base_rate(train).alias("b")).first().b
    assert rate == pytest.approx(sum(y for _, _, y in rows) / 200)


def test_percentiles_against_brute_force(spark):
    import math
    import random

    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.random(), 0.5, float(rng.randrange(4))])) for _ in range(3000)] + [("only nulls", None)]
    got = {r.k: r for r in quantiles.exact(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"low": 0.1, "mid": 0.5, "high": 0.99}, parts=7).collect()}
    for k in {k for k, _ in rows}:
        known = sorted(v for g, v in rows if g == k and v is not None)
        want = [known[math.ceil(p * len(known)) - 1] if known else None for p in (0.1, 0.5, 0.99)]
        assert [got[k].low, got[k].mid, got[k].high] == want and got[k].n == sum(g == k for g, _ in rows)


def test_samples_weeks_and_loads(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", 2020 + i % 3, i % 20 + 1) for i in range(300)], "k string, season int, week int")
    a, b = tables.seeded_sample(df, "k", 20, 1), tables.seeded_sample(df.repartition(13), "k", 20, 1)
    assert sorted(a.collect()) == sorted(b.collect()) != sorted(tables.seeded_sample(df, "k", 20, 2).collect())
    assert {(r.season, r.week) for r in tables.in_weeks(df, [202003], ["2021-08"]).collect()} == {(2020, 3), (2021, 8)} and tables.in_weeks(df, [], []).count() == 0
    assert tables.load(df, str(tmp_path / "t"), 300) == 300
    with pytest.raises(ValueError, match="300 rows loaded"):
        tables.load(df, str(tmp_path / "u"), 299)
    assert not (tmp_path / "u").exists()
    none = tables.table_or_empty(spark, str(tmp_path), "absent", "a int, b string")
    assert none.columns == ["a", "b"] and none.count() == 0
    assert tables.capped(df, 7).count() == 7


def test_names_in_texts(spark):
    docs = spark.createDataFrame([(1, "The St. Mary Old Boys' team beat MARY OLD 3-1; Mary Old's win."), (2, None), (3, ""), (4, "old boys"), (5, "Élan Nord Élan Nord")], "i int, t string")
    known = spark.createDataFrame([("St. Mary Old Boys",), ("Mary Old, Jr.",), ("élan nord",), ("Old Boys",)], "n string").select(names.name_key(F.col("n")).alias("name_key"))
    got = sorted((r.i, r.start, r["name_key"]) for r in names.mentions(docs, "i", "t", known).collect())
    assert got == [(1, 1, "st mary old boys"), (1, 7, "mary old"), (1, 11, "mary old"), (4, 0, "old boys"), (5, 0, "élan nord"), (5, 2, "élan nord")]
    n = spark.range(1, 1000).select(F.col("id").cast("int").alias("n")).withColumn("r", names.roman(F.col("n"))).withColumn("back", names.from_roman(F.col("r")))
    assert n.where("back <> n OR r IS NULL").count() == 0 and n.where("n = 949").first().r == "CMXLIX"
    odd = spark.createDataFrame([("IIII",), ("",), (None,), ("x ",), ("abc",), ("IXI",)], "r string").select(names.from_roman(F.col("r")).alias("v")).collect()
    assert [r.v for r in odd] == [None, None, None, 10, None, None]


def test_an_index_is_brought_up_to_date(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "changed"), (3, "new"), (4, None)], "i int, t string")
    index = retrieval.index_updates(docs.withColumn("t", F.when(F.col("i") == 2, "before").otherwise(F.col("t"))).where("i IN (1, 2)"), docs.select("i", F.lit("").alias("digest")).limit(0), "i", "t")
    due = retrieval.index_updates(docs, index, "i", "t").collect()
    assert sorted(r.i for r in due) == [2, 3, 4] and {len(r.vector) for r in due} == {256}
    assert {r.i: round(sum(x * x for x in r.vector), 5) for r in due} == {2: 1.0, 3: 1.0, 4: 0.0}
    retrieval.require_space({"model": "hashed", "size": 256}, "hashed", 256)
    with pytest.raises(ValueError, match="vectors of 256"):
        retrieval.require_space({"model": "hashed", "size": 256}, "hashed", 96)


def test_stream_equals_batch_across_restarts(spark, tmp_path):
    rows = [("g1", i, 0.5 + (i * 37 % 11) / 40) for i in range(12)] + [("g2", i, 0.3 + i / 50) for i in range(6)]
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    schema = "game string, seq int, wp double"

    def run():
        s = spark.readStream.schema(schema).json(str(src))
        scored = score.stream_changes(s, "game", "seq", "wp")
        scored.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)

    for part in range(2):
        (src / f"{part}.json").write_text("\n".join(json.dumps(dict(zip(("game", "seq", "wp"), r))) for r in rows if (r[1] >= 4) == bool(part)))
        run()
    got = {(r.game, r.seq): (r.score, r.change) for r in spark.read.parquet(str(out)).collect()}
    batch = score.changes(spark.createDataFrame(rows, schema), "game", ["seq"], "wp").collect()
    assert got == {(r.game, r.seq): (pytest.approx(r.score), pytest.approx(r.change, abs=1e-9)) for r in batch}


def test_dead_letters(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("{",), (None,), ('{"b": 1}',)], "v string")
    assert [r.reason for r in score.decode(df, "v", ["a"]).collect()] == [None, "not an object", "not json", "empty", "missing a"]


def test_misspelt_surnames_find_all_alike(spark):
    """Every pair at 0.88 or more, by brute force; names between the first and the last of a group too."""
    names = ["mahomes", "mahones", "mahaffey", "mason", "allen", "allan", "al", "kelce", "kelcey", "st. brown", "brown", "browne", "", None, "mahomes"]
    asked = ["mahommes", "alen", "kelec", "bronw", "al", None, "zz", ""]
    got = [(r.asked, r.name) for r in alike_names(spark.createDataFrame([(x,) for x in asked], "asked string"), spark.createDataFrame([(x,) for x in names], "name string")).collect()]
    want = {(a, b) for a in asked for b in names if a is not None and b is not None and _jaro_winkler(a, b) >= 0.88}
    assert sorted(got) == sorted(want)
    assert {("mahommes", "mahomes"), ("mahommes", "mahones"), ("alen", "allen")} <= want


def test_fuzzy_lookup_finds_the_player(spark, small):
    """Each misspelt surname meets the one it was made of; nothing is compared with itself alone."""
    from hashmark.plans import warehouse

    found = warehouse.registry.queries["fuzzy_lookup"](spark, small).collect()
    assert found and any(r.similarity < 1 for r in found)
    assert len({r.short_name for r in found}) > 1
    for asked in {r.asked for r in found}:
        right = asked[:2] + asked[3] + asked[2] + asked[4:]
        assert right in {r.short_name.split(".")[-1].lower() for r in found if r.asked == asked}
