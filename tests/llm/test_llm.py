"""Operators for training data against brute force, round trips and held-out labels."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from compare import same
from pyspark.sql import functions as F

from hashmark.llm import neighbours, packing, queries, splits, subjects, tokens

TEAMS = "team string, former_team string"


@pytest.mark.parametrize("name", sorted(queries.registry.sql))
def test_against_sql(spark, small, oracle, name):
    same(queries.registry.queries[name](spark, small), oracle, queries.registry.sql[name])


@pytest.mark.parametrize("name", sorted(set(queries.registry.queries) - set(queries.registry.sql)))
def test_runs(spark, small, name):
    assert queries.registry.queries[name](spark, small).count() > 0


# --- splits


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(180)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("x", None), ("y", "y"), ("c000", "c001")]
    nodes = [("alone",), ("x",), (None,)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if b is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    root |= {"alone": "alone", "x": "x"}
    got = dict(splits.components(spark.createDataFrame(nodes, "node string"), spark.createDataFrame(edges, "a string, b string")).collect())
    assert got == {a: find(a) for a in root}
    empty = spark.createDataFrame([], "node string")
    assert splits.components(empty, spark.createDataFrame([], "a string, b string")).count() == 0


PLAYS = "game_id string, season int, posteam_won boolean, component string, split string"
GAMES = "game_id string, moved_from string"


def plays_of(spark, games, seasons=4):
    rows = [(g, 2000 + i % seasons, None if j % 9 == 0 else (i + j) % 2 == 0, "c", "s") for i, (g, n) in enumerate(games) for j in range(n)]
    return spark.createDataFrame(rows, PLAYS)


def test_splits_keep_games_together(spark):
    games = [(f"2000_{i:02}_AAA_T{i}", 20 + i % 7) for i in range(120)] + [("2000-05-old-t5 ", 11), ("2001_77_MVD_T9", 13), (None, 6), (" ", 3)]
    plays = plays_of(spark, games)
    dims = spark.createDataFrame([("2001_77_mvd_t9", "2001_78_GONE_T9"), ("2001_78_gone_t9", "2000-09-AAA-T9"), ("2000_01_AAA_T1", "")], GAMES)
    teams = spark.createDataFrame([("AAA", "OLD"), ("BBB", None)], TEAMS)
    got = splits.split_plays(plays.drop("split"), dims, teams)
    assert got.count() == plays.count()
    by = defaultdict(set)
    share = Counter()
    for r in got.collect():
        assert r.split in ("train", "validation", "test")
        by[r.game_id].add(r.split)
        share[r.split] += 1
    assert all(len(s) == 1 for s in by.values())
    assert by["2000-05-old-t5 "] == by["2000_05_AAA_T5"] and by["2001_77_MVD_T9"] == by["2000_09_AAA_T9"]
    assert abs(share["train"] / plays.count() - 0.8) < 0.05 and share["test"] and share["validation"]
    pairs = {tuple(r) for r in splits.same_split_pairs(plays, dims, teams).collect()}
    assert pairs == {("2000-05-old-t5 ", "2000_05_AAA_T5"), ("2000_09_AAA_T9", "2001_77_MVD_T9")}


def test_a_game_with_a_third_of_the_plays(spark):
    plays = plays_of(spark, [("hot", 1000)] + [(f"g{i}", 20) for i in range(100)])
    sizes = Counter()
    for r in splits.assign_splits(plays, spark.createDataFrame([], GAMES), spark.createDataFrame([], TEAMS)).collect():
        sizes[r.split] += r.n_rows
    assert sum(sizes.values()) == 3000 and abs(sizes["train"] / 3000 - 0.8) < 0.05


# --- nearest vectors

DOCS = "doc_id long, embedding array<float>, vector string, id string"


def brute(rows, k, dims):
    usable = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(usable)
    x = np.stack([usable[i] / np.linalg.norm(usable[i]) for i in ids])
    s = np.round(x @ x.T, 12)
    pairs = set()
    for a in range(len(ids)):
        for b in sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]:
            pairs.add((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return pairs


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 96))
    vectors = [(i, (centres[i % 40] + 0.3 * rng.standard_normal(96)) * rng.uniform(0.2, 5)) for i in range(1500)]
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in vectors]
    rows += [(2000 + i, rows[3][1]) for i in range(300)]  # many copies of one
    rows += [(3000, None), (3001, []), (3002, [1.0] * 95), (3003, [0.0] * 96), (3004, [float("nan")] + [1.0] * 95), (3005, [float("inf")] * 96), (3006, [None] + [1.0] * 95)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], DOCS)
    got = {tuple(r) for r in neighbours.nearest_pairs(df).collect()}
    want = brute(rows, 5, 96)
    assert len(got & want) / len(want) >= 0.9
    copies = {p for p in want if p[0] in (3, *range(2000, 2300)) and p[1] in range(2000, 2300)}
    assert copies <= got
    assert len(got - want) <= 0.1 * len(want)


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(1, [1.0] * 96, "", ""), (2, [2.0] * 96, "", "")], DOCS)
    assert {tuple(r) for r in neighbours.nearest_pairs(df).collect()} == {(1, 2)}
    assert neighbours.nearest_pairs(df.where("doc_id = 1")).count() == 0
    assert neighbours.nearest_pairs(df.where("false")).count() == 0


def test_large_cells_are_divided(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 40)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 96))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.05 * rng.standard_normal(96)]) for i in range(600)]
    found = {r.doc_id: r.neighbours for r in neighbours.nearest(spark.createDataFrame([(i, v, "", "") for i, v in rows], DOCS)).collect()}
    # none is left out, and no list is short
    assert len(found) == 600 and all(len(n) == 5 for n in found.values())


def test_groups_of_a_tight_cluster_stay_small(spark, monkeypatch):
    """Vectors that the words can't tell apart: no group grows with them, and the search is as good as exact."""
    monkeypatch.setattr(neighbours, "CELL", 40)
    monkeypatch.setattr(neighbours, "CHUNK", 40)
    monkeypatch.setattr(neighbours, "FIRST", 1)
    monkeypatch.setattr(neighbours, "RESIDUAL", (2,) * 8)
    seen = []
    real = neighbours._placed_cells
    monkeypatch.setattr(neighbours, "_placed_cells", lambda *a: seen.append(real(*a)) or seen[-1])
    rng = np.random.default_rng(4)
    x = (rng.standard_normal(96) + 0.01 * rng.standard_normal((1200, 96))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(f) for f in v], "", "") for i, v in enumerate(x)], DOCS)
    found = {r.doc_id: [n.doc_id for n in r.neighbours] for r in neighbours.nearest(df).collect()}
    groups = seen[0].groupBy("cell", "block", "chunk").agg(F.count_if("asks").alias("asks"), F.count_if("member").alias("members")).agg(F.max("asks"), F.max("members"), F.count(F.lit(1))).first()
    assert groups[0] <= 3 * 40 and groups[1] <= 3 * 40 and groups[2] > 30
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    np.fill_diagonal(sims, -2)
    right = [set(np.lexsort((np.arange(1200), -sims[i]))[:5]) for i in range(1200)]
    assert sum(len(right[i] & set(found[i])) for i in range(1200)) >= 0.9 * 5 * 1200


def test_many_who_come_by_a_small_cell(spark, monkeypatch):
    """Vectors between two words come by both, members or not: they meet a small cell's members in chunks."""
    monkeypatch.setattr(neighbours, "CHUNK", 50)
    monkeypatch.setattr(neighbours, "PER_WORD", 400)
    seen = []
    real = neighbours._placed_cells
    monkeypatch.setattr(neighbours, "_placed_cells", lambda *a: seen.append(real(*a)) or seen[-1])
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(12)]) for i in range(1200)]
    got = {tuple(r) for r in neighbours.nearest_pairs(spark.createDataFrame(rows, "doc_id long, embedding array<float>"), 5, 12).collect()}
    most = seen[0].groupBy("cell", "block", "chunk").agg(F.count_if("asks").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2 * 50
    want = brute(rows, 5, 12)
    assert len(got & want) / len(want) > 0.99


# --- tokens

TEXTS = [
    (1, "a" * 5000), (2, " " * 3000 + "x"), (3, "don't" * 400 + "\n\n" * 300 + "What"), (4, ""), (5, None), (6, "日本語。" * 500 + " " * 100 + "x"), (7, "b c" * 3000), (7, "b c" * 3000),
    (8, "''''" * 300), (9, "<|endoftext|> hi"), (10, "  two  spaces \t\r\n\r\n end  "), (11, "🙂é  " * 200), (12, "Word. \n\nNext \n line" * 200),
]


@pytest.mark.parametrize(("stride", "overlap"), [(64, 16), (40, 40), (16_384, 512)])
def test_ids_and_round_trip(spark, stride, overlap):
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    whole = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in TEXTS], "doc_id long, text string, ids int, _doc string")
    encoded = tokens.encode(docs, stride=stride, overlap=overlap)
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == want
    assert Counter((r.doc_id, r.text) for r in tokens.decode(encoded).collect()) == Counter((i, t or "") for i, t in TEXTS)
    assert Counter((r.doc_id, r.ids) for r in tokens.encode(docs, stride=stride, overlap=overlap, counts=True).collect()) == Counter((i, len(x)) for i, x in want.elements())


def test_no_texts(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- packing


def test_packing(spark):
    rng = random.Random(4)
    items = [(i, rng.choice([1, 7, 300, 300, 511, 1024, 2047, 2048, 2049, 5000, 0, None])) for i in range(3000)] + [(5, 300), (5, 300)]
    packed = packing.pack(spark.createDataFrame([(i, s, 1, 2) for i, s in items], "doc_id long, size int, container int, piece int"))
    rows = packed.collect()
    by_doc, used = defaultdict(list), Counter()
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.size))
        used[r.container] += r["size"]
    assert max(used.values()) <= 2048
    want = Counter()
    for i, s in items:
        want[i] += s or 0
    assert all(sum(s for _, s in by_doc.get(i, [])) == n for i, n in want.items())
    for i, s in items:
        if s and s <= 2048 and i != 5:
            assert by_doc[i] == [(0, s)]
    total = sum(s or 0 for _, s in items)
    assert len(used) <= math.ceil(total / 2048 * 1.03)
    lengths = packing.containers(packed).collect()
    assert all(r.used <= r.length and r.length in packing.LENGTHS for r in lengths)
    assert packing.pack(spark.createDataFrame([], "doc_id long, size int")).count() == 0


def test_plan_does_not_grow_with_the_items():
    rng = random.Random(2)
    small = {rng.randrange(1, 2048): rng.randrange(1, 50) for _ in range(500)}
    large = {s: n * 1_000_003 for s, n in small.items()}
    a, b = packing.plan(small), packing.plan(large)
    assert len(b) < 4 * len(a) + 2000
    for histogram, plan in ((small, a), (large, b)):
        placed = Counter()
        for p in plan:
            placed[p.size] += p.until - p.first
        assert placed == Counter(histogram)


# --- subjects


def test_subjects_of_made_up_texts(spark):
    rng = random.Random(8)
    words = {"law": "court judge appeal verdict statute".split(), "travel": "flight hotel luggage airport itinerary".split(), "science": "hypothesis sample variance friction sensor".split()}
    docs, truth = [], {}
    for i in range(600):
        chosen = rng.sample(sorted(words), 1 if i % 4 else 2)
        lines = [f"The {rng.choice(words[s])} and the {rng.choice(words[s])} were noted on day {i}." for s in chosen for _ in range(4)] + ["More in the next bulletin."] * 2
        rng.shuffle(lines)
        docs.append((i, " ".join(lines), "zz"))
        truth[i] = set(chosen)
    docs += [(1000, None, None), (1001, "", None), (1002, " \n", None), (1003, "12 34 !!", None), (1004, "More in the next bulletin. " * 3, None), (1005, "The court and the appeal. " * 3000, None)]
    labels = [(i, rng.choice(sorted(truth[i])) if rng.random() > 0.1 else "law", "a") for i in range(0, 600, 5)]
    areas = [("law", "Court and judge."), ("travel", "Flight and hotel."), ("science", "Hypothesis and sample."), (None, None)]
    got = defaultdict(set)
    args = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(areas, "subject string, description string"), spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    for r in subjects.document_subjects(*args).collect():
        got[r.doc_id].add(r.subject)
    right = sum(got[i] == t for i, t in truth.items())
    assert right / len(truth) > 0.9
    assert got[1005] == {"law"} and not any(got[i] for i in (1000, 1001, 1002, 1003))
    assert subjects.document_subjects(args[0].where("false"), *args[1:]).count() == 0


def test_subjects_agree_with_annotators(spark, small):
    """Documents two annotators agree on, though single labels have errors."""
    read = lambda n: spark.read.parquet(f"{small}/{n}.parquet")
    found = subjects.document_subjects(read("documents"), read("subject_areas"), read("subject_labels")).join(read("subject_labels"), ["doc_id", "subject"])
    assert found.count() >= 0.6 * read("subject_labels").count()




def test_a_passing_remark(spark):
    """One of six sentences with a subject isn't enough, one of five is; sentences without any don't count."""
    rows = [(1, "law", 1, 5, True), (2, "law", 1, 6, False), (3, "law", 2, 10, True), (4, "law", 2, 11, False), (5, "law", 1, 1, True)]
    counted = spark.createDataFrame(rows, "doc_id long, subject string, n_sentences long, n_any long, expected boolean")
    assert counted.where(subjects.is_subject() != F.col("expected")).count() == 0


def test_splits_with_clashing_columns(spark):
    """Columns of the plays named like those made on the way are kept, but for ``split`` itself."""
    plays = plays_of(spark, [(f"g{i}", 12) for i in range(40)] + [(None, 4)])
    named = plays.drop("split", "component").withColumns({"split": F.lit("old"), "node": F.lit(1), "component": F.lit("c"), "_node": F.lit(2), "_game": F.lit(3)})
    got = splits.split_plays(named, spark.createDataFrame([], GAMES), spark.createDataFrame([], TEAMS))
    assert sorted(got.columns) == sorted(named.columns)
    assert got.count() == named.count() and got.where("split NOT IN ('train', 'validation', 'test')").count() == 0 and got.where("node = 1 AND component = 'c' AND _node = 2 AND _game = 3").count() == got.count()


def test_lists_are_full_where_cells_are_small(spark, monkeypatch):
    """Cells of about two vectors hold too few: the rest is searched exactly, copies and ties included."""
    monkeypatch.setattr(neighbours, "PER_WORD", 2)
    monkeypatch.setattr(neighbours, "PROBES", 1)
    monkeypatch.setattr(neighbours, "CELL", 90)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(12)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(3)] + [(2000, None), (2001, [0.0] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    found = {r.doc_id: [x.doc_id for x in r.neighbours] for r in neighbours.nearest(docs, 5, 12).collect()}
    assert set(found) == {i for i, _ in rows if i < 2000} and all(len(x) == 5 for x in found.values())
    assert found[7][:3] == [1000, 1001, 1002] and found[1001][:3] == [7, 1000, 1002]
    want = brute(rows, 5, 12)
    got = {tuple(r) for r in neighbours.nearest_pairs(docs, 5, 12).collect()}
    assert len(got & want) / len(want) > 0.99


@pytest.mark.parametrize("parts", [1, 40])
def test_multiples_of_a_vector_tie(spark, parts):
    """Many multiples of one vector and a few of others: the least ids are nearest, whichever task holds them."""
    rng = np.random.default_rng(11)
    one = rng.standard_normal(96)
    vectors = [(i, one * (0.3 + i / 7)) for i in range(300)] + [(1000 + i, rng.standard_normal(96)) for i in range(200)]
    vectors += [(2000 + i, dict(vectors)[1000 + i // 4] * (1.7 + i)) for i in range(40)]
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in vectors]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(parts)
    found = {r.doc_id: [x.doc_id for x in r.neighbours] for r in neighbours.nearest(docs).collect()}
    for i in range(300):
        assert found[i] == [j for j in range(6) if j != i][:5]
    for i in range(40):
        assert found[2000 + i][:4] == [j for j in (1000 + i // 4, *range(2000 + i // 4 * 4, 2004 + i // 4 * 4)) if j != 2000 + i]


def test_multiples_fill_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 30)
    one = np.random.default_rng(12).standard_normal(96)
    docs = spark.createDataFrame([(i, [float(np.float32(x)) for x in one * (0.3 + i / 7)]) for i in range(300)], "doc_id long, embedding array<float>").repartition(60)
    found = {r.doc_id: [x.doc_id for x in r.neighbours] for r in neighbours.nearest(docs).collect()}
    assert found == {i: [j for j in range(6) if j != i][:5] for i in range(300)}


def test_many_more_vectors_than_the_codebooks_saw(spark):
    """Cells hold many more than are reranked without the tables, and their borders cut through what is near each other: few pairs are lost."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((3, 96))[np.arange(2400) % 3] + 0.5 * rng.standard_normal((2400, 96))
    rows = [(i, [float(np.float32(f)) for f in v]) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    found = neighbours.nearest(docs, sample=300).select("doc_id", F.explode("neighbours.doc_id").alias("b")).collect()
    got = {(min(r), max(r)) for r in map(tuple, found)}
    want = brute(rows, 5, 96)
    assert len(got & want) >= 0.99 * len(want)


def test_leaves_are_fitted_on_all_documents(spark, monkeypatch):
    """However many there are: the directions and the leaves come from every text that has words."""
    monkeypatch.setattr(subjects, "SAMPLE", 50, raising=False)
    seen = []

    def centres(docs, *_):
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        raise InterruptedError

    monkeypatch.setattr(subjects, "_leaf_centres", centres)
    words = "court judge appeal verdict statute flight hotel luggage airport itinerary".split()
    docs = spark.createDataFrame([(i, f"The {words[i % 10]} and the {words[i // 10 % 10]}.") for i in range(600)] + [(1000, None), (1001, " ")], "doc_id long, text string")
    with pytest.raises(InterruptedError):
        subjects.fit(docs, spark.createDataFrame([("law", "Court.")], "subject string, description string"), spark.createDataFrame([], "doc_id long, subject string, annotator string"))
    assert seen == [set(range(600))]
