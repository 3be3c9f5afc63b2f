"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashmark.llm import neighbours, packing, splits, subjects, tokens
from hashmark.plans.registry import Registry
from hashmark.sources.tables import table, tables

registry = Registry()

_CLEAN = "upper(replace(trim({c}, ' ' || chr(9)), '-', '_'))"
_GAME = f"CASE WHEN {_CLEAN} <> '' THEN array_to_string(list_transform(string_split({_CLEAN}, '_'), lambda p: coalesce(m[p], p)), '_') END"


_PLACED = f"""WITH RECURSIVE aliases AS (SELECT map(list(f), list(t)) AS m FROM (
  SELECT {_CLEAN.format(c='former_team')} AS f, min({_CLEAN.format(c='team')}) AS t FROM dim_team WHERE trim(former_team) <> '' GROUP BY 1)),
written AS (SELECT game_id, {_GAME.format(c='game_id')} AS node, count(*) AS n_rows FROM fact_plays, aliases GROUP BY ALL),
links AS (SELECT {_GAME.format(c='game_id')} AS a, {_GAME.format(c='moved_from')} AS b FROM dim_game, aliases),
edges AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT DISTINCT node AS a, node AS b FROM written WHERE node IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1),
placed AS (SELECT game_id, component, n_rows FROM written JOIN comp USING (node))
"""


@registry.query("p2_found", _PLACED + "SELECT x.game_id AS game_id_a, y.game_id AS game_id_b FROM placed x JOIN placed y ON x.component = y.component AND x.game_id < y.game_id")
def p2_found(spark, sf_dir):
    """Pairs of game ids as written that must share a split."""
    return splits.same_split_pairs(*tables(spark, sf_dir, "fact_plays", "dim_game", "dim_team"))


@registry.query("p2_classes", _PLACED + "SELECT game_id, component, n_rows FROM placed")
def p2_classes(spark, sf_dir):
    """Game ids as written with the component that must share a split, and their plays: the same as the pairs, one row an id."""
    return splits.same_split_classes(*tables(spark, sf_dir, "fact_plays", "dim_game", "dim_team"))


@registry.query("p2_kept_together", _PLACED + "SELECT component, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS n_splits FROM placed GROUP BY 1")
def p2_kept_together(spark, sf_dir):
    """Each component's plays, and the number of splits they lie in."""
    plays, games, teams = tables(spark, sf_dir, "fact_plays", "dim_game", "dim_team")
    split = splits.split_plays(plays, games, teams).groupBy("game_id", "split").agg(F.count(F.lit(1)).alias("n"))
    classes = splits.same_split_classes(plays, games, teams).select("game_id", "component")
    return classes.join(split, "game_id").groupBy("component").agg(F.sum("n").alias("n_rows"), F.countDistinct("split").alias("n_splits"))


@registry.query("p2_splits")
def p2_splits(spark, sf_dir):
    """Rows, seasons' spread and share of posteam_won of each split."""
    split = splits.split_plays(*tables(spark, sf_dir, "fact_plays", "dim_game", "dim_team"))
    return split.groupBy("split", "season").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("posteam_won").cast("int")).alias("share_won"))


@registry.query(
    "p3_found",
    """WITH usable AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM documents
  WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT a.doc_id AS a, b.doc_id AS b, row_number() OVER (PARTITION BY a.doc_id ORDER BY round(list_cosine_similarity(a.e, b.e), 12) DESC, b.doc_id) AS r
  FROM usable a JOIN usable b ON a.doc_id <> b.doc_id)
SELECT DISTINCT least(a, b) AS doc_id_a, greatest(a, b) AS doc_id_b FROM near WHERE r <= 5""",
)
def p3_found(spark, sf_dir):
    """Pairs of documents of which one is among the five nearest of the other."""
    return neighbours.nearest_pairs(table(spark, sf_dir, "documents"))


@registry.query("p7_ids")
def p7_ids(spark, sf_dir):
    """The token ids of every document's text."""
    return tokens.encode(table(spark, sf_dir, "documents"))


@registry.query("p7_roundtrip", "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents")
def p7_roundtrip(spark, sf_dir):
    """The texts as their ids give them back: length and digest."""
    texts = tokens.decode(tokens.encode(table(spark, sf_dir, "documents")))
    return texts.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@registry.query("p8_pack")
def p8_pack(spark, sf_dir):
    """Where each document's text goes: piece, container and size in tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@registry.query("p8_containers")
def p8_containers(spark, sf_dir):
    """The containers with what they hold and the length they are cut down to."""
    return packing.containers(packing.pack_documents(table(spark, sf_dir, "documents")))


@registry.query("p8_faults", "SELECT doc_id, true AS in_order, true AS cut_only_beyond, true AS within FROM documents WHERE length(text) > 0")
def p8_faults(spark, sf_dir):
    """Every document that has a text, once: whether its pieces are whole, cut only where they must be, in containers that aren't too full."""
    return packing.faults(packing.pack_documents(table(spark, sf_dir, "documents")))


@registry.query("p9_found")
def p9_found(spark, sf_dir):
    """The subjects of every document."""
    return subjects.document_subjects(*tables(spark, sf_dir, "documents", "subject_areas", "subject_labels"))


@registry.query("p9_composition")
def p9_composition(spark, sf_dir):
    """The corpus by subject: documents and sentences."""
    counted = subjects.sentence_counts(*tables(spark, sf_dir, "documents", "subject_areas", "subject_labels"))
    return counted.groupBy("subject").agg(F.count_if(subjects.is_subject()).alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))


@registry.query("p9_leaves")
def p9_leaves(spark, sf_dir):
    """The leaves of the clustering: the terms that label them and their mixtures of subjects."""
    return subjects.leaf_report(*tables(spark, sf_dir, "documents", "subject_areas", "subject_labels"))
