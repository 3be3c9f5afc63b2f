"""Splits that keep related records together: hash-to-min components, weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashmark.functions.ids import game_key, team_aliases
from hashmark.operators.skew import hot_keys, replicated, salted
from hashmark.session import Kept, cut

#: Rounds after which clusters that still change are an error; hash-to-min needs about the logarithm of the longest chain.
MAX_ROUNDS = 60


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``, ``component`` for all of ``nodes`` (``node``) and both ends of ``edges`` (``a``, ``b``); the component is its least node.

    Hash-to-min: each node holds a cluster of nodes, at first itself and its neighbours. In each round it sends
    its cluster to the least node in it, and that least node to all of the cluster, until no cluster changes. Clusters
    are (node, member) rows without repeats, those of a node with a large share of them salted, so a component of any
    size is spread over all tasks; only a count and a sum of hashes come to the driver, and two rounds are stored at most. Nulls are no nodes; repeated edges and loops don't matter.
    """
    ends = F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("member")) for x in "ab" for y in "ab"])
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.explode(ends).alias("e")).select("e.*")
    own = nodes.where(F.col("node").isNotNull()).select("node", F.col("node").alias("member"))
    kept = Kept(nodes.sparkSession)
    clusters = kept.keep(both.unionByName(own).distinct(), "clusters")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first())

    before = state(clusters)
    for _ in range(MAX_ROUNDS):
        least = kept.keep(clusters.groupBy("node").agg(F.min("member").alias("least"), F.count(F.lit(1)).alias("n")), "least")
        # the least node of a large component holds all of it: such clusters are spread by their members
        hot = hot_keys(least.select("node", "n"), ["node"])
        known = salted(clusters, hot, ["node"], ["member"]).join(replicated(least.select("node", "least"), hot, ["node"]), ["node", "_salt"])
        # a node that holds others sends them to its least member; the least member tells all of them its name
        sent = known.select(F.explode(F.array(F.struct(F.col("least").alias("node"), "member"), F.struct(F.col("member").alias("node"), F.col("least").alias("member")))).alias("s")).select("s.*")
        clusters = kept.keep(sent.distinct(), "clusters")
        after = state(clusters)
        if after == before:
            # clusters that no longer change have the same least members
            return least.select("node", F.col("least").alias("component"))
        before = after
    raise RuntimeError(f"clusters still change after {MAX_ROUNDS} rounds")


def game_components(plays: DataFrame, dim_game: DataFrame, dim_team: DataFrame) -> DataFrame:
    """``node`` (game under the id rule), ``component``: games of plays and dim_game, connected where one was moved to another."""
    aliases = team_aliases(dim_team)
    nodes = plays.select(game_key(F.col("game_id"), aliases).alias("node")).unionByName(dim_game.select(game_key(F.col("game_id"), aliases).alias("node"))).distinct()
    edges = dim_game.select(game_key(F.col("game_id"), aliases).alias("a"), game_key(F.col("moved_from"), aliases).alias("b"))
    return components(nodes, edges)


def same_split_pairs(plays: DataFrame, dim_game: DataFrame, dim_team: DataFrame) -> DataFrame:
    """``game_id_a`` < ``game_id_b``: all pairs of different spellings in the plays that must share a split.

    Null, empty and blank ids name no game and have no pair. The pairs are of distinct spellings of one
    game or chain of moved games, never of rows.
    """
    written = plays.select("game_id").distinct().withColumn("node", game_key(F.col("game_id"), team_aliases(dim_team)))
    placed = written.join(game_components(plays, dim_game, dim_team), "node").select("game_id", "component")
    a, b = placed.withColumnRenamed("game_id", "game_id_a"), placed.withColumnRenamed("game_id", "game_id_b")
    return a.join(b, "component").where("game_id_a < game_id_b").select("game_id_a", "game_id_b")


def same_split_classes(plays: DataFrame, dim_game: DataFrame, dim_team: DataFrame) -> DataFrame:
    """``game_id`` as written in the plays, ``component`` it belongs to, ``n_rows``: what the pairs say, one row a spelling."""
    written = plays.where(F.col("game_id").isNotNull()).groupBy("game_id").agg(F.count(F.lit(1)).alias("n_rows"))
    named = written.withColumn("node", game_key(F.col("game_id"), team_aliases(dim_team)))
    return named.join(game_components(plays, dim_game, dim_team), "node").select("game_id", "component", "n_rows")


def rendezvous(key: Column, seed: Column, weights: dict[str, Column | float]) -> Column:
    """The split whose weighted hash of the key is best: -weight / ln(u), u uniform in (0, 1) from key, split and seed."""

    def score(name: str, weight: Column | float) -> Column:
        u = (F.pmod(F.xxhash64(key, F.lit(name), seed), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return F.struct((-(weight if isinstance(weight, Column) else F.lit(float(weight))) / F.log(u)).alias("score"), F.lit(name).alias("split"))

    return F.greatest(*[score(n, w) for n, w in weights.items()])["split"]


def assign_splits(plays: DataFrame, dim_game: DataFrame, dim_team: DataFrame, weights: dict[str, float] | None = None, seeds: int = 32, components: DataFrame | None = None) -> DataFrame:
    """``component``, ``split``, ``n_rows``: 80/10/10 of the plays unless ``weights`` says otherwise; ``components`` if they are known already.

    Components holding more than a quarter of the smallest split's share (at most 4 / that share of them, as
    shares add to one) can't be left to chance: largest first, each goes to the split that lacks most rows. All others
    go by weighted rendezvous hashing with the weights that then remain. Of ``seeds`` hashes, all tried in
    one pass over the components, the one is taken whose splits come nearest to the weights in rows, in each
    season and in the share of posteam_won. Plays without a game are components of their own kind: each
    null or blank id is one component named null. Deterministic; no play is left out.
    """
    weights = weights or {"train": 0.8, "validation": 0.1, "test": 0.1}
    total_weight = sum(weights.values())
    weights = {k: w / total_weight for k, w in weights.items()}
    aliases = team_aliases(dim_team)
    won = F.sum(F.coalesce(F.col("posteam_won").cast("int"), F.lit(0)))
    by_game = plays.groupBy(game_key(F.col("game_id"), aliases).alias("node"), "season").agg(F.count(F.lit(1)).alias("n_rows"), won.alias("n_won"))
    components = game_components(plays, dim_game, dim_team) if components is None else components
    stats = cut(
        by_game.join(components, "node", "left").groupBy("component", "season").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_won").alias("n_won"))
    )
    sizes = stats.groupBy("component").agg(F.sum("n_rows").alias("n_rows"))
    total = sizes.agg(F.sum("n_rows")).first()[0] or 0
    share = min(weights.values()) / 4
    heavy = sizes.where(F.col("n_rows") > share * total).orderBy(F.desc("n_rows"), "component").limit(int(1 / share) + 1).collect()
    room = {k: w * total for k, w in weights.items()}
    fixed = {}
    for r in heavy:
        fixed[r.component] = max(room, key=lambda k: (room[k], k))
        room[fixed[r.component]] -= r.n_rows
    left = {k: max(v, 1e-9) for k, v in room.items()}

    spark = plays.sparkSession
    placed = spark.createDataFrame([(c, s) for c, s in fixed.items()], "component string, fixed string")
    tried = (
        stats.join(F.broadcast(placed), stats["component"].eqNullSafe(placed["component"]), "left")
        .drop(placed["component"])
        .withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
        .withColumn("split", F.coalesce("fixed", rendezvous(F.coalesce("component", F.lit("")), F.col("seed"), left)))
    )
    cells = tried.groupBy("seed", "season", "split").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_won").alias("n_won"))
    wish = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("split")]
    by_season = Window.partitionBy("seed", "season")
    by_split = Window.partitionBy("seed", "split")
    off = (
        cells.withColumn("off_season", F.pow(F.col("n_rows") - wish * F.sum("n_rows").over(by_season), 2) / (wish * F.sum("n_rows").over(by_season)))
        .withColumn("split_rows", F.sum("n_rows").over(by_split))
        .withColumn("split_won", F.sum("n_won").over(by_split))
        .groupBy("seed")
        .agg(
            F.sum("off_season").alias("a"),
            F.sum(F.pow(F.col("split_rows") - wish * total, 2) / (wish * F.greatest(F.lit(total), F.lit(1))) * F.col("n_rows") / F.col("split_rows")).alias("b"),
            (F.max(F.col("split_won") / F.col("split_rows")) - F.min(F.col("split_won") / F.col("split_rows"))).alias("c"),
            F.countDistinct("split").alias("n_splits"),
        )
        .orderBy(F.desc("n_splits"), F.col("b") * 10 + F.col("a") + F.col("c") * F.sqrt(F.lit(float(total))), "seed")
        .first()
    )
    seed = off.seed if off else 0
    return tried.where(F.col("seed") == seed).groupBy("component", "split").agg(F.sum("n_rows").alias("n_rows"))


def split_plays(plays: DataFrame, dim_game: DataFrame, dim_team: DataFrame, **how) -> DataFrame:
    """All plays with ``split``; a column of that name which the plays already have is replaced, any other is kept."""
    components = game_components(plays, dim_game, dim_team)
    assigned = assign_splits(plays, dim_game, dim_team, components=components, **how)
    by_game = components.join(assigned.where("component IS NOT NULL"), "component").select(F.col("node").alias("_split_node"), F.col("split").alias("_split"))
    no_game = assigned.where("component IS NULL").select(F.lit(None).cast("string").alias("_split_node"), F.col("split").alias("_split"))
    keys = by_game.unionByName(no_game)
    named = plays.drop("split").withColumn("_split_game", game_key(F.col("game_id"), team_aliases(dim_team)))
    joined = named.join(keys, F.col("_split_game").eqNullSafe(F.col("_split_node")), "left")
    return joined.drop("_split_game", "_split_node").withColumnRenamed("_split", "split")
