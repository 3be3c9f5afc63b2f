"""Outcome models of plays with MLlib, their metrics, and what a decision is worth."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashmark.session import cut

#: Known before the snap, so that a model may use them.
PRE_SNAP = ["down", "ydstogo", "yardline_100", "game_seconds_remaining", "score_differential", "qtr"]
#: Outcomes of the play: never features.
LEAKAGE = {"epa", "wp", "yards_gained", "posteam_won", "is_pass_call"}


def design(plays: DataFrame, target: str, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """``label`` and the features of rows that have all of them, and the columns ``keep``; a feature that leaks the outcome is refused."""
    if bad := sorted(LEAKAGE & set(features)):
        raise ValueError(f"features known only after the play: {bad}")
    return plays.select("season", F.col(target).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features], *(keep or [])).na.drop(subset=["label", *features])


def season_split(frame: DataFrame, first_valid: int, first_test: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Earlier seasons to train on, later ones to validate and test on."""
    return frame.where(F.col("season") < first_valid), frame.where((F.col("season") >= first_valid) & (F.col("season") < first_test)), frame.where(F.col("season") >= first_test)


#: The network's hidden layers and iterations; the trees' depth, rounds at most and step. Rounds end where the validation seasons no longer gain.
HIDDEN, ITERATIONS = [64, 64], 60
DEPTH, ROUNDS, STEP = 6, 40, 0.1


def fit(train: DataFrame, features: list[str], kind: str = "logistic", valid: DataFrame | None = None):
    """A pipeline that standardises and predicts: a logistic regression, a "network" of two hidden layers, or boosted "trees".

    Trees stop early by the rows of ``valid``, if given. Without rows to train on there is no model, which is an error.
    """
    if not train.limit(1).count():
        raise ValueError("no rows to train on")
    learner = {
        "logistic": LogisticRegression(maxIter=30, regParam=1e-3),
        "network": MultilayerPerceptronClassifier(layers=[len(features), *HIDDEN, 2], maxIter=ITERATIONS, seed=7),
        "trees": GBTClassifier(maxDepth=DEPTH, maxIter=ROUNDS, stepSize=STEP, seed=7),
    }[kind]
    rows = train
    if kind == "trees" and valid is not None and valid.limit(1).count():
        rows = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
        learner = learner.setValidationIndicatorCol("_valid")
    assembled = VectorAssembler(inputCols=features, outputCol="raw")
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    return Pipeline(stages=[assembled, scaled, learner]).fit(rows)


def best(train: DataFrame, valid: DataFrame, features: list[str], kinds: list[str]):
    """Of models of several kinds the one whose log loss on the validation rows is least; the first kind, to be the plainest, where there are none.

    Few rows suit a plain model, many a network: the validation seasons tell which.
    """
    fitted = {k: fit(train, features, k, valid) for k in kinds}
    losses = {k: metrics(score(m, valid)).first().log_loss for k, m in fitted.items()}
    known = {k: x for k, x in losses.items() if x is not None and x == x}
    return fitted[min(known, key=known.get) if known else kinds[0]]


def save(model, path: str) -> None:
    """A fitted pipeline with its scaler, so that it predicts the same wherever it is loaded."""
    model.write().overwrite().save(path)


def load(path: str):
    return PipelineModel.load(path)


def base_rate(train: DataFrame) -> Column:
    """The share of positives in training, within what a logarithm bears: the least a model has to beat."""
    return F.least(F.greatest(train.agg(F.avg("label")).scalar(), F.lit(1e-7)), F.lit(1 - 1e-7))


def score(model, frame: DataFrame) -> DataFrame:
    return model.transform(frame).withColumn("p", vector_to_array("probability")[1])


def metrics(scored: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """One row: rows, log loss (clipped at 1e-7), Brier score, accuracy."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    y = F.col(label)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"),
        F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"),
        F.avg(((F.col(p) >= 0.5).cast("double") == y).cast("double")).alias("accuracy"),
    )


def calibration(scored: DataFrame, p: str = "p", label: str = "label", bins: int = 10) -> DataFrame:
    """Predicted and observed shares by bin of the prediction."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return scored.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(label).alias("observed"))


def calibration_error(scored: DataFrame, p: str = "p", label: str = "label", bins: int = 10) -> DataFrame:
    """One row, ``ece``: the mean distance of predicted and observed shares over the bins, weighted by their rows."""
    c = calibration(scored, p, label, bins)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n")).alias("ece"))


def rank_auc(scored: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """The probability that a positive ranks above a negative, ties counting half; null without both.

    Equal predictions are counted together first, and those counts are summed within ranges of the
    prediction and then over the ranges, so that no task sees all rows.
    """
    values = cut(scored.groupBy(F.col(p).alias("v")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg")).withColumn("range", F.floor(F.col("v") * 1024).cast("int")))
    ranges = values.groupBy("range").agg(F.sum("neg").alias("range_neg"))
    below = ranges.withColumn("below", F.coalesce(F.sum("range_neg").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("range", "below")
    within = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    lower = values.join(F.broadcast(below), "range").withColumn("lower", F.col("below") + F.coalesce(F.sum("neg").over(within), F.lit(0.0)))
    wins = F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2))
    return lower.agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def feature_auc(frame: DataFrame, features: list[str], label: str, parts: int = 256) -> DataFrame:
    """``feature``, ``n``, ``auc``: how well each feature alone ranks the outcome, folded to at least a half, in one pass.

    Equal values are counted together; the values of a feature are cut at its quantiles, so that no window holds
    more than about one of ``parts`` ranges. Null and NaN values, and rows without outcome, don't count.
    """
    held = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    long = frame.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), held.alias("f")).select("y", "f.*").where("v IS NOT NULL AND NOT isnan(v)")
    values = cut(long.groupBy("feature", "v").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    cuts = values.groupBy("feature").agg(F.percentile_approx("v", [i / parts for i in range(1, parts)]).alias("cuts"))
    ranged = values.join(F.broadcast(cuts), "feature").withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sums = ranged.groupBy("feature", "range").agg(F.sum("neg").alias("range_neg"))
    below = Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("feature", "range", F.coalesce(F.sum("range_neg").over(below), F.lit(0.0)).alias("below"))
    within = Window.partitionBy("feature", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    lower = ranged.join(F.broadcast(starts), ["feature", "range"]).withColumn("lower", F.col("below") + F.coalesce(F.sum("neg").over(within), F.lit(0.0)))
    wins = F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))
    return lower.groupBy("feature").agg(F.sum(F.col("pos") + F.col("neg")).cast("long").alias("n"), wins.alias("a")).select("feature", "n", F.greatest("a", 1 - F.col("a")).alias("auc"))


def flipped(frame: DataFrame) -> DataFrame:
    """The state the other side sees after losing the ball: field mirrored (1..99), score negated, six seconds gone, first and ten (or goal)."""
    yard = F.least(F.greatest(100 - F.col("yardline_100"), F.lit(1)), F.lit(99))
    return frame.withColumns(
        {
            "yardline_100": yard,
            "score_differential": -F.col("score_differential"),
            "game_seconds_remaining": F.greatest(F.col("game_seconds_remaining") - 6, F.lit(0.0)),
            "down": F.lit(1),
            "ydstogo": F.least(F.lit(10), yard),
        }
    )
