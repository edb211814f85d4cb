"""Stacking: meta-learners over base predictions, with a scoring side and an output file."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from starling.operators import ensemble as en, linear, trees
from starling.sources import io


@dataclass
class Stack:
    """scores (model, RMSE and profile, is_best), coefficients of the ridge, train (id, y, a column per learner) and test (id, the same columns)."""

    scores: DataFrame
    coefficients: list[tuple[str, float]]
    train: DataFrame
    test: DataFrame
    best: str


def stack(train: DataFrame, test: DataFrame, bases: Sequence[str], alpha: float = 1.0, net: tuple[float, float] = (0.01, 0.5), rounds: int = 10, depth: int = 3, points: int = 21) -> Stack:
    """Ridge, elastic net and boosted trees over out-of-fold base predictions, and the best weighted mean of ridge and trees.

    ``train`` has id, fold, y and the bases out of fold, ``test`` id and the bases of the scoring
    side. Linear learners come from one pass of Gram matrices; all learners predict the scoring
    side as the mean of their fold models.
    """
    rows = io.materialize(train.select("id", "fold", "y", *bases), io.scratch(train.sparkSession, "stack-train"))
    held = io.materialize(test.select("id", *bases), io.scratch(test.sparkSession, "stack-test"))
    grams = linear.fold_grams(rows, bases, target="y")
    weights = {"ridge": linear.ridge_weights(grams, alpha), "elastic_net": linear.elastic_net_weights(grams, *net)}
    fitted, _, scored = trees.gbt_oof(rows, bases, target="y", rounds=rounds, depth=depth, scoring=held)
    both, out = fitted.withColumnRenamed("pred", "gbt"), scored.withColumnRenamed("pred", "gbt")
    for name, w in weights.items():
        both, out = linear.linear_oof(both, bases, w, name), linear.linear_scoring(out, bases, w, name)
    both = io.materialize(both.select("id", "y", *weights, "gbt"), io.scratch(train.sparkSession, "stack-oof"))
    grid = en.best(en.score_blends(both, en.pair_grid("ridge", "gbt", points)), ["w_gbt", "w_ridge"]).first()  # one row
    share = {"ridge": grid["w_ridge"], "gbt": grid["w_gbt"]}
    both, out = both.withColumn("ridge_gbt", en.blend(share)), out.withColumn("ridge_gbt", en.blend(share))
    names = [*weights, "gbt", "ridge_gbt"]
    scores = en.profile(en.long_form(both, names))
    best = scores.agg(F.min_by("model", F.struct("rmse", "model")).alias("best")).first()["best"]
    return Stack(scores.withColumn("is_best", F.col("model") == best), list(zip(["intercept", *bases], map(float, linear.mean_coefficients(grams, alpha)), strict=True)), both, out.select("id", *names), best)


def submission(result: Stack, expected: DataFrame, path: str) -> DataFrame:
    """The best learner's scoring predictions moved to the training target's mean and deviation, written as a prediction file and read back.

    Fails if the file's ids are not exactly those of ``expected``.
    """
    learned = result.train.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()  # one row
    moved = en.expand_variance(result.test.select("id", F.col(result.best).alias("pred")), "pred", mean=F.lit(learned["m"]), std=F.lit(learned["s"]))
    io.write_predictions(moved, path, value="expanded")
    out = io.cast_columns(io.read_text_csv(result.test.sparkSession, path, ["id", "rating"]), {"id": "long", "rating": "double"})
    check = io.check_same_ids(expected, out, "id").first()  # one row
    if check["missing"] or check["extra"]:
        raise ValueError(f"{check['missing']} ids are missing, {check['extra']} were not asked for")
    return out
