"""Evaluation, blending, calibration and comparison of prediction tables.

Predictions are rows (id, y, one column per model); blends are expressions on these columns and
grids are aggregates over one pass, with as many sums as the grid has points.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from starling.operators.joins import split_join
from starling.sources.io import materialize, scratch

#: Numbers of a block of rows against a blend grid.
GRID_CELLS = 1 << 20
#: Rows that a table of runs may have.
MOST_RUNS = 10_000


def rmse(p: Column, y: Column) -> Column:
    return F.sqrt(F.avg(F.pow(p - y, 2)))


def clip_rating(x: Column) -> Column:
    """Into the range of ratings, 1 to 5."""
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), x))


def long_form(wide: DataFrame, models: Sequence[str], keep: Sequence[str] = ("id", "y")) -> DataFrame:
    """(keep..., model, pred) of the models that have a prediction."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("pred")) for m in models])
    return wide.select(*keep, F.inline(pairs)).where("pred IS NOT NULL")


def rmse_by_fold(rows: DataFrame, pred: str, y: str = "y") -> DataFrame:
    return rows.groupBy("fold").agg(rmse(F.col(pred), F.col(y)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population deviation of the folds' RMSE."""
    return per_fold.agg(F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"))


def profile(long: DataFrame) -> DataFrame:
    """Per model: mean, deviation, range and RMSE."""
    return long.groupBy("model").agg(F.avg("pred").alias("mean"), F.stddev_pop("pred").alias("std"), F.min("pred").alias("min"), F.max("pred").alias("max"), rmse(F.col("pred"), F.col("y")).alias("rmse"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the exact area under the ROC curve, ties counting half.

    Rows become counts per distinct score; counts below a score are offsets of score ranges plus
    a running sum within a range, so no task sees all scores.
    """
    counts = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranged = materialize(counts.repartitionByRange("s").withColumn("part", F.spark_partition_id()), scratch(rows.sparkSession, "ranges"))
    sizes = ranged.groupBy("part").agg(F.sum("neg").alias("n"), F.min("s").alias("low"))  # a row per range
    over = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = ranged.withColumn("inside", inside).join(F.broadcast(offsets), "part")
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("inside") + F.col("neg") / 2.0))
    return below.agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def coverage(long: DataFrame, expected: DataFrame, least: int = 3) -> DataFrame:
    """Per model: predictions, whether every expected id has one, and whether enough complete models are there."""
    n = expected.agg(F.count(F.lit(1)).alias("expected"))
    counts = long.join(expected.select("id"), "id", "left_semi").groupBy("model").agg(F.countDistinct("id").alias("n"))
    out = counts.crossJoin(F.broadcast(n)).withColumn("complete", F.col("n") == F.col("expected"))  # one row
    enough = out.agg((F.count_if("complete") >= least).alias("enough"))
    return out.crossJoin(F.broadcast(enough)).select("model", "n", "complete", "enough")


def pool(long: DataFrame, expected: DataFrame, least: int = 3) -> tuple[DataFrame, list[str], DataFrame]:
    """(split, id and a column for each model that enters; their names; model, split, n, expected, enters of all models).

    long: model, split, id, pred; expected: split, id. A model enters if it has one prediction, not
    null, for every expected id of every split; what it has for other ids is passed over. Fewer than
    ``least`` such models are an error. Of repeated predictions the smallest counts.
    """
    names = sorted(r["model"] for r in long.select("model").distinct().collect() if r["model"] is not None)  # a row for each model
    known = long.where("pred IS NOT NULL AND split IS NOT NULL AND id IS NOT NULL").select("split", "id", "model", "pred", F.lit(False).alias("wanted"))
    both = known.unionByName(expected.select("split", "id", F.lit(True).alias("wanted")), allowMissingColumns=True)
    # A row for each id, not for each prediction: those of an id mostly lie side by side and are one row before they are shuffled.
    wide = both.groupBy("split", "id").agg(F.max("wanted").alias("wanted"), *[F.min(F.when(F.col("model") == m, F.col("pred"))).alias(f"m{i}") for i, m in enumerate(names)])
    wide = materialize(wide.where("wanted").drop("wanted"), scratch(long.sparkSession, "pool"))
    counts = wide.groupBy("split").agg(F.count(F.lit(1)).alias("expected"), *[F.count(f"m{i}").alias(f"n{i}") for i in range(len(names))])
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"n{i}").alias("n")) for i, m in enumerate(names)]) if names else F.expr("CAST(array() AS ARRAY<STRUCT<model STRING, n BIGINT>>)")
    counts = counts.select("split", "expected", F.inline(cells))
    whole = counts.groupBy("model").agg(F.min(F.col("n") == F.col("expected")).alias("enters"))
    report = materialize(counts.join(whole, "model").select("model", "split", "n", "expected", "enters"), scratch(long.sparkSession, "models"))
    enter = [r["model"] for r in report.where("enters").select("model").distinct().orderBy("model").collect()]  # a row for each model
    if len(enter) < least:
        raise ValueError(f"{len(enter)} models have all predictions, {least} are needed")
    return wide.select("split", "id", *[F.col(f"m{names.index(m)}").alias(m) for m in enter]), enter, report


def blend(weights: dict[str, float], clip: bool = True) -> Column:
    """The weighted sum of model columns."""
    total = sum((F.col(m) * w for m, w in weights.items()), start=F.lit(0.0))
    return clip_rating(total) if clip else total


def geometric(weights: dict[str, float]) -> Column:
    return F.exp(sum((F.log(m) * w for m, w in weights.items()), start=F.lit(0.0)))


def harmonic(weights: dict[str, float]) -> Column:
    return F.lit(sum(weights.values())) / sum((F.lit(w) / F.col(m) for m, w in weights.items()), start=F.lit(0.0))


def score_blends(rows: DataFrame, blends: Sequence[dict[str, float]], y: str = "y", clip: bool = True) -> DataFrame:
    """idx, the weights and the RMSE of each blend, over rows that have all predictions.

    Rows meet the grid as matrix products of GRID_CELLS numbers; one row per grid point and task is shuffled.
    """
    models = sorted({m for b in blends for m in b})
    weights = np.array([[float(b.get(m, 0.0)) for b in blends] for m in models])
    names, height = [y, *models], max(1, GRID_CELLS // len(blends))

    def run(batches):
        total, n = np.zeros(len(blends)), 0
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            for lo in range(0, len(x), height):
                error = x[lo : lo + height, 1:] @ weights
                if clip:
                    np.clip(error, 1.0, 5.0, out=error)
                error -= x[lo : lo + height, :1]
                total += np.einsum("ij,ij->j", error, error)
            n += len(x)
        yield pd.DataFrame({"idx": np.arange(len(blends), dtype=np.int32), "s": total, "n": n})

    known = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    sums = known.mapInPandas(run, "idx int, s double, n long").groupBy("idx").agg(F.sqrt(F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("rmse"))
    grid = rows.sparkSession.createDataFrame([(i, *map(float, w)) for i, w in enumerate(weights.T)], ", ".join(["idx int", *[f"`w_{m}` double" for m in models]]))
    return grid.join(sums, "idx").select("idx", *[f"w_{m}" for m in models], "rmse")


#: Named weights of the base models "user", "year" and "month".
PRESETS = {
    "equal": {"user": 1 / 3, "year": 1 / 3, "month": 1 / 3},
    "user_led": {"user": 0.6, "year": 0.2, "month": 0.2},
    "calm": {"user": 0.15, "year": 0.15, "month": 0.7},
}


def mean_blend(models: Sequence[str]) -> Column:
    """The plain mean of model columns."""
    return sum((F.col(m) for m in models[1:]), start=F.col(models[0])) / float(len(models))


def pair_grid(a: str, b: str, points: int = 101) -> list[dict[str, float]]:
    return [{a: i / (points - 1), b: 1 - i / (points - 1)} for i in range(points)]


def simplex(models: Sequence[str], steps: int) -> list[dict[str, float]]:
    a, b, c = models
    return [{a: i / steps, b: j / steps, c: (steps - i - j) / steps} for i in range(steps + 1) for j in range(steps + 1 - i)]


def best(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The row of the least RMSE, the first of equals (RMSE compared at 9 decimals)."""
    return scores.agg(F.min(F.struct(F.round("rmse", 9).alias("r"), F.col("idx"), *columns, F.col("rmse").alias("rmse"))).alias("b")).select(*[F.col("b")[c].alias(c) for c in columns], F.col("b.rmse").alias("rmse"))


def inverse_rmse_weights(long: DataFrame) -> DataFrame:
    """model, rmse, weight = (1 / rmse) / sum(1 / rmse)."""
    per = long.groupBy("model").agg(rmse(F.col("pred"), F.col("y")).alias("rmse"))
    total = per.agg(F.sum(1 / F.col("rmse")).alias("t"))
    return per.crossJoin(F.broadcast(total)).select("model", "rmse", (1 / F.col("rmse") / F.col("t")).alias("weight"))  # one row


def expand_variance(rows: DataFrame, pred: str, mean: Column | None = None, std: Column | None = None, target: str | None = None, clip: bool = True) -> DataFrame:
    """rows with ``expanded``: the predictions moved to a mean and deviation. Mean and deviation are given, learned from ``target``, or (mean) their own; constant predictions become the mean."""
    stats = rows.agg(F.avg(pred).alias("__m"), F.stddev_pop(pred).alias("__s"), *([F.avg(target).alias("__tm"), F.stddev_pop(target).alias("__ts")] if target else []))
    to_mean = mean if mean is not None else F.col("__tm" if target else "__m")
    to_std = std if std is not None else F.col("__ts" if target else "__s")
    value = F.when(F.col("__s") > 1e-12, (F.col(pred) - F.col("__m")) * (to_std / F.when(F.col("__s") > 1e-12, F.col("__s"))) + to_mean).otherwise(to_mean)
    out = rows.crossJoin(F.broadcast(stats)).withColumn("expanded", clip_rating(value) if clip else value)  # one row
    return out.drop("__m", "__s", "__tm", "__ts")


def write_blends(rows: DataFrame, blends: dict[str, Column], path: str, key: str = "id") -> DataFrame:
    """Writes all blends as prediction files in one job, a folder ``blend=<name>`` each, and reads them: blend, id, rating (text with six decimals)."""
    long = rows.select(key, F.inline(F.array(*[F.struct(F.lit(name).alias("blend"), value.cast("double").alias("value")) for name, value in blends.items()])))
    long.select("blend", F.col(key).alias("id"), F.format_string("%.6f", "value").alias("rating")).write.mode("overwrite").option("header", True).partitionBy("blend").csv(path)
    kinds = f"id {rows.schema[key].dataType.simpleString()}, rating double, blend string"
    return rows.sparkSession.read.option("header", True).schema(kinds).csv(path).select("blend", "id", "rating")


def missing_predictions(written: DataFrame, blends: Sequence[str], expected: DataFrame) -> DataFrame:
    """blend, missing, extra: ids that each set lacks or has too many (others, or again)."""
    n = expected.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    own = split_join(written, expected.select("id").distinct().withColumn("__known", F.lit(1)), "id")
    found = own.groupBy("blend").agg(F.countDistinct(F.when(F.col("__known") == 1, F.col("id"))).alias("right"), F.count(F.lit(1)).alias("rows"))
    names = written.sparkSession.createDataFrame([(b,) for b in blends], "blend string")
    return names.join(found, "blend", "left").fillna(0, ["right", "rows"]).crossJoin(F.broadcast(n)).select("blend", (F.col("n") - F.col("right")).alias("missing"), (F.col("rows") - F.col("right")).alias("extra"))  # one row


def ladder(rows: DataFrame, a: str, b: str, shares: Sequence[float]) -> DataFrame:
    """share, mean and deviation of each blend of two columns: what a set of outputs would look like."""
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("share"), blend({a: s, b: 1 - s}).alias("pred")) for s in shares])
    return rows.select(F.inline(pairs)).groupBy("share").agg(F.avg("pred").alias("mean"), F.stddev_pop("pred").alias("std"), F.count(F.lit(1)).alias("n"))


def compare(left: DataFrame, right: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """One row: ids in both, mean and largest absolute difference, correlation, rows beyond the tolerance."""
    both = left.select("id", F.col("pred").alias("a")).join(right.select("id", F.col("pred").alias("b")), "id")
    gap = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean_diff"), F.max(gap).alias("max_diff"), F.corr("a", "b").alias("corr"), F.count_if(gap > tolerance).alias("n_beyond"))


def gate(rows: DataFrame, old: str, new: str, y: str = "y", allowed: float = 0.001) -> DataFrame:
    """PASS unless the new model's RMSE exceeds the old one's by more than allowed."""
    out = rows.agg(rmse(F.col(old), F.col(y)).alias("old_rmse"), rmse(F.col(new), F.col(y)).alias("new_rmse"))
    return out.withColumn("verdict", F.when(F.col("new_rmse") - F.col("old_rmse") > allowed, "FAIL").otherwise("PASS"))


def association(scores: DataFrame, x: str, y: str) -> DataFrame:
    """One row on how local scores follow external ones: Pearson, Spearman, the regression line, R², mean and deviation of the offset. For tables of runs (a few rows)."""
    if scores.limit(MOST_RUNS + 1).count() > MOST_RUNS:
        raise ValueError(f"more than {MOST_RUNS} runs")
    order = lambda c: Window.orderBy(c)
    rank = lambda c: F.rank().over(order(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0
    ranked = scores.select(x, y, rank(x).alias("rx"), rank(y).alias("ry"))
    return ranked.agg(
        F.corr(x, y).alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.avg(F.col(y) - F.col(x)).alias("offset_mean"), F.stddev_samp(F.col(y) - F.col(x)).alias("offset_std"),
    )


def drift(rows: DataFrame, pred: str, fold_a: int, fold_b: int) -> DataFrame:
    """Ratio of two folds' deviations and its alert: drift below 0.5, warning below 0.8, else ok (the smaller over the larger)."""
    out = rows.agg(F.stddev_pop(F.when(F.col("fold") == fold_a, F.col(pred))).alias("std_a"), F.stddev_pop(F.when(F.col("fold") == fold_b, F.col(pred))).alias("std_b"))
    ratio = F.least("std_a", "std_b") / F.nullif(F.greatest("std_a", "std_b"), F.lit(0.0))
    return out.withColumn("ratio", ratio).withColumn("alert", F.when(F.col("ratio") < 0.5, "drift").when(F.col("ratio") < 0.8, "warning").otherwise("ok"))


def compression(rows: DataFrame, pred: str, y: str = "y", threshold: float = 0.5) -> DataFrame:
    """Whether predictions spread much less than the target does."""
    out = rows.agg((F.stddev_pop(pred) / F.nullif(F.stddev_pop(y), F.lit(0.0))).alias("ratio"))
    return out.withColumn("compressed", F.col("ratio") < threshold)
