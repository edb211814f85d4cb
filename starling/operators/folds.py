"""One driver for out-of-fold models: any learner, folds fitted side by side, scoring rows alongside."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from starling.sources.io import materialize, scratch


@dataclass
class Fitted:
    """A model: ``predict(rows, name)`` adds its prediction as a column, ``report`` is what else it tells."""

    predict: Callable[[DataFrame, str], DataFrame]
    report: Any = None


@dataclass
class OutOfFold:
    """Rows with a prediction out of fold, the scoring rows with the mean of the fold models' predictions, and the models' reports by fold."""

    rows: DataFrame
    scored: DataFrame | None
    reports: list[Any]


#: Maps the rows of all folds but one to a model.
Learner = Callable[[DataFrame], Fitted]


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def out_of_fold(rows: DataFrame, learner: Learner, k: int = 5, name: str = "pred", scoring: DataFrame | None = None, bound: Callable[[Column], Column] = lambda x: x, parallel: int = 5) -> OutOfFold:
    """Fits the learner once without each fold (column ``fold``, 0 to k - 1) and predicts that fold.

    The rows are written once; ``parallel`` fits run at a time, each in a scheduler pool of its own
    (pools share executors evenly if spark.scheduler.mode is FAIR). ``bound`` is applied to every
    prediction. A fold without rows is fitted for the scoring side all the same; rows without a
    fold, or of another one, get no prediction and are left out.
    """
    spark = rows.sparkSession
    data = materialize(rows, scratch(spark, "folds"))

    def one(f: int) -> Fitted:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{f}")
        try:
            return learner(data.where(F.col("fold") != f))
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, min(parallel, k))) as pool:
        models = [x.result() for x in [pool.submit(inheritable_thread_target(spark)(one), f) for f in range(k)]]
    own = union([m.predict(data.where(F.col("fold") == f), name) for f, m in enumerate(models)]).withColumn(name, bound(F.col(name)))
    if scoring is None:
        return OutOfFold(own, None, [m.report for m in models])
    out = scoring
    for f, m in enumerate(models):
        out = m.predict(out, f"__p{f}")
    each = [bound(F.col(f"__p{f}")) for f in range(k)]
    scored = out.withColumn(name, sum(each[1:], start=each[0]) / k).drop(*[f"__p{f}" for f in range(k)])
    return OutOfFold(own, scored, [m.report for m in models])
