"""Out-of-fold tree ensembles, text models, importances, and the train/score shift check."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from starling.operators.ensemble import auc, clip_rating
from starling.operators.folds import Fitted, Learner, OutOfFold, out_of_fold
from starling.operators.stats import sample_rows
from starling.sources.io import materialize, scratch


def _with_vector(rows: DataFrame, features: Sequence[str], out: str = "__x") -> DataFrame:
    filled = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(filled)


#: Bins of a feature, as many as Spark ML's trees make by default.
BINS = 32


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Ascending upper edges of each feature's bins but the last: midpoints where it has ``bins`` values at most, else quantiles of all rows."""
    shares = [i / bins for i in range(1, bins)]
    seen = rows.agg(*[f.alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("q", F.percentile_approx(c, shares, 10_000)), ("d", F.approx_count_distinct(c)))]).first()  # a row of bins - 1 numbers a feature
    out = []
    for i, c in enumerate(features):
        edges = sorted(set(seen[f"q{i}"] or [0.0]))
        if seen[f"d{i}"] <= 2 * bins:
            values = sorted(r[0] for r in rows.select(c).distinct().limit(bins + 1).collect())
            if 1 < len(values) <= bins:
                edges = [(a + b) / 2 for a, b in zip(values[:-1], values[1:], strict=True)]
        out.append(edges)
    return out


def _filled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """rows with the features as ``__f0``, ``__f1``..., 0 for null."""
    return rows.withColumns({f"__f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)})


def bin_cells(rows: DataFrame, bins: Sequence[str], target: str, *more: str) -> DataFrame:
    """bins, more, target, __w: weighted rows with the count, sum and sum of squares of the target that the rows of each combination have.

    The rows of a combination become half their number at either side of their mean, a deviation
    away. Squared error knows no more of them, so that trees on these bins are the same; the result
    has 2 * BINS ** features rows at most, however many rows there are.
    """
    sums = rows.groupBy(*bins, *more).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(target).alias("m"), F.stddev_pop(target).alias("s"))
    half = [F.struct((F.col("m") + sign * F.col("s")).alias(target), (F.col("n") / 2).alias("__w")) for sign in (-1, 1)]
    whole = F.struct(F.col("m").alias(target), F.col("n").alias("__w"))
    return sums.select(*bins, *more, F.inline(F.when(F.col("s") > 0, F.array(*half)).otherwise(F.array(whole))))


def boosted(features: Sequence[str], target: str, rounds: int, depth: int, fit_rows: int | None = None, seed: int = 42) -> Learner:
    """Boosted regression trees; the report has importances and the number of trees.

    Rounds stop early once a tenth of the training folds' rows (by the hash of their id), never of
    the predicted fold, gains less than a hundredth; ``fit_rows`` bounds the rows of a fit. All
    training rows are summed once by their features' bins; every round runs over these sums.
    """
    raw, binned = [f"__f{i}" for i in range(len(features))], [f"__b{i}" for i in range(len(features))]

    def learn(rows: DataFrame) -> Fitted:
        spark = rows.sparkSession
        fit = _filled(materialize(sample_rows(rows, "id", fit_rows, seed), scratch(spark, "fit-rows")) if fit_rows else rows, features)
        splits = [[-math.inf, *[math.nextafter(e, math.inf) for e in edges], math.inf] for edges in bin_edges(fit, raw)]  # a bin has its upper edge
        into = Bucketizer(inputCols=raw, outputCols=binned, splitsArray=splits)
        vector = VectorAssembler(inputCols=binned, outputCol="__x")
        ordered = [F.col(c).alias(c, metadata={}) for c in binned]  # without the note that they are categories
        fit = into.transform(fit).select(*ordered, F.col(target).cast("double").alias("__y"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10)) == 0).alias("__v"))
        cells = materialize(bin_cells(fit, binned, "__y", "__v"), scratch(spark, "cells"))
        model = GBTRegressor(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=rounds, maxDepth=depth, maxBins=BINS, stepSize=0.1, validationIndicatorCol="__v", seed=seed).fit(vector.transform(cells))

        def predict(df: DataFrame, name: str) -> DataFrame:
            return model.copy().setPredictionCol(name).transform(vector.transform(into.transform(_filled(df, features)))).drop(*raw, *binned, "__x")

        return Fitted(predict, {"importance": model.featureImportances.toArray(), "trees": model.getNumTrees})

    return learn


def gbt_folds(rows: DataFrame, features: Sequence[str], target: str = "rating", k: int = 5, rounds: int = 10, depth: int = 4, fit_rows: int | None = None, seed: int = 42, scoring: DataFrame | None = None) -> OutOfFold:
    return out_of_fold(rows, boosted(features, target, rounds, depth, fit_rows, seed), k, scoring=scoring, bound=clip_rating)


def gbt_oof(rows: DataFrame, features: Sequence[str], target: str = "rating", k: int = 5, rounds: int = 10, depth: int = 4, fit_rows: int | None = None, seed: int = 42, scoring: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows with pred out of fold, importances averaged over folds, rows of ``scoring`` with the mean of the fold models' clipped predictions)."""
    out = gbt_folds(rows, features, target, k, rounds, depth, fit_rows, seed, scoring)
    return out.rows, _importances(rows, features, out), out.scored


def _importances(rows: DataFrame, features: Sequence[str], out: OutOfFold) -> DataFrame:
    each = [r["importance"] for r in out.reports]
    return rows.sparkSession.createDataFrame([(c, float(sum(w[i] for w in each)) / len(each)) for i, c in enumerate(features)], "feature string, importance double")


def weighted_text(vector: str, label: str, penalty: float, rounds: int, least_docs: int = 2) -> Learner:
    """The probability of class 1 by logistic regression; a term's weight, too, comes from the rows that are fitted."""

    def learn(rows: DataFrame) -> Fitted:
        idf = IDF(minDocFreq=least_docs, inputCol=vector, outputCol="__x").fit(rows)
        model = LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__q", maxIter=rounds, regParam=penalty).fit(idf.transform(rows).withColumn("__y", F.col(label).cast("double")))
        return Fitted(lambda df, name: model.transform(idf.transform(df)).withColumn(name, vector_to_array("__p")[1]).drop("__x", "__p", "__r", "__q"))

    return learn


def boosted_text(vector: str, label: str, rounds: int, depth: int, least_docs: int = 2, seed: int = 42) -> Learner:
    """The same by boosted trees; the report has the number of trees."""

    def learn(rows: DataFrame) -> Fitted:
        idf = IDF(minDocFreq=least_docs, inputCol=vector, outputCol="__x").fit(rows)
        model = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=depth, seed=seed).fit(idf.transform(rows).withColumn("__y", F.col(label).cast("double")))
        model = model.setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__q")
        return Fitted(lambda df, name: model.transform(idf.transform(df)).withColumn(name, vector_to_array("__p")[1]).drop("__x", "__p", "__r", "__q"), model.getNumTrees)

    return learn


def text_oof(rows: DataFrame, vector: str, label: str, k: int = 5, penalty: float = 0.01, rounds: int = 20) -> DataFrame:
    """rows with score = the probability of class 1 from sparse term counts; weights and models never see the predicted fold."""
    return out_of_fold(rows, weighted_text(vector, label, penalty, rounds), k, name="score").rows


def shift_report(train: DataFrame, test: DataFrame, features: Sequence[str], importance: DataFrame) -> DataFrame:
    """feature, importance for telling train from test, and its mean and deviation in both, from one aggregate each."""

    def moments(df: DataFrame, side: str) -> DataFrame:
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
        return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias(f"{side}_mean"), F.col(f"{c}__std").alias(f"{side}_std")) for c in features])))

    return importance.join(moments(train, "train"), "feature").join(moments(test, "test"), "feature")


def adversarial(train: DataFrame, test: DataFrame, features: Sequence[str], n: int = 10_000, k: int = 3, rounds: int = 5, alarm: float = 0.6, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(one row with the out-of-fold AUC of telling train from test and whether it alarms, importances)."""
    both = sample_rows(train, "id", n, seed).select("id", *features).withColumn("is_test", F.lit(0)).unionByName(sample_rows(test, "id", n, seed).select("id", *features).withColumn("is_test", F.lit(1)))
    def learn(fit: DataFrame) -> Fitted:
        model = GBTClassifier(featuresCol="__x", labelCol="is_test", maxIter=rounds, maxDepth=3, seed=seed).fit(fit)
        return Fitted(lambda df, name: model.transform(df).withColumn(name, vector_to_array("probability")[1]), {"importance": model.featureImportances.toArray()})

    data = _with_vector(both, features).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)))
    out = out_of_fold(data, learn, k, name="score")
    report = auc(out.rows.select("id", "is_test", "score"), "score", "is_test").withColumn("alarm", F.col("auc") > alarm)
    return report, _importances(train, features, out)
