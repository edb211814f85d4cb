"""Out-of-fold linear models: ridge and elastic net from per-fold Gram matrices, logistic models of all folds from shared passes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starling.operators import blocks
from starling.sources.io import materialize, scratch


#: Sums of products that one pass keeps in a task.
NUMBERS = 1 << 24


def fold_grams(rows: DataFrame, features: Sequence[str], target: str = "rating", k: int = 5) -> np.ndarray:
    """k matrices of sums of products of (1, features, target); p² numbers a fold reach the driver.

    One pass while all k matrices have NUMBERS numbers at most; beyond that (1,800 features and
    more, at five folds) one pass for each group of columns that do, so that a task's memory is
    bounded. Tasks send blocks of sums, not rows of single numbers.
    """
    names, width = [*features, target], len(features) + 2
    step = max(1, NUMBERS // (k * width))
    parts = rows.select(F.col("fold").cast("int").alias("fold"), F.array(*[F.col(c).cast("double") for c in names]).alias("x"))

    def products(lo: int, hi: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros((k, width, hi - lo)), False
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.ones((batch.num_rows, width))
                x[:, 1:] = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width - 1)
                fold, some = batch.column("fold").to_numpy(zero_copy_only=False), True
                for f in range(k):
                    own = x[fold == f]
                    total[f] += own.T @ own[:, lo:hi]
            if some:
                for f in range(k):
                    yield from blocks.cut(f, total[f])

        return blocks.summed(parts.mapInArrow(run, blocks.KINDS), k, width, hi - lo)

    return np.concatenate([products(lo, min(lo + step, width)) for lo in range(0, width, step)], axis=2)


def solve(gram: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, weights) of ridge with an unpenalised intercept."""
    n, means = gram[0, 0], gram[0, 1:] / max(gram[0, 0], 1)
    centred = gram[1:, 1:] - n * np.outer(means, means)
    xx, xy = centred[:-1, :-1], centred[:-1, -1]
    w = np.linalg.lstsq(xx + alpha * np.eye(len(xx)), xy, rcond=None)[0]
    return np.r_[means[-1] - means[:-1] @ w, w]


def without(grams: np.ndarray, fold: int, subset: Sequence[int] | None = None) -> np.ndarray:
    gram = grams.sum(axis=0) - grams[fold]
    if subset is None:
        return gram
    at = [0, *[i + 1 for i in subset], len(gram) - 1]
    return gram[np.ix_(at, at)]


def _linear(w: np.ndarray, features: Sequence[str]) -> Column:
    return sum((F.col(c).cast("double") * float(x) for c, x in zip(features, w[1:], strict=True)), start=F.lit(float(w[0])))


def soft(x: float, by: float) -> float:
    return np.sign(x) * max(abs(x) - by, 0.0)


def solve_elastic_net(gram: np.ndarray, alpha: float, l1_ratio: float, rounds: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """(intercept, weights) of least squares / 2n + alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w²), by coordinate descent on the sums of products."""
    n = max(gram[0, 0], 1)
    means = gram[0, 1:] / n
    centred = gram[1:, 1:] / n - np.outer(means, means) * (gram[0, 0] / n)
    xx, xy = centred[:-1, :-1], centred[:-1, -1]
    w = np.zeros(len(xx))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            scale = xx[j, j] + alpha * (1 - l1_ratio)
            w[j] = soft(xy[j] - xx[j] @ w + xx[j, j] * w[j], alpha * l1_ratio) / scale if scale > 1e-300 else 0.0
        if np.abs(w - before).max(initial=0.0) <= tolerance * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return np.r_[means[-1] - means[:-1] @ w, w]


def _clipped(x: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), x))


def linear_oof(rows: DataFrame, features: Sequence[str], weights: Sequence[np.ndarray], name: str = "pred") -> DataFrame:
    """rows with each fold predicted by the weights fitted without it, clipped to 1 to 5."""
    value = F.lit(None).cast("double")
    for f, w in enumerate(weights):
        value = F.when(F.col("fold") == f, _linear(w, features)).otherwise(value)
    return rows.withColumn(name, _clipped(value))


def linear_scoring(rows: DataFrame, features: Sequence[str], weights: Sequence[np.ndarray], name: str = "pred") -> DataFrame:
    """rows of the scoring set with the mean of the fold models' clipped predictions."""
    each = [_clipped(_linear(w, features)) for w in weights]
    return rows.withColumn(name, sum(each[1:], start=each[0]) / len(weights))


def ridge_weights(grams: np.ndarray, alpha: float = 1.0) -> list[np.ndarray]:
    """The ridge of all other folds, for each fold."""
    return [solve(without(grams, f), alpha) for f in range(len(grams))]


def elastic_net_weights(grams: np.ndarray, alpha: float, l1_ratio: float) -> list[np.ndarray]:
    return [solve_elastic_net(without(grams, f), alpha, l1_ratio) for f in range(len(grams))]


def ridge_oof(rows: DataFrame, features: Sequence[str], alpha: float = 1.0, target: str = "rating", k: int = 5, grams: np.ndarray | None = None) -> DataFrame:
    """rows with ``pred``: each fold predicted by the ridge of the others, clipped to 1 to 5."""
    return linear_oof(rows, features, ridge_weights(fold_grams(rows, features, target, k) if grams is None else grams, alpha))


def ridge_scoring(train_grams: np.ndarray, rows: DataFrame, features: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """rows of the scoring set with ``pred``: the mean of the fold models' clipped predictions."""
    return linear_scoring(rows, features, ridge_weights(train_grams, alpha))


def _error(grams: np.ndarray, fit, subset: Sequence[int] | None = None) -> float:
    """RMSE out of fold, before clipping, of the weights that fit gives for the other folds' sums."""
    width = grams.shape[1]
    cells = [0, *[i + 1 for i in (range(width - 2) if subset is None else subset)], width - 1]
    error = 0.0
    for f in range(len(grams)):
        w = np.r_[fit(without(grams, f, subset)), -1.0]
        error += w @ grams[f][np.ix_(cells, cells)] @ w
    return float(np.sqrt(max(error, 0.0) / grams[:, 0, 0].sum()))


def ridge_grid(grams: np.ndarray, features: Sequence[str], alphas: Sequence[float], subsets: dict[str, Sequence[str]] | None = None) -> list[tuple[str, float, float]]:
    """(subset, alpha, RMSE out of fold before clipping) for feature subsets and penalties, from the same matrices: no further pass."""
    at = {name: [list(features).index(c) for c in some] for name, some in (subsets or {"all": features}).items()}
    return [(name, float(alpha), _error(grams, lambda g: solve(g, alpha), some)) for name, some in at.items() for alpha in alphas]


def elastic_net_grid(grams: np.ndarray, alphas: Sequence[float], ratios: Sequence[float]) -> list[tuple[float, float, float]]:
    """(alpha, l1 ratio, RMSE out of fold before clipping), from the same matrices: no further pass."""
    return [(float(alpha), float(ratio), _error(grams, lambda g: solve_elastic_net(g, alpha, ratio))) for alpha in alphas for ratio in ratios]


def mean_coefficients(grams: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, weights), averaged over the folds' models."""
    return np.mean([solve(without(grams, f), alpha) for f in range(len(grams))], axis=0)


def elastic_net_oof(rows: DataFrame, features: Sequence[str], alpha: float, l1_ratio: float, target: str = "rating", k: int = 5, grams: np.ndarray | None = None) -> DataFrame:
    """rows with ``pred`` from elastic nets fitted on the other folds, clipped to 1 to 5."""
    return linear_oof(rows, features, elastic_net_weights(fold_grams(rows, features, target, k) if grams is None else grams, alpha, l1_ratio))


def _features(features: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]


def _moments(rows: DataFrame, features: Sequence[str], target: str, cuts: Sequence[float], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows outside of each fold: their number, the features' means and sample deviations (0 for constants), and the rows whose target exceeds each cut."""
    part = F.when(F.col("fold").between(0, k - 1), F.col("fold").cast("int")).otherwise(k).alias("part")  # k: in every model
    columns = [f(x).alias(f"{n}{j}") for j, x in enumerate(_features(features)) for n, f in (("m", F.avg), ("v", F.var_pop), ("lo", F.min), ("hi", F.max))]
    above = [F.count_if(F.col(target) > c).alias(f"c{t}") for t, c in enumerate(cuts)]
    seen = rows.where("fold IS NOT NULL").groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.count(target).alias("known"), *columns, *above).collect()  # k + 1 rows at most
    if any(r["n"] != r["known"] for r in seen):
        raise ValueError(f"{target} has nulls")
    n, at = np.zeros(k), range(len(features))
    mean, std, over = np.zeros((k, len(features))), np.zeros((k, len(features))), np.zeros((k, len(cuts)))
    for f in range(k):
        own = [r for r in seen if r["part"] != f]
        if not own:
            raise ValueError(f"no rows outside of fold {f}")
        w = np.array([float(r["n"]) for r in own])
        m, v, lo, hi = (np.array([[r[f"{c}{j}"] for j in at] for r in own], float) for c in ("m", "v", "lo", "hi"))
        if not (np.isfinite(lo).all() and np.isfinite(hi).all()):
            raise ValueError("features have to be finite")
        n[f], mean[f] = w.sum(), w @ m / w.sum()
        square = w @ (v + (m - mean[f]) ** 2)
        std[f] = np.where(lo.min(axis=0) < hi.max(axis=0), np.sqrt(square / max(n[f] - 1, 1)), 0.0)
        over[f] = [sum(r[f"c{t}"] for r in own) for t in range(len(cuts))]
    return n, mean, std, over


def fold_logistics(rows: DataFrame, features: Sequence[str], target: str, cuts: Sequence[float], k: int = 5, penalty: float = 0.01, rounds: int = 50, tolerance: float = 1e-12) -> np.ndarray:
    """(fold, cut, intercept and weights) of the logistic models of target > cut, each fitted on all rows but a fold's.

    The mean loss plus half the penalty times the squared weights of the features in units of their
    deviation, as Spark ML's LogisticRegression has it, by Newton steps: one pass sums losses, gradients and second derivatives
    of all models, so that the passes (some 5, ``rounds`` at most) grow neither with folds nor
    cuts. A step that raises the loss is halved. Features without a deviation get no weight; where
    all rows are on one side of a cut, the intercept is infinite.
    """
    n, mean, std, over = _moments(rows, features, target, cuts, k)
    models = [(f, t) for f in range(k) for t in range(len(cuts)) if 0 < over[f, t] < n[f]]
    width, out = len(features) + 1, np.zeros((k, len(cuts), len(features) + 1))
    out[..., 0] = np.where(over > 0, np.inf, -np.inf)
    if not models:
        return out
    fold_of, cut_of = np.array([f for f, _ in models]), np.array([cuts[t] for _, t in models], float)
    centre, scale = mean.mean(axis=0), np.where(std.max(axis=0) > 0, std.max(axis=0), 1.0)
    a, b = np.triu_indices(width)
    parts = rows.where("fold IS NOT NULL").select(F.col("fold").cast("int").alias("fold"), F.array(*_features(features), F.col(target).cast("double")).alias("x"))

    def sums(at: np.ndarray) -> np.ndarray:
        """Rows: loss, gradient, upper triangle of the second derivatives; a column for each model."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros((1 + width + len(a), len(models))), False
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, some = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), True
                z = np.ones((len(x), width))
                z[:, 1:] = (x[:, :-1] - centre) / scale
                used = batch.column("fold").to_numpy(zero_copy_only=False)[:, None] != fold_of
                y, e = x[:, -1:] > cut_of, z @ at
                small = np.exp(-np.abs(e))
                p = np.where(e >= 0, 1.0, small) / (1 + small)
                total[0] += ((np.log1p(small) + np.maximum(e, 0) - y * e) * used).sum(axis=0)
                total[1 : 1 + width] += z.T @ ((p - y) * used)
                total[1 + width :] += (z[:, a] * z[:, b]).T @ (p * (1 - p) * used)
            if some:
                yield from blocks.cut(0, total)

        return blocks.summed(parts.mapInArrow(run, blocks.KINDS), 1, 1 + width + len(a), len(models))[0]

    weight = n[fold_of]
    ridge = np.vstack([np.zeros(len(models)), penalty * (std[fold_of] / scale).T ** 2])
    free = np.vstack([np.ones(len(models), bool), std[fold_of].T > 0])
    share = np.array([over[f, t] / n[f] for f, t in models])
    at = np.zeros((width, len(models)))
    at[0] = np.log(share / (1 - share))
    best, step, least = at.copy(), np.zeros_like(at), np.full(len(models), np.inf)
    for _ in range(rounds):
        got = sums(at) / weight
        loss = got[0] + (ridge * at**2).sum(axis=0) / 2
        small = np.abs(step).max(axis=0) < 1e-13  # no more than rounding
        gain = np.zeros(len(models))
        for m in range(len(models)):
            if not loss[m] <= least[m] + 1e-14 * abs(least[m]) and not small[m]:
                step[:, m] /= 2
                gain[m] = np.inf
                continue
            best[:, m], least[m] = at[:, m], loss[m]
            second = np.zeros((width, width))
            second[a, b] = second[b, a] = got[1 + width :, m]
            on = free[:, m]
            second, slope = (second + np.diag(ridge[:, m]))[np.ix_(on, on)], (got[1 : 1 + width, m] + ridge[:, m] * at[:, m])[on]
            step[:, m] = 0.0
            step[on, m] = -np.linalg.lstsq(second, slope, rcond=None)[0]
            gain[m] = -slope @ step[on, m]
        at = best + step
        if (gain <= tolerance).all():
            break
    else:
        raise ValueError(f"logistic models did not settle in {rounds} rounds")
    for (f, t), w in zip(models, at.T, strict=True):
        out[f, t] = np.r_[w[0] - w[1:] @ (centre / scale), w[1:] / scale]
    return out


def ordinal_oof(rows: DataFrame, features: Sequence[str], target: str = "rating", k: int = 5, classes: int = 5, penalty: float = 0.01) -> DataFrame:
    """rows of the folds 0 to k - 1 with pred = 1 plus the probabilities of exceeding each threshold, by the models of the other folds. The rows are written once."""
    data = materialize(rows, scratch(rows.sparkSession, "folds"))
    weights = fold_logistics(data, features, target, range(1, classes), k, penalty)

    def value(of: np.ndarray) -> Column:
        odds = [sum((x * float(c) for x, c in zip(_features(features), w[1:], strict=True)), start=F.lit(float(w[0]))) for w in of]
        return sum((1 / (1 + F.exp(-e)) for e in odds), start=F.lit(1.0))

    out = F.lit(None).cast("double")
    for f in range(k):
        out = F.when(F.col("fold") == f, value(weights[f])).otherwise(out)
    return data.where(F.col("fold").isin(list(range(k)))).withColumn("pred", out)
