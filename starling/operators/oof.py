"""Out-of-fold (leak-free) aggregates and target encodings by subtracting fold sums.

Each key's rows are aggregated once into one slot of sums per fold; the value for a row in fold
f is computed from the key's totals minus slot f. One shuffle makes the slots, one on either
side joins them back, whatever k is; that join may split a hot key, and null keys pass it by. With
many folds (k > SLOTS) sums per (key, fold) are used instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from starling.operators.joins import split_join

SLOTS = 16


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _field(name: str):
    return lambda x: x[name]


def fold_sums(rows: DataFrame, key: str | Sequence[str], sums: dict[str, Column], k: int, fold: str = "fold") -> DataFrame:
    """key, slots: an array with a struct (n and the named sums) for each fold."""
    keys = _keys(key)
    if k > SLOTS:
        per_fold = rows.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x.cast("double")).alias(c) for c, x in sums.items()])
        slots = F.map_from_entries(F.collect_list(F.struct(F.col(fold).cast("int"), F.struct("n", *sums))))
        empty = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in sums])
        out = per_fold.groupBy(*keys).agg(slots.alias("by_fold"))
        return out.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.coalesce(F.try_element_at("by_fold", f), empty)).alias("slots"))
    aggregates = []
    for f in range(k):
        here = F.col(fold) == f
        aggregates.append(F.count_if(here).alias(f"n__{f}"))
        aggregates += [F.sum(F.when(here, x.cast("double")).otherwise(0.0)).alias(f"{c}__{f}") for c, x in sums.items()]
    slots = F.array(*[F.struct(F.col(f"n__{f}").alias("n"), *[F.col(f"{c}__{f}").alias(c) for c in sums]) for f in range(k)])
    return rows.groupBy(*keys).agg(*aggregates).select(*keys, slots.alias("slots"))


def with_others(rows: DataFrame, key: str | Sequence[str], sums: dict[str, Column], k: int, fold: str = "fold", prefix: str = "o_", source: DataFrame | None = None) -> DataFrame:
    """rows with the n and sums of their key's rows in the other folds (0 if there are none); the sums are made from ``source``, the same rows before other joins, if given."""
    keys = _keys(key)
    joined = split_join(rows, fold_sums(rows if source is None else source, key, sums, k, fold), keys)
    own = F.element_at("slots", (F.col(fold) + 1).cast("int"))
    out = {}
    for c, zero in (("n", F.lit(0).cast("long")), *[(c, F.lit(0.0)) for c in sums]):
        total = F.aggregate(F.transform("slots", _field(c)), zero, lambda s, x: s + x)
        out[f"{prefix}{c}"] = F.coalesce(total - own[c], zero)
    return joined.withColumns(out).drop("slots")


def with_totals(rows: DataFrame, train: DataFrame, key: str | Sequence[str], sums: dict[str, Column], prefix: str = "o_") -> DataFrame:
    """rows with the n and sums of their key over all of ``train``: the scoring side of with_others."""
    keys = _keys(key)
    totals = train.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}n"), *[F.sum(x.cast("double")).alias(f"{prefix}{c}") for c, x in sums.items()])
    zero = {f"{prefix}n": F.coalesce(F.col(f"{prefix}n"), F.lit(0))} | {f"{prefix}{c}": F.coalesce(F.col(f"{prefix}{c}"), F.lit(0.0)) for c in sums}
    return split_join(rows, totals, keys).withColumns(zero)


def mean(n: Column, s: Column) -> Column:
    return s / F.nullif(n, F.lit(0))


def sample_std(n: Column, s: Column, q: Column) -> Column:
    """From count, sum and sum of squares; 0 for a single row, null for none."""
    variance = (q - s * s / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0))
    return F.when(n == 1, 0.0).when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0))))


def oof_stats(rows: DataFrame, key: str | Sequence[str], k: int = 5, target: str = "rating", means: dict[str, Column] | None = None) -> DataFrame:
    """rows with oof_mean, oof_count, oof_std of the target over the key's other folds, and oof_<name> for further means."""
    y, means = F.col(target).cast("double"), means or {}
    out = with_others(rows, key, {"s": y, "q": y * y} | means, k)
    out = out.withColumns({
        "oof_mean": mean(F.col("o_n"), F.col("o_s")), "oof_count": F.col("o_n"), "oof_std": sample_std(F.col("o_n"), F.col("o_s"), F.col("o_q")),
        **{f"oof_{c}": mean(F.col("o_n"), F.col(f"o_{c}")) for c in means},
    })
    return out.drop("o_n", "o_s", "o_q", *[f"o_{c}" for c in means])


def smoothed(n: Column, s: Column, prior: Column, smoothing: float) -> Column:
    """Bayesian mean (s + smoothing * prior) / (n + smoothing); the prior itself for n = 0."""
    return F.when(n > 0, (s + smoothing * prior) / (n + smoothing)).otherwise(prior)


def target_encode(rows: DataFrame, key: str | Sequence[str], k: int = 5, target: str = "rating", smoothing: float = 1.0, name: str = "te", prior: str = "all", noise: float = 0.0, seed: int = 42, source: DataFrame | None = None) -> DataFrame:
    """rows with their out-of-fold encoding and count. prior: the mean over "all" rows or over the "other_folds"; noise is drawn from the row's id; source as in with_others."""
    y = F.col(target).cast("double")
    per_fold = (rows if source is None else source).groupBy("fold").agg(F.sum(y).alias("fs"), F.count(F.lit(1)).alias("fn"))  # k rows
    overall = per_fold.agg(F.sum("fs").alias("ts"), F.sum("fn").alias("tn"))
    priors = per_fold.crossJoin(overall).select("fold", ((F.col("ts") / F.col("tn")) if prior == "all" else (F.col("ts") - F.col("fs")) / F.nullif(F.col("tn") - F.col("fn"), F.lit(0))).alias("__prior"))
    out = with_others(rows, key, {"s": y}, k, source=source).join(F.broadcast(priors), "fold")
    value = smoothed(F.col("o_n"), F.col("o_s"), F.col("__prior"), smoothing)
    if noise:
        u = [(F.pmod(F.xxhash64(F.lit(seed + i), F.lit(name), "id"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1) for i in (0, 1)]
        value = value + noise * F.sqrt(-2 * F.log(u[0])) * F.cos(2 * 3.141592653589793 * u[1])
    return out.withColumns({name: value, f"{name}_count": F.col("o_n")}).drop("o_n", "o_s", "__prior")


def target_encode_scoring(rows: DataFrame, train: DataFrame, key: str | Sequence[str], target: str = "rating", smoothing: float = 1.0, name: str = "te") -> DataFrame:
    """The scoring side: encodings from all training rows, unseen keys get the training mean."""
    overall = train.agg(F.avg(F.col(target).cast("double")).alias("__prior"))
    out = with_totals(rows, train, key, {"s": F.col(target)}).crossJoin(F.broadcast(overall))  # one row
    return out.withColumns({name: smoothed(F.col("o_n"), F.col("o_s"), F.col("__prior"), smoothing), f"{name}_count": F.col("o_n")}).drop("o_n", "o_s", "__prior")


def safe_target_encode(rows: DataFrame, keys: dict[str, str | Sequence[str]], k: int = 5, smoothing: float = 10.0, noise: float = 0.0) -> DataFrame:
    """Encodings and counts for several keys at once, named by the dict. Every key's sums come from the given rows, so that no key repeats the joins of those before it."""
    out = rows
    for name, key in keys.items():
        out = target_encode(out, key, k, smoothing=smoothing, name=name, noise=noise, source=rows)
    return out


def fold_prior(rows: DataFrame, target: str = "rating") -> DataFrame:
    """fold and the mean over the other folds' rows (k rows)."""
    per_fold = rows.groupBy("fold").agg(F.sum(F.col(target).cast("double")).alias("fs"), F.count(F.lit(1)).alias("fn"))
    overall = per_fold.agg(F.sum("fs").alias("ts"), F.sum("fn").alias("tn"))
    return per_fold.crossJoin(overall).select("fold", ((F.col("ts") - F.col("fs")) / F.nullif(F.col("tn") - F.col("fn"), F.lit(0))).alias("prior"))


def deviations(rows: DataFrame, keys: dict[str, str], k: int = 5) -> DataFrame:
    """Differences of the rating from other-fold means of several keys: <name>_dev, <name>_absdev and <name>_n; a key without other rows uses the other folds' mean.

    These columns contain the row's own rating: they serve analysis, never models (see LEAKING).
    """
    out = rows.join(F.broadcast(fold_prior(rows)), "fold")
    for name, key in keys.items():
        out = with_others(out, key, {"s": F.col("rating")}, k)
        m = F.coalesce(mean(F.col("o_n"), F.col("o_s")), F.col("prior"))
        out = out.withColumns({f"{name}_dev": F.col("rating") - m, f"{name}_absdev": F.abs(F.col("rating") - m), f"{name}_n": F.col("o_n"), f"{name}_mean": m}).drop("o_n", "o_s")
    return out


def leniency(rows: DataFrame, key: str = "user_id", k: int = 5) -> DataFrame:
    """The leak-safe part: other-fold mean of the key minus the other folds' mean, its absolute value, and the count."""
    out = with_others(rows.join(F.broadcast(fold_prior(rows)), "fold"), key, {"s": F.col("rating")}, k)
    value = F.coalesce(mean(F.col("o_n"), F.col("o_s")), F.col("prior")) - F.col("prior")
    return out.withColumns({"leniency": value, "harshness": F.abs(value), "oof_count": F.col("o_n")}).drop("o_n", "o_s", "prior")


#: Columns of deviations() that contain the row's own target.
LEAKING = ("_dev", "_absdev")


def oof_pair(rows: DataFrame, first: str = "user_id", second: str = "main_category", k: int = 5) -> DataFrame:
    """Other-fold mean, count and deviation from the first key's other-fold mean, for pairs of keys."""
    out = with_others(rows, [first, second], {"s": F.col("rating")}, k, prefix="p_")
    out = with_others(out, first, {"s": F.col("rating")}, k, prefix="f_")
    pair, own = mean(F.col("p_n"), F.col("p_s")), mean(F.col("f_n"), F.col("f_s"))
    return out.withColumns({"pair_mean": pair, "pair_count": F.col("p_n"), "pair_deviation": pair - own}).drop("p_n", "p_s", "f_n", "f_s")


def leak_check_pairs(encoded: DataFrame, key: str, value: str = "oof_mean", target: str = "rating", tolerance: float = 1e-9) -> DataFrame:
    """For keys with exactly two rows in different folds: each row's value must be the other's target. Counts of keys and violations."""
    pairs = encoded.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("fold").alias("lo"), F.max("fold").alias("hi"), F.sum(F.col(target).cast("double")).alias("total"))
    pairs = pairs.where("n = 2 AND lo <> hi").select(key, "total")
    bad = F.coalesce(F.abs(F.col(value) - (F.col("total") - F.col(target))) > tolerance, F.lit(True))
    return split_join(encoded, pairs, key, "inner").agg(F.countDistinct(key).alias("n_keys"), F.count_if(bad).alias("n_violations"))


def direct_oof_mean(rows: DataFrame, key: str, target: str = "rating") -> DataFrame:
    """id and the other-fold mean computed the direct way: sums per (key, fold), each fold against all others."""
    cells = rows.groupBy(key, "fold").agg(F.sum(F.col(target).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    other = cells.select(F.col(key).alias("k2"), F.col("fold").alias("f2"), "s", "n")
    means = cells.select(key, "fold").join(other, (F.col(key) == F.col("k2")) & (F.col("fold") != F.col("f2"))).groupBy(key, "fold").agg((F.sum("s") / F.sum("n")).alias("direct_mean"))
    return split_join(rows.select("id", key, "fold"), means, [key, "fold"]).select("id", "direct_mean")


def leak_check_full(encoded: DataFrame, key: str, value: str = "oof_mean", target: str = "rating", tolerance: float = 1e-9) -> DataFrame:
    """Recomputes every row's value from the other folds; counts of rows and of differences."""
    both = encoded.join(direct_oof_mean(encoded, key, target), "id")
    same = F.col(value).eqNullSafe(F.col("direct_mean")) | (F.abs(F.col(value) - F.col("direct_mean")) <= tolerance)
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(same, F.lit(False))).alias("n_violations"))


def stratified_folds(rows: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """Folds with the classes' shares: ranks by hash within each class, dealt round. Ranks come from hash ranges, so no class meets in one task."""
    bucket = F.conv(F.substring("h", 1, 2), 16, 10).cast("int")
    hashed = rows.withColumn("h", F.md5(F.col(key).cast("string").cast("binary"))).withColumn("b", bucket)

    sizes = hashed.groupBy(label, "b").agg(F.count(F.lit(1)).alias("n"))  # 256 rows a class
    before = F.coalesce(F.sum("n").over(Window.partitionBy(label).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(label, "b", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy(label, "b").orderBy("h", key)) - 1
    return hashed.withColumn("rank", rank).join(F.broadcast(offsets), [label, "b"]).withColumn("fold", ((F.col("before") + F.col("rank")) % k).cast("int")).drop("h", "b", "rank", "before")
