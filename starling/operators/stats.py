"""Grouped statistics, profiling and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from starling.operators.joins import split_join, unique_dimension
from starling.sources.io import materialize, scratch


def user_stats(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """Per user: mean rating, count, mean votes, purchase rate, population deviation."""
    return rows.groupBy(key).agg(
        F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("n_reviews"), F.avg("votes").alias("avg_votes"),
        F.avg(F.when(F.col("purchased"), 1.0).otherwise(0.0)).alias("purchase_rate"), F.stddev_pop("rating").alias("std_rating"),
    )


def product_stats(rows: DataFrame, products: DataFrame, key: str = "prod_id") -> DataFrame:
    """Per product: mean rating and count, with the product's own columns (one row a key)."""
    return rows.groupBy(key).agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("n_reviews")).join(products, key, "left")


def category_stats(rows: DataFrame, key: str = "main_category") -> DataFrame:
    """Per category: mean and population deviation of ratings, mean over its distinct prices."""
    return rows.groupBy(key).agg(F.avg("rating").alias("avg_rating"), F.stddev_pop("rating").alias("std_rating"), F.count(F.lit(1)).alias("n_reviews")).join(
        rows.select(key, "price").distinct().groupBy(key).agg(F.avg("price").alias("avg_price")), key, "left"
    )


def extended_stats(rows: DataFrame, key: str | Sequence[str], active: int | None = None) -> DataFrame:
    """Mean, count, sample deviation (0 for one row), exact median, least, largest, range, log count; ``is_active`` from a count on."""
    keys = [key] if isinstance(key, str) else list(key)
    out = rows.groupBy(*keys).agg(
        F.avg("rating").alias("mean_rating"), F.count(F.lit(1)).alias("n_reviews"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("std_rating"),
        F.percentile("rating", F.lit(0.5)).alias("median_rating"), F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"),
    )
    out = out.withColumns({"rating_range": F.col("max_rating") - F.col("min_rating"), "log_reviews": F.log1p("n_reviews")})
    return out.withColumn("is_active", (F.col("n_reviews") >= active).cast("int")) if active is not None else out


def mean_deviation(rows: DataFrame, key: str = "user_id", of: str = "prod_id") -> DataFrame:
    """Per key: the mean difference of its ratings from the mean of what they rate."""
    means = rows.groupBy(of).agg(F.avg("rating").alias("of_mean"))
    return split_join(rows, means, of, "inner").groupBy(key).agg(F.avg(F.col("rating") - F.col("of_mean")).alias("mean_deviation"))


def group_profile(items: DataFrame, group: str, value: str) -> DataFrame:
    """Per group (null ones left out): items, mean and total of a value."""
    return items.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n_items"), F.avg(value).alias("avg_value"), F.sum(value).alias("total_value"))


def store_features(items: DataFrame, key: str, store: str, value: str) -> DataFrame:
    """Per item, its store's profile; zeros and has_store = 0 without a store."""
    out = split_join(items.select(key, store), group_profile(items, store, value), store)
    return out.select(key, store, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_items", "avg_value", "total_value")], F.col(store).isNotNull().cast("int").alias("has_store"))


def pair_stats(rows: DataFrame, first: str = "user_id", second: str = "main_category") -> DataFrame:
    """Per pair: mean, count and difference from the first key's mean (from sums, in one pass over the pairs)."""
    pairs = rows.groupBy(first, second).agg(F.sum("rating").alias("s"), F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy(first).agg((F.sum("s") / F.sum("n")).alias("own_mean"))
    return split_join(pairs, totals, first, "inner").select(first, second, (F.col("s") / F.col("n")).alias("mean_rating"), F.col("n").alias("n_reviews"), (F.col("s") / F.col("n") - F.col("own_mean")).alias("deviation"))


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column and percentage of null or blank values, from one aggregate."""
    columns = list(columns or df.columns)
    blank = [F.sum(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1).otherwise(0)).alias(c) for c in columns]
    row = df.agg(F.count(F.lit(1)).alias("__n"), *blank)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.col(c) * 100.0 / F.nullif(F.col("__n"), F.lit(0)), 2).alias("missing_pct")) for c in columns])
    return row.select(F.inline(pairs))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Each value with its count and percentage."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("__n"))).select("value", "n", F.round(F.col("n") * 100.0 / F.col("__n"), 2).alias("pct"))


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of exact, interpolated quantiles, named by the dict's keys, of (column, share); null without values.

    No task sees all values of a column: rows become counts per distinct value, these are dealt to
    ranges and written, and running counts over the ranges (a row each) and within each of them
    find the values around the wanted ranks.
    """
    columns = sorted({c for c, _ in wanted.values()})
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))).where("v IS NOT NULL")
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = materialize(counts.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()), scratch(df.sparkSession, "ranges"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("c", "part").agg(F.sum("n").alias("n")).select("c", "part", before.alias("before"), F.sum("n").over(Window.partitionBy("c")).alias("total"))
    placed = ranged.withColumn("inside", F.sum("n").over(Window.partitionBy("c", "part").orderBy("v"))).join(F.broadcast(offsets), ["c", "part"])  # a row per column and range
    upto, found = F.col("before") + F.col("inside"), []
    for name, (column, share) in wanted.items():
        here, rank = F.col("c") == column, (F.col("total") - 1) * float(share)
        low, high = (F.min(F.when(here & (upto > edge), F.col("v"))) for edge in (F.floor(rank), F.ceil(rank)))
        found.append((low + (high - low) * F.max(F.when(here, rank - F.floor(rank)))).alias(name))
    return placed.agg(*found)


def numeric_summary(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Mean, median (``exact``, or with a relative rank error of 1/10000), deviation, range and zeros."""
    own = F.lit(None).cast("double") if exact else F.percentile_approx(column, 0.5, 10000).cast("double")
    out = df.agg(
        F.avg(column).alias("mean"), own.alias("median"), F.stddev_samp(column).alias("std"), F.min(column).cast("double").alias("min"),
        F.max(column).cast("double").alias("max"), F.count_if(F.col(column) == 0).alias("zeros"),
    )
    return out.drop("median").crossJoin(quantiles(df, {"median": (column, 0.5)})) if exact else out  # one row each


def time_range(df: DataFrame, ts: str) -> DataFrame:
    """First and last time, as epoch milliseconds and ISO text."""
    low, high = F.min(ts), F.max(ts)
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return df.agg(F.unix_millis(low.cast("timestamp")).alias("first_ms"), F.unix_millis(high.cast("timestamp")).alias("last_ms"), F.date_format(low, iso).alias("first_iso"), F.date_format(high, iso).alias("last_iso"))


def supported_means(df: DataFrame, key: Column, value: str, least: int) -> DataFrame:
    """Mean and count of groups with at least so many rows."""
    return df.groupBy(key.alias("key")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k largest groups; ties by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def histogram(df: DataFrame, column: str, bins: int, clip_quantile: float | None = None, log: bool = False) -> DataFrame:
    """bin and count over equal widths, values above a quantile counted in the last bin; ``log`` bins log1p."""
    x = F.log1p(column) if log else F.col(column).cast("double")
    values = df.select(x.alias("x")).where("x IS NOT NULL")
    bounds = values.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    if clip_quantile is not None:
        bounds = bounds.drop("high").crossJoin(quantiles(values, {"high": ("x", clip_quantile)}))  # one row each
    width = (F.col("high") - F.col("low")) / bins
    spot = F.when(width > 0, F.floor((F.least("x", "high") - F.col("low")) / F.when(width > 0, width))).otherwise(0)
    return values.crossJoin(F.broadcast(bounds)).groupBy(F.least(spot, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # bounds: one row


def feature_target_corr(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """feature and Pearson correlation with the target, from one aggregate."""
    row = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("corr")) for f in features])))


def top_features(corr: DataFrame, k: int = 10) -> DataFrame:
    return corr.orderBy(F.desc(F.abs("corr")), "feature").limit(k)


def first_per_group(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One whole row per key: the first in ``order``, the same in every run."""
    return unique_dimension(df, key, order)


def mean_of_means(df: DataFrame, key: str, value: str) -> DataFrame:
    """The unweighted mean over groups of their means."""
    return df.groupBy(key).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean_of_means"))


def dense_ranks(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``df`` with the dense rank of a value within its group, null last. Distinct values are dealt to ranges, so that no task sorts a hot group."""
    order = [F.col(group), F.col(value).asc_nulls_last()]
    ranged = df.select(group, value).distinct().repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, scratch(df.sparkSession, "ranges"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n")).select(F.col(group).alias("__g"), F.col("__part").alias("__p"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(F.col(value).asc_nulls_last()))
    placed = ranged.withColumn("__inside", inside).join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    ranks = placed.select(F.col(group).alias("__g"), F.col(value).alias("__v"), (F.col("__before") + F.col("__inside")).cast("int").alias(name))
    return df.join(ranks, F.col(group).eqNullSafe(F.col("__g")) & F.col(value).eqNullSafe(F.col("__v")), "left").drop("__g", "__v")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by the hash of their key: the same ones in every partitioning."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")).cast("binary")), key).limit(n)


def median_fill(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Nulls become the median of the fitting rows, or 0 where that has none; approximate medians have a relative rank error of 0.01."""
    fit = fit_on if fit_on is not None else df
    medians = quantiles(fit, {f"__{c}": (c, 0.5) for c in columns}) if exact else fit.agg(*[F.percentile_approx(c, 0.5, 100).cast("double").alias(f"__{c}") for c in columns])
    out = df.crossJoin(F.broadcast(medians))  # one row
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}"), F.lit(0.0)) for c in columns}).drop(*[f"__{c}" for c in columns])


def mode_fill(df: DataFrame, column: str) -> DataFrame:
    """Nulls become the commonest value, the smallest of equals."""
    mode = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n")).agg(F.min_by(column, F.struct(-F.col("__n"), F.col(column))).alias("__mode"))
    return df.crossJoin(F.broadcast(mode)).withColumn(column, F.coalesce(column, "__mode")).drop("__mode")  # one row
