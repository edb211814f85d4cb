"""Sketches of values and of distinct keys: kept for each group, merged later, asked many times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Size of quantile sketches: ranks are off by about 1.33 % / (K / 200) at most, with 99 % confidence. And log2 of the buckets of distinct counts: about 1.04 / sqrt(2^LOG_BUCKETS) relative deviation.
K, LOG_BUCKETS = 1024, 12


def sketch_groups(df: DataFrame, keys: Sequence[str], value: str, distinct: str, k: int = K, log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """keys, values (a quantile sketch of ``value`` as double), distinct (a sketch of the different values of ``distinct``), n: a row of a few KB a group, however large it is.

    Nulls enter no sketch; a group of nulls alone has an empty one. Tasks sketch their rows before the shuffle.
    """
    return df.groupBy(*keys).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("values"), F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(log_buckets)).alias("distinct"), F.count(F.lit(1)).alias("n")
    )


def merged(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Coarser groups (or one row) from the sketches of finer ones."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("distinct").alias("distinct"), F.sum("n").alias("n"))


def asked(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The sketches' other columns, the named quantiles and the estimated number of different values."""
    found = {name: F.when(F.kll_sketch_get_n_double("values") > 0, F.kll_sketch_get_quantile_double("values", F.lit(q))) for name, q in quantiles.items()}
    return sketches.withColumns(found).withColumn("n_distinct", F.hll_sketch_estimate("distinct")).drop("values", "distinct")
