"""Feature assembly: fill and scale with statistics of the training rows, audit the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from starling.operators.stats import quantiles
from starling.sources.io import materialize, scratch, write_parquet
from starling.sources.store import BUCKETS, FeatureStore


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: median, and mean and population deviation after filling, of each column."""
    medians = quantiles(train, {f"{c}__med": (c, 0.5) for c in columns})
    filled = train.crossJoin(F.broadcast(medians))  # one row
    value = {c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}__med"), F.lit(0.0)) for c in columns}
    stats = filled.agg(*[F.avg(x).alias(f"{c}__mean") for c, x in value.items()], *[F.stddev_pop(x).alias(f"{c}__std") for c, x in value.items()])
    return medians.crossJoin(stats)


def apply_scaler(rows: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns filled and standardised; a column that was constant in training becomes 0."""
    out = rows.crossJoin(F.broadcast(scaler))  # one row
    value = {c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}__med"), F.lit(0.0)) for c in columns}
    scaled = {c: F.when(F.col(f"{c}__std") > 1e-12, (x - F.col(f"{c}__mean")) / F.when(F.col(f"{c}__std") > 1e-12, F.col(f"{c}__std"))).otherwise(0.0) for c, x in value.items()}
    return out.withColumns(scaled).drop(*[f"{c}__{s}" for c in columns for s in ("med", "mean", "std")])


def assemble(train: DataFrame, test: DataFrame, columns: Sequence[str], path: str, key: str = "id", rows_per_file: int = 500_000) -> DataFrame:
    """key, split, features: both splits filled and scaled by the training rows' statistics, as one vector a row, written in files of bounded length and read back.

    Fails when a split lacks a column or a vector holds a null or NaN.
    """
    sides = []
    scaler = materialize(fit_scaler(require(train, columns), columns), scratch(train.sparkSession, "scaler"))
    for name, side in (("train", train), ("test", require(test, columns))):
        sides.append(apply_scaler(side.select(key, *columns), scaler, columns).withColumn("split", F.lit(name)))
    both = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(sides[0].unionByName(sides[1]))
    write_parquet(both.select(key, "split", "features"), path, partition_by=["split"], rows_per_file=rows_per_file)
    return train.sparkSession.read.parquet(path).select(key, "split", "features")


def assemble_blocks(train: DataFrame, test: DataFrame, numeric: Sequence[str], blocks: dict[str, tuple[DataFrame, str, int]], path: str, key: str = "id", buckets: int = BUCKETS, rows_per_file: int = 500_000) -> DataFrame:
    """key, split, features: numeric columns as in assemble(), then each block's vector (rows of key and an array column of a known width).

    Both splits and all blocks are written in buckets of the key and lined up without a shuffle. A
    key that a block lacks has zeros there; one that it has twice, or a vector of another width, fails.
    The splits' numbers are written once before statistics and scaling read them, and the split is
    a column of the result's files, not a folder: folders would sort the whole vectors once more.
    """
    spark = train.sparkSession
    store = FeatureStore(spark, key, buckets)
    train, test = (materialize(require(side, numeric).select(key, *numeric), scratch(spark, "numeric")) for side in (train, test))
    scaler = materialize(fit_scaler(train, numeric), scratch(spark, "scaler"))
    sides = [apply_scaler(side, scaler, numeric).withColumn("split", F.lit(name)) for name, side in (("train", train), ("test", test))]
    store.put("numeric", sides[0].unionByName(sides[1]))
    for name, (df, column, _) in blocks.items():
        store.put(name, df.select(key, F.col(column).cast("array<double>").alias(name)))
        if not store.repeats(name).isEmpty():
            raise ValueError(f"block {name} has a key more than once")
    parts = [F.array(*[F.col(c).cast("double") for c in numeric])]
    for name, (_, _, width) in blocks.items():
        right = F.assert_true(F.size(name) == width, F.concat(F.lit(f"{name} should have {width} values, not "), F.size(name).cast("string")))
        whole = F.transform(name, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x))
        parts.append(F.when(F.col(name).isNull(), F.array_repeat(F.lit(0.0), width)).when(right.isNull(), whole))
    rows = store.aligned("numeric", list(blocks)).select(key, "split", F.concat(*parts).alias("features"))
    write_parquet(rows, path, rows_per_file=rows_per_file)
    store.drop()
    return spark.read.parquet(path).select(key, "split", "features")


def null_audit(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, nulls and NaNs, from one aggregate."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_bad")) for c in columns])))


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fails when a column is missing, instead of leaving its features out."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df
