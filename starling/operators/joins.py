"""Joins of facts, dimensions and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


#: Dimensions of at most so many rows are broadcast; larger ones are left to the planner's own measures.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if a count says that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def split_join(rows: DataFrame, table: DataFrame, keys: str | Sequence[str], how: str = "left") -> DataFrame:
    """Joins on the keys and a hash of them.

    The second key makes Spark shuffle both sides for the join, a grouped table too, so that
    adaptive execution may split a hot key. Rows with a null key match nothing; they are dealt
    out by their other columns instead of meeting in one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    empty = F.lit(False)
    for c in keys:
        empty = empty | F.col(c).isNull()
    others = [c for c, kind in rows.dtypes if c not in keys and not kind.startswith(("map", "variant"))]
    salt = F.when(empty, F.xxhash64(*others)).otherwise(F.xxhash64(*keys)) if others else F.xxhash64(*keys)
    return rows.withColumn("__salt", salt).join(table.withColumn("__salt", F.xxhash64(*keys)), [*keys, "__salt"], how).drop("__salt")


def join_dimension(facts: DataFrame, dimension: DataFrame, key: str, prefix: str = "pi_") -> DataFrame:
    """Left join on ``key``; columns of the dimension that facts have too get a prefix."""
    renamed = dimension.select(key, *[F.col(c).alias(f"{prefix}{c}" if c in facts.columns else c) for c in dimension.columns if c != key])
    return facts.join(small(renamed), key, "left")


def unique_dimension(dimension: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row a key, so that joins keep the number of facts."""
    rest = [c for c in dimension.columns if c != key]
    ordered = [*order, *[c for c in rest if c not in order]]
    return dimension.groupBy(key).agg(F.min(F.struct(*ordered)).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def chain_lookup(rows: DataFrame, *hops: tuple[DataFrame, str]) -> DataFrame:
    """Left joins one after the other, each on a column that the one before may have brought."""
    for df, key in hops:
        rows = split_join(rows, df, key)
    return rows


def align(key: str, *tables: DataFrame) -> DataFrame:
    """Feature tables side by side on their row key (inner)."""
    out = tables[0]
    for df in tables[1:]:
        out = out.join(df, key)
    return out


def union_splits(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both splits' common columns with a label."""
    return train.select(*columns, F.lit("train").alias("split")).unionByName(test.select(*columns, F.lit("test").alias("split")))


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys in both, only left, only right."""
    a, b = left.select(key).distinct().withColumn("a", F.lit(1)), right.select(key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_left"), F.count_if(F.col("a").isNull()).alias("n_right"))
