"""Feature tables in buckets of their row key, which line up without a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.sources.io import scratch

#: Buckets of a store's tables: each table's rows of one bucket are one file and one task when tables are lined up.
BUCKETS = 16


class FeatureStore:
    """Tables of one row key, all in the same number of buckets, in the folder that driver and executors share.

    ``put`` shuffles a table once, when it is made; any number of them are then joined on their key
    bucket by bucket (a plan without exchanges). At 100 TB choose so many buckets that one of the
    widest table fits a task, as with shuffle partitions.
    """

    def __init__(self, spark: SparkSession, key: str, buckets: int = BUCKETS):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.names: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> None:
        """Writes a table under ``name``, in place of one of that name. Keys must be unique and not null."""
        table = f"store_{uuid.uuid4().hex}"
        rows = df.where(F.col(self.key).isNotNull()).repartition(self.buckets, self.key)
        rows.write.bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet").option("path", scratch(self.spark, f"store-{name}")).saveAsTable(table)
        old, self.names[name] = self.names.get(name), table
        if old:
            self.spark.sql(f"DROP TABLE {old}")

    def get(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def repeats(self, name: str) -> DataFrame:
        """Keys that a table has more than once, with their number; no shuffle either."""
        return self.get(name).groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def aligned(self, base: str, others: Sequence[str]) -> DataFrame:
        """The rows of ``base`` with the columns of the others, null where one lacks the key."""
        out = self.get(base)
        for name in others:
            out = out.join(self.get(name).hint("merge"), self.key, "left")
        return out

    def drop(self) -> None:
        """Forgets the tables; their files go with io.remove_scratch()."""
        for table in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.names.clear()
