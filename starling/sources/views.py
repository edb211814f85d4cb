"""The review-shaped views over the base tables, and hashed folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: id, user_id, rating (1 to 5), purchased, price, ts."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
        (F.col("o_orderstatus") == "F").alias("purchased"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("ts"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: id, user_id, prod_id, main_category, store_id, rating, votes, purchased, price, ts."""
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return lines.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("prod_id"),
        F.col("p_type").alias("main_category"),
        F.col("l_suppkey").alias("store_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
        F.col("l_quantity").alias("votes"),
        (F.col("l_returnflag") == "R").alias("purchased"),
        F.col("p_retailprice").alias("price"),
        F.col("o_orderdate").alias("ts"),
    )


def hash_bucket(key: Column, modulus: int, salt: str = "") -> Column:
    """A bucket of the first 32 bits of md5(salt + key): the same in every engine and partitioning."""
    text = F.concat(F.lit(salt), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % modulus


def fold(key: Column, k: int = 5) -> Column:
    return hash_bucket(key, k)


def is_scoring(key: Column) -> Column:
    """The fifth of the keys that stands for the scoring set."""
    return hash_bucket(key, 5, "split") == 4


#: The same views for DuckDB, as common table expressions.
SQL_ORDER_REVIEWS = """order_reviews AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS rating,
         o_orderstatus = 'F' AS purchased, o_totalprice AS price, o_orderdate AS ts FROM orders)"""
SQL_REVIEWS = """reviews AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS user_id, l.l_partkey AS prod_id, p.p_type AS main_category,
         l.l_suppkey AS store_id, CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS rating, l.l_quantity AS votes,
         l.l_returnflag = 'R' AS purchased, p.p_retailprice AS price, o.o_orderdate AS ts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""


def sql_bucket(key: str, modulus: int, salt: str = "") -> str:
    return f"(('0x' || substr(md5('{salt}' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT % {modulus})"
