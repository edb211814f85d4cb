"""Exact deduplication by progressive refinement, with DataFrame functions only.

Texts are equal when they are identical without the characters space and U+0009 to U+000D.
Rows are narrowed in steps: documents whose normalised length nobody shares are settled at
once; of the others, those whose hash of a prefix nobody of that length shares; only what is
left has its full content hashed and grouped. The plan is one for all sizes: Spark joins the
surviving (length, prefix hash) keys by shuffle, or sends them around if their table is below its
own broadcast threshold. Where every digest is wanted they are taken at the scan, so that texts
never cross a shuffle.

Edge cases: a null text counts as empty, and all empty texts form one group. Of equal texts the
row with the most code points stays, then the one with the smallest doc_id (a null doc_id comes
last). Rows that repeat a doc_id with an equal text count in group_size, and ``kept`` is true for
each of them if theirs is the doc_id that stays. An empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from starling.llm.common import saved

#: Characters of the normalised text that the second step hashes.
PREFIX_CHARS = 64

_SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in _SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, code points, normalised text, its length and the hash of its prefix."""
    norm = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", "chars", "norm", F.length("norm").alias("norm_len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix_hash"))


def surviving_keys(sig: DataFrame) -> DataFrame:
    """(norm_len, prefix_hash) pairs that more than one document has, found length first."""
    by_prefix = sig.groupBy("norm_len", "prefix_hash").agg(F.count(F.lit(1)).alias("n"))
    shared_len = by_prefix.groupBy("norm_len").agg(F.sum("n").alias("same_len")).where("same_len > 1")
    return by_prefix.where("n > 1").join(shared_len, "norm_len", "left_semi").select("norm_len", "prefix_hash")


def exact_dedup(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_hash.

    text_hash is the sha-256 of the normalised text for documents that survive both cheap steps
    and, with ``digest_all``, for all others too.
    """
    sig = signatures(docs)
    keys = saved(surviving_keys(sig.drop("norm")), "dedup-keys").withColumn("shared", F.lit(True))
    content = F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256))
    if digest_all:
        hashed = sig.withColumn("key", content).drop("norm").join(keys, ["norm_len", "prefix_hash"], "left")
    else:
        # Only documents with a surviving key have their whole content hashed.
        hashed = sig.join(keys, ["norm_len", "prefix_hash"], "left").withColumn("key", F.when(F.col("shared"), content)).drop("norm")
    hashed = saved(hashed.select("doc_id", "chars", "shared", "key"), "dedup-hashes")
    order = F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    groups = hashed.where("shared").groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    # Joined on a second column besides, so that both sides are shuffled for the join and Spark may split a hot group.
    groups = groups.select("key", F.xxhash64("key").alias("salt"), F.col("first.doc_id").alias("keep_id"), "group_size")
    rows = hashed.withColumn("salt", F.when(F.col("shared"), F.xxhash64("key")))
    out = rows.join(groups, ["key", "salt"], "left")
    grouped = F.col("group_size").isNotNull()
    return out.select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(grouped, F.col("keep_id").eqNullSafe(F.col("doc_id"))).otherwise(F.lit(True)).alias("kept"),
        F.lower(F.hex("key")).alias("text_hash"),
    )
