"""The corpus pipeline: toxic documents go, copies and near copies go, repeated passages go, the rest is packed.

Each stage works on what its predecessor left (written as Parquet and read again): the first
four return documents with their columns, the last one the packed pieces. Decisions return to
rows by a hash of the whole row, kept apart from the columns of the table, so that ids may be
null, repeated or shared and no column name can clash. An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.llm import exact_dedup, jaccard, packing, suffix_dedup, toxicity
from starling.llm.common import crc_bucket, remove_saved, row_key, saved, saved_so_far, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above the toxicity threshold go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 3) != 1)
    return toxicity.without_toxic(docs, model)


def _keyed(docs: DataFrame) -> DataFrame:
    """key (128 bits of hash over all columns) and row (a struct of them)."""
    return docs.select(row_key(*[F.col(f"`{c}`") for c in docs.columns]).alias("key"), F.struct("*").alias("row"))


def _without(keyed: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows but those that ``decided`` (key, stays) doesn't let stay; of the equal rows of a key that stays, one is left."""
    others = keyed.join(decided.select("key"), "key", "left_anti")
    again = decided.where("stays").select("key")
    if not again.isEmpty():
        others = others.unionByName(keyed.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return others.select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays: the longest, then the one with the smallest id (null last)."""
    keyed = _keyed(docs)
    row = F.struct(F.col("row.doc_id").isNull().alias("null"), F.col("row.doc_id").alias("id"), "key")
    found = exact_dedup.exact_dedup(keyed.select(row.alias("doc_id"), F.col("row.text").alias("text"))).where("group_size > 1")
    rows = found.groupBy(F.col("doc_id.key").alias("key")).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("times"))
    return _without(keyed, saved(rows.where("NOT stays OR times > 1").select("key", "stays"), "copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that chains of similar ones connect (five-word shingles, 0.8 or more), the one with the smallest id (null last) stays."""
    keyed = _keyed(docs)
    found = jaccard.jaccard_components(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), words=5, percent=80).where("n_shingles > 0")
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component"), F.max("copies").alias("copies"))
    # Rows alone in their component are settled. A hash is a second join key, so that joins shuffle both sides and may split a hot component.
    linked = found.where("copies > 1 OR component <> doc_id").select("component", F.xxhash64("component").alias("salt")).distinct()
    members = found.withColumn("salt", F.xxhash64("component")).join(linked, ["component", "salt"], "left_semi")
    members = saved(members.select(F.col("doc_id").alias("key"), "component"), "near-members")
    rows = keyed.groupBy("key").agg(F.first("row.doc_id").alias("id"), F.count(F.lit(1)).alias("times"))
    rows = saved(rows.join(members, "key"), "near-rows")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("best")).select("component", F.xxhash64("component").alias("salt"), F.col("best.key").alias("best"))
    decided = rows.withColumn("salt", F.xxhash64("component")).join(best, ["component", "salt"]).withColumn("stays", F.expr("key = best"))
    return _without(keyed, saved(decided.where("NOT stays OR times > 1").select("key", "stays"), "near-copies"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur more than once go; documents stay, with what is left of them."""
    left = suffix_dedup.remaining_text(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of power-of-two length."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_passages),
    ("packing", pack),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = saved_so_far()
        docs = saved(stage(spark, docs, sf_dir), name)
        remove_saved(spark, before, saved_so_far() - 1)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
