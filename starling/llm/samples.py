"""Bounded samples of labelled documents, and training in one task on such a sample."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from starling.llm.common import batch_of, row_key, saved

#: Whole texts of one class in a sample end with the one that reaches so many bytes: with long documents there are fewer, but none is cut.
SAMPLE_BYTES = 24 << 20


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: tuple[int, int], size: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text, label of at most most[c] rows of documents of class c (0 and 1), chosen by the hash of their ids.

    Texts are whole; a class ends early with the text that reaches ``size`` bytes.

    A document with several labels counts as 1 if any of them is; null ids and labels are left out.
    Rows that repeat doc_id and text count once, others that share a doc_id one by one, in the order
    of their texts' hashes. Rows are chosen by ids, hashes and lengths alone, at first most[c] of
    each class; only the texts of chosen rows are read after that, by a broadcast of at most
    sum(most) keys.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where(usable)
    texts = docs.where(F.col("doc_id").isNotNull() & usable).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    rows = texts.select("doc_id", "key", F.octet_length("text").cast("long").alias("bytes")).join(one, "doc_id")
    order = [F.xxhash64("doc_id"), "doc_id", "key"]
    rows = rows.distinct()  # repeated rows meet before any order is made
    picked = [rows.where(F.col("label") == c).orderBy(*order).limit(most[c]) for c in (0, 1)]
    before = Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chosen = picked[0].unionByName(picked[1]).withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0).cast("long")))  # at most sum(most) rows
    chosen = saved(chosen.where(F.col("before") < size).select("key", "label"), "sample")
    found = texts.join(F.broadcast(chosen), "key")
    return found.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("label").alias("label")).drop("key")


def trained(sample: DataFrame, fit: Callable[[list[str], list], bytes], label: str = "label") -> bytes:
    """Runs fit(texts, labels) in one task over a bounded sample; only the model comes to the driver."""

    def run(batches):
        rows = sorted((d, t, y) for b in batches for d, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", label)), strict=True))
        model = fit([t for _, t, _ in rows], [y for _, _, y in rows])
        rows.clear()
        yield batch_of(model=pa.array([model], pa.binary()))

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(row["model"]) if row else fit([], [])
