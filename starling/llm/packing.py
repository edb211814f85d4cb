"""Packing token streams into power-of-two sequences.

Each document's ids (with the end id) are cut into pieces whose lengths are powers of two: as
many of the full length as fit, then the binary digits of the rest. Pieces of equal length form
a bucket, and each piece is one sequence of its own: no sequence crosses documents, and none
needs padding. One map cuts the documents; a shuffle then brings each bucket together, the longest
pieces first, in as many slots of about SLOT_BYTES as its bytes take. Within a slot pieces follow
doc_id and start, and all sequences are numbered without gaps; the numbers don't depend on how
the input is split into files.

Edge cases: a null or empty text gives the end id alone. Repeated rows are packed each by
itself. An empty table gives no pieces; columns other than doc_id and text are ignored. A null
doc_id is carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from starling.llm.common import batch_of, binaries, raw, saved, steps
from starling.llm.words import WordEncoder


#: Ids (4 bytes each) of one bucket that are numbered together.
SLOT_BYTES = 32 << 20


def pieces_of(lens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents with these lengths, longest first."""
    full = lens // longest
    docs, sizes = [np.repeat(np.arange(len(lens)), full)], [np.full(full.sum(), longest, np.int64)]
    for bit in range(longest.bit_length() - 2, -1, -1):
        have = np.flatnonzero(lens >> bit & 1)
        docs.append(have)
        sizes.append(np.full(len(have), 1 << bit, np.int64))
    doc, size = np.concatenate(docs), np.concatenate(sizes)
    order = np.argsort(doc, kind="stable")
    doc, size = doc[order], size[order]
    ends = np.cumsum(size)
    first = np.cumsum(lens) - lens
    return doc, ends - size - first[doc], size


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, bucket, sequence_id, offset.

    ``longest`` must be a power of two. ``bucket`` is the logarithm of ``length``; sequence ids of a
    bucket follow each other.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")

    def run(batches):
        for batch in steps(batches):
            ids, lens = WordEncoder.of(tokenizer).encode_step(batch, end_id)
            doc, start, size = pieces_of(lens, longest)
            if len(WordEncoder.of(tokenizer).ends) <= 1 << 16:
                ids = ids.astype(np.uint16)  # for the way through the shuffle
            yield batch_of(
                doc_id=batch.column("doc_id").take(pa.array(doc)), start=start, length=size, ids=binaries(ids, size).cast(pa.binary()), doc_tokens=lens[doc]
            )

    def widen(batches):
        for batch in batches:
            length, ids = batch.column("length").to_numpy(), batch.column("ids").cast(pa.large_binary())
            data = raw(ids.view(pa.large_string()))[0]
            narrow = len(data) < 4 * length.sum()
            data = data.view("<u2").astype(np.uint32) if narrow else data
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", binaries(data, length if narrow else 4 * length).cast(pa.binary()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    cut = saved(cut.withColumn("bucket", F.log2("length").cast("int")), "pieces")
    counts = {r["bucket"]: r["n"] for r in cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per bucket
    slots = F.lit(1)
    for bucket, n in counts.items():
        slots = F.when(F.col("bucket") == bucket, n * (4 << bucket) // SLOT_BYTES + 1).otherwise(slots)
    crc = F.crc32("ids")
    cut = cut.withColumn("slot", F.pmod(F.xxhash64("doc_id", "start", crc), slots))
    before = Window.orderBy(F.desc("bucket"), "slot").rowsBetween(Window.unboundedPreceding, -1)  # a row per slot
    base = cut.groupBy("bucket", "slot").agg(F.count(F.lit(1)).alias("n")).select("bucket", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket", "slot").orderBy("doc_id", "start", crc))
    out = cut.withColumn("place", place.cast("long")).join(base, ["bucket", "slot"])
    out = out.select("doc_id", "start", "length", "ids", "doc_tokens", "bucket", (F.col("before") + F.col("place") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.mapInArrow(widen, out.schema)
