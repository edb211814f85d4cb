"""A content-addressed store for token-id streams.

Layout of a store folder, all Parquet:

* ``chunks``: hash (blake2b-128 of the ids), ids (little-endian) and width, the bytes of an id: 2
  if the vocabulary allows, else 4. A rolling hash over the last few ids decides where a stream is
  cut, so equal passages give equal chunks wherever they stand; each distinct chunk is stored once.
* ``recipes``: one row per document in ascending doc_id order: part, idx (row within the part),
  doc_id, start (ids of all documents before it), n_tokens, hashes and lens of its chunks, leaf.
* ``manifest``: Merkle root, documents and tokens of each part. A leaf is the sha-256 of the
  recipe: doc_id, start, n_tokens, lengths and hashes.

Reading recomputes the Merkle roots from the recipes and fails if a part, its documents or its
tokens differ from the manifest; it verifies every chunk against its address, and rebuilds each
document's crc32 from the digests of its chunks, so that chunk bytes never cross a shuffle.
``documents`` restores ids.

Edge cases: a null or empty text is the end id alone. Rows that share a doc_id (or have none;
null comes first) are documents of their own, ordered by their recipes. An empty table makes an
empty store. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from starling.llm.common import batch_of, mix, saved, scratch, steps
from starling.llm.words import WordEncoder

#: Ids that the rolling hash sees, one cut in so many ids on average, and bounds of a chunk's length.
WINDOW, MEAN, LEAST, MOST = 8, 512, 64, 4096
#: Children of a node of the Merkle tree.
FANOUT = 256
#: Up to so many ids take two bytes each.
NARROW = 1 << 16
_CRC = 0xEDB88320


def cut_points(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the chunks of all streams, and the number of chunks of each stream."""
    with np.errstate(over="ignore"):
        rolled = mix(ids.astype(np.uint64) + np.uint64(1))
        total = rolled.copy()
        for back in range(1, WINDOW):
            total[back:] += rolled[:-back] * np.uint64(2 * back + 1)
    good = np.flatnonzero(mix(total) % np.uint64(MEAN) == 0) + 1  # a chunk may end before these
    ends = np.cumsum(lens)
    sizes, counts = [], []
    low = 0
    for end, n in zip(ends.tolist(), lens.tolist(), strict=True):
        at, before = end - n, len(sizes)
        high = int(np.searchsorted(good, end))
        for cut in good[low:high].tolist():
            # The window must lie in this stream for the cut to depend on its content alone.
            if cut - at < LEAST or cut - (end - n) < WINDOW:
                continue
            while cut - at > MOST:
                sizes.append(MOST)
                at += MOST
            if cut > at:
                sizes.append(cut - at)
                at = cut
        while end - at > MOST:
            sizes.append(MOST)
            at += MOST
        if end > at:
            sizes.append(end - at)
        counts.append(len(sizes) - before)
        low = high
    return np.array(sizes, np.int64), np.array(counts, np.int64)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encodes all documents and writes the store below ``path``."""
    kind, narrow = docs.schema["doc_id"].dataType.simpleString(), NARROW

    def run(batches):
        encoder = WordEncoder.of(tokenizer)
        wide = np.uint16 if len(encoder.ends) <= narrow else np.uint32
        for batch in steps(batches):
            ids, lens = encoder.encode_step(batch, end_id)
            sizes, counts = cut_points(ids, lens)
            data, width = ids.astype(wide).tobytes(), np.dtype(wide).itemsize
            ends = np.cumsum(sizes) * width
            chunks = [data[e - n * width : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            hashes = [hashlib.blake2b(c, digest_size=16).digest() for c in chunks]
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            yield batch_of(
                doc_id=batch.column("doc_id"), n_tokens=pa.array(lens), hashes=pa.ListArray.from_arrays(offsets, pa.array(hashes, pa.binary())),
                lens=pa.ListArray.from_arrays(offsets, pa.array(sizes)), hash=pa.nulls(len(lens), pa.binary()), ids=pa.nulls(len(lens), pa.binary()), width=pa.nulls(len(lens), pa.int32()),
            )
            own = dict(zip(hashes, chunks, strict=True))
            n = len(own)
            yield batch_of(
                doc_id=pa.nulls(n, batch.column("doc_id").type), n_tokens=pa.nulls(n, pa.int64()), hashes=pa.nulls(n, pa.list_(pa.binary())),
                lens=pa.nulls(n, pa.list_(pa.int64())), hash=pa.array(list(own), pa.binary()), ids=pa.array(list(own.values()), pa.binary()), width=pa.array([width] * n, pa.int32()),
            )

    staged = saved(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, hashes array<binary>, lens array<long>, hash binary, ids binary, width int"), "token-stage")
    staged.where("hash IS NOT NULL").select("hash", "ids", "width").dropDuplicates(["hash"]).write.option("compression", "zstd").parquet(f"{path}/chunks")

    rows = staged.where("hash IS NULL").select("doc_id", "n_tokens", "hashes", "lens")
    order = ["doc_id", F.xxhash64("hashes"), "n_tokens"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = saved(ordered.withColumn("part", F.spark_partition_id()).withColumn("idx", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "token-order")
    within = Window.partitionBy("part").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = numbered.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    offsets = parts.select("part", F.coalesce(F.sum("tokens").over(over_parts), F.lit(0)).alias("before"))
    recipes = numbered.join(offsets, "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).withColumn("leaf", recipe_leaf())
    recipes.select("part", "idx", "doc_id", "start", "n_tokens", "hashes", "lens", "leaf").sortWithinPartitions("part", "idx").write.parquet(f"{path}/recipes")
    manifest_of(docs.sparkSession.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def recipe_leaf():
    """sha-256 of what a recipe says."""
    head = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull().cast("string"), "start", "n_tokens", F.concat_ws(",", F.col("lens").cast("array<string>")))
    return F.sha2(F.concat(head.cast("binary"), F.expr("aggregate(hashes, cast('' as binary), (a, h) -> concat(a, h))")), 256)


def manifest_of(recipes: DataFrame) -> DataFrame:
    """part, root, documents, tokens of recipes with their leaves."""
    parts = recipes.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    return merkle_roots(recipes.select("part", "idx", "leaf")).join(parts, "part")


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """part, root: two levels of at most FANOUT children a node, then the part's root over their hashes."""
    level = leaves.withColumnRenamed("leaf", "node")
    for _ in range(2):
        level = level.groupBy("part", F.expr(f"idx div {FANOUT}").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("children"))
        level = level.select("part", "idx", F.sha2(F.concat_ws("", F.transform("children", lambda c: c["node"])), 256).alias("node"))
    root = level.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("children"))
    return root.select("part", F.sha2(F.concat_ws("", F.transform("children", lambda c: c["node"])), 256).alias("root"))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of bit-reflected polynomials modulo the crc polynomial."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(np.broadcast(a, b).shape, np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(_CRC), b >> np.uint32(1))
    return out


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each crc32 contributes when so many bytes follow it."""
    power = np.array([1 << 23], np.uint32)  # x to the 8
    out, n = crc.astype(np.uint32), n_bytes.astype(np.int64).copy()
    while n.any():
        odd = (n & 1).astype(bool)
        out[odd] = _times(out[odd], power)
        power, n = _times(power, power), n >> 1
    return out


def _wide(ids: bytes, width: int) -> bytes:
    """Stored ids as little-endian 4-byte ones."""
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def chunk_digests(spark: SparkSession, path: str) -> DataFrame:
    """hash, crc and n of every stored chunk; fails on one that its address doesn't match."""

    def run(batches):
        for batch in steps(batches, column="ids"):
            hashes, data = batch.column("hash").to_pylist(), batch.column("ids").to_pylist()
            for h, c in zip(hashes, data, strict=True):
                if hashlib.blake2b(c, digest_size=16).digest() != h:
                    raise ValueError(f"chunk {h.hex()} is damaged")
            ids = [_wide(c, w) for c, w in zip(data, batch.column("width").to_pylist(), strict=True)]
            yield batch_of(hash=batch.column("hash"), crc=pa.array(map(zlib.crc32, ids), pa.int64()), n=pa.array([len(c) >> 2 for c in ids], pa.int64()))

    return spark.read.parquet(f"{path}/chunks").mapInArrow(run, "hash binary, crc long, n long")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored files; fails if they don't verify."""
    ensure_intact(spark, path)

    def run(batches):
        for batch in batches:
            crc = batch.column("crc")
            if crc.null_count:
                raise ValueError("a chunk is missing from the store")
            after = batch.column("after").to_numpy(zero_copy_only=False) * 4
            term = crc_shift(crc.to_numpy(zero_copy_only=False), after).astype(np.int64)
            yield batch_of(**{c: batch.column(c) for c in ("part", "idx", "doc_id", "start", "said", "n")}, term=pa.array(term))

    recipes = spark.read.parquet(f"{path}/recipes")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    uses = recipes.select("part", "idx", "doc_id", "start", "n_tokens", "lens", F.posexplode("hashes").alias("pos", "hash"))
    # Ids after this chunk in its document.
    uses = uses.withColumn("after", F.col("n_tokens") - F.aggregate(F.slice("lens", 1, F.col("pos") + 1), F.lit(0).cast("long"), lambda a, x: a + x)).drop("lens").withColumnRenamed("n_tokens", "said")
    found = uses.join(chunk_digests(spark, path), "hash", "left").mapInArrow(run, f"part int, idx long, doc_id {kind}, start long, said long, n long, term long")
    out = found.groupBy("part", "idx", "doc_id", "start", "said").agg(F.sum("n").alias("n_tokens"), F.expr("bit_xor(term)").alias("ids_crc32"))
    whole = F.when(F.col("n_tokens") == F.col("said"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe's chunks don't have its number of ids")).cast("long"))
    return out.select("doc_id", "start", whole.alias("n_tokens"), "ids_crc32")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (little-endian uint32) of every document, rebuilt from its verified recipe."""
    ensure_intact(spark, path)
    uses = spark.read.parquet(f"{path}/recipes").select("part", "idx", "doc_id", "start", F.posexplode("hashes").alias("pos", "hash"))
    kind = uses.schema["doc_id"].dataType.simpleString()
    rows = uses.join(spark.read.parquet(f"{path}/chunks"), "hash", "left")
    rows = rows.groupBy("part", "idx", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "ids", "width"))).alias("chunks"))  # of one document

    def run(batches):
        for batch in batches:
            found = []
            for chunks in batch.column("chunks").to_pylist():
                for c in chunks:
                    if c["ids"] is None or hashlib.blake2b(c["ids"], digest_size=16).digest() != c["hash"]:
                        raise ValueError(f"chunk {c['hash'].hex()} is damaged or missing")
                found.append(b"".join(_wide(c["ids"], c["width"]) for c in chunks))
            yield batch_of(doc_id=batch.column("doc_id"), start=batch.column("start"), ids=pa.array(found, pa.binary()))

    return rows.select("doc_id", "start", "chunks").mapInArrow(run, f"doc_id {kind}, start long, ids binary")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """part, intact: whether each part's recipes still give the manifest's Merkle root, documents and tokens."""
    now = manifest_of(spark.read.parquet(f"{path}/recipes").withColumn("leaf", recipe_leaf())).select("part", F.struct("root", "documents", "tokens").alias("found"))
    said = spark.read.parquet(f"{path}/manifest").select("part", F.struct("root", "documents", "tokens").alias("said"))
    return said.join(now, "part", "full").select("part", F.col("said").eqNullSafe(F.col("found")).alias("intact"))


def ensure_intact(spark: SparkSession, path: str) -> None:
    if bad := [r.part for r in verify(spark, path).where("NOT intact").limit(10).collect()]:
        raise ValueError(f"parts {bad} of the store differ from its manifest")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    path = path or scratch(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer, end_id)
    return read_digests(docs.sparkSession, path)
