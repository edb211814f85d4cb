"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that one numpy step inside a task works on; a longer single text is a step of its own.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_FOLDER: dict[str, str] = {}
_SAVED: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may leave the setting out; its one process gets a temporary folder then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN_FOLDER:
            _OWN_FOLDER[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        root = _OWN_FOLDER[context.applicationId]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _SAVED.append(path)
    df.sparkSession.sparkContext._jvm.System.gc()  # lets Spark remove the shuffle files of finished steps now
    return df.sparkSession.read.schema(schema).parquet(path)


def saved_so_far() -> int:
    return len(_SAVED)


def remove_saved(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes the tables that ``saved`` wrote after ``since`` of them; DataFrames that read them end with it."""
    for path in _SAVED[since:until]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _SAVED[since:until]


def crc_bucket(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def row_key(*columns: Column) -> Column:
    """Two 64-bit hashes of the columns' values and nulls, as 16 bytes."""
    cells = [c for column in columns for c in (column, column.isNull())]  # hashing skips nulls
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(salt), *cells)), 16, "0") for salt in (1, 2)]))


def filled(texts: pa.Array) -> pa.Array:
    """Null texts become empty ones; chunks become one string array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    return pc.fill_null(texts, "")


def steps(batches: Iterable[pa.RecordBatch], size: int = STEP_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows whose texts together have about ``size`` bytes; a text beyond that stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(lens) - lens) // size
        alone = lens > size
        edges = np.flatnonzero((group[1:] != group[:-1]) | alone[1:] | alone[:-1]) + 1
        for lo, hi in zip(np.r_[0, edges], np.r_[edges, batch.num_rows], strict=True):
            yield batch.slice(int(lo), int(hi - lo))


#: UTF-8 of letters: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, hiragana, Chinese characters, hangul.
_LETTER = (
    rb"[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|\xCE[\x91-\xA1\xA3-\xBF]|\xCF[\x80-\x89]|\xD0[\x90-\xBF]|\xD1[\x80-\x8F]|\xD7[\x90-\xAA]|\xD8[\xA1-\xBA]|\xD9[\x81-\x8A]"
    rb"|\xE0\xA4[\x85-\xB9]|\xE0\xB8[\x81-\xAE]|\xE3\x81[\x81-\xBF]|\xE4[\xB8-\xBF][\x80-\xBF]|[\xE5-\xE8][\x80-\xBF][\x80-\xBF]|\xEA[\xB0-\xBF][\x80-\xBF]|[\xEB\xEC][\x80-\xBF][\x80-\xBF]"
)
_BETWEEN_WORDS = re.compile(rb"[A-Za-z0-9\x80-\xBF] (?=" + _LETTER + rb")")


def long_parts(batch: pa.RecordBatch, size: int = STEP_BYTES) -> Iterator[pa.Array]:
    """The texts of a step; one text beyond ``size`` bytes comes in parts of about as many, each an array of one.

    Parts begin with a single space between a letter or digit (or anything beyond ASCII) and a
    letter, which no word and no match of a tokenizer's pattern crosses; a stretch without one, as of
    a script that sets no spaces, stays whole.
    """
    data, _ = raw(batch.column("text"))
    if batch.num_rows > 1 or len(data) <= size:
        yield filled(batch.column("text"))
        return
    text, at = data.tobytes(), 0
    while at < len(text):
        found = _BETWEEN_WORDS.search(text, at + size) if len(text) - at > size else None
        to = found.start() + 1 if found else len(text)
        yield pa.array([text[at:to].decode()], pa.large_string())
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the n + 1 offsets into them."""
    texts = filled(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[:1]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + len), one run after the other."""
    lens = np.asarray(lens, np.int64)
    ends = np.cumsum(lens)
    return np.repeat(np.asarray(starts, np.int64) - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def binaries(values: np.ndarray, lens: np.ndarray) -> pa.Array:
    """A binary column out of one buffer of fixed-width values and the number of values per row."""
    offsets = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(np.asarray(lens, np.int64) * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
