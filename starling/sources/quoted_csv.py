"""CSV files with line breaks inside quotes, read by many tasks a file.

Spark's text source cuts files in byte ranges and gives each line to the range in which it begins.
Whether a line begins inside quotes depends on the number of quotes before it, modulo two: of lines,
of ranges and of files' beginnings these parities combine by exclusive or.

1. A first pass takes the parity of each range; a running exclusive or over the ranges of a file
   gives the state at each range's beginning (one row a range: with ranges of 128 MB, 800,000 rows
   for 100 TB), which is broadcast to the lines.
2. A second pass puts lines together to records. A record that ends in its range is complete there.
   What a range has of records that cross its borders, two pieces at most, is put together in a
   shuffle of these pieces alone; the record belongs to the range in which it begins.
3. Spark's CSV parser turns records into columns.

Quotes inside quotes are doubled. Lines end with LF or CR LF, but a CR alone ends none. Empty lines
outside of quotes are passed over. The first record of each file is its header if ``header``; files
are told apart by their path. A quote that never closes makes the rest of its file one record.
Columns that a record lacks are null, as are empty fields without quotes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

#: A record that is complete, one that the next range goes on with, and what a range has of a record that began before it.
WHOLE, HEAD, REST = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the range), line."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def range_states(lines: DataFrame) -> DataFrame:
    """file, start, inside: whether the range begins inside quotes; one row a range."""
    odd = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))).bitwiseAND(F.lit(1))
    parity = lines.groupBy("file", "start").agg(F.bit_xor(odd).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return parity.select("file", "start", (F.coalesce(F.bit_xor("odd").over(before), F.lit(0)) == 1).alias("inside"))


class _Range:
    """The lines of one range, a batch at a time; ``open`` holds those of a record that has not ended."""

    def __init__(self, file: str, start: int, inside: bool):
        self.file, self.start, self.inside, self.kind, self.open, self.first = file, start, inside, REST if inside else HEAD, [], start == 0

    def take(self, lines: pa.Array) -> list[tuple[int, pa.Array]]:
        odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) & 1
        after = np.cumsum(odd) + self.inside & 1  # inside quotes after the line
        self.inside = bool(after[-1])
        ends = np.flatnonzero(after == 0) + 1
        if not len(ends):
            self.open.append(lines)
            return []
        out, at = [], 0
        if self.open or self.kind == REST:  # the line that ends what was open
            at = int(ends[0])
            whole = pa.concat_arrays([*self.open, lines.slice(0, at)])
            out.append((WHOLE if self.kind == HEAD else REST, _joined(whole, np.array([0, len(whole)]))))
            self.open, self.kind = [], HEAD
        cuts = np.r_[at, ends[ends > at]]
        out.append((WHOLE, _joined(lines.slice(at, int(cuts[-1]) - at), cuts - at)))
        if cuts[-1] < len(lines):
            self.open.append(lines.slice(int(cuts[-1])))
        return out

    def last(self) -> list[tuple[int, pa.Array]]:
        if not self.open:
            return []
        whole = pa.concat_arrays(self.open)
        return [(self.kind, _joined(whole, np.array([0, len(whole)])))]


def _joined(lines: pa.Array, cuts: np.ndarray) -> pa.Array:
    """The lines between cuts as one string each."""
    if len(cuts) == len(lines) + 1:
        return lines
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), lines), "\n")


def _pieces(stated: DataFrame, header: bool, whole: bool) -> DataFrame:
    """file, start, kind, text of the complete records (``whole``) or else of the pieces that ranges share."""

    def run(batches):
        now: _Range | None = None

        def made(parts):
            for kind, texts in parts:
                if header and now.first and kind != REST and len(texts):
                    now.first = False
                    if kind == HEAD:  # a header that goes on in the next range is told by its start
                        kind = -HEAD
                    else:
                        texts = texts.slice(1)
                if (kind == WHOLE) == whole and len(texts):
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays([pa.array([now.file] * n if not whole else [""] * n, pa.string()), pa.array(np.full(n, now.start)), pa.array(np.full(n, kind, np.int32)), texts], names=["file", "start", "kind", "text"])

        for batch in batches:
            starts = batch.column("start").to_numpy()
            files = batch.column("file").dictionary_encode()
            codes = files.indices.to_numpy()
            lines = batch.column("line").cast(pa.string())
            edges = [0, *(np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1).tolist(), len(starts)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                file, start = files.dictionary[int(codes[lo])].as_py(), int(starts[lo])
                if now is None or (file, start) != (now.file, now.start):
                    if now is not None:
                        yield from made(now.last())
                    now = _Range(file, start, batch.column("inside")[lo].as_py())
                yield from made(now.take(lines.slice(lo, hi - lo)))
        if now is not None:
            yield from made(now.last())

    return stated.mapInArrow(run, "file string, start long, kind int, text string")


def records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """text: one row for each record."""
    lines = _lines(spark, path)
    stated = lines.join(F.broadcast(range_states(lines)), ["file", "start"])
    shared = _pieces(stated, header, whole=False)
    order = Window.partitionBy("file").orderBy("start", F.when(F.col("kind") == REST, 0).otherwise(1))
    numbered = shared.withColumn("record", F.sum(F.when(F.col("kind") != REST, 1).otherwise(0)).over(order))
    piece = F.struct("start", F.when(F.col("kind") == REST, 0).otherwise(1).alias("late"), "kind", "text")
    crossing = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(piece)).alias("p")).where(F.col("p")[0]["kind"] != -HEAD)
    text = _pieces(stated, header, whole=True).select("text").unionByName(crossing.select(F.array_join("p.text", "\n").alias("text")))
    return text.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")


def read_quoted_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """All columns as strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    row = F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"escape": '"', "maxCharsPerColumn": "-1"})
    return records(spark, path, header).select(row.alias("r")).select("r.*")
