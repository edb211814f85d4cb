"""Removal of byte strings that occur more than once, over a whole corpus, by suffix arrays.

Every byte covered by a WINDOW-byte string that also starts anywhere else (in this or another
document) is removed; texts are judged as they came.

1. The window's smallest k-gram hash (the leftmost of equals) is its anchor. Consecutive windows
   with one anchor form a slice of the text. Equal windows have equal anchors at equal offsets,
   and every window is in exactly one slice.
2. Anchors that occur once are dropped. Of equal slices (equal in two independent hashes) one
   goes on with its bytes and the number of its copies.
3. The slices of one anchor meet in one task. Slices without copies none of whose windows can
   occur in another slice, as their cores differ, are left out. Over the others, joined to one
   text, a suffix array is built by linear grouping (see suffix_array); its symbols are runs of
   bytes that end with a separator byte. A window is the end of a symbol followed by a suffix;
   windows are equal if these ends are equal and the suffixes lie in one run of the suffix array
   whose common prefixes reach the window's end. A window of more than one slice or of a slice
   with copies is removed.
4. Removed intervals return to all copies of their slices, and so to the documents.

An anchor with more than MOST_SLICES different slices (a passage in a large share of all
documents, with many different texts around it) is split into its single windows, which are
counted in a shuffle, so that no task gathers them.

Memory: texts of any length are read in ranges of RANGE bytes that overlap by WINDOW - 1.

Edge cases: null and empty texts, and texts shorter than WINDOW, lose nothing. Repeated rows
are copies of each other and lose all windows; rows that repeat doc_id and text are worked on once. Bytes are cut without regard to characters; see
``remaining_text``. An empty table gives an empty result; columns other than doc_id and text are
ignored, whatever their names. A null doc_id is carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from starling.llm.common import batch_of, mix, ragged, raw, row_key, saved, steps
from starling.llm.suffix_array import suffix_array

WINDOW, GRAM = 200, 24
#: Windows that one core decides on: their first bytes lie at most so far apart (a third of all offsets of an anchor).
CORE = (WINDOW - GRAM + 1) // 3
#: Different slices of one anchor that one task sorts; anchors with more are counted in a shuffle.
MOST_SLICES = 8192
#: Slices of about so many bytes are sorted together.
TEXT_BYTES = 256 << 10
#: Bytes of text in one numpy step, and of a longer text in one range.
STEP, RANGE = 1 << 20, 2 << 20

# Bytes that end a symbol: rare letters, some marks and digits, one byte in 32 beyond ASCII. Any choice gives the same result; symbols of
# about 20 bytes make short suffix arrays and few windows within one symbol.
_SEPARATES = np.zeros(256, bool)
_SEPARATES[1:128:8] = True
_SEPARATES[ord("a") : ord("z") + 1] = False
_SEPARATES[[ord(c) for c in "bjkqvxz"]] = True
_SEPARATES[128::32] = True
_SEPARATES[0] = True  # closes each slice

_POSITION = np.uint64((1 << 24) - 1)


class Prefixes:
    """Hashes of any substrings of ``data``, from prefix sums of a polynomial modulo 2^64."""

    _POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        with np.errstate(over="ignore"):
            table = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * seed))
            power, self.inverse = self._powers(len(data) + 1, seed)
            self.total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * power[: len(data)], out=self.total[1:])

    @classmethod
    def _powers(cls, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        if seed not in cls._POWERS or len(cls._POWERS[seed][0]) < n:
            base = int(mix(np.array([0x9E3779B97F4A7C15 + seed], np.uint64))[0]) | 1
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                row = np.full(n, b, np.uint64)
                row[0] = 1
                made.append(np.cumprod(row))
            cls._POWERS[seed] = tuple(made)
        return cls._POWERS[seed]

    def hashes(self, starts: np.ndarray, lens: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[starts + lens] - self.total[starts]) * self.inverse[starts] + np.asarray(lens).astype(np.uint64))

    def grams(self, length: int) -> np.ndarray:
        """Hashes, good in their upper bits, of all strings of ``length`` bytes at their starts."""
        with np.errstate(over="ignore"):
            h = (self.total[length:] - self.total[:-length]) * self.inverse[: len(self.total) - length]
            return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def slices(data: np.ndarray, offsets: np.ndarray, prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, first window's start (in data), number of windows, anchor's place and anchor hash of all slices."""
    none = np.zeros(0, np.int64)
    lens = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    if not lens.any():
        return none, none, none, none, none
    if len(data) > int(_POSITION):
        raise ValueError("a range of text is too long")
    grams = prefixes.grams(GRAM)
    n = len(grams)
    # Hash in the upper bits, position in the lower ones: the minimum is the leftmost smallest.
    low = (grams & ~_POSITION) | np.arange(n, dtype=np.uint64)
    width = WINDOW - GRAM + 1
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    starts = ragged(offsets[:-1], lens)
    text = np.repeat(np.arange(len(lens)), lens)
    at = (low[starts] & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    return text[first], starts[first], np.diff(np.r_[first, len(at)]), at[first], grams[at[first]].view(np.int64)


def _ranges(batch: pa.RecordBatch):
    """Bytes, offsets and place of the first byte: a batch of texts at once, or the overlapping ranges of a long one."""
    data, offsets = raw(batch.column("text"))
    if batch.num_rows > 1 or len(data) < RANGE + WINDOW:
        yield data, offsets, 0
        return
    for lo in range(0, len(data) - WINDOW + 1, RANGE):
        part = data[lo : lo + RANGE + WINDOW - 1]
        yield part, np.array([0, len(part)]), lo


def mark(docs: DataFrame) -> DataFrame:
    """rid, los, ahead, n, anchor, content, times: the slices of all texts; the anchor is so many bytes ahead, content is a hash of the slice's bytes.

    Equal slices of one text (as of a line that repeats) share a row with all their places;
    ``times`` is how often the whole text (its rid) is there.
    """

    def run(batches):
        for batch in steps(batches, STEP):
            for data, offsets, base in _ranges(batch):
                text, at, n, place, anchor = slices(data, offsets, Prefixes(data, 0))
                content = Prefixes(data, 1).hashes(at, n + WINDOW - 1).view(np.int64)
                order = np.lexsort((at, content, anchor, text))
                text, at, n, place, anchor, content = (x[order] for x in (text, at, n, place, anchor, content))
                new = np.ones(len(order), bool)
                new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
                head, rows = np.flatnonzero(new), pa.array(text[new])
                places = pa.ListArray.from_arrays(pa.array(np.r_[head, len(order)].astype(np.int32)), pa.array((at - offsets[text] + base).astype(np.int32)))
                yield batch_of(
                    rid=batch.column("rid").take(rows), los=places, ahead=pa.array((place - at)[new], pa.int32()),
                    n=pa.array(n[new], pa.int32()), anchor=pa.array(anchor[new], pa.int64()), content=pa.array(content[new]), times=batch.column("times").take(rows),
                )

    return docs.mapInArrow(run, "rid binary, los array<int>, ahead int, n int, anchor long, content long, times long")


def comparable(data: np.ndarray, at: np.ndarray, n: np.ndarray, ahead: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Of slices at these places with so many windows each and anchors so far ahead: which have copies or share a core with another one.

    Windows that begin k to k + CORE - 1 bytes before their anchor (k a multiple of CORE) have
    WINDOW - CORE + 1 bytes in common; equal windows of different slices have equal such cores.
    """
    alive = copies > 1
    keys, owners = [], []
    prefixes = Prefixes(data, 2)
    for k in range(0, WINDOW - GRAM + 1, CORE):
        has = np.flatnonzero((ahead >= k) & (ahead - n + 1 < k + CORE))
        keys.append(prefixes.hashes(at[has] + ahead[has] - k, WINDOW - CORE + 1) + np.uint64(k))
        owners.append(has)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    alive[owners[times[which] > 1]] = True
    return alive


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths, up to about WINDOW, of the common prefixes of the bytes at a and at b, found eight bytes at a time."""
    padded = np.r_[data, np.zeros(WINDOW + 16, np.uint8)]
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), strides=(1,))
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live):
        x = eight[a[live] + out[live]] ^ eight[b[live] + out[live]]
        same = x == 0
        with np.errstate(over="ignore"):
            out[live] += np.where(same, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
        live = live[same & (out[live] < WINDOW)]
    return out


def repeated_starts(data: np.ndarray, at: np.ndarray, n: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Of slices at these places with so many windows each and so many copies: which windows (slice by slice) occur more than once."""
    starts = ragged(at, n)
    size = len(data)
    ends = np.flatnonzero(_SEPARATES[data])
    first = np.r_[0, ends + 1]
    first = first[first < size]
    symbol_lens = np.diff(np.r_[first, size])
    pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.r_[first, size].astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    values, kinds = pieces.dictionary.to_pylist(), pieces.indices.to_numpy().astype(np.int64)
    rank = np.empty(len(values), np.int64)
    rank[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))
    order = suffix_array(rank[kinds])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))

    common = np.r_[0, _common(data, first[order[:-1]], first[order[1:]])]

    # Symbols in the order of their reversed bytes: those that end alike lie in runs, too.
    backward = [v[::-1] for v in values]
    by_end = sorted(range(len(values)), key=backward.__getitem__)
    end_place = np.empty(len(values), np.int64)
    end_place[by_end] = np.arange(len(values))
    lens = np.array([len(values[k]) for k in by_end])
    at_end = np.cumsum(lens) - lens
    common_end = np.r_[0, np.minimum(_common(np.frombuffer(b"".join(backward[k] for k in by_end), np.uint8), at_end[:-1], at_end[1:]), np.minimum(lens[:-1], lens[1:]))]

    # Each window: the end of its first symbol (numbered by its run) and the suffix after it (by its run).
    symbol = np.searchsorted(first, starts, side="right") - 1
    part = first[symbol] + symbol_lens[symbol] - starts
    key = np.empty(len(starts), np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(WINDOW + 1))
    for length in range(1, WINDOW):
        here = order[edges[length] : edges[length + 1]]
        if len(here):
            ends, runs = np.cumsum(common_end < length), np.cumsum(common < WINDOW - length)
            key[here] = (ends[end_place[kinds[symbol[here]]]] * WINDOW + length) * len(first) + runs[place[symbol[here] + 1]] - 1
    known: dict[bytes, int] = {}
    whole = data.tobytes()
    for i in order[edges[WINDOW] :].tolist():  # within one symbol
        key[i] = -1 - known.setdefault(whole[starts[i] : starts[i] + WINDOW], len(known))
    _, which = np.unique(key, return_inverse=True)
    return np.bincount(which, np.repeat(copies, n))[which] > 1 if len(which) else np.zeros(0, bool)


def _intervals(flags: np.ndarray, slice_of: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, first byte within it, bytes) of the runs of flagged windows."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on, on
    new = np.r_[True, (np.diff(on) != 1) | (np.diff(slice_of[on]) != 0)]
    head, tail = on[new], on[np.r_[new[1:], True]]
    return slice_of[head], offset[head], tail - head + WINDOW


def sorted_intervals(rows: DataFrame) -> DataFrame:
    """Removed intervals (anchor, content, n, ahead, lo, size; lo within the slice) of slices (anchor, content, copies, n, ahead, bytes), all of an anchor in one partition, in order."""

    def joined(held):
        lens = np.array([len(r[-1]) for r in held], np.int64)
        return np.frombuffer(b"\0".join(r[-1] for r in held) + b"\0", np.uint8), np.cumsum(lens + 1) - lens - 1

    def solve(held):
        copies, n, ahead = (np.array([r[k] for r in held], np.int64) for k in (2, 3, 4))
        alive = comparable(*joined(held), n, ahead, copies)
        held, n, copies = [r for r, x in zip(held, alive.tolist(), strict=True) if x], n[alive], copies[alive]
        data, at = joined(held) if held else (np.zeros(0, np.uint8), n)
        flags = repeated_starts(data, at, n, copies) if held else np.zeros(0, bool)
        s, offset, size = _intervals(flags, np.repeat(np.arange(len(held)), n), ragged(np.zeros(len(n), np.int64), n))
        return batch_of(
            anchor=pa.array([held[i][0] for i in s.tolist()], pa.int64()), content=pa.array([held[i][1] for i in s.tolist()], pa.int64()),
            n=pa.array([held[i][3] for i in s.tolist()], pa.int32()), ahead=pa.array([held[i][4] for i in s.tolist()], pa.int32()), lo=pa.array(offset, pa.int32()), size=pa.array(size, pa.int32()),
        )

    def run(batches):
        held, weight, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and weight >= TEXT_BYTES:
                    yield solve(held)
                    held, weight = [], 0
                held.append(row)
                weight += len(row[-1])
                last = row[0]
        if held:
            yield solve(held)

    return rows.select("anchor", "content", "copies", "n", "ahead", "bytes").mapInArrow(run, "anchor long, content long, n int, ahead int, lo int, size int")


def counted_intervals(rows: DataFrame) -> DataFrame:
    """As sorted_intervals, window by window, for anchors whose slices no task can hold."""

    def run(batches):
        for batch in steps(batches, 256 << 10, column="bytes"):
            data, offsets = raw(batch.column("bytes").cast(pa.large_binary()).view(pa.large_string()))
            n = batch.column("n").to_numpy()
            starts, owner = ragged(offsets[:-1], n), pa.array(np.repeat(np.arange(len(n)), n))
            yield batch_of(
                **{c: batch.column(c).take(owner) for c in ("anchor", "content", "copies", "n", "ahead")}, lo=pa.array(ragged(np.zeros(len(n), np.int64), n), pa.int32()),
                h1=pa.array(Prefixes(data, 3).hashes(starts, WINDOW).view(np.int64)), h2=pa.array(Prefixes(data, 4).hashes(starts, WINDOW).view(np.int64)),
            )

    windows = rows.select("anchor", "content", "copies", "n", "ahead", "bytes").mapInArrow(run, "anchor long, content long, copies long, n int, ahead int, lo int, h1 long, h2 long")
    twice = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("times")).where("times > 1").select("h1", "h2", F.xxhash64("h1", "h2").alias("key"))
    found = windows.withColumn("key", F.xxhash64("h1", "h2")).join(twice, ["h1", "h2", "key"], "left_semi")
    return found.select("anchor", "content", "n", "ahead", "lo", F.lit(WINDOW).alias("size"))


#: Slices are told apart by their anchor, a hash of their bytes, their windows and the anchor's place.
SLICE = ["anchor", "content", "n", "ahead"]


def once(docs: DataFrame) -> DataFrame:
    """rid, text, times: one row for each rid. Only texts whose rid repeats cross a shuffle, after tasks have dropped their own repeats."""
    repeats = docs.groupBy("rid").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    repeats = saved(repeats, "repeats")
    if repeats.isEmpty():
        return docs.select("rid", "text", F.lit(1).cast("long").alias("times"))
    single = docs.join(repeats.select("rid"), "rid", "left_anti").select("rid", "text", F.lit(1).cast("long").alias("times"))
    texts = docs.join(repeats.select("rid"), "rid", "left_semi").groupBy("rid").agg(F.first("text").alias("text"))
    return single.unionByName(saved(texts.join(repeats, "rid").select("rid", "text", "times"), "repeated-texts"))


def removed_intervals(docs: DataFrame) -> DataFrame:
    """rid, lo, size of byte runs to remove (they may overlap), once for each rid; docs needs rid and text."""
    docs = once(docs)
    marks = saved(mark(docs), "slices")
    # A second, derived column in a join's key makes it shuffle both sides, so that Spark may split hot keys.
    shared = marks.groupBy("anchor").agg(F.sum(F.size("los") * F.col("times")).alias("all")).where("all > 1").select("anchor", F.xxhash64("anchor").alias("key"))
    rows = saved(marks.withColumn("key", F.xxhash64("anchor")).join(shared, ["anchor", "key"], "left_semi").drop("key"), "shared-slices")
    per_slice = rows.groupBy(*SLICE).agg(F.sum(F.size("los") * F.col("times")).alias("copies"), F.min(F.struct("rid", F.col("los")[0].alias("lo"))).alias("one"))
    per_slice = saved(per_slice, "distinct-slices")
    kinds = per_slice.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("copies").alias("most")).where("kinds > 1 OR most > 1").select("anchor", F.xxhash64("anchor").alias("key"), "kinds")
    wanted = per_slice.withColumn("key", F.xxhash64("anchor")).join(kinds, ["anchor", "key"]).select("one.*", *SLICE, "copies", "kinds")
    by_doc = wanted.groupBy("rid").agg(F.collect_list(F.struct("lo", "n", "ahead", "anchor", "content", "copies", "kinds")).alias("slices"))  # as many as one text has

    def cut(batches):
        for batch in steps(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            flat = [(i, s) for i, row in enumerate(batch.column("slices").to_pylist()) for s in row]
            yield batch_of(
                **{c: pa.array([s[c] for _, s in flat], t) for c, t in (("anchor", pa.int64()), ("content", pa.int64()), ("copies", pa.int64()), ("kinds", pa.int64()), ("n", pa.int32()), ("ahead", pa.int32()))},
                bytes=pa.array([texts[i][s["lo"] : s["lo"] + s["n"] + WINDOW - 1] for i, s in flat], pa.binary()),
            )

    schema = "anchor long, content long, copies long, kinds long, n int, ahead int, bytes binary"
    texts = saved(docs.drop("times").join(by_doc, "rid").mapInArrow(cut, schema), "slice-bytes")
    small = texts.where(F.col("kinds") <= MOST_SLICES).repartition("anchor").sortWithinPartitions("anchor")
    found = saved(sorted_intervals(small).unionByName(counted_intervals(texts.where(F.col("kinds") > MOST_SLICES))), "slice-intervals")
    found = found.withColumnRenamed("lo", "within")
    # Places (in ascending order) that overlap make one run, so that a text of one repeated letter doesn't give a run for each of its bytes.
    los, size = F.col("los"), F.col("size")
    first = F.filter(los, lambda x, i: F.coalesce(x - F.get(los, i - 1) > size, F.lit(True)))
    last = F.filter(los, lambda x, i: F.coalesce(F.get(los, i + 1) - x > size, F.lit(True)))
    # A second key here as well: one slice may be in a large share of all texts.
    runs = rows.withColumn("key", F.xxhash64(*SLICE)).join(found.withColumn("key", F.xxhash64(*SLICE)), [*SLICE, "key"]).select("rid", "within", "size", F.explode(F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("run"))
    return runs.select("rid", (F.col("run.a") + F.col("within")).alias("lo"), (F.col("run.b") - F.col("run.a") + F.col("size")).alias("size"))


def _merged(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of a batch's texts; row, start and end (in the bytes) of the maximal runs that its spans cover."""
    data, offsets = raw(batch.column("text"))
    spans = batch.column("spans")
    per_row = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = spans.flatten()
    row = np.repeat(np.arange(len(per_row)), per_row)
    lo = offsets[row] + flat.field("lo").to_numpy(zero_copy_only=False).astype(np.int64)
    hi = lo + flat.field("size").to_numpy(zero_copy_only=False)
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])
    return data, offsets, row[new], lo[new], hi[np.r_[new[1:], True]] if len(row) else hi


def _kept(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """What is left of ``data`` without the runs."""
    view = memoryview(np.ascontiguousarray(data))
    edges = zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)
    return b"".join(view[a:b] for a, b in edges)


def _with_spans(docs: DataFrame, others: list[str]) -> DataFrame:
    """rid, row (a struct of the other columns, so that no name can clash), text and the spans to remove."""
    source = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text")
    found = saved(removed_intervals(source.select("rid", "text")), "removed")
    spans = found.groupBy("rid").agg(F.collect_list(F.struct("lo", "size")).alias("spans")).withColumn("key", F.xxhash64("rid"))  # of one text
    return source.withColumn("key", F.xxhash64("rid")).join(spans, ["rid", "key"], "left").drop("key")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document."""
    kind = docs.schema["doc_id"].dataType

    def apply(batches):
        for batch in steps(batches):
            data, offsets, row, begin, end = _merged(batch)
            lens, rows = np.diff(offsets), batch.num_rows
            removed = np.bincount(row, end - begin, rows).astype(np.int64)
            kept = np.zeros(rows + 1, np.int64)
            np.cumsum(lens - removed, out=kept[1:])
            yield batch_of(
                doc_id=batch.column("row").field("doc_id"), n_bytes=pa.array(lens, pa.int64()), n_removed=pa.array(removed), n_spans=pa.array(np.bincount(row, minlength=rows), pa.int64()),
                kept=pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(kept), pa.py_buffer(_kept(data, begin, end))]).cast(pa.binary()),
            )

    rows = _with_spans(docs, ["doc_id"]).select("row", "text", "spans")
    return rows.mapInArrow(apply, f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def remaining_text(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns and only the remaining text; characters that a cut splits go too."""
    names, types = docs.columns, [to_arrow_type(f.dataType) for f in docs.schema]

    def apply(batches):
        for batch in steps(batches):
            data, offsets, row, begin, end = _merged(batch)
            left = np.r_[0, np.cumsum(np.diff(offsets) - np.bincount(row, end - begin, batch.num_rows).astype(np.int64))].tolist()
            kept = _kept(data, begin, end)
            texts = pa.array([kept[a:b].decode(errors="ignore") for a, b in zip(left[:-1], left[1:], strict=True)], pa.string(), mask=batch.column("text").is_null().to_numpy(zero_copy_only=False))
            held = batch.column("row")
            yield pa.RecordBatch.from_arrays([texts if c == "text" else held.field(c).cast(t) for c, t in zip(names, types, strict=True)], names=names)

    return _with_spans(docs, [c for c in names if c != "text"]).select("row", "text", "spans").mapInArrow(apply, docs.schema)
