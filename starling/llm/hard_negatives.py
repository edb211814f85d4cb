"""Hard negatives of anchor vectors, with angular triangle filtering before exact integer scores.

Components become the integers floor(SCALE * x); a score is the integer inner product with the
anchor, higher scores come first, ties by smaller vec_id. An anchor's positives are its first rows
of the same label; a positive's negatives are the first rows of another label whose score is
between ``low`` and 100 percent of the positive's.

1. REFERENCES rows, those with the smallest hashes of their ids, give reference directions. Each
   row is stored with its norm, its angles to all references, and the nearest reference as cell.
2. Rows are dealt to stripes of bounded size (of a label for the positives, of a cell for the
   negatives) and stand there by their angle to their cell's reference. Anchors, in blocks of
   bounded size, go to the stripes of their label, or to the cells that can hold a score in one of
   their ranges. A task reads one block and then one stripe, WINDOW rows at a time.
3. A window of rows has a range of angles to each reference. By the triangle inequality, the angle
   of an anchor and a row is at least the distance of their angles to a reference, and at most
   their sum (and 2 pi less the sum): over all references a range of cosines, times the norms a
   range of scores, which SLACK and SLOP widen beyond any rounding. Only anchors whose wanted range
   overlaps a window's get integer scores with it. The wanted range shrinks as rows are found.
4. The best rows of each anchor (and positive) of all stripes are merged by rank.

Scores are sums of products of integers in float64, exact below 2^53; vectors whose norms could
exceed that are scored in int64, and beyond 2^63 an error says so.

Edge cases: rows without label or vector, or with a null or non-finite component, take no part, and
rows without vec_id neither. Rows that are equal in vec_id, label and integers count once; others
that share a vec_id are rows of their own, but rows with the anchor's vec_id are no positives or
negatives of it. Shorter vectors count as filled up with zeros. Vectors of norm zero score zero.
Anchors without positives, and positives without negatives, give no rows. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from starling.llm.common import row_key, saved

SCALE = 256
REFERENCES = 16
#: Rows of a stripe and anchors of a block (about), and rows of a window.
STRIPE, BLOCK, WINDOW = 1 << 12, 1 << 12, 256
#: What angles (radians, from arccos of rounded cosines) and scores (of the norms' product) may be off by, at most.
SLACK, SLOP = 1e-6, 1e-9
#: Found rows that wait for being ranked.
POOL = 1 << 18


def integers(vectors: DataFrame, label: Column) -> DataFrame:
    """key, vec_id, label and q (array of long) of the rows that take part, equal rows once."""
    taken = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    rows = vectors.where(taken & F.col("vec_id").isNotNull()).select("vec_id", label.alias("label"), whole.alias("q")).where("label IS NOT NULL")
    return rows.withColumn("key", row_key(F.col("vec_id"), F.col("label"), F.col("q"))).dropDuplicates(["key"])


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists of a column as rows of ``width`` values, filled up with zeros."""
    lens = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lens), width), np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _directions(rows: DataFrame, width: int) -> np.ndarray:
    """Unit vectors along REFERENCES rows, those with the smallest hashes; one axis if there is none."""
    picked = rows.where(F.exists("q", lambda x: x != 0)).orderBy(F.xxhash64("vec_id", F.lit(13)), "key").limit(REFERENCES).select("q").collect()
    found = np.zeros((max(len(picked), 1), width))
    found[0, :1] = 1
    for i, r in enumerate(picked):
        found[i, : len(r.q)] = r.q
        found[i, len(r.q) :] = 0
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def indexed(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows with norm, angles (to each reference) and cell; and the number of components."""
    width = rows.agg(F.max(F.size("q"))).first()[0] or 1
    toward = _directions(rows, width)

    def run(batches):
        for batch in batches:
            q = _matrix(batch.column("q"), width).astype(np.float64)
            norm = np.linalg.norm(q, axis=1)
            angle = np.arccos(np.clip((q / np.maximum(norm, 1)[:, None]) @ toward.T, -1, 1))
            cell = angle.argmin(axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * angle.shape[1]), pa.array(angle.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "vec_id", "label", "q")], pa.array(norm), lists, pa.array(cell), pa.array(angle[np.arange(len(q)), cell])], names=["key", "vec_id", "label", "q", "norm", "angles", "cell", "turn"])

    kind = rows.schema["label"].dataType.simpleString()
    return saved(rows.select("key", "vec_id", "label", "q").mapInArrow(run, f"key binary, vec_id long, label {kind}, q array<long>, norm double, angles array<double>, cell int, turn double"), "vectors"), width


def score_bounds(anchor_angle: np.ndarray, anchor_norm: np.ndarray, least: np.ndarray, most: np.ndarray, short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, window) bounds of the score of an anchor and any row with angles in [least, most] to the references (window, reference) and a norm in [short, long]."""
    apart, wide = np.zeros((len(anchor_norm), len(least))), np.full((len(anchor_norm), len(least)), np.pi)
    for k in range(least.shape[1]):
        a = anchor_angle[:, k, None]
        np.maximum(apart, np.maximum(a - most[:, k], least[:, k] - a), out=apart)
        np.minimum(wide, np.minimum(a + most[:, k], 2 * np.pi - a - least[:, k]), out=wide)
    top, bottom = np.cos(np.maximum(apart - SLACK, 0)), np.cos(np.minimum(wide + SLACK, np.pi))
    slop = SLOP * anchor_norm[:, None] * long + 1e-6
    high = anchor_norm[:, None] * np.where(top > 0, top * long, top * short) + slop
    low = anchor_norm[:, None] * np.where(bottom > 0, bottom * short, bottom * long) - slop
    return low, high


class Asked:
    """A block of anchors with the ranges of scores that they want: one for each anchor and slot, [floor, ceil]."""

    def __init__(self, q: np.ndarray, norm: np.ndarray, angles: np.ndarray, label: np.ndarray, ident: np.ndarray, floor: np.ndarray, ceil: np.ndarray, same: bool, most: int):
        self.q, self.norm, self.angles, self.label, self.ident = q, norm, angles, label, ident
        self.floor, self.ceil, self.same, self.most = floor, ceil, same, most
        self.pool: list[tuple[np.ndarray, ...]] = []
        self.waiting, self.scored, self.seen = 0, 0, 0

    def offer(self, q: np.ndarray, norm: np.ndarray, angles: np.ndarray, label: np.ndarray, ident: np.ndarray) -> None:
        """Scores a window of rows with the anchors whose ranges it may meet."""
        largest = float(self.norm.max()) * float(norm.max())
        if largest >= 1 << 63:
            raise OverflowError("scores of these vectors may not fit in 64 bits")
        low, high = score_bounds(self.angles, self.norm, angles.min(axis=0)[None], angles.max(axis=0)[None], norm.min(keepdims=True), norm.max(keepdims=True))
        who = np.flatnonzero(((high >= self.floor) & (low <= self.ceil)).any(axis=1))
        self.seen += len(self.norm) * len(norm)
        self.scored += len(who) * len(norm)
        if not len(who):
            return
        if largest < 1 << 52:
            score = np.rint(self.q[who].astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
        else:
            score = self.q[who] @ q.T
        fits = (self.label[who, None] == label) == self.same
        fits &= self.ident[who, None] != ident
        for slot in range(self.floor.shape[1]):
            a, b = np.nonzero(fits & (score >= self.floor[who, slot, None]) & (score <= self.ceil[who, slot, None]))
            if len(a):
                self.pool.append((who[a], np.full(len(a), slot), score[a, b], ident[b]))
                self.waiting += len(a)
        if self.waiting > POOL:
            self.best()

    def best(self) -> tuple[np.ndarray, ...]:
        """anchor, slot, score, vec_id of the best rows so far; raises the ranges' floors to what still may enter."""
        if not self.pool:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        who, slot, score, ident = (np.concatenate(x) for x in zip(*self.pool, strict=True))
        order = np.lexsort((ident, -score, slot, who))
        who, slot, score, ident = who[order], slot[order], score[order], ident[order]
        start = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (slot[1:] != slot[:-1])])
        rank = np.arange(len(who)) - np.repeat(start, np.diff(np.r_[start, len(who)]))
        keep, full = rank < self.most, rank == self.most - 1
        self.floor[who[full], slot[full]] = np.maximum(self.floor[who[full], slot[full]], score[full])
        self.pool = [(who[keep], slot[keep], score[keep], ident[keep])]
        self.waiting = len(self.pool[0][0])
        return self.pool[0]


def _searched(rows: DataFrame, by: list[str], width: int, slots: int, same: bool, most: int) -> DataFrame:
    """anchor (key), slot, score, vec_id of the best rows within each group. rows: the group's columns, ``asks`` (1 for anchors), ``floors`` and ``ceils`` (null in other rows) and those of indexed()."""
    span = (1 << 63) - 1

    def run(batches):
        asked, key, parts, keys = None, None, [], []

        def done():
            who, slot, score, ident = asked.best()
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in who.tolist()], pa.binary()), pa.array(slot), pa.array(score), pa.array(ident)], names=["anchor", "slot", "score", "vec_id"])

        def held():
            floor, ceil = (np.concatenate([p[k] for p in parts]) for k in (5, 6))
            return Asked(*(np.concatenate([p[k] for p in parts]) for k in range(5)), floor, ceil, same, most)

        for batch in batches:
            group = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            asks = batch.column("asks").to_numpy()
            q, norm, label, ident = _matrix(batch.column("q"), width), batch.column("norm").to_numpy(), np.array(batch.column("label").to_pylist()), batch.column("vec_id").to_numpy()
            angles = batch.column("angles").flatten().to_numpy().reshape(len(norm), -1) if len(norm) else np.zeros((0, 1))
            ident_key = batch.column("key").to_pylist()
            edges = [0, *[i for i in range(1, len(group)) if group[i] != group[i - 1] or asks[i] != asks[i - 1]], len(group)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if group[lo] != key:
                    if asked is not None:
                        yield done()
                    asked, parts, keys, key = None, [], [], group[lo]
                if asks[lo]:
                    cut = slice(lo, hi)
                    parts.append((q[cut], norm[cut], angles[cut], label[cut], ident[cut], _limits(batch.column("floors")[lo:hi], slots, span), _limits(batch.column("ceils")[lo:hi], slots, -span)))
                    keys += ident_key[cut]
                elif parts:
                    asked = asked or held()
                    for at in range(lo, hi, WINDOW):
                        cut = slice(at, min(at + WINDOW, hi))
                        asked.offer(q[cut], norm[cut], angles[cut], label[cut], ident[cut])
        if asked is not None:
            yield done()

    laid = rows.repartition(*by).sortWithinPartitions(*by, F.col("asks").desc(), "cell", "turn")
    return laid.mapInArrow(run, "anchor binary, slot long, score long, vec_id long")


def _limits(column: pa.ListArray, slots: int, fill: int) -> np.ndarray:
    """Lists of limits as rows; ``fill`` in slots that an anchor has not (as a floor and a ceiling, a range without scores)."""
    out = np.full((len(column), slots), fill, np.int64)
    for i, own in enumerate(column.to_pylist()):
        if own is not None:
            out[i, : len(own)] = own
    return out


def _dealt(group: list[str], rows: DataFrame, asks: DataFrame, parts: Column, blocks: Column, slots: str) -> DataFrame:
    """Rows in their part, for each block of anchors; anchors in their block, for each part. ``slots``: type of floors and ceils."""
    held = rows.withColumns({"asks": F.lit(0), "floors": F.lit(None).cast(slots), "ceils": F.lit(None).cast(slots), "part": F.pmod(F.xxhash64("key"), parts).cast("int"), "block": F.explode(F.sequence(F.lit(0), blocks - 1))})
    asking = asks.withColumns({"asks": F.lit(1), "block": F.pmod(F.xxhash64("key", F.lit(1)), blocks).cast("int"), "part": F.explode(F.sequence(F.lit(0), parts - 1))})
    columns = [*group, "part", "block", "asks", "floors", "ceils", *[c for c in ("key", "vec_id", "label", "q", "norm", "angles", "cell", "turn") if c not in group]]
    return held.select(columns).unionByName(asking.select(columns))


def _first(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` rows of highest score (ties: smaller vec_id) with their rank from 1."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= most)


def positives(index: DataFrame, width: int, is_anchor: Column, most: int, stripe: int = STRIPE, block: int = BLOCK) -> DataFrame:
    """anchor (key), rank, vec_id, score of the first ``most`` rows of each anchor's label."""
    sizes = index.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / stripe).cast("int").alias("parts"), F.ceil(F.sum(is_anchor.cast("int")) / block).cast("int").alias("blocks")).where("blocks > 0")
    sized = index.withColumn("salt", F.xxhash64("label")).join(sizes.withColumn("salt", F.xxhash64("label")), ["label", "salt"]).drop("salt")
    limit = [F.array(F.lit(v).cast("long")) for v in (-(1 << 63) + 1, (1 << 63) - 1)]
    asks = sized.where(is_anchor).withColumns({"floors": limit[0], "ceils": limit[1]})
    laid = _dealt(["label"], sized, asks, F.col("parts"), F.col("blocks"), "array<long>")
    return saved(_first(_searched(laid, ["label", "part", "block"], width, 1, True, most).drop("slot"), ["anchor"], most), "positives")


def _routed(asks: DataFrame, bounds: list[np.ndarray], slots: int) -> DataFrame:
    """``asks`` with the cells that may hold a score in one of the anchor's ranges."""
    span = (1 << 63) - 1

    def run(batches):
        for batch in batches:
            angles = batch.column("angles").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, bounds[0].shape[1]))
            floor, ceil = _limits(batch.column("floors"), slots, span), _limits(batch.column("ceils"), slots, -span)
            low, high = score_bounds(angles, batch.column("norm").to_numpy(), *bounds)
            meets = np.zeros(low.shape, bool)
            for k in range(slots):
                meets |= (high >= floor[:, k, None]) & (low <= ceil[:, k, None])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(meets.sum(axis=1))].astype(np.int32)), pa.array(np.nonzero(meets)[1].astype(np.int32)))
            yield batch.append_column("places", lists)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asks.schema.fields)
    return asks.mapInArrow(run, f"{kinds}, places array<int>")


def hard_negatives(vectors: DataFrame, label: Column, is_anchor: Column, positives_each: int = 5, negatives_each: int = 5, low: int = 80, stripe: int = STRIPE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, embedding and what ``label`` and ``is_anchor`` need (``is_anchor``: of vec_id alone)."""
    index, width = indexed(integers(vectors, label))
    found = positives(index, width, is_anchor, positives_each, stripe, block)

    least = f"CASE WHEN x.score >= 0 THEN ({low} * x.score + 99) DIV 100 ELSE ({low} * x.score) DIV 100 END"
    wanted = found.groupBy(F.col("anchor").alias("key")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("own"))
    wanted = wanted.select("key", F.expr(f"transform(own, x -> {least})").alias("floors"), F.expr("transform(own, x -> x.score)").alias("ceils"))
    asks = index.where(is_anchor).join(wanted, "key")

    angle = [F.col("angles")[k] for k in range(REFERENCES)]
    cells = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("short"), F.max("norm").alias("long"), F.array(*map(F.min, angle)).alias("least"), F.array(*map(F.max, angle)).alias("most")).orderBy("cell").collect()  # one row for each reference at most
    if not cells:
        return _named(found, index, found.withColumn("slot", F.lit(0).cast("long")))
    used = [k for k in range(REFERENCES) if cells[0].least[k] is not None]
    bounds = [np.array([[c[name][k] for k in used] for c in cells]) for name in ("least", "most")] + [np.array([c[name] for c in cells]) for name in ("short", "long")]
    asks = _routed(asks, bounds, positives_each).withColumn("at", F.explode("places")).withColumn("cell", F.array(*[F.lit(c.cell) for c in cells])[F.col("at")]).drop("places", "at")
    asks = saved(asks, "asks")
    many = {r.cell: r["count"] for r in asks.groupBy("cell").count().collect()}

    def per_cell(numbers: dict[int, int]) -> Column:
        return F.coalesce(F.create_map(*[F.lit(int(x)) for pair in numbers.items() for x in pair])[F.col("cell")], F.lit(0))

    parts, blocks = per_cell({c.cell: -(-c.n // stripe) for c in cells}), per_cell({c.cell: -(-many.get(c.cell, 0) // block) for c in cells})
    laid = _dealt(["cell"], index.where(blocks > 0), asks, parts, blocks, "array<long>")
    hard = _first(_searched(laid, ["cell", "part", "block"], width, positives_each, False, negatives_each), ["anchor", "slot"], negatives_each)
    return _named(found, index.where(is_anchor), hard)


def _named(found: DataFrame, anchors: DataFrame, hard: DataFrame) -> DataFrame:
    names = anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = found.select("anchor", (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "anchor")
    out = hard.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
