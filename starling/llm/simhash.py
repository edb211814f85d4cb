"""Near-duplicates by SimHash fingerprints that differ in few bits, found with BK-trees.

1. Every text gets a 64-bit fingerprint: a bit is 1 if it is set in more than half of the hashes
   (XXH64, seed SEED) of the text's word shingles, repeats included. Equal fingerprints form a
   class; classes are compared from here on, never copies.
2. Fingerprints within ``radius`` bits of each other agree in one of radius + 1 blocks of bits, so
   each goes to one shard for each block. A shard of more than SHARD fingerprints is dealt to the
   shards of a second cut, of its other bits; what is still larger is cut in parts, and every
   fingerprint of the shard asks the parts from its own to half a turn further, so that any two
   parts meet.
3. The fingerprints of a shard (or part) become a BK-tree: a node's children are keyed by their
   Hamming distance to it. The tree goes to all that ask the shard, who follow from a node at
   distance d only the edges from d - radius to d + radius. A task builds and searches the trees of
   many shards at once, level by level. It keeps what is connected, not the pairs, and gives stars.
4. Components of the stars give each class, and so each document, its component.

Trees reach those who ask through the shuffle that makes the shards, not as broadcast variables:
all trees together hold every fingerprint, which must not pass through the driver.

Edge cases: null, empty and wordless texts have fingerprint zero, which links like any other. With
fewer words than a shingle has, the whole sequence is the one shingle. Rows without doc_id have a
fingerprint and connect others, but are never the id of a component: a component of such rows alone
has none. Rows that share a doc_id are documents of their own. An empty table gives an empty
result; columns other than doc_id and text are ignored. A long text is read in parts of STEP bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from starling.llm.common import batch_of, ragged, raw, saved, steps
from starling.llm.graph import components
from starling.llm.words import ascii_lower

SEED = 42
#: Bytes of text that one step hashes.
STEP = 1 << 20
#: Fingerprints of one BK-tree at most, and about as many of all trees that a task holds at once.
SHARD, HELD = 1 << 13, 1 << 15
#: Pairs of a fingerprint and a node that are looked at in one step.
PAIRS = 1 << 20
_LANES = np.uint64(0x0101010101010101)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _spaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with one space after each word and no other white space; where each word starts and ends in them. ``data`` ends with white space."""
    gap = _SPACE[data]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    out = np.where(gap, np.uint8(32), data)[keep]
    ends = np.flatnonzero(gap[keep])
    return out, np.r_[0, ends[:-1] + 1] if len(ends) else ends, ends


def _hashes(out: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    data = out.tobytes()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(data.__getitem__, map(slice, starts.tolist(), ends.tolist())), repeat(SEED)), np.uint64, len(starts))


def bit_counts(hashes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """(run, bit) how many of a run's hashes have the bit; ``lens`` (each above 0) are the lengths of consecutive runs."""
    pieces = -(-lens // 255)  # eight counts fit in the bytes of a word
    first = np.cumsum(pieces) - pieces
    at = np.repeat(np.cumsum(lens) - lens, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    counts = np.zeros((len(lens), 8, 8), np.int64)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, at)
        counts[:, :, bit] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return counts.reshape(-1, 64)


def _packed(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _of_batch(texts: pa.Array, words: int) -> np.ndarray:
    data, offsets = raw(ascii_lower(texts))
    lens = np.diff(offsets)
    apart = np.full(len(data) + len(lens), 32, np.uint8)  # each text ends with a space
    apart[ragged(offsets[:-1] + np.arange(len(lens)), lens)] = data
    out, starts, ends = _spaced(apart)
    word_end = np.zeros(len(apart), bool)
    word_end[1:] = _SPACE[apart[1:]] & ~_SPACE[apart[:-1]]
    n = np.diff(np.r_[0, np.cumsum(word_end)[offsets[1:] + np.arange(len(lens))]]) if len(lens) else lens
    first = np.cumsum(n) - n
    shingles = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = ragged(first, shingles)
    last = at + np.repeat(np.minimum(n, words), shingles) - 1
    result, has = np.zeros(len(lens), np.uint64), shingles > 0
    if has.any():
        result[has] = _packed(bit_counts(_hashes(out, starts[at], ends[last]), shingles[has]), shingles[has])
    return result


def _of_long(texts: pa.Array, words: int) -> np.ndarray:
    """As _of_batch() for one long text, whose words are taken STEP bytes at a time."""
    data, _ = raw(ascii_lower(texts))
    counts, total, left, at = np.zeros(64, np.int64), 0, np.zeros(0, np.uint8), 0
    while at < len(data):
        to = at + STEP
        while to < len(data) and not (cut := np.flatnonzero(_SPACE[data[to : to + STEP]])).size:
            to += STEP
        to = to + int(cut[0]) if to < len(data) else len(data)
        out, starts, ends = _spaced(np.concatenate([left, data[at:to], np.array([32], np.uint8)]))
        at = to
        if len(starts) >= words:
            hashes = _hashes(out, starts[: len(starts) - words + 1], ends[words - 1 :])
            counts, total = counts + bit_counts(hashes, np.array([len(hashes)]))[0], total + len(hashes)
            out = out[starts[len(starts) - words + 1] :] if words > 1 else out[:0]
        left = out
    if not total:
        return _of_batch(pa.array([left.tobytes().decode()], pa.large_string()), words)
    return _packed(counts[None], np.array([total]))


def fingerprints_of(texts: pa.Array, words: int) -> np.ndarray:
    return _of_long(texts, words) if len(texts) == 1 and len(raw(texts)[0]) > STEP else _of_batch(texts, words)


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id and fingerprint (a long with its 64 bits) of each row."""

    def run(batches):
        for batch in steps(batches, STEP):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(batch.column("text"), words).view(np.int64))], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint long")


class BKTrees:
    """BK-trees of several sets at once; ``tree`` (ascending) tells the set of each fingerprint, and sets repeat none."""

    def __init__(self, prints: np.ndarray, tree: np.ndarray):
        n = len(prints)
        self.prints, self.roots = prints, np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if n else np.zeros(0, np.int64)
        self.tree = tree[self.roots]
        sizes = np.diff(np.r_[self.roots, n])
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        waiting = np.delete(np.arange(n), self.roots)
        at = np.repeat(self.roots, sizes)[waiting]
        while len(waiting):
            distance = np.bitwise_count(prints[waiting] ^ prints[at]).astype(np.int64)
            order = np.argsort(at * 65 + distance, kind="stable")
            waiting, at, distance = waiting[order], at[order], distance[order]
            first = np.r_[True, (at[1:] != at[:-1]) | (distance[1:] != distance[:-1])]
            child = waiting[first]  # the first to come along an edge is its node, the others go on below it
            parent[child], edge[child] = at[first], distance[first]
            below = child[np.cumsum(first) - 1]
            waiting, at = waiting[~first], below[~first]
        inner = np.flatnonzero(parent >= 0)
        self.children = inner[np.argsort(parent[inner] * 66 + edge[inner], kind="stable")]
        #: At node * 66 + d: how many children stand before the node's first one at distance d or more.
        self.before = np.r_[0, np.cumsum(np.bincount(parent[inner] * 66 + edge[inner], minlength=66 * n))]

    def within(self, asking: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index of an asking fingerprint, node of its tree) that differ in ``radius`` bits at most."""
        stack = [(np.arange(len(asking)), self.roots[np.searchsorted(self.tree, tree)])]
        while stack:
            who, node = stack.pop()
            if len(who) > PAIRS:
                stack += [(who[i : i + PAIRS], node[i : i + PAIRS]) for i in range(0, len(who), PAIRS)]
                continue
            distance = np.bitwise_count(asking[who] ^ self.prints[node]).astype(np.int64)
            near = distance <= radius
            if near.any():
                yield who[near], node[near]
            lo = self.before[node * 66 + np.maximum(distance - radius, 0)]
            hi = self.before[node * 66 + np.minimum(distance + radius, 64) + 1]
            more = hi - lo
            if more.any():
                stack.append((np.repeat(who, more), self.children[ragged(lo, more)]))


def connect(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives items that pairs connect the smallest of their labels; labels[i] is an item of i's group and the group's own label."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """Stars (src, dst) of the fingerprints that chains within each (shard, part) connect. rows: shard, part, asks, fingerprint; those that ask only have asks = 1."""

    def stars(held, asking):
        """held, asking: lists of (tree, fingerprints)."""
        tree = np.concatenate([np.full(len(p), t) for t, p in held])
        prints = np.concatenate([p for _, p in held])
        trees = BKTrees(prints, tree)
        others = np.concatenate([p for _, p in asking]) if asking else prints[:0]
        everyone = np.concatenate([prints, others])
        labels = np.arange(len(everyone))
        for who, node in trees.within(everyone, np.concatenate([tree, *[np.full(len(p), t) for t, p in asking]]), radius):
            connect(labels, who, node)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return batch_of(src=pa.array(everyone[moved].view(np.int64)), dst=pa.array(everyone[labels[moved]].view(np.int64)))

    def run(batches):
        held, asking, size, key, last, trees = [], [], 0, None, None, 0
        for batch in batches:
            shard, part, asks = (batch.column(c).to_numpy() for c in ("shard", "part", "asks"))
            prints = batch.column("fingerprint").to_numpy().view(np.uint64)
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip(np.r_[0, edges].tolist(), np.r_[edges, len(shard)].tolist(), strict=True):
                now = (int(shard[lo]), int(part[lo]))
                if now != key:
                    if size >= HELD:
                        yield stars(held, asking)
                        held, asking, size = [], [], 0
                    key, trees, last = now, trees + 1, []
                if asks[lo]:
                    if not last:  # a part without fingerprints of its own
                        continue
                    asking.append((trees, prints[lo:hi].copy()))
                    size += hi - lo
                    if size >= 4 * HELD:  # the same tree answers in turns
                        yield stars(held, asking)
                        held, asking, size = [(trees, x) for x in last], [], sum(map(len, last))
                else:
                    held.append((trees, prints[lo:hi].copy()))
                    last.append(held[-1][1])
                    size += hi - lo
        if held:
            yield stars(held, asking)

    return rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "asks").mapInArrow(run, "src long, dst long")


def _cuts(bits: int, blocks: int) -> list[tuple[int, int]]:
    edges = [bits * k // blocks for k in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _block(value: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(value, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _sized(rows: DataFrame) -> DataFrame:
    """rows of shards that hold more than one fingerprint, with the shard's size."""
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.withColumn("salt", F.xxhash64("shard")).join(sizes.withColumn("salt", F.xxhash64("shard")), ["shard", "salt"]).drop("salt")


def sharded(classes: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """shard, part, asks, fingerprint: every two fingerprints within the radius are in one tree's reach."""
    cuts = _cuts(64, radius + 1)
    value = F.col("fingerprint")
    first = []
    for k, (lo, hi) in enumerate(cuts):
        above = F.shiftleft(F.shiftrightunsigned(value, hi), lo) if hi < 64 else F.lit(0).cast("long")
        rest = above.bitwiseOR(value.bitwiseAND(F.lit((1 << lo) - 1))) if lo else above
        first.append(F.struct(F.xxhash64(F.lit(k), _block(value, lo, hi)).alias("shard"), F.lit(k).alias("k"), rest.alias("rest")))
    rows = saved(_sized(classes.select("fingerprint", F.explode(F.array(*first)).alias("to")).select("fingerprint", "to.*")), "shards")
    whole = rows.where(F.col("size") <= shard).select("shard", F.lit(0).alias("part"), F.lit(0).alias("asks"), "fingerprint")
    large = rows.where(F.col("size") > shard).drop("size")
    if large.isEmpty():
        return whole
    others = 64 - min(hi - lo for lo, hi in cuts)  # bits outside the first block
    second = [F.xxhash64("shard", F.lit(j), _block(F.col("rest"), lo, hi)) for j, (lo, hi) in enumerate(_cuts(others, radius + 1))]
    again = _sized(large.select("fingerprint", F.explode(F.array(*second)).alias("shard")))
    again = again.withColumn("parts", F.ceil(F.col("size") / shard).cast("int")).withColumn("own", F.pmod(F.xxhash64("fingerprint"), "parts").cast("int"))
    held = again.select("shard", F.col("own").alias("part"), F.lit(0).alias("asks"), "fingerprint")
    turn = F.explode(F.expr("transform(sequence(1, CAST(parts DIV 2 AS INT)), i -> pmod(own + i, parts))"))
    asking = again.where("parts > 1").select("shard", turn.alias("part"), F.lit(1).alias("asks"), "fingerprint")
    return whole.unionByName(held).unionByName(asking)


def simhash_components(docs: DataFrame, words: int = 5, radius: int = 4, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and copies (documents with the same fingerprint) of every document.

    Fingerprints link when they differ in ``radius`` bits at most; component_id is the smallest
    doc_id that links reach. Radii up to 15 are meant.
    """
    prints = saved(fingerprints(docs, words), "fingerprints")
    classes = saved(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")), "classes")
    links = saved(_linked(sharded(classes.select("fingerprint"), radius, shard), radius), "links")

    def salted(rows: DataFrame, column: str) -> DataFrame:
        return rows.withColumn("salt", F.xxhash64(column))

    found = salted(components(links).withColumnRenamed("node", "fingerprint").join(classes, "fingerprint"), "component")
    least = salted(found.groupBy("component").agg(F.min("low").alias("least")), "component")
    joined = found.join(least, ["component", "salt"]).select("fingerprint", "least")
    labelled = classes.join(joined, "fingerprint", "left").select("fingerprint", "copies", F.when(F.col("least").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))
    out = salted(prints, "fingerprint").join(salted(labelled, "fingerprint"), ["fingerprint", "salt"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "copies")
