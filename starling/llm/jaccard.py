"""Similarity join on word n-gram sets (Jaccard) by signature trees.

1. Each text's set of shingles is hashed; documents with one set form a class, and classes are
   compared from here on, never copies.
2. Routing: classes that agree on any of several minhash bands are put in one candidate
   cluster. The number of bands follows from the threshold, so that two sets that reach it miss
   each other with a probability below MISS (1e-13); all that is linked is in one cluster.
3. Each cluster's texts meet once, in blocks of bounded weight. A block becomes a signature tree:
   leaves hold a set's token bitmap and size, inner nodes the OR and the AND of their bitmaps and
   the range of sizes. A dual traversal, from the lowest common ancestors up, drops a pair of
   nodes when the largest possible overlap cannot reach the threshold, when sizes are too far
   apart, or when all its documents are connected already. All links come from surviving pairs of
   leaves, whose sets are intersected exactly.
4. A cluster of several blocks shares some pivots among all of them, which connect its bulk.
   Documents that stay outside the bulk are compared with every block in a second round, so all
   pairs that no path connects have been compared.
5. Components of the links give each document its class.

Trees route nothing corpus-wide: the OR of unrelated documents' bitmaps fills up a few levels
above the leaves, so that node pairs could not be pruned there and their number would be quadratic.

Edge cases: null, empty and wordless texts have empty sets and link with nothing. With fewer
words than a shingle has, the whole sequence is the one shingle. Ids may have any type that can
be ordered. Rows without doc_id link with nothing and have no component; rows that share a doc_id
are documents of their own. An empty table gives an empty result; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from starling.llm.common import batch_of, mix, ragged, raw, saved, steps
from starling.llm.graph import components
from starling.llm.words import ascii_lower

#: Most probable loss of a link by routing, and minhashes of one band: sets with a similarity of 0.3 share one of 51 bands in 12 % of all cases.
MISS, ROWS = 1e-13, 5
#: Shingles (8 bytes each) that a block holds, what a document counts besides, and pivots that a cluster's blocks share.
BLOCK_SHINGLES, DOCUMENT, PIVOTS = 1 << 21, 64, 32
BITS, FAN = 1024, 8
#: Pairs of nodes that are looked at in one step.
PAIRS = 1 << 13
STEP = 1 << 20


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    parts = pc.ascii_split_whitespace(ascii_lower(texts))
    flat = parts.flatten().dictionary_encode()
    index = flat.indices.to_numpy()
    data, at = raw(flat.dictionary)
    lens = np.diff(at)
    with np.errstate(over="ignore"):
        spot = np.arange(len(data)) - np.repeat(at[:-1], lens)
        total = np.r_[np.uint64(0), np.cumsum(mix(spot.astype(np.uint64) * np.uint64(256) + data))]
        word = mix(total[at[1:]] - total[at[:-1]] + lens.astype(np.uint64))
        real = lens[index] > 0  # white space at an end leaves an empty word
        ends = np.r_[0, np.cumsum(real)][np.r_[0, np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))]]
        hashes = word[index[real]]
        shingles = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for k in range(words):
            shingles += mix(hashes[k : k + len(shingles)] + np.uint64(k + 1))
        shingles = mix(shingles)
        out = []
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if hi - lo >= words:
                out.append(np.unique(shingles[lo : hi - words + 1]))
            elif hi > lo:
                out.append(mix(mix(hashes[lo:hi] + np.arange(1, hi - lo + 1, dtype=np.uint64)).sum(keepdims=True) + np.uint64(hi - lo)))
            else:
                out.append(hashes[:0])
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 128-bit digest of each set, as 16 bytes."""
    lens = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    ends = np.cumsum(lens)
    with np.errstate(over="ignore"):
        keys = []
        for salt in (1, 2):
            total = np.r_[np.uint64(0), np.cumsum(mix(flat ^ np.uint64(0xA0761D6478BD642F * salt & (1 << 64) - 1)))]
            keys.append(mix(total[ends] - total[ends - lens] + lens.astype(np.uint64)))
    return np.stack(keys, axis=1).view("S16").ravel() if sets else np.zeros(0, "S16")


def band_keys(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """(set, band) keys: equal if ROWS minhashes of that band are. Sets must not be empty."""
    lens = np.array([len(s) for s in sets], np.int64)
    flat, first = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), np.cumsum(lens) - lens
    out = np.zeros((len(sets), bands), np.uint64)
    seeds = mix(np.arange(1, 2 * bands * ROWS + 1, dtype=np.uint64)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for k in range(bands * ROWS):
            low = np.minimum.reduceat((flat ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint32(1)), first)
            out[:, k // ROWS] = mix(out[:, k // ROWS] + low)
        out = mix(out + np.arange(bands, dtype=np.uint64))
    return out.view(np.int64)


def profiles(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (the set's digest, null if it is empty), node (its first half), bands (once for each set of a step)."""

    def run(batches):
        for batch in steps(batches, STEP):
            sets = shingle_sets(batch.column("text"), words)
            n = np.array([len(s) for s in sets], np.int64)
            keyed = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) & (n > 0)
            keys = [k if has else None for k, has in zip(_digests(sets), keyed.tolist(), strict=True)]
            first = {k: i for i, k in reversed(list(enumerate(keys))) if k is not None}
            new = sorted(first.values())
            has = np.zeros(len(n), bool)
            has[new] = True
            values = band_keys([sets[i] for i in new], bands).ravel() if new else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(has) * bands].astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n), pa.array(keys, pa.binary()), pa.array([None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()), pc.if_else(pa.array(has), lists, pa.scalar(None, lists.type))],
                names=["doc_id", "text_hash", "n_shingles", "class", "node", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, class binary, node long, bands array<long>")


def _digests(sets: list[np.ndarray]) -> list[bytes]:
    return [bytes(k).ljust(16, b"\0") for k in set_keys(sets).tolist()]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def roots(self) -> np.ndarray:
        up = np.array(self.up, np.int64)
        while (up != up[up]).any():
            up = up[up]
        return up


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, exactly."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


class SignatureTree:
    """Documents in an order that puts similar ones together; nodes of FAN children up to one root."""

    def __init__(self, sets: list[np.ndarray]):
        bits = np.zeros((len(sets), BITS), np.uint8)
        lens = np.array([len(s) for s in sets], np.int64)
        bits[np.repeat(np.arange(len(sets)), lens), (np.concatenate(sets) % np.uint64(BITS)).astype(np.int64)] = 1
        own = np.packbits(bits, axis=1).view(np.uint64)
        self.levels = [(own, own, lens, lens)]
        while len(self.levels[-1][0]) > 1:
            some, every, least, most = self.levels[-1]
            at = np.arange(0, len(some), FAN)
            self.levels.append((np.bitwise_or.reduceat(some, at), np.bitwise_and.reduceat(every, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def label(self, roots: np.ndarray) -> None:
        """Gives each node the one component of all its documents, or -1 if they have several."""
        self.labels = [roots]
        for level in self.levels[1:]:
            below = self.labels[-1]
            at = np.arange(0, len(below), FAN)
            low, high = np.minimum.reduceat(below, at), np.maximum.reduceat(below, at)
            self.labels.append(np.where((low == high), low, -1))

    def keep(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold a pair of unconnected documents that reaches the threshold."""
        label = self.labels[level]
        some, every, least, most = self.levels[level]
        keep = (label[a] < 0) | (label[a] != label[b])
        keep &= (100 * most[a] >= percent * least[b]) & (100 * most[b] >= percent * least[a])
        at = np.flatnonzero(keep)
        x, y = a[at], b[at]
        only_a = np.bitwise_count(every[x] & ~some[y]).sum(axis=1, dtype=np.int64)  # tokens that any document of a has and none of b
        only_b = np.bitwise_count(every[y] & ~some[x]).sum(axis=1, dtype=np.int64)
        overlap = np.minimum(most[x] - only_a, most[y] - only_b)
        keep[at] = 100 * overlap >= percent * (overlap + only_a + only_b)
        return keep

    def _siblings(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of nodes of a level that have one parent."""
        n = len(self.levels[level][0])
        i, j = np.triu_indices(FAN, 1)
        at = np.arange(0, n, FAN)[:, None]
        a, b = (at + i).ravel(), (at + j).ravel()
        return a[b < n], b[b < n]

    def connect(self, forest: Forest, join, percent: int) -> None:
        """Calls join(i, j) for leaf pairs that no bound excludes, until all that reaches the threshold is connected.

        Pairs are taken by their lowest common ancestor, low ones first: what is alike stands
        together and is connected early, and connected nodes are skipped further up.
        """
        self.label(forest.roots())
        for level in range(len(self.levels) - 1):
            stack = [(level, *self._siblings(level))]
            while stack:
                now, a, b = stack.pop()
                if len(a) > PAIRS:
                    stack += [(now, a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]
                    continue
                keep = self.keep(now, a, b, percent)
                a, b = a[keep], b[keep]
                if not len(a):
                    continue
                if now == 0:
                    if sum([join(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)]):
                        self.label(forest.roots())
                    continue
                n = len(self.levels[now - 1][0])
                left = (a[:, None] * FAN + np.arange(FAN)).repeat(FAN, axis=1).ravel()
                right = np.tile(b[:, None] * FAN + np.arange(FAN), (1, FAN)).ravel()
                real = (left < n) & (right < n)
                stack.append((now - 1, left[real], right[real]))


def link(sets: list[np.ndarray], labels: list, percent: int) -> list[tuple]:
    """Pairs (label, smallest label) that connect all documents which similarity connects; documents of one label are connected already.

    They form stars, one for each group of connected labels.
    """
    order = sorted(range(len(sets)), key=lambda i: (sets[i][:2].tolist(), len(sets[i]), labels[i]))
    sets, labels = [sets[i] for i in order], [labels[i] for i in order]
    forest = Forest(len(sets))

    def join(i: int, j: int) -> bool:
        a, b = forest.root(i), forest.root(j)
        if a != b and similar(sets[i], sets[j], percent):
            forest.up[max(a, b)] = min(a, b)
            return True
        return False

    first: dict = {}
    for i, label in enumerate(labels):
        if (j := first.setdefault(label, i)) != i:
            forest.up[forest.root(i)] = forest.root(j)
    SignatureTree(sets).connect(forest, join, percent)
    return _stars(forest, labels)


def _stars(forest: Forest, labels: list) -> list[tuple]:
    low: dict[int, object] = {}
    for i, label in enumerate(labels):
        root = forest.root(i)
        low[root] = min(label, low.get(root, label))
    return sorted({(label, low[forest.root(i)]) for i, label in enumerate(labels) if label != low[forest.root(i)]})


def _linked(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links within each group (g1, g2, g3) of rows (class, label, text); rows whose text has another class, or a class again, are passed over."""

    def run(batches):
        group, seen, key, found = [], set(), None, []
        for batch in steps(batches, STEP):
            sets = shingle_sets(batch.column("text"), words)
            keys = zip(*(batch.column(c).to_pylist() for c in ("g1", "g2", "g3")), strict=True)
            for now, own, s, digest, label in zip(keys, batch.column("class").to_pylist(), sets, _digests(sets), batch.column("label").to_pylist(), strict=True):
                if now != key and group:
                    found += link(*map(list, zip(*group, strict=True)), percent)
                    group, seen = [], set()
                key = now
                if digest == own and own not in seen:
                    seen.add(own)
                    group.append((s, label))
        if group:
            found += link(*map(list, zip(*group, strict=True)), percent)
        yield batch_of(src=pa.array([a for a, _ in found], pa.binary()), dst=pa.array([b for _, b in found], pa.binary()))

    keys = ["g1", "g2", "g3"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "src binary, dst binary")


def _salted(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with a hash of columns that a join takes as a second key: it then shuffles both sides itself, and Spark may split a hot key."""
    return rows.withColumn("salt", F.xxhash64(*columns))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and copies (documents with the same set) of every document.

    Documents link when 100 * intersection >= percent * union of their sets of ``words``-word
    shingles; component_id is the smallest doc_id that links reach.
    """
    bands = bands_for(percent)
    profile = saved(profiles(docs, words, bands), "profiles")
    grouped = profile.where("class IS NOT NULL").groupBy("class")
    classes = grouped.agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"), F.first("bands", ignorenulls=True).alias("bands"), F.first("node").alias("node"))
    classes = saved(classes, "classes")

    # Routing goes by the digests' first halves: if two were equal, their clusters would be compared as one.
    keyed = classes.select("node", F.explode("bands").alias("band"))
    leaders = _salted(keyed.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "leader"), "band")
    edges = _salted(keyed, "band").join(leaders, ["band", "salt"]).select(F.col("node").alias("src"), F.col("leader").alias("dst"))
    members = components(edges).join(classes.select("class", "node", "first", "n"), "node").drop("node").withColumnRenamed("component", "g1")
    weights = members.groupBy("g1").agg(F.ceil(F.sum(F.col("n") + DOCUMENT) / BLOCK_SHINGLES).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size"))
    members = saved(_salted(members, "g1").join(_salted(weights, "g1"), ["g1", "salt"]).drop("salt"), "members")
    own = F.pmod(F.xxhash64("class"), "blocks").cast("int")
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("class", F.lit(1)), "size") < PIVOTS)
    texts = docs.where("doc_id IS NOT NULL").select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("first"), "text")
    placed = members.withColumn("g2", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    # By shuffle at any size: a plan that broadcasts members while they are few would change as they grow.
    rows = placed.hint("merge").join(texts, "first").select("g1", "g2", F.lit(0).alias("g3"), "class", F.col("class").alias("label"), "text")
    links = saved(_linked(rows, words, percent), "links")

    split = members.where("blocks > 1")
    if not split.isEmpty():
        links = links.unionByName(_second_round(split, links, texts, words, percent))
    found = _salted(components(links).join(classes.select(F.col("class").alias("node"), "first", "copies"), "node"), "component")
    least = _salted(found.groupBy("component").agg(F.min("first.doc_id").alias("component_id")), "component")
    linked = found.join(least, ["component", "salt"]).select(F.col("node").alias("class"), "component_id")
    labelled = classes.join(linked, "class", "left").select("class", F.coalesce("component_id", "first.doc_id").alias("component_id"), "copies")
    out = profile.withColumn("salt", F.when(F.col("class").isNotNull(), F.xxhash64("class"))).join(_salted(labelled, "class"), ["class", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))


def _second_round(split: DataFrame, links: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Compares documents outside the largest component of their cluster with the cluster's every block."""
    labels = components(links).withColumnRenamed("node", "class")
    now = split.join(labels, "class", "left").withColumn("label", F.coalesce("component", "class")).drop("component")
    counts = now.groupBy("g1", "label").agg(F.count(F.lit(1)).alias("members"))
    bulk = _salted(counts.groupBy("g1").agg(F.max_by("label", F.struct("members", "label")).alias("bulk")), "g1")
    now = saved(_salted(now, "g1").join(bulk, ["g1", "salt"]).drop("salt"), "outside")
    outside = now.where("label <> bulk")
    if outside.isEmpty():
        return links.limit(0)
    parts = _salted(outside.groupBy("g1").agg(F.ceil(F.sum(F.col("n") + DOCUMENT) / BLOCK_SHINGLES).cast("int").alias("parts")), "g1")
    now = _salted(now, "g1").join(parts, ["g1", "salt"]).drop("salt")
    block, part = F.pmod(F.xxhash64("class"), "blocks").cast("int"), F.pmod(F.xxhash64("class", F.lit(2)), "parts").cast("int")
    held = now.select("g1", "first", "class", "label", block.alias("g2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("g3"))
    asks = now.where("label <> bulk").select("g1", "first", "class", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("g2"), part.alias("g3"))
    rows = held.unionByName(asks).join(texts, "first").select("g1", "g2", "g3", "class", "label", "text")
    return saved(_linked(rows, words, percent), "links")
