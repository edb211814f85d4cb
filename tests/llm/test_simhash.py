"""SimHash components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from starling.llm import simhash as sh
from test_jaccard import corpus


def plain_print(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, radius):
    """{doc: smallest doc reachable} of (doc, fingerprint) pairs."""
    up = {d: d for d, _ in prints}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= radius:
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: root(d) for d in up}


@pytest.mark.parametrize("words", [1, 4])
def test_fingerprints(words, monkeypatch):
    import pyarrow as pa

    texts = [t for _, t in corpus(3)] + ["w" * 700, "x " * 3000, "a b c", "É É É é"]
    want = [plain_print(t, words) for t in texts]
    assert sh.fingerprints_of(pa.array(texts), words).tolist() == want
    assert sh.fingerprints_of(pa.array([], pa.string()), words).tolist() == []
    monkeypatch.setattr(sh, "STEP", 64)  # every text in parts
    assert [int(sh.fingerprints_of(pa.array([t]), words)[0]) for t in texts] == want


def balls(seed, n=400):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(8)]
    prints = {0}
    for _ in range(n):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    return sorted(prints | {rng.getrandbits(64) for _ in range(n)})


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_trees_find_all_within_the_radius(radius):
    prints = np.array(balls(1), np.uint64)
    tree = np.sort(np.random.default_rng(2).integers(0, 5, len(prints))) * 3
    found = set()
    for who, node in sh.BKTrees(prints, tree).within(prints, tree, radius):
        pairs = list(zip(who.tolist(), node.tolist(), strict=True))
        assert not found & set(pairs)
        found |= set(pairs)
    want = {(i, j) for i, a in enumerate(prints.tolist()) for j, b in enumerate(prints.tolist()) if tree[i] == tree[j] and (a ^ b).bit_count() <= radius}
    assert found == want


@pytest.mark.parametrize("shard,held", [(sh.SHARD, sh.HELD), (40, 64), (3, 8)])
def test_shards_lose_no_link(spark, monkeypatch, shard, held):
    """The second cut and the parts of large shards included."""
    monkeypatch.setattr(sh, "HELD", held)
    prints = balls(4)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = sh._linked(sh.sharded(spark.createDataFrame(signed, "fingerprint long"), 4, shard), 4).collect()
    up = {p: p for p, in signed}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    want = brute([(s, p) for (s,), p in zip(signed, prints, strict=True)], 4)
    assert {p: root(p) for p, in signed} == want


def test_components(spark):
    rows = corpus(5) + [(5000, "one two three four"), (5001, "ONE\ttwo three  four")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fingerprint string, copies string").repartition(3)
    got = {r.doc_id: r for r in sh.simhash_components(docs, words=4).collect()}
    prints = [(i, plain_print(t, 4)) for i, t in rows]
    want = brute(prints, 4)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{p:016x}", want[d]) for d, p in prints}
    assert got[5001].copies == 2 and len(set(want.values())) < len(rows)


def test_edges(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "q r s t u"), (7, "q r s t u"), (None, "q r s t u"), (9, None), (4, ""), (2, " \n")]
    got = sh.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((str(r.doc_id), r.component_id, r.copies) for r in got), key=str) == sorted([("None", None, 2)] * 2 + [("7", 7, 3)] * 2 + [("None", 7, 3)] + [(x, 2, 3) for x in "942"], key=str)
    assert {r.fingerprint for r in got if r.component_id == 2} == {"0" * 16}
    assert sh.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
