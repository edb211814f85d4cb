"""The similarity join against brute force."""

import random
import re

import numpy as np
import pytest

from starling.llm import jaccard as jc
from starling.llm.graph import components


def brute(rows, words, percent):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in docs}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "don't", "x\x1cy", "a\xa0b"]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return w

    texts = [" ".join(prose(rng.randint(0, 80))) for _ in range(40)]
    for size, edits in ((60, 1), (90, 2), (150, 3), (200, 6), (40, 1)):
        base = prose(size)
        texts += ["  ".join(edited(base, rng.randint(0, edits + 1))) for _ in range(25)]
    chain = prose(120)
    for _ in range(12):
        chain = edited(chain, 1)
        texts.append("\t".join(chain))
    texts += ["", None, " \n", "a b", "A  B", "a b c", "one", "x " * 500, "x y " * 400, texts[0], texts[0].upper()]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "words", "percent", "weight", "pivots"), [(1, 4, 85, 1 << 21, 32), (2, 5, 80, 700, 2), (3, 4, 85, 500, 1)])
def test_components_equal_brute_force(spark, seed, words, percent, weight, pivots, monkeypatch):
    monkeypatch.setattr(jc, "BLOCK_SHINGLES", weight)
    monkeypatch.setattr(jc, "PIVOTS", pivots)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, class string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jc.jaccard_components(df, words, percent).collect()}
    assert got == brute(rows, words, percent)


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_what_all_pairs_find(seed):
    """One block, without routing."""
    import pyarrow as pa

    rows = [(d, t) for d, t in corpus(seed) if t and t.strip()]
    sets = jc.shingle_sets(pa.array([t for _, t in rows]), 3)
    want = {d: c for d, (_, c) in brute(rows, 3, 60).items()}
    links = jc.link(sets, [d for d, _ in rows], 60)
    up = {d: d for d, _ in rows}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    assert {d: root(d) for d in up} == want


def test_edges(spark):
    assert jc.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (2, None), (4, "other words")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.copies) for r in jc.jaccard_components(rows).collect()), key=str)
    assert got == [(2, 2, 1), (4, 4, 1), (4, 4, 3), (4, 4, 3), (9, 4, 3), (None, None, 1)]


def test_ids_of_other_types(spark):
    rows = corpus(7)
    got = {r.doc_id: r.component_id for r in jc.jaccard_components(spark.createDataFrame([(f"{d:05}", t) for d, t in rows], "doc_id string, text string"), 4, 85).collect()}
    assert got == {f"{d:05}": f"{c:05}" for d, (_, c) in brute(rows, 4, 85).items()}


def test_band_collisions_follow_the_similarity():
    """Each band agrees with a probability of about J to the ROWS, so that the bound on lost links holds."""
    rng, bands, trials = np.random.default_rng(0), 51, 200
    for share in (0.5, 0.8, 0.9):
        hits = 0
        for _ in range(trials):
            both, rest = int(200 * share), 200 - int(200 * share)
            x = rng.integers(0, 1 << 63, both + rest, dtype=np.uint64) * np.uint64(2)
            sets = [np.sort(x[:both + rest // 2]), np.sort(np.r_[x[:both], x[both + rest // 2 :]])]
            a, b = jc.band_keys(sets, bands)
            hits += int((a == b).sum())
        want = share**jc.ROWS
        assert abs(hits / (bands * trials) - want) < 0.03, share


def test_a_large_group_of_near_copies_is_linked_quickly():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    sets = []
    for _ in range(3000):
        own = base.copy()
        own[rng.integers(0, 120, 4)] = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        sets.append(np.unique(own))
    calls = 0

    def counted(*args, plain=jc.similar):
        nonlocal calls
        calls += 1
        return plain(*args)

    jc.similar, plain = counted, jc.similar
    try:
        links = jc.link(sets, list(range(3000)), 85)
    finally:
        jc.similar = plain
    assert len(links) == 2999 and calls < 20 * 3000


def test_long_chain_of_edges(spark):
    ids = list(range(200))
    random.Random(0).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in ids} | {1000: 1000, 1001: 1000}
