"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.llm import periodic_runs as pr, queries
from test_jaccard import corpus


def plain_runs(w):
    """Every (start, length, period): maximal stretches by period, of which a shorter period excludes longer ones over the same words."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sequences():
    rng = random.Random(8)
    for n in range(0, 14):
        for _ in range(60):
            yield [rng.choice("ab") for _ in range(n)]
    for _ in range(150):
        w = []
        while len(w) < 120:
            root = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            w += root * rng.randint(1, 7) + root[: rng.randint(0, len(root))]
        yield w
    yield ["a"] * 500
    yield list("ab") * 300
    yield [f"w{i % 50}" for i in range(400)] + ["x", "y"] * 6
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    yield list(fib[-1])


def test_suffix_tree_orders_and_compares():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 200):
        s = rng.integers(1, 3, n)
        tree = pr.SuffixTree(s.tolist())
        text = [*s.tolist(), 0]
        assert tree.sorted.tolist() == sorted(range(n + 1), key=lambda i: text[i:])
        i, j = rng.integers(0, n + 1, (2, 400))
        i, j = i[i != j], j[i != j]

        def common(a, b):
            k = 0
            while a + k <= n and b + k <= n and text[a + k] == text[b + k]:
                k += 1
            return k

        assert tree.common(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


@pytest.mark.parametrize("block", [2, 32])
def test_range_minimum(block, monkeypatch):
    monkeypatch.setattr(pr.RangeMinimum, "BLOCK", block)
    rng = np.random.default_rng(2)
    for n in (1, 5, 64, 333):
        v = rng.integers(0, 50, n)
        a, b = np.sort(rng.integers(0, n, (2, 300)), axis=0)
        assert pr.RangeMinimum(v).of(a, b).tolist() == [v[x : y + 1].min() for x, y in zip(a, b, strict=True)]


def test_runs_of_whole_sequences():
    for w in sequences():
        _, symbols = np.unique(np.array(w, dtype=str), return_inverse=True)
        assert [tuple(r) for r in pr.runs_of(symbols + 1).tolist()] == plain_runs(w)


def test_operator(spark):
    texts = [" ".join(w) for w in sequences()] + [t for _, t in corpus(9)] + ["a\x0ba\x0ca\ra a\ta", "É É É É É É x", "  a a a a a a", "x x x x x x x x x x x x "]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, runs int").repartition(3)
    got = {r.doc_id: r for r in pr.periodic_runs(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = plain_runs(w)
        assert [tuple(r) for r in got[i].runs] == want and got[i].collapsed == collapsed(w, want), i


def test_long_text(spark):
    rng = random.Random(3)
    w = [rng.choice("abcdefgh") for _ in range(40_000)] + ["x", "y", "z"] * 30_000 + [f"v{rng.randrange(9000)}" for _ in range(20_000)] * 5
    got = pr.periodic_runs(spark.createDataFrame([(None, " ".join(w))], "doc_id long, text string")).first()
    assert [40_000, 90_000, 3] in [list(r) for r in got.runs] and [130_000, 100_000, 20_000] in [list(r) for r in got.runs]
    assert got.collapsed == collapsed(w, [tuple(r) for r in got.runs])


def plain_query(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (len(runs), *best, best[1] * 1000 // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())


def test_query(spark, tmp_path):
    texts = [t for _, t in corpus(10)] + [" ".join(w) for w in list(sequences())[-60:]]
    path = f"file://{tmp_path}"
    rows = [(i * 7, t, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in queries.queries()["op12_periodic_runs"](spark, path).collect()}
    assert got == {i: plain_query(i, t) for i, t, _ in rows}
    assert sum(v[0] > 0 for v in got.values()) > 60


def test_edges(spark):
    rows = [(None, "a " * 9), (1, None), (1, None), (2, ""), (3, " \n"), (4, "a b c")]
    got = pr.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("best", pr.strongest(F.col("runs"))).collect()
    assert sorted(((r.doc_id, len(r.runs), r.collapsed, r.best and tuple(r.best)) for r in got), key=str) == sorted([(None, 1, "a", (0, 9, 1)), (1, 0, "", None), (1, 0, "", None), (2, 0, "", None), (3, 0, "", None), (4, 0, "a b c", None)], key=str)
    assert pr.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
