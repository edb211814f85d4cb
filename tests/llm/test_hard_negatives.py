"""Hard negatives against brute force and DuckDB."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.llm import hard_negatives as hn, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "s", "r") for i, v, y in rows], SCHEMA).repartition(3)


def plain(rows, every=10, most=5):
    own = {}
    for i, v, y in rows:
        if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v):
            q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
            own[(i, y, q)] = (i, y, q)
    out = []
    for i, y, q in own.values():
        if i % every:
            continue
        scores = [(sum(a * b for a, b in zip(q, r, strict=False)), j, z) for j, z, r in own.values() if j != i]
        for p, j, _ in sorted((x for x in scores if x[2] == y), key=lambda x: (-x[0], x[1]))[:most]:
            hard = sorted((x for x in scores if x[2] != y and 80 * p <= 100 * x[0] <= 100 * p), key=lambda x: (-x[0], x[1]))[:most]
            out += [(i, j, k + 1, n, p, s) for k, (s, n, _) in enumerate(hard)]
    return sorted(out)


def vectors(seed, n=400, dims=12, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = [(i, (scale * (centres[k := rng.integers(6)] + rng.normal(size=dims) * rng.choice([0.1, 0.5, 2])) * rng.choice([0.1, 1, 1, 3])).astype(np.float32).tolist(), int((k + (rng.random() < 0.4)) % 3)) for i in range(n)]
    rows += [(1000 + i, rows[i][1], rows[i + 1][2]) for i in range(40)]  # equal vectors, other labels: ties
    return rows


def run(spark, rows, **options):
    return sorted(tuple(r) for r in hn.hard_negatives(table(spark, rows), F.col("label"), F.col("vec_id") % 10 == 0, **options).collect())


@pytest.mark.parametrize("stripe,block,window", [(hn.STRIPE, hn.BLOCK, hn.WINDOW), (30, 7, 5)])
def test_against_brute_force(spark, monkeypatch, stripe, block, window):
    monkeypatch.setattr(hn, "WINDOW", window)
    monkeypatch.setattr(hn, "POOL", 50)
    rows = vectors(1)
    got = run(spark, rows, stripe=stripe, block=block)
    assert got == plain(rows) and len(got) > 300


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 8)) * 400
    q = np.floor(np.repeat(centres, 40, axis=0) + rng.normal(size=(200, 8)) * 30)
    q[0] = 0
    toward = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    norm = np.linalg.norm(q, axis=1)
    angle = np.arccos(np.clip(q / np.maximum(norm, 1)[:, None] @ toward.T, -1, 1))
    score = q @ q.T
    low, high = hn.score_bounds(angle, norm, angle, angle, norm, norm)  # windows of one row
    assert (low <= score).all() and (score <= high).all()
    least, most, short, long = angle.reshape(5, 40, 5).min(axis=1), angle.reshape(5, 40, 5).max(axis=1), norm.reshape(5, 40).min(axis=1), norm.reshape(5, 40).max(axis=1)
    low, high = hn.score_bounds(angle, norm, least, most, short, long)
    grouped = score.reshape(200, 5, 40)
    assert (low <= grouped.min(axis=2)).all() and (grouped.max(axis=2) <= high).all()
    assert (high < 0.8 * norm[:, None] * short).mean() > 0.3  # far clusters are left out


def test_large_components(spark):
    rows = vectors(2, n=120, scale=3000.0)  # scores beyond 2^31
    assert run(spark, rows) == plain(rows)
    huge = [(i, [1e15, 1.0], i % 2) for i in range(0, 40, 2)] + [(1, [1e15, 0.0], 1)] + [(3, [1e15, 2.0], 0)]
    with pytest.raises(Exception, match="64 bits"):
        run(spark, huge)


def test_edges(spark):
    rows = vectors(3, n=150) + [(None, [1.0] * 12, 0), (20000, None, 0), (20010, [1.0, None], 1), (20020, [float("nan")] * 12, 1), (20030, [float("inf")], 2), (20040, [1.0] * 12, None)]
    rows += [(20050, [], 0), (20060, [0.0] * 12, 1), (20061, [0.0] * 12, 1), (20062, [0.0] * 12, 2), (20070, [1.0, 2.0], 2), (20080, [5.0], 77), *[(20090, [1.0] * 12, 1)] * 3, (20090, [2.0] * 12, 1), (20090, [1.0] * 12, 2)]
    assert run(spark, rows) == sorted(plain(rows))
    assert run(spark, []) == []
    assert run(spark, [(i, [1.0], 0) for i in range(20)]) == []  # no other label
    assert run(spark, [(i, [1.0], i) for i in range(20)]) == []  # no positives


@pytest.mark.parametrize("path", ["/root/testdata/sf0.001"])
def test_sql(spark, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    want = con.execute(queries.oracle_sql()["op13_hard_negatives"])
    names = [c[0] for c in want.description]
    got = queries.queries()["op13_hard_negatives"](spark, path)
    assert sorted(names) == sorted(got.columns) and sorted(want.fetchall()) == sorted(tuple(r) for r in got.select(names).collect())
    assert got.count() > 0
