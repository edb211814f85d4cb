"""Graph training, sparse text features, block sums, the fold driver, pools, outputs and the feature store against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from starling.operators import assemble, blocks, ensemble as en, folds, graph, linear, sketches, tfidf, trees
from starling.sources import io
from starling.sources.store import FeatureStore


def node_vectors(spark, names, dims, seed=1):
    rng = np.random.default_rng(seed)
    e = {n: rng.normal(size=dims) for n in names}
    return e, spark.createDataFrame([(n, [float(x) for x in v]) for n, v in e.items()], "node string, e array<double>")


def test_propagation_equals_matrix_powers(spark, monkeypatch):
    """A hot node whose edges are cut in pieces, sums that are sent on early."""
    monkeypatch.setattr(graph, "PIECE", 3)
    monkeypatch.setattr(graph, "HELD", 4)
    rng = random.Random(3)
    pairs = [(0, i) for i in range(30)] + [(rng.randrange(12), rng.randrange(30)) for _ in range(60)]
    edges = graph.normalized(graph.bipartite_edges(spark.createDataFrame(pairs, "user_id long, prod_id long")))
    rows = edges.collect()
    names = sorted({r.src for r in rows})
    e, start = node_vectors(spark, names, 5)
    a = np.zeros((len(names),) * 2)
    for r in rows:
        a[names.index(r.dst), names.index(r.src)] = r.w
    x = np.stack([e[n] for n in names])
    want = (x + a @ x + a @ a @ x) / 3
    got = {r.node: r.e for r in graph.propagate(edges, start, 5, layers=2).collect()}
    assert np.allclose(np.array([got[n] for n in names]), want)
    assert graph.adjacency(edges).where("src = 'u0'").count() > 5 and graph.propagate(edges.limit(0), start.limit(0), 5, 1).count() == 0


def test_gradient_equals_differences(spark):
    names = ["u1", "u2", "i1", "i2", "i3"]
    e, vectors = node_vectors(spark, names, 3)
    triples = [("u1", "i1", "i2"), ("u1", "i3", "i2"), ("u2", "i2", "i1"), ("u2", "i2", "i1")]

    def loss(e):
        return sum(math.log1p(math.exp(-(e[u] @ e[i] - e[u] @ e[j]))) for u, i, j in triples) / len(triples)

    df = spark.createDataFrame(triples, "user string, pos string, neg string")
    got = {r.node: r.e for r in graph.bpr_gradient(df, vectors, 3, len(triples)).collect()}
    for n in names:
        for k in range(3):
            moved = {m: v.copy() for m, v in e.items()}
            moved[n][k] += 1e-6
            assert abs((loss(moved) - loss(e)) / 1e-6 - got[n][k]) < 1e-5
    assert abs(graph.bpr_loss(df, vectors).first().loss - loss(e)) < 1e-12
    far = spark.createDataFrame([("u1", [1000.0]), ("i1", [-1.0]), ("i2", [1.0])], "node string, e array<double>")
    assert graph.bpr_loss(spark.createDataFrame([("u1", "i1", "i2")], df.schema), far).first().loss == 2000.0


def test_training_lowers_the_loss(spark):
    pairs = [(u, i) for u in range(20) for i in range(12) if (u + i) % 3 == 0]
    rows = spark.createDataFrame(pairs, "user_id long, prod_id long")
    edges = graph.normalized(graph.bipartite_edges(rows))
    start = graph.hashed_vectors(edges, 4)
    vectors, losses = graph.bpr_train(edges, rows, rows, start, 4, steps=3, rate=30.0, layers=1)
    assert losses[0] > losses[1] > losses[2] and vectors.count() == 32


def test_negatives_are_no_own_items(spark):
    pairs = [(u, i) for u in range(6) for i in range(10) if (u * i) % 4 != 1] + [(9, i) for i in range(10)]  # user 9 has all
    rows = spark.createDataFrame(pairs, "user_id long, prod_id long")
    got = graph.with_negatives(rows, rows, "user_id", "prod_id").collect()
    own = set(pairs)
    assert not [r for r in got if (r.user_id, r.neg) in own] and all(r.user_id != 9 for r in got)
    assert len(got) == len([p for p in pairs if len([x for x in pairs if x[0] == p[0]]) < 10])


def test_exported_vectors(spark, tmp_path):
    e, vectors = node_vectors(spark, ["u1", "i1", "i2"], 2)
    index, _ = graph.save_vectors(vectors, f"file://{tmp_path}/v")
    assert sorted(r.number for r in index.collect()) == [0, 1, 2]
    assert {r.node: list(r.e) for r in graph.load_vectors(spark, f"file://{tmp_path}/v").collect()} == {n: v.tolist() for n, v in e.items()}
    index.where("number > 0").write.mode("overwrite").parquet(f"file://{tmp_path}/w/index")
    spark.read.parquet(f"file://{tmp_path}/v/vectors").write.parquet(f"file://{tmp_path}/w/vectors")
    with pytest.raises(ValueError):
        graph.load_vectors(spark, f"file://{tmp_path}/w")


def test_svd_in_column_blocks(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "NUMBERS", 60)
    monkeypatch.setattr(tfidf, "ENTRIES", 16)
    monkeypatch.setattr(blocks, "ROWS", 4)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(80, 4)) @ rng.normal(size=(4, 23)) + 0.01 * rng.normal(size=(80, 23))) * (rng.random((80, 23)) < 0.7)
    x[5] = 0
    rows = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in x], "idx array<int>, val array<double>").repartition(3)
    v, s = tfidf.truncated_svd(rows, 23, 4, passes=6)
    _, want, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, want[:4], rtol=1e-5) and np.allclose(np.abs(np.diag(v.T @ vt[:4].T)), 1, atol=1e-4)
    assert (tfidf.truncated_svd(rows.limit(0), 23, 2)[1] == 0).all()


def test_hashed_counts(spark):
    docs = [(1, "Red red  blue"), (2, None), (3, "red"), (4, "blue red red blue x")]
    df = spark.createDataFrame(docs, "d long, t string")
    counts = tfidf.hashed_counts(df, "d", "t", dims=31)
    want = Counter()
    for d, t in docs:
        w = (t or "").lower().split()
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                h = int(hashlib.md5(" ".join(w[i : i + n]).encode()).hexdigest()[:8], 16)
                want[d, h % 11 if n == 1 else 11 + (n - 2) * 10 + h % 10] += 1
    assert {(r.d, r.idx): r.tf for r in counts.collect()} == dict(want)
    df_of = Counter(i for _, i in want)
    got = {(r.d, r.idx): r.val for r in tfidf.hashed_weights(counts, df, "d").collect()}
    assert got == pytest.approx({k: n * math.log(5 / (1 + df_of[k[1]])) for k, n in want.items() if 2 <= df_of[k[1]] < 4})


def test_wide_grams_in_column_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 7))
    rows = spark.createDataFrame([(i % 3, *map(float, r)) for i, r in enumerate(x)], "fold int, " + ", ".join(f"c{i} double" for i in range(6)) + ", rating double").repartition(4)
    names = [f"c{i}" for i in range(6)]
    whole = linear.fold_grams(rows, names, k=3)
    monkeypatch.setattr(linear, "NUMBERS", 60)
    monkeypatch.setattr(blocks, "ROWS", 2)
    one = np.column_stack([np.ones(50), x])
    want = np.stack([one[f::3].T @ one[f::3] for f in range(3)])
    assert np.allclose(whole, want) and np.allclose(linear.fold_grams(rows, names, k=3), want)


@pytest.mark.parametrize("parallel", [1, 4])
def test_fold_driver(spark, parallel):
    """The learner is the mean of what it is given: folds never see themselves."""
    rows = spark.createDataFrame([(i, i % 4 if i != 9 else None, float(i)) for i in range(20)], "id long, fold int, y double")

    def learn(fit):
        m = fit.agg(F.avg("y")).first()[0]
        return folds.Fitted(lambda df, name: df.withColumn(name, F.lit(m)), m)

    out = folds.out_of_fold(rows, learn, 4, scoring=rows.select("id"), parallel=parallel, bound=lambda x: F.least(x, F.lit(9.0)))
    want = [np.mean([i for i in range(20) if i != 9 and i % 4 != f]) for f in range(4)]
    assert out.reports == pytest.approx(want)
    assert {r.id: r.pred for r in out.rows.collect()} == pytest.approx({i: min(want[i % 4], 9.0) for i in range(20) if i != 9})
    assert [r.pred for r in out.scored.collect()] == pytest.approx([np.mean(np.minimum(want, 9.0))] * 20)


def test_pool_of_models(spark):
    expected = [("train", i) for i in range(6)] + [("test", i) for i in range(3)]
    long = [(m, s, i, float(i)) for m in ("a", "b", "c") for s, i in expected] + [("a", "train", 77, 1.0), ("b", "train", 0, -1.0), ("d", "train", 0, 1.0)] + [("e", s, i, None if i == 2 else 0.5) for s, i in expected]
    long, want = spark.createDataFrame(long, "model string, split string, id long, pred double"), spark.createDataFrame(expected, "split string, id long")
    wide, names, report = en.pool(long, want)
    assert names == ["a", "b", "c"] and wide.count() == 9 and wide.where("split = 'train' AND id = 0").first().b == -1.0
    assert {(r.model, r.split): (r.n, r.enters) for r in report.collect() if r.model in "de"} == {("d", "train"): (1, False), ("d", "test"): (0, False), ("e", "train"): (5, False), ("e", "test"): (2, False)}
    with pytest.raises(ValueError, match="4 are needed"):
        en.pool(long, want, least=4)


def test_a_pool_shuffles_rows_of_ids(spark, tmp_path, monkeypatch):
    """The predictions of an id are one row before any shuffle; ids that are null have none, and neither has a model without a name."""
    rows = spark.range(3000).select("id", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.rand(1).alias("pred")) for m in "abcd"])))
    rows.withColumn("split", F.lit("train")).write.parquet(f"file://{tmp_path}/long")
    long, seen, plain = spark.read.parquet(f"file://{tmp_path}/long"), [], en.materialize
    monkeypatch.setattr(en, "materialize", lambda df, path: seen.append(df) or plain(df, path))
    want = spark.range(3000).select("id", F.lit("train").alias("split"))
    wide, names, _ = en.pool(long, want)
    assert names == list("abcd") and wide.count() == 3000
    assert not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in seen[:1])
    exchanges = [line for df in seen for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert not any("model" in line and "id#" in line for line in exchanges)
    odd = long.unionByName(spark.createDataFrame([("train", None, "a", 1.0), ("train", 5, None, 1.0)], "split string, id long, model string, pred double"))
    report = en.pool(odd, want.unionByName(spark.createDataFrame([(None, "train")], "id long, split string")), least=0)[2]
    assert sorted((r.model, r.n, r.expected, r.enters) for r in report.collect()) == [(m, 3000, 3001, False) for m in "abcd"]


def test_outputs_of_one_job(spark, tmp_path):
    rows = spark.range(0, 50, 1, 3).select("id", (F.col("id") / 7).alias("a"), F.lit(1.0).alias("b"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    written = en.write_blends(rows, {"x": F.col("a"), "y": F.col("a") + F.col("b")}, f"file://{tmp_path}/o")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs <= 1
    assert {(r.blend, r.id): r.rating for r in written.collect()} == {(b, i): round(i / 7 + (b == "y"), 6) for i in range(50) for b in "xy"}
    assert en.missing_predictions(written, ["x", "y"], rows).where("missing <> 0 OR extra <> 0").isEmpty()
    wrong = en.missing_predictions(written.where("NOT (blend = 'x' AND id < 3)"), ["x", "y", "z"], rows.where("id <> 9")).collect()
    assert {r.blend: (r.missing, r.extra) for r in wrong} == {"x": (3, 1), "y": (0, 1), "z": (49, 0)}


def test_store_lines_up_without_a_shuffle(spark, tmp_path):
    store = FeatureStore(spark, "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.put("base", spark.range(100).withColumn("x", F.col("id") * 2))
        store.put("even", spark.range(0, 100, 2).withColumn("y", F.lit(1)))
        store.put("gone", spark.range(3).withColumn("z", F.lit(1)))
        store.put("gone", spark.range(50).withColumn("z", F.col("id") + 1))
        out = store.aligned("base", ["even", "gone"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert {(r.id, r.x, r.y, r.z) for r in out.collect()} == {(i, 2 * i, 1 if i % 2 == 0 else None, i + 1 if i < 50 else None) for i in range(100)}
        assert "Exchange" not in store.repeats("even")._jdf.queryExecution().executedPlan().toString() and store.repeats("even").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        store.drop()


def test_blocks_of_features(spark, tmp_path):
    train = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "id long, x double")
    test = spark.createDataFrame([(4, 5.0)], "id long, x double")
    vec = spark.createDataFrame([(1, [1.0, None]), (4, [2.0, float("nan")]), (77, [9.0, 9.0])], "id long, v array<double>")
    got = {(r.split, r.id): r.features for r in assemble.assemble_blocks(train, test, ["x"], {"v": (vec, "v", 2)}, f"file://{tmp_path}/a").collect()}
    assert {k: v[1:] for k, v in got.items()} == {("train", 1): [1.0, 0.0], ("train", 2): [0.0, 0.0], ("train", 3): [0.0, 0.0], ("test", 4): [2.0, 0.0]}
    assert got["train", 1][0] == pytest.approx(-(1.5**0.5)) and got["train", 3][0] == pytest.approx(0)
    with pytest.raises(ValueError, match="more than once"):
        assemble.assemble_blocks(train, test, ["x"], {"v": (vec.unionByName(vec), "v", 2)}, f"file://{tmp_path}/b")
    with pytest.raises(Exception, match="should have 3 values"):
        assemble.assemble_blocks(train, test, ["x"], {"v": (vec, "v", 3)}, f"file://{tmp_path}/c")


def test_sketches_merge(spark):
    rng = np.random.default_rng(4)
    values = rng.exponential(size=20_000)
    rows = spark.createDataFrame([(int(i % 7), float(v), int(v * 1000)) for i, v in enumerate(values)], "g int, v double, k int").repartition(5)
    kept = sketches.sketch_groups(rows, ["g"], "v", "k")
    whole = sketches.asked(sketches.merged(kept), {"a": 0.1, "b": 0.9}).first()
    assert whole.n == 20_000 and abs(np.mean(values <= whole.a) - 0.1) < 0.01 and abs(np.mean(values <= whole.b) - 0.9) < 0.01
    exact = len({int(v * 1000) for v in values})
    assert abs(whole.n_distinct / exact - 1) < 0.06
    at_once = sketches.asked(sketches.sketch_groups(rows, [], "v", "k"), {"a": 0.1}).first()
    assert at_once.n_distinct == whole.n_distinct
    none = sketches.asked(sketches.sketch_groups(spark.createDataFrame([(1, None, None)], rows.schema), ["g"], "v", "k"), {"a": 0.1}).first()
    assert (none.a, none.n_distinct, none.n) == (None, 0, 1)


def test_metrics(spark, tmp_path):
    rows = spark.createDataFrame([(i, i if i % 3 else None) for i in range(30)], "id long, x long").repartition(2)
    found = io.write_observed(rows, f"file://{tmp_path}/m", valid=F.col("x") < 20, nulls=["x", "id"])
    assert found == {"rows": 30, "rejected": 17, "nulls": {"x": 10, "id": 0}} and spark.read.parquet(f"file://{tmp_path}/m").count() == 13
    assert io.merge_metrics({"a": {"b": 1, "c": {"d": 2}}, "x": 1}, {"a": {"c": {"e": 3}, "b": 4}, "y": {"z": 0}}) == {"a": {"b": 4, "c": {"d": 2, "e": 3}}, "x": 1, "y": {"z": 0}}
    assert io.merge_metrics({"a": 1}, {"a": {"b": 2}}) == {"a": {"b": 2}} and io.flat_metrics({"a": {"b": 2}, "c": 1}) == {"a.b": 2, "c": 1}


def test_steps_over_cells(spark, monkeypatch):
    """Several cells and packs a cell: one sum a node leaves a cell, degrees count ends without a name, SVD has no limit of items."""
    monkeypatch.setattr(graph, "CELL", 12)
    monkeypatch.setattr(graph, "PACK", 5)
    monkeypatch.setattr(graph, "HELD", 4)
    rng = random.Random(5)
    pairs = [(0, i) for i in range(30)] + [(rng.randrange(12), rng.randrange(30)) for _ in range(90)]
    rows = spark.createDataFrame([*pairs, (None, 3)], "user_id long, prod_id long")
    cells = graph.pair_cells(rows, 3)
    assert cells.side >= 3 and cells.packs.count() > cells.side**2 // 2
    counts = np.zeros((12, 30))
    for u, i in pairs:
        counts[u, i] += 1
    names = [f"u{u}" for u in range(12)] + [f"i{i}" for i in range(30)]
    a = np.block([[np.zeros((12, 12)), counts], [counts.T, np.zeros((30, 30))]])
    d = a.sum(axis=1)
    d[names.index("i3")] += 1
    assert {r.node: r.d for r in cells.degrees.collect()} == {n: x for n, x in zip(names, d, strict=True) if x}
    e, start = node_vectors(spark, names[1:], 3)  # u0 has no vector
    x = np.stack([np.zeros(3)] + [e[n] for n in names[1:]])
    a = a / np.sqrt(np.maximum(np.outer(d, d), 1))
    want = dict(zip(names, (x + a @ x + a @ a @ x) / 3, strict=True))
    got = {r.node: r.e for r in graph.propagate(None, start, 3, layers=2, adjacent=cells).collect()}
    assert got.keys() == {n for n, y in zip(names, d, strict=True) if y or n in e} and all(np.allclose(got[n], want[n]) for n in got)
    rows = rows.where("user_id IS NOT NULL")
    vectors, share = graph.svd_start(rows, dims=4, passes=8)
    _, s, vt = np.linalg.svd(counts)
    assert abs(share - (s[:4] ** 2).sum() / (counts**2).sum()) < 1e-9
    got = {r.node: np.array(r.e) for r in vectors.collect()}
    for n in range(4):
        column = np.array([got.get(f"i{i}", np.zeros(4))[n] for i in range(30)])
        assert np.allclose(np.abs(column), np.abs(vt[n]) * s[n] ** 0.5, atol=1e-6) and column[np.abs(column).argmax()] > 0


def test_trees_on_cells_are_those_on_rows(spark):
    """Boosted trees on weighted cells of bins predict what Spark ML's trees on all binned rows predict, early stopping included; repeated rows add none."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 3000), rng.normal(size=3000).round(1)
    y = np.clip(np.round(3 + 0.4 * (a - 4) * (b > 0) + rng.normal(size=3000) * 0.5), 1, 5)
    rows = spark.createDataFrame([(i, float(p), float(q), float(r)) for i, (p, q, r) in enumerate(zip(a, b, y, strict=True))], "id long, a double, b double, y double").repartition(3)
    got = trees.boosted(["a", "b"], "y", 12, 3)(rows)
    edges = trees.bin_edges(rows, ["a", "b"])
    assert edges[0] == [i + 0.5 for i in range(8)] and len(edges[1]) <= trees.BINS - 1
    x = [(int(i), float(np.searchsorted(edges[0], p)), float(np.searchsorted(edges[1], q)), float(r)) for i, (p, q, r) in enumerate(zip(a, b, y, strict=True))]
    binned = spark.createDataFrame(x, "id long, a double, b double, y double").withColumn("v", F.pmod(F.xxhash64("id", F.lit(42)), F.lit(10)) == 0)
    put = VectorAssembler(inputCols=["a", "b"], outputCol="x")
    model = GBTRegressor(featuresCol="x", labelCol="y", maxIter=12, maxDepth=3, stepSize=0.1, validationIndicatorCol="v", seed=42).fit(put.transform(binned))
    want = {r.id: r.prediction for r in model.transform(put.transform(binned)).collect()}
    assert got.report["trees"] == model.getNumTrees
    assert all(r.p == pytest.approx(want[r.id], abs=1e-6) for r in got.predict(rows, "p").collect())
    flagged = binned.select("a", "b", "v", "y")
    once, often = (trees.bin_cells(df, ["a", "b"], "y", "v").orderBy("a", "b", "v", "y").collect() for df in (flagged, flagged.unionByName(flagged).unionByName(flagged)))
    assert len(once) == len(often) <= 2 * 2 * 9 * trees.BINS
    assert sum(r["__w"] for r in once) == 3000 and sum(r["__w"] for r in often) == 9000
    assert sum(r["__w"] * r.y**2 for r in often) == pytest.approx(3 * float((y**2).sum()))


def test_blocks_compute_the_numbers_once(spark, tmp_path):
    """Scaling, statistics and the written blocks read one written copy of the splits' numbers; whole vectors are not sorted into folders."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    train = spark.createDataFrame([(i, float(i)) for i in range(7)], "id long, x double").withColumn("x", counted.asNondeterministic()("x"))
    test = spark.createDataFrame([(9, 5.0)], "id long, x double")
    vec = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    got = assemble.assemble_blocks(train, test, ["x"], {"v": (vec, "v", 2)}, f"file://{tmp_path}/a")
    assert got.groupBy("split").count().orderBy("split").collect() == [("test", 1), ("train", 7)]
    assert seen.value == 7
    assert not list((tmp_path / "a").glob("split=*"))


def test_ordinal_models_share_their_passes(spark):
    """All folds' and cuts' models are those of Spark ML, one at a time; a pass serves all of them. Rows of other folds are learned from, rows without one are left out."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [1.0, 5e4] + [0.0, 2e5]
    y = np.clip(np.round(3 + x[:, 0] + rng.normal(size=400)), 1, 4)
    folds_of = [None if i % 40 == 7 else 9 if i % 40 == 8 else i % 3 for i in range(400)]
    rows = spark.createDataFrame([(i, f, float(r), None if i % 50 == 4 else float(a), float(b), 2.5) for i, (f, r, (a, b)) in enumerate(zip(folds_of, y, x, strict=True))], "id long, fold int, rating double, a double, b double, flat double").repartition(3)
    context, names = spark.sparkContext, ["a", "b", "flat"]
    context.setJobGroup("ordinal", "")
    got = {r.id: r.pred for r in linear.ordinal_oof(rows, names, k=3).collect()}
    context.setJobGroup("other", "")
    assert len(context.statusTracker().getJobIdsForGroup("ordinal")) < 30
    filled = VectorAssembler(inputCols=names, outputCol="x").transform(rows.fillna(0.0, names))
    assert got.keys() == {i for i, f in enumerate(folds_of) if f in (0, 1, 2)}
    for f in range(3):
        fit, own = filled.where(F.col("fold") != f), filled.where(F.col("fold") == f)
        want = dict.fromkeys([r.id for r in own.collect()], 1.0)
        for t in range(4):  # nothing exceeds 4: the last model is constant
            model = LogisticRegression(featuresCol="x", labelCol="t", maxIter=200, regParam=0.01, tol=1e-12).fit(fit.withColumn("t", (F.col("rating") - 1 > t).cast("double")))
            for r in model.transform(own).collect():
                want[r.id] += r.probability[1]
        assert all(got[i] == pytest.approx(p, abs=1e-6) for i, p in want.items())
    with pytest.raises(ValueError, match="nulls"):
        linear.ordinal_oof(rows.withColumn("rating", F.when(F.col("id") > 0, F.col("rating"))), names, k=3)


def test_wide_vectors_come_in_chunks(spark, monkeypatch):
    """Wide vectors reach a cell some dimensions at a time; they neither make more cells nor larger tasks, and several pieces a block add up."""
    monkeypatch.setattr(graph, "SIDE", 90)
    monkeypatch.setattr(graph, "HELD", 4)
    rng = random.Random(7)
    pairs = [(rng.randrange(12), rng.randrange(30)) for _ in range(150)]
    cells = graph.pair_cells(spark.createDataFrame(pairs, "user_id long, prod_id long"), 24)
    assert cells.side == 1
    counts = np.zeros((12, 30))
    for u, i in pairs:
        counts[u, i] += 1
    names = [f"u{u}" for u in range(12)] + [f"i{i}" for i in range(30)]
    a = np.block([[np.zeros((12, 12)), counts], [counts.T, np.zeros((30, 30))]])
    d = a.sum(axis=1)
    a = a / np.sqrt(np.maximum(np.outer(d, d), 1))
    e, start = node_vectors(spark, [*names, "u99"], 24)  # u99 has no edge
    x = np.stack([e[n] for n in names])
    got = {r.node: r.e for r in graph.propagate(None, start.repartition(3), 24, layers=2, adjacent=cells).collect()}
    want = dict(zip(names, (x + a @ x + a @ a @ x) / 3, strict=True))
    assert got.keys() == {n for n, y in zip(names, d, strict=True) if y} | set(names) | {"u99"}
    assert all(np.allclose(got[n], want[n]) for n in names) and np.allclose(got["u99"], e["u99"] / 3)


def test_draws_read_the_pairs_a_fixed_number_of_times(spark):
    """However often negatives are drawn again, all pairs are read thrice; draws after the first read what its users have."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    pairs = [(1, i) for i in range(15)] + [(2 + i % 3, i) for i in range(16)]  # user 1 has 15 of 16 items
    rows = spark.createDataFrame(pairs, "user_id long, prod_id long")
    lazily = rows.withColumn("prod_id", counted.asNondeterministic()("prod_id"))
    got = graph.with_negatives(lazily, rows, "user_id", "prod_id").collect()
    assert seen.value <= 3 * len(pairs) and not [r for r in got if (r.user_id, r.neg) in pairs]
    assert len({(r.user_id, r.prod_id) for r in got}) == len(got) > 16 and all(r.neg == 15 for r in got if r.user_id == 1)


def test_products_of_dealt_rows_and_of_cells(spark, monkeypatch):
    """The ranking loss's products are the same whether tasks get all vectors or cells of them; nodes without a name or vector are left out."""
    e, vectors = node_vectors(spark, ["u1", "u2", "u3", "i1", "i2", "i3"], 4)
    triples = [("u1", "i1", "i2"), ("u2", "i3", "i1"), ("u3", "i2", "i3"), ("u9", "i1", "i2"), ("u1", None, "i2"), ("u1", "i1", "i9")]
    df = spark.createDataFrame(triples, "user string, pos string, neg string")
    want = {(u, i, j): e[u] @ e[i] - e[u] @ e[j] for u, i, j in triples[:3]}
    monkeypatch.setattr(graph, "CELL", 2)
    for whole in (1 << 24, 0):
        monkeypatch.setattr(graph, "WHOLE", whole)
        got = {(r.user, r.pos, r.neg): r.gap for r in graph.gaps(df, vectors).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_pairs_of_words_come_from_one_search(spark):
    """A text is searched for words once; weights from the vocabulary's terms alone are those of weigh()."""
    docs = spark.createDataFrame([(1, "the red fox saw the red hen"), (2, "the red hen"), (3, ""), (4, None), (5, "x y")], "doc_id long, text string")
    plan = docs.select(tfidf.words_and_pairs(F.col("text")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    counts = tfidf.term_counts(docs, "doc_id", "text", tfidf.words_and_pairs)
    want = {(r.doc_id, r.term): r.weight for r in tfidf.weigh(counts, tfidf.vocabulary(counts, "doc_id", 6), "doc_id").collect()}
    got = {(r.doc_id, r.term): r.weight for r in tfidf.term_weights(docs, "doc_id", "text", 6, tfidf.words_and_pairs).collect()}
    assert got.keys() == want.keys() and len({t for _, t in got}) == 6 and all(got[k] == pytest.approx(want[k]) for k in want)
