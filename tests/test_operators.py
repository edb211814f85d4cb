"""Edge cases of cleaning, joins, vectors, graph, blending, calibration, models and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.functions import lexicon as lx, scalar, vectors
from starling.operators import assemble, ensemble as en, graph, joins, linear, stacking, stats, tfidf
from starling.sources import io


def one(df):
    return df.first()


def test_clean_text(spark):
    rows = spark.createDataFrame([("<b>Hi</b> https://x.y/z THERE\n\n~ok~ don't!",), (None,), ("",), ("...",)], "t string")
    assert [r.c for r in rows.select(scalar.clean_text(F.col("t")).alias("c")).collect()] == ["hi there ok don't!", None, "", "..."]


def test_text_stats_of_empty_and_marks(spark):
    rows = spark.createDataFrame([("",), (None,), ("!!",), ("A1 b",)], "t string")
    got = rows.select(*[x.alias(c) for c, x in scalar.text_stats(F.col("t")).items()]).collect()
    assert [(r.chars, r.words) for r in got] == [(0, 0), (0, 0), (2, 1), (4, 2)]
    assert got[2].punct_ratio == 1.0 and got[3].upper_ratio == 0.25 and got[3].digit_ratio == 0.25


def test_text_stats_replace_only_what_they_count(spark):
    rows = spark.createDataFrame([("\t\u00c4B-\U0001f600[~]\u000b9 9\n",)], "t string").select(*[x.alias(c) for c, x in scalar.text_stats(F.col("t")).items()])
    assert tuple(one(rows)) == (13, 3, 4 / 13, 1 / 13, 2 / 13)
    assert "[^" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_flags_numbers_lists(spark):
    rows = spark.createDataFrame([("True", "1.5", "['a', 'bcd']"), ("4", "abc", "not a list"), (None, None, None), ("yes", "", "[]"), ("1", "1", """["it's", 'a "b"', 'c\\'d', ]"""), ("1", "1", "['open"), ("1", "1", '["a", null]')], "f string, n string, l string")
    got = rows.select(scalar.flag(F.col("f")).alias("f"), scalar.number(F.col("n")).alias("n"), *[x.alias(c) for c, x in scalar.list_features(F.col("l")).items()]).collect()
    assert [(r.f, r.n, r.n_items, r.total_len) for r in got] == [(1, 1.5, 2, 4), (0, 0.0, 0, 0), (0, 0.0, 0, 0), (1, 0.0, 0, 0), (1, 1.0, 3, 12), (1, 1.0, 0, 0), (1, 1.0, 2, 1)]


def test_csv_rejects_and_quarantine(spark, tmp_path):
    rows = [("a", "5", 'multi\nline "quoted", text'), ("b", "abc", "x"), ("c", "0", "y"), ("d", "6", "z"), ("e", None, "w"), ("f", "1", None)]
    path = f"file://{tmp_path}/csv"
    io.write_csv(spark.createDataFrame(rows, "id string, rating string, text string"), path)
    read = io.cast_columns(io.read_text_csv(spark, path, ["id", "rating", "text"]), {"rating": "double"})
    good, bad = io.reject_rows(read, F.col("rating").between(1, 5))
    assert sorted(r.id for r in good.collect()) == ["a", "f"] and sorted(r.id for r in bad.collect()) == ["b", "c", "d", "e"]
    assert [r.text for r in good.collect() if r.id == "a"] == ['multi\nline "quoted", text']


def test_dimension_join_keeps_rows_and_prefixes(spark):
    facts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "w")], "k long, title string")
    dim = spark.createDataFrame([(1, "p", 3.0), (1, "q", 2.0), (2, "r", None)], "k long, title string, price double")
    out = joins.join_dimension(facts, joins.unique_dimension(dim, "k", ["price", "title"]), "k")
    assert out.columns == ["k", "title", "pi_title", "price"] and out.count() == 4
    assert {r.k: r.pi_title for r in out.collect()} == {1: "q", 2: "r", 3: None, None: None}


def test_store_features_without_store(spark):
    rows = spark.createDataFrame([(1, "s", 2.0), (2, None, 5.0), (3, "s", 4.0)], "p long, store string, v double")
    got = {r.p: (r.n_items, r.total_value, r.has_store) for r in stats.store_features(rows, "p", "store", "v").collect()}
    assert got == {1: (2, 6.0, 1), 2: (0, 0.0, 0), 3: (2, 6.0, 1)}


def test_single_row_deviation_is_zero(spark):
    rows = spark.createDataFrame([(1, 4), (2, 1), (2, 5)], "user_id long, rating int")
    assert {r.user_id: round(r.std_rating, 6) for r in stats.extended_stats(rows, "user_id").collect()} == {1: 0.0, 2: round(8**0.5, 6)}


def test_char_grams_of_short_words(spark):
    rows = spark.createDataFrame([(1, "ab abc"), (2, None)], "d long, t string")
    got = {r.term: r.tf for r in tfidf.char_counts(rows, "d", "t").collect()}
    assert got == {" ab": 2, "ab ": 1, " ab ": 1, "abc": 1, "bc ": 1, " abc": 1, "abc ": 1, " abc ": 1}


def test_weights_have_length_one(spark):
    rows = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, "")], "d long, t string")
    counts = tfidf.term_counts(rows, "d", "t")
    w = tfidf.weigh(counts, tfidf.vocabulary(counts, "d", 10), "d").groupBy("d").agg(F.sum(F.col("weight") ** 2).alias("n"))
    assert {r.d: round(r.n, 9) for r in w.collect()} == {1: 1.0, 2: 1.0}


def test_truncated_svd_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 12)) + 0.01 * rng.normal(size=(60, 12))
    rows = spark.createDataFrame([(i, list(range(12)), [float(v) for v in r]) for i, r in enumerate(x)], "d long, idx array<int>, val array<double>").repartition(3)
    v, s = tfidf.truncated_svd(rows, 12, 3)
    _, want, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, want[:3], rtol=1e-6) and np.allclose(np.abs((v.T @ vt[:3].T)), np.eye(3), atol=1e-6)
    assert abs(tfidf.explained_share(rows, s) - (want[:3] ** 2).sum() / (x**2).sum()) < 1e-9
    got = {r.d: r.embedding for r in tfidf.project(rows, v, "d").collect()}
    assert np.allclose(got[7], x[7] @ v, atol=1e-4)


def test_propagation_by_hand(spark):
    star = spark.createDataFrame([(0, i) for i in range(5)] + [(0, 0)], "user_id long, prod_id long")
    edges = graph.bipartite_edges(star)
    assert edges.where("src = 'u0' AND dst = 'i0'").first().w == 2.0
    norm = {(r.src, r.dst): r.w for r in graph.normalized(edges).collect()}
    assert abs(norm["u0", "i1"] - 1 / 6**0.5) < 1e-12 and abs(norm["i0", "u0"] - 2 / 12**0.5) < 1e-12
    start = spark.createDataFrame([("u0", [1.0])] + [(f"i{i}", [0.0]) for i in range(5)], "node string, e array<double>")
    out = {r.node: r.e[0] for r in graph.propagate(graph.normalized(edges), start, 1, layers=1).collect()}
    assert abs(out["u0"] - 0.5) < 1e-12 and abs(out["i1"] - 0.5 / 6**0.5) < 1e-12


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "k long, v array<float>")
    assert [r.n for r in rows.select(vectors.norm(F.col("v")).alias("n")).collect()] == [5.0, 0.0]
    assert one(vectors.norm_health(rows, "v")).n_near_zero == 1
    missing = spark.createDataFrame([(1,), (9,)], "k long")
    assert {r.k: list(r.v) for r in vectors.lookup(missing, rows, "k", "v", 2).collect()} == {1: [3.0, 4.0], 9: [0.0, 0.0]}


def test_variance_expansion(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, float(p), float(3 + 2 * (p - 3) + e)) for i, (p, e) in enumerate(zip(rng.normal(3, 0.2, 200), rng.normal(0, 0.3, 200)))], "id long, p double, y double")
    out = en.expand_variance(rows, "p", target="y", clip=False).agg(F.avg("expanded").alias("m"), F.stddev_pop("expanded").alias("s"), F.avg("y").alias("ym"), F.stddev_pop("y").alias("ys")).first()
    assert abs(out.m - out.ym) < 1e-9 and abs(out.s - out.ys) < 1e-9
    flat = en.expand_variance(spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, p double"), "p", std=F.lit(1.0))
    assert [r.expanded for r in flat.collect()] == [2.0, 2.0]


def test_ridge_equals_normal_equations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = 3 + x @ [0.3, -0.2, 0.1] + rng.normal(0, 0.1, 300)
    rows = spark.createDataFrame([(i, i % 5, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, fold long, a double, b double, c double, rating double")
    got = {r.id: r.pred for r in linear.ridge_oof(rows, ["a", "b", "c"], alpha=2.0).collect()}
    for f in range(5):
        fit = np.arange(300) % 5 != f
        m, t = x[fit].mean(axis=0), y[fit].mean()
        w = np.linalg.solve((x[fit] - m).T @ (x[fit] - m) + 2 * np.eye(3), (x[fit] - m).T @ (y[fit] - t))
        for i in np.flatnonzero(~fit):
            assert abs(got[int(i)] - min(5, max(1, (x[i] - m) @ w + t))) < 1e-9
    grams = linear.fold_grams(rows, ["a", "b", "c"])
    grid = linear.ridge_grid(grams, ["a", "b", "c"], [2.0])
    assert abs(grid[0][2] - np.sqrt(np.mean([(got[i] - y[i]) ** 2 for i in range(300)]))) < 1e-6


def test_elastic_net_equals_plain_gradient_descent(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) @ np.array([[1, 0.5, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0.2], [0, 0, 0, 1]])
    y = 3 + x @ [0.5, 0.0, -0.4, 0.01] + rng.normal(0, 0.1, 200)
    rows = spark.createDataFrame([(i, i % 5, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, fold long, a double, b double, c double, d double, rating double")
    grams = linear.fold_grams(rows, ["a", "b", "c", "d"])
    got = linear.solve_elastic_net(linear.without(grams, 0), 0.1, 0.5)
    fit = np.arange(200) % 5 != 0
    xc, yc, w = x[fit] - x[fit].mean(axis=0), y[fit] - y[fit].mean(), np.zeros(4)
    for _ in range(20_000):  # proximal steps
        w = w - 0.1 * (-(xc.T @ (yc - xc @ w)) / fit.sum() + 0.05 * w)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 * 0.05, 0)
    assert np.allclose(got[1:], w, atol=1e-6) and got[4] == 0.0 and abs(got[0] - (y[fit].mean() - x[fit].mean(axis=0) @ w)) < 1e-6
    grid = linear.elastic_net_grid(grams, [0.1], [0.5])
    oof = linear.elastic_net_oof(rows, ["a", "b", "c", "d"], 0.1, 0.5).agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("rating"), 2))).alias("r")).first().r
    assert abs(grid[0][2] - oof) < 1e-6


def test_scoring_sides_and_submission(spark, tmp_path):
    rng = np.random.default_rng(6)
    values = [(i, i % 5, *map(float, rng.uniform(1, 5, 2))) for i in range(600)]
    train = spark.createDataFrame([(*v, min(5.0, max(1.0, 0.7 * v[2] + 0.3 * v[3]))) for v in values], "id long, fold long, a double, b double, y double")
    test = spark.createDataFrame([(1000 + i, *map(float, rng.uniform(1, 5, 2))) for i in range(50)], "id long, a double, b double")
    result = stacking.stack(train, test, ["a", "b"], rounds=3)
    assert result.test.columns == ["id", "ridge", "elastic_net", "gbt", "ridge_gbt"] and result.test.count() == 50 and result.train.count() == 600
    for r in result.test.join(test, "id").collect():
        assert abs(r.ridge - (0.7 * r.a + 0.3 * r.b)) < 0.05 and all(1 <= r[c] <= 5 for c in result.test.columns[1:])
    assert [round(c, 1) for _, c in result.coefficients] == [0.0, 0.7, 0.3] and one(result.scores.where("is_best")).model == result.best
    out = {r.id: r.rating for r in stacking.submission(result, test, f"file://{tmp_path}/out").collect()}
    assert out.keys() == {1000 + i for i in range(50)} and all(1 <= v <= 5 for v in out.values())
    with pytest.raises(ValueError):
        stacking.submission(result, test.union(test.limit(1).withColumn("id", F.lit(7).cast("long"))), f"file://{tmp_path}/more")


def test_pair_statistics_read_the_rows_once(spark, tmp_path):
    rows = [("u", "i", "c", 5), ("u", "i", "c", 3), ("u", "j", None, None), ("v", "i", "c", 1), (None, "j", "d", 2), ("w", None, "c", 4)]
    path = f"file://{tmp_path}/rows"
    spark.createDataFrame(rows, "user_id string, prod_id string, main_category string, rating int").write.parquet(path)
    out = graph.stat_features(spark.read.parquet(path))
    got = {(r.user_id, r.prod_id): r for r in out.collect()}
    assert len(got) == 5 and str(tmp_path) not in " ".join(out.inputFiles())
    r = got["u", "i"]
    assert (r.user_mean, r.user_count, r.user_deviation, r.item_mean, r.item_count, r.item_std, r.category_mean, r.category_count) == (4.0, 3, 1.0, 3.0, 3, 2.0, 3.25, 4)
    assert got["u", "j"].item_mean == 2.0 and got["u", "j"].category_mean is None and got["w", None].user_deviation is None and got[None, "j"].user_mean is None


def test_common_words_of_a_lexicon_are_not_shuffled(spark):
    words = spark.createDataFrame([("the", 1.0, 9), ("a", -1.0, 8), ("rare", 2.0, 3), ("odd", -2.0, 3)], "word string, valence double, n_docs long")
    docs = spark.createDataFrame([(1, "The\u000bthe  a\tRARE none"), (2, " the ODD odd "), (3, None)], "d long, t string")
    whole, parted = (lx.scored_tokens(docs, "d", "t", words, most=most) for most in (4, 2))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parted.collect())) == [(1, "a", -1.0), (1, "rare", 2.0), (1, "the", 1.0), (1, "the", 1.0), (2, "odd", -2.0), (2, "odd", -2.0), (2, "the", 1.0)]
    plan = lx.valence(docs, "d", "t", words)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" not in plan and "BroadcastHashJoin [word" in plan


def test_lexicons_of_thousands_of_words(spark, tmp_path):
    words = [(f"w{i}", (i % 9) - 4.0, ((i % 9) - 4) / 4, 0.5) for i in range(5000)]
    spark.createDataFrame(words, "word string, valence double, polarity double, subjectivity double").write.parquet(f"file://{tmp_path}/lexicon")
    lexicon = lx.read_lexicon(spark, f"file://{tmp_path}/lexicon")
    docs = spark.createDataFrame([(1, "W8 w0 w4 other w8"), (2, None), (3, "nothing here")], "d long, t string")
    assert {r.d: (r.pos_hits, r.neg_hits) for r in lx.table_hits(docs, "d", "t", lexicon).collect()} == {1: (1, 1), 2: (0, 0), 3: (0, 0)}
    got = {r.d: r for r in lx.valence(docs, "d", "t", lexicon).collect()}
    assert abs(got[1].compound - 4 / (16 + 15) ** 0.5) < 1e-12 and got[2].compound == 0.0 and got[3].neu == 1.0
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, y int")
    texts = spark.createDataFrame([(i, "good all" if i % 2 else "bad all all") for i in range(8)], "doc_id long, text string")
    learned = {r.word: r.valence for r in lx.learned_lexicon(texts, labels, "y").collect()}
    assert learned == {"good": 4.0, "bad": -4.0}


def test_accents(spark):
    rows = spark.createDataFrame([("Crème brûlée ÑANDÚ Ångström ß øre e\u0301t\u0065\u0301",)], "t string")
    assert one(rows.select(tfidf.plain_words(F.col("t")).alias("w"))).w == ["creme", "brulee", "nandu", "angstrom", "re", "ete"]


def test_svd_start_and_negatives(spark):
    pairs = [(u, i) for u in range(12) for i in range(9) if (u * 7 + i * 3) % 4 < 2 and u % 3 == i % 3]
    rows = spark.createDataFrame(pairs, "user_id long, prod_id long")
    vectors, share = graph.svd_start(rows, dims=3)
    x = np.zeros((12, 9))
    for u, i in pairs:
        x[u, i] = 1
    assert abs(share - (np.linalg.svd(x)[1][:3] ** 2).sum() / (x**2).sum()) < 1e-6 and vectors.count() == len({u for u, _ in pairs}) + len({i for _, i in pairs})
    drawn = graph.with_negatives(rows, rows, "user_id", "prod_id").collect()
    assert len(drawn) == len(pairs) and {r.neg for r in drawn} <= {i for _, i in pairs}
    with pytest.raises(ValueError):
        graph.svd_start(rows, most_items=2)


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1)], "s double, l int")
    assert one(en.auc(rows, "s", "l")).auc == 0.875


def test_scaler_constant_and_missing(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (3.0, 2.0)], "a double, b double")
    out = assemble.apply_scaler(rows, assemble.fit_scaler(rows, ["a", "b"]), ["a", "b"])
    assert [r.b for r in out.collect()] == [0.0] * 3 and abs(sum(r.a for r in out.collect())) < 1e-12
    assert {r.column: r.n_bad for r in assemble.null_audit(rows, ["a", "b"]).collect()} == {"a": 1, "b": 0}
    with pytest.raises(ValueError):
        assemble.require(rows, ["a", "z"])


def test_materialize_reuses_finished_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert io.materialize(spark.range(3), path).count() == 3
    assert io.materialize(spark.range(9), path).count() == 3
    assert io.materialize(spark.range(9), path, reuse=False).count() == 9


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=300).round(2), np.zeros(200)]
    rows = spark.createDataFrame([(float(v), None if i % 7 else float(i)) for i, v in enumerate(x)], "a double, b double").repartition(5)
    got = one(stats.quantiles(rows, {"m": ("a", 0.5), "p": ("a", 0.99), "lo": ("a", 0.0), "hi": ("a", 1.0), "b": ("b", 0.3)}))
    some = [float(i) for i in range(500) if i % 7 == 0]
    assert np.allclose([got.m, got.p, got.lo, got.hi, got.b], [*np.quantile(x, [0.5, 0.99, 0, 1]), np.quantile(some, 0.3)])
    assert one(stats.quantiles(rows.limit(0), {"m": ("a", 0.5)})).m is None
    near = stats.median_fill(rows.withColumn("a", F.when(F.col("b").isNull(), F.col("a"))), ["a"], fit_on=rows, exact=False).where("b IS NOT NULL").first().a
    assert (x < near).mean() <= 0.51 and (x <= near).mean() >= 0.49


def test_dense_ranks(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", None), (None, 2.0), (None, 1.0), ("b", 9.0)], "g string, v double").repartition(4)
    got = sorted(((r.g, r.v, r.rank) for r in stats.dense_ranks(rows, "g", "v", "rank").collect()), key=str)
    assert got == sorted([("a", 3.0, 2), ("a", 1.0, 1), ("a", 3.0, 2), ("a", None, 3), (None, 2.0, 2), (None, 1.0, 1), ("b", 9.0, 1)], key=str)


def test_grid_equals_single_blends(spark, monkeypatch):
    monkeypatch.setattr(en, "GRID_CELLS", 30)
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in rng.uniform(0, 6, (100, 4))] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double")
    points = en.simplex(["a", "b", "c"], 4)
    got = {r.idx: r.rmse for r in en.score_blends(rows, points).collect()}
    known = rows.where("a IS NOT NULL")
    want = known.agg(*[en.rmse(en.blend(w), F.col("y")).alias(str(i)) for i, w in enumerate(points)]).first()
    assert np.allclose([got[i] for i in range(len(points))], list(want))


def test_assembly_fails_on_missing_columns_and_scratch_is_removed(spark, tmp_path):
    import os

    rows = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 2.0)], "id long, a double, b double")
    out = assemble.assemble(rows, rows.limit(1), ["a", "b"], f"file://{tmp_path}/out")
    assert sorted((r.split, r.id, list(r.features)) for r in out.collect())[1:] == [("train", 1, [-1.0, 0.0]), ("train", 2, [1.0, 0.0])]
    with pytest.raises(ValueError):
        assemble.assemble(rows, rows.drop("b"), ["a", "b"], f"file://{tmp_path}/more")
    path = io.scratch(spark, "gone")
    rows.write.parquet(path)
    assert io.remove_scratch(spark) >= 1 and not os.path.exists(path.removeprefix("file://"))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, user_id long, rating int, votes double, purchased boolean, price double, fold long")
    assert stats.user_stats(empty).count() == 0
    assert stats.missing_rates(empty, ["price"]).first().missing_pct is None
    assert en.auc(spark.createDataFrame([], "s double, l int"), "s", "l").first().auc is None


def test_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Counts and lengths by document need no shuffle but that of the texts; grams of a document none; repeated and null keys make one document."""
    docs = spark.createDataFrame([(1, "red red green"), (1, "redder"), (2, "green tea"), (None, "tea"), (None, "red"), (3, None), (4, "a")], "d long, t string")
    counts = tfidf.term_counts(docs, "d", "t")
    vocab = tfidf.vocabulary(counts, "d", 10)
    spark.createDataFrame([("red", 1.5)], "term string, idf double").write.parquet(f"file://{tmp_path}/v")
    fixed = spark.read.parquet(f"file://{tmp_path}/v")
    for df in (tfidf.weigh(counts, fixed, "d"), tfidf.hashed_counts(docs, "d", "t")):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert vocab.count() == 4
    monkeypatch.setattr(tfidf, "WORDS", 2)
    grams = tfidf.char_counts(docs, "d", "t")
    want = {(r.d, r.term): r.weight for r in tfidf.weigh(grams, tfidf.vocabulary(grams, "d", 12), "d").collect()}
    got = {(r.d, r.term): r.weight for r in tfidf.char_weights(docs, "d", "t", 12).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "Exchange hashpartitioning(term" not in tfidf.char_weights(docs, "d", "t", 12)._jdf.queryExecution().executedPlan().toString()
    assert tfidf.char_weights(docs.limit(0), "d", "t", 12).count() == 0


def test_sparse_rows_count_only_the_vocabulary(spark, monkeypatch):
    """The same vocabulary and weights as by counts of all terms; what is written has no other term; repeated and null keys make one document."""
    docs = spark.createDataFrame([(1, "Red red green"), (1, "redder green"), (2, "green tea tea"), (None, "tea"), (None, "red"), (3, None), (4, "a"), (5, "rare"), (6, "")], "d long, t string")
    seen, plain = [], tfidf.materialize
    monkeypatch.setattr(tfidf, "materialize", lambda df, path: seen.append(plain(df, path)) or seen[-1])
    vocab, rows = tfidf.sparse_rows(docs, "d", "t", 3)
    counts = tfidf.term_counts(docs, "d", "t")
    want = tfidf.vocabulary(counts, "d", 3)
    assert {r.term: (r.cf, r.df, round(r.idf, 12)) for r in vocab.collect()} == {r.term: (r.cf, r.df, round(r.idf, 12)) for r in want.collect()}
    expected = {r.d: (r.idx, r.val) for r in tfidf.indexed(tfidf.weigh(counts, want, "d"), want, "d").collect()}
    got = {r.d: (r.idx, r.val) for r in rows.collect()}
    assert got.keys() == expected.keys() == {1, 2, None}
    assert all(got[d][0] == idx and np.allclose(got[d][1], val) for d, (idx, val) in expected.items())
    assert all(df.count() <= 4 for df in seen)
    assert tfidf.sparse_rows(docs.limit(0), "d", "t", 3)[1].count() == 0
