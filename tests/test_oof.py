"""Leak-freedom, negative tests and partition invariance of the out-of-fold operators."""

import pytest
from pyspark.sql import functions as F

from starling.operators import oof
from starling.sources.views import fold

ROWS = [(1, 1, 5), (2, 1, 3), (3, 1, 4), (4, 1, 1), (5, 1, 2), (6, 2, 5), (7, 2, 5), (8, 2, 1), (9, 3, 4), (10, 3, 2), (11, 4, 3)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, u, r, i % 3) for i, u, r in ROWS], "id long, user_id long, rating int, fold long")


def direct(k):
    out = {}
    for i, u, _ in ROWS:
        others = [r for j, v, r in ROWS if v == u and j % k != i % k]
        out[i] = (sum(others) / len(others) if others else None, len(others))
    return out


@pytest.mark.parametrize("k", [2, 3, 5, 20])
def test_mean_and_count_by_hand(spark, k):
    df = spark.createDataFrame([(i, u, r, i % k) for i, u, r in ROWS], "id long, user_id long, rating int, fold long")
    got = {r.id: (r.oof_mean, r.oof_count) for r in oof.oof_stats(df, "user_id", k=k).collect()}
    for i, (mean, n) in direct(k).items():
        assert got[i][1] == n and (got[i][0] is None if mean is None else abs(got[i][0] - mean) < 1e-12)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partitioning_changes_nothing(spark, rows, parts):
    got = sorted((r.id, round(r.te, 12)) for r in oof.target_encode(rows.repartition(parts), "user_id", k=3).collect())
    assert got == sorted((r.id, round(r.te, 12)) for r in oof.target_encode(rows, "user_id", k=3).collect())


def test_single_row_keys_have_no_value_and_get_the_prior(rows):
    stats = {r.id: r for r in oof.oof_stats(rows, "user_id", k=3).collect()}
    assert stats[11].oof_mean is None and stats[11].oof_count == 0 and stats[11].oof_std is None
    encoded = {r.id: r for r in oof.target_encode(rows, "user_id", k=3).collect()}
    assert abs(encoded[11].te - sum(r for _, _, r in ROWS) / len(ROWS)) < 1e-12


def test_unseen_scoring_keys_get_the_mean(spark, rows):
    test = spark.createDataFrame([(100, 99), (101, 1)], "id long, user_id long")
    got = {r.id: r for r in oof.target_encode_scoring(test, rows, "user_id", smoothing=0.0).collect()}
    assert abs(got[100].te - sum(r for _, _, r in ROWS) / len(ROWS)) < 1e-12 and got[100].te_count == 0
    assert abs(got[101].te - 3.0) < 1e-12


def test_leak_checks_pass_and_catch_a_leak(rows):
    good = oof.oof_stats(rows, "user_id", k=3)
    assert oof.leak_check_full(good, "user_id").first().n_violations == 0
    assert oof.leak_check_pairs(good, "user_id").first().n_violations == 0
    means = rows.groupBy("user_id").agg(F.avg("rating").alias("oof_mean"))
    leaky = rows.join(means, "user_id")
    assert oof.leak_check_full(leaky, "user_id").first().n_violations > 0
    assert oof.leak_check_pairs(leaky, "user_id").first().n_violations > 0


def test_row_counts_stay(spark, rows):
    for df in (oof.oof_stats(rows, "user_id", k=3), oof.target_encode(rows, "user_id", k=3), oof.leniency(rows, k=3), oof.deviations(rows, {"user": "user_id"}, k=3)):
        assert df.count() == len(ROWS)
    assert oof.target_encode(rows, "user_id", k=3, noise=0.01).count() == len(ROWS)


def test_both_join_sides_are_shuffled(spark, rows):
    """One exchange makes the slots, one on either side of the join brings the rows: adaptive execution may split a hot key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for k in (5, 12):
            plan = oof.oof_stats(rows, "user_id", k=k)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Exchange hashpartitioning(user_id") == 3
            assert sum("Exchange" in line and "__salt" in line for line in plan.splitlines()) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_encodings_do_not_repeat_each_others_joins(spark, rows):
    """Three keys, three joins: the sums of each come from the rows themselves."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = oof.safe_target_encode(rows, {"a": "user_id", "b": ["user_id", "fold"], "c": "fold"}, k=3)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and plan.count("BroadcastHashJoin") == 3 and plan.count("Scan ExistingRDD") <= 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_hot_and_null_keys(spark):
    """Nine tenths of the rows on one key, and rows without a key."""
    key = F.when(F.col("id") % 20 == 0, None).when(F.col("id") % 10 > 0, 7).otherwise(F.col("id"))
    df = spark.range(4000).select("id", key.alias("user_id"), (F.col("id") % 5 + 1).cast("int").alias("rating"), (F.col("id") % 3).alias("fold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.id: r for r in oof.oof_stats(df, "user_id", k=3).collect()}
        joined = oof.split_join(df, df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count_if(F.col("user_id").isNull()).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    hot = [i for i in range(4000) if i % 10 > 0]
    for i in (1, 2, 33):
        others = [j % 5 + 1 for j in hot if j % 3 != i % 3]
        assert got[i].oof_count == len(others) and abs(got[i].oof_mean - sum(others) / len(others)) < 1e-9
    assert got[20].oof_count == 0 and got[20].oof_mean is None and got[10].oof_count == 0 and len(got) == 4000
    assert sum(sizes) == 200 and max(sizes) < 80  # four partitions share the rows without a key


def test_folds_are_stable_and_stratified(spark):
    ids = spark.range(5000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    counts = {r.f: r["count"] for r in ids.groupBy(fold(F.col("id")).alias("f")).count().collect()}
    assert set(counts) == set(range(5)) and max(counts.values()) < 1.15 * min(counts.values())
    per = oof.stratified_folds(ids, "id", "label").groupBy("label", "fold").count().collect()
    assert {r["count"] for r in per if r.label == 1} == {100} and {r["count"] for r in per if r.label == 0} == {900}
