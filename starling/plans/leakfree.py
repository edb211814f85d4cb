"""Queries: folds, out-of-fold statistics, target encodings and leak checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.functions.scalar import rounded as Q
from starling.operators import oof, stats
from starling.plans.registry import query
from starling.sources.views import fold, is_scoring, order_reviews, reviews, table


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_reviews(spark, sf_dir).withColumn("fold", fold(F.col("id")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).withColumn("fold", fold(F.col("id")))


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, test = folded(spark, sf_dir), is_scoring(F.col("id"))
    return rows.where(~test), rows.where(test).drop("rating")


def _direct(view: str, key: str, columns: str, extra: str = "") -> str:
    """The k-fold form: each row's key's rows of other folds, aggregated per (key, fold)."""
    return f"""cells AS (SELECT DISTINCT {key}, fold FROM {view}), other AS (SELECT {', '.join('c.' + k for k in key.split(', '))}, c.fold, {columns} FROM cells c JOIN {view} r ON {' AND '.join(f'c.{k} = r.{k}' for k in key.split(', '))} AND r.fold <> c.fold GROUP BY ALL){extra}"""


@query("SELECT id, CAST(fold AS BIGINT) AS fold, scoring FROM folded")
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).select("id", "fold", is_scoring(F.col("id")).alias("scoring"))


@query("""WITH h AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM labels) SELECT doc_id, toxic, CAST(r % 5 AS INT) AS fold FROM h""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oof.stratified_folds(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


@query("WITH " + _direct("folded", "user_id", "avg(r.rating) AS m, count(*) AS n, coalesce(stddev_samp(r.rating), 0) AS sd, avg(ln(r.price)) AS p, avg(CASE WHEN r.purchased THEN 1.0 ELSE 0.0 END) AS b") + """
  SELECT f.id, f.fold, round(m, 6) AS oof_mean, CAST(coalesce(n, 0) AS BIGINT) AS oof_count, round(sd, 6) AS oof_std, round(p, 6) AS oof_log_price, round(b, 6) AS oof_purchase_rate FROM folded f LEFT JOIN other o ON f.user_id = o.user_id AND f.fold = o.fold""")
def oof_user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = {"log_price": F.log("price"), "purchase_rate": F.when(F.col("purchased"), 1.0).otherwise(0.0)}
    out = oof.oof_stats(folded(spark, sf_dir), "user_id", means=means)
    return Q(out.select("id", "fold", "oof_mean", "oof_count", "oof_std", "oof_log_price", "oof_purchase_rate"))


@query("""WITH t AS (SELECT * FROM folded WHERE NOT scoring), u AS (SELECT user_id, avg(rating) AS m, count(*) AS n FROM t GROUP BY 1), g AS (SELECT avg(m) AS fallback FROM u)
  SELECT s.id, round(coalesce(m, fallback), 6) AS mean_rating, CAST(coalesce(n, 0) AS BIGINT) AS n_reviews FROM folded s LEFT JOIN u USING (user_id), g WHERE scoring""")
def test_side_user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(spark, sf_dir)
    full = stats.extended_stats(train, "user_id").select("user_id", "mean_rating", "n_reviews")
    out = test.join(full, "user_id", "left").crossJoin(F.broadcast(stats.mean_of_means(train, "user_id", "rating")))  # one row
    return Q(out.select("id", F.coalesce("mean_rating", "mean_of_means").alias("mean_rating"), F.coalesce("n_reviews", F.lit(0)).alias("n_reviews")))


@query("WITH " + _direct("lines", "prod_id", "avg(r.rating) AS m, count(*) AS n, coalesce(stddev_samp(r.rating), 0) AS sd") + """
  SELECT f.id, f.prod_id, f.store_id, f.votes, round(m, 6) AS oof_mean, CAST(coalesce(n, 0) AS BIGINT) AS oof_count, round(sd, 6) AS oof_std, round(f.price, 6) AS price FROM lines f LEFT JOIN other o ON f.prod_id = o.prod_id AND f.fold = o.fold""")
def oof_product_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(oof.oof_stats(lines(spark, sf_dir), "prod_id").select("id", "prod_id", "store_id", "votes", "oof_mean", "oof_count", "oof_std", "price"))


@query("WITH " + _direct("lines", "main_category", "avg(r.rating) AS m, count(*) AS n, coalesce(stddev_samp(r.rating), 0) AS sd", ", dp AS (SELECT main_category, avg(price) AS avg_price FROM (SELECT DISTINCT main_category, price FROM reviews) GROUP BY 1)") + """
  SELECT DISTINCT o.main_category, o.fold, round(m, 6) AS oof_mean, CAST(n AS BIGINT) AS oof_count, round(sd, 6) AS oof_std, round(avg_price, 6) AS avg_price FROM other o JOIN dp ON o.main_category = dp.main_category""")
def oof_category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    prices = stats.category_stats(rows).select("main_category", "avg_price")
    return Q(oof.oof_stats(rows, "main_category").select("main_category", "fold", "oof_mean", "oof_count", "oof_std").distinct().join(prices, "main_category"))


def _te(smoothing: float, key: str = "user_id") -> str:
    return "WITH " + _direct("folded", key, "sum(r.rating) AS s, count(*) AS n", ", g AS (SELECT avg(rating) AS prior FROM folded)") + f"""
  SELECT f.id, round(CASE WHEN n > 0 THEN (s + {smoothing} * prior) / (n + {smoothing}) ELSE prior END, 6) AS te, CAST(coalesce(n, 0) AS BIGINT) AS te_count FROM folded f LEFT JOIN other o ON f.user_id = o.user_id AND f.fold = o.fold, g"""


@query(_te(1.0))
def oof_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(oof.target_encode(folded(spark, sf_dir), "user_id").select("id", "te", "te_count"))


@query("WITH " + _direct("lines", "prod_id", "sum(r.rating) AS s, count(*) AS n") + ", g AS (SELECT avg(rating) AS prior FROM lines)" + """,
  c2 AS (SELECT DISTINCT user_id, fold FROM lines), o2 AS (SELECT c.user_id, c.fold, sum(r.rating) AS s, count(*) AS n FROM c2 c JOIN lines r ON c.user_id = r.user_id AND r.fold <> c.fold GROUP BY ALL)
  SELECT f.id, f.prod_id, f.store_id, f.votes, round(CASE WHEN o.n > 0 THEN (o.s + 10.0 * prior) / (o.n + 10.0) ELSE prior END, 6) AS prod_te, CAST(coalesce(o.n, 0) AS BIGINT) AS prod_te_count,
  round(CASE WHEN o2.n > 0 THEN (o2.s + 10.0 * prior) / (o2.n + 10.0) ELSE prior END, 6) AS user_te, CAST(coalesce(o2.n, 0) AS BIGINT) AS user_te_count
  FROM lines f LEFT JOIN other o ON f.prod_id = o.prod_id AND f.fold = o.fold LEFT JOIN o2 ON f.user_id = o2.user_id AND f.fold = o2.fold, g""")
def oof_safe_te(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = oof.safe_target_encode(lines(spark, sf_dir), {"user_te": "user_id", "prod_te": "prod_id"})
    return Q(out.select("id", "prod_id", "store_id", "votes", "user_te", "user_te_count", "prod_te", "prod_te_count"))


@query("""WITH t AS (SELECT * FROM folded WHERE NOT scoring), u AS (SELECT user_id, sum(rating) AS s, count(*) AS n FROM t GROUP BY 1), g AS (SELECT avg(rating) AS prior FROM t)
  SELECT f.id, round(CASE WHEN n > 0 THEN (s + 10.0 * prior) / (n + 10.0) ELSE prior END, 6) AS te, CAST(coalesce(n, 0) AS BIGINT) AS te_count FROM folded f LEFT JOIN u USING (user_id), g WHERE scoring""")
def te_test_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(spark, sf_dir)
    return Q(oof.target_encode_scoring(test, train, "user_id", smoothing=10.0).select("id", "te", "te_count"))


_PRIOR = ", pr AS (SELECT c.fold, avg(r.rating) AS prior FROM (SELECT DISTINCT fold FROM folded) c JOIN folded r ON r.fold <> c.fold GROUP BY c.fold)"


@query("WITH " + _direct("folded", "user_id", "avg(r.rating) AS m, count(*) AS n", _PRIOR) + """
  SELECT f.id, round(f.rating - coalesce(m, prior), 6) + 0.0 AS user_dev, round(abs(f.rating - coalesce(m, prior)), 6) AS user_absdev, CAST(coalesce(n, 0) AS BIGINT) AS user_n, round(coalesce(m, prior), 6) AS user_mean
  FROM folded f JOIN pr USING (fold) LEFT JOIN other o ON f.user_id = o.user_id AND f.fold = o.fold""")
def oof_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(oof.deviations(folded(spark, sf_dir), {"user": "user_id"}).select("id", "user_dev", "user_absdev", "user_n", "user_mean"))


@query("""WITH t AS (SELECT * FROM folded WHERE NOT scoring), u AS (SELECT user_id, avg(rating) AS m, count(*) AS n FROM t GROUP BY 1), g AS (SELECT avg(rating) AS prior FROM t)
  SELECT f.id, 0.0 AS user_dev, 0.0 AS user_absdev, round(coalesce(m, prior) - prior, 6) + 0.0 AS leniency, CAST(coalesce(n, 0) AS BIGINT) AS user_n FROM folded f LEFT JOIN u USING (user_id), g WHERE scoring""")
def test_side_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations need the row's rating, which the scoring set hasn't: they are 0 there."""
    train, test = split(spark, sf_dir)
    out = oof.with_totals(test, train, "user_id", {"s": F.col("rating")}).crossJoin(F.broadcast(train.agg(F.avg("rating").alias("prior"))))  # one row
    lenient = F.coalesce(oof.mean(F.col("o_n"), F.col("o_s")), F.col("prior")) - F.col("prior")
    return Q(out.select("id", F.lit(0.0).alias("user_dev"), F.lit(0.0).alias("user_absdev"), lenient.alias("leniency"), F.col("o_n").alias("user_n")))


@query("WITH " + _direct("folded", "user_id", "avg(r.rating) AS m, count(*) AS n", _PRIOR) + """
  SELECT f.id, round(coalesce(m, prior) - prior, 6) + 0.0 AS leniency, round(abs(coalesce(m, prior) - prior), 6) AS harshness, CAST(coalesce(n, 0) AS BIGINT) AS oof_count
  FROM folded f JOIN pr USING (fold) LEFT JOIN other o ON f.user_id = o.user_id AND f.fold = o.fold""")
def oof_leniency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(oof.leniency(folded(spark, sf_dir)).select("id", "leniency", "harshness", "oof_count"))


@query("WITH " + _direct("lines", "user_id, main_category", "avg(r.rating) AS m, count(*) AS n") + """, c2 AS (SELECT DISTINCT user_id, fold FROM lines), o2 AS (SELECT c.user_id, c.fold, avg(r.rating) AS m FROM c2 c JOIN lines r ON c.user_id = r.user_id AND r.fold <> c.fold GROUP BY ALL)
  SELECT DISTINCT f.user_id, f.main_category, f.fold, round(o.m, 6) AS pair_mean, CAST(coalesce(o.n, 0) AS BIGINT) AS pair_count, round(o.m - o2.m, 6) + 0.0 AS pair_deviation
  FROM lines f LEFT JOIN other o ON f.user_id = o.user_id AND f.main_category = o.main_category AND f.fold = o.fold LEFT JOIN o2 ON f.user_id = o2.user_id AND f.fold = o2.fold""")
def oof_user_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(oof.oof_pair(lines(spark, sf_dir)).select("user_id", "main_category", "fold", "pair_mean", "pair_count", "pair_deviation").distinct())


@query("""WITH k AS (SELECT *, CAST(user_id AS VARCHAR) || '/' || CAST(year(ts) AS VARCHAR) AS uy FROM folded), p AS (SELECT uy FROM k GROUP BY uy HAVING count(*) = 2 AND min(fold) <> max(fold))
  SELECT CAST(count(*) AS BIGINT) AS n_keys, CAST(0 AS BIGINT) AS n_violations FROM p""")
def leak_check_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folded(spark, sf_dir).withColumn("uy", F.concat_ws("/", "user_id", F.year("ts")))
    return oof.leak_check_pairs(oof.oof_stats(rows, "uy"), "uy")


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_violations FROM folded")
def leak_check_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oof.leak_check_full(oof.oof_stats(folded(spark, sf_dir), "user_id"), "user_id")


@query("WITH te AS (" + _te(1.0).replace("WITH ", "WITH ", 1) + ") SELECT CAST(fold AS BIGINT) AS fold, round(sqrt(avg(pow(te - rating, 2))), 6) AS rmse, CAST(count(*) AS BIGINT) AS n FROM te JOIN folded USING (id) GROUP BY fold")
def te_rmse_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: leak-free user encodings scored as predictions, fold by fold."""
    rows = oof.target_encode(folded(spark, sf_dir), "user_id")
    return Q(rows.groupBy("fold").agg(F.sqrt(F.avg(F.pow(F.col("te") - F.col("rating"), 2))).alias("rmse"), F.count(F.lit(1)).alias("n")))
