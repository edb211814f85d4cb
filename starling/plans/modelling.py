"""Queries: assembly, models under cross-validation, evaluation, blending, stacking."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.functions.scalar import rounded as Q
from starling.operators import assemble, ensemble as en, linear, oof, stacking as st, tfidf, trees
from starling.operators.folds import out_of_fold
from starling.operators.joins import split_join
from starling.plans import textual
from starling.plans.leakfree import folded, split
from starling.plans.registry import query
from starling.sources import io
from starling.sources.views import fold, is_scoring, table

# Base "models" of the evaluation queries: out-of-fold encodings of users, of (user, year) and of months.
_MODELS = ["m_user", "m_year", "m_month"]


def base_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, fold, y and three out-of-fold predictions."""
    rows = folded(spark, sf_dir).withColumns({"yr": F.year("ts"), "mo": F.month("ts"), "y": F.col("rating").cast("double")})
    out = oof.safe_target_encode(rows, {"m_user": "user_id", "m_year": ["user_id", "yr"], "m_month": "mo"}, smoothing=1.0)
    return out.select("id", "fold", "user_id", "price", "purchased", "ts", "rating", "y", *_MODELS)


def _enc(name: str, key: str) -> str:
    on = " AND ".join(f"c.{k} = r.{k}" for k in key.split(", "))
    return f"{name}_o AS (SELECT {', '.join('c.' + k for k in key.split(', '))}, c.fold, sum(r.rating) AS s, count(*) AS n FROM (SELECT DISTINCT {key}, fold FROM b) c JOIN b r ON {on} AND r.fold <> c.fold GROUP BY ALL)"


def _value(name: str) -> str:
    return f"CASE WHEN {name}_o.n > 0 THEN ({name}_o.s + prior) / ({name}_o.n + 1.0) ELSE prior END AS {name}"


_BASE = f"""b AS (SELECT *, year(ts) AS yr, month(ts) AS mo FROM folded), g AS (SELECT avg(rating) AS prior FROM b), {_enc('m_user', 'user_id')}, {_enc('m_year', 'user_id, yr')}, {_enc('m_month', 'mo')},
  base AS (SELECT b.id, b.fold, b.user_id, b.price, CAST(b.rating AS DOUBLE) AS y, {_value('m_user')}, {_value('m_year')}, {_value('m_month')} FROM b LEFT JOIN m_user_o ON b.user_id = m_user_o.user_id AND b.fold = m_user_o.fold
  LEFT JOIN m_year_o ON b.user_id = m_year_o.user_id AND b.yr = m_year_o.yr AND b.fold = m_year_o.fold LEFT JOIN m_month_o ON b.mo = m_month_o.mo AND b.fold = m_month_o.fold, g),
  long AS (SELECT id, fold, y, 'm_user' AS model, m_user AS pred FROM base UNION ALL SELECT id, fold, y, 'm_year', m_year FROM base UNION ALL SELECT id, fold, y, 'm_month', m_month FROM base)"""


@query("WITH " + _BASE + " SELECT CAST(fold AS BIGINT) AS fold, round(sqrt(avg(pow(m_user - y, 2))), 6) AS rmse, CAST(count(*) AS BIGINT) AS n FROM base GROUP BY fold")
def rmse_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(en.rmse_by_fold(base_models(spark, sf_dir), "m_user"))


@query("WITH " + _BASE + ", f AS (SELECT sqrt(avg(pow(m_user - y, 2))) AS rmse FROM base GROUP BY fold) SELECT round(avg(rmse), 6) AS mean_rmse, round(stddev_pop(rmse), 6) AS std_rmse FROM f")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(en.fold_summary(en.rmse_by_fold(base_models(spark, sf_dir), "m_user")))


@query("WITH " + _BASE + " SELECT model, round(avg(pred), 6) AS mean, round(stddev_pop(pred), 6) AS std, round(min(pred), 6) AS min, round(max(pred), 6) AS max, round(sqrt(avg(pow(pred - y, 2))), 6) AS rmse FROM long GROUP BY model")
def prediction_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(en.profile(en.long_form(base_models(spark, sf_dir), _MODELS)))


@query("""WITH d AS (SELECT n_chars AS s, toxic AS l FROM documents JOIN labels USING (doc_id)), r AS (SELECT l, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM d), a AS (SELECT sum(CASE WHEN l = 1 THEN r ELSE 0 END) AS sr, sum(l) AS p, sum(1 - l) AS n FROM r)
  SELECT round((sr - p * (p + 1) / 2.0) / (p * n), 6) AS auc, CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg FROM a""")
def auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return Q(en.auc(rows, "n_chars", "toxic"))


@query("WITH " + _BASE + ", l AS (SELECT * FROM long WHERE NOT (model = 'm_month' AND id % 10 = 0)), c AS (SELECT model, count(*) AS n FROM l GROUP BY model), e AS (SELECT count(*) AS e FROM base) SELECT model, CAST(n AS BIGINT) AS n, n = e AS complete, (SELECT count(*) FROM c, e WHERE n = e) >= 3 AS enough FROM c, e")
def model_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_models(spark, sf_dir)
    long = en.long_form(base, _MODELS).where("NOT (model = 'm_month' AND id % 10 = 0)")
    return en.coverage(long, base)


@query("WITH " + _BASE + " SELECT id, round(greatest(1, least(5, 0.5 * m_user + 0.3 * m_year + 0.2 * m_month)), 6) AS pred, round((m_user + m_year + m_month) / 3, 6) AS equal FROM base")
def weighted_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = dict.fromkeys(_MODELS, 1 / 3)
    return Q(base_models(spark, sf_dir).select("id", en.blend({"m_user": 0.5, "m_year": 0.3, "m_month": 0.2}).alias("pred"), en.blend(third, clip=False).alias("equal")))


@query("WITH " + _BASE + ", e AS (SELECT i, sqrt(avg(pow(greatest(1, least(5, i / 100.0 * m_user + (1 - i / 100.0) * m_month)) - y, 2))) AS rmse FROM base, range(101) r(i) GROUP BY i) SELECT CAST(i AS INT) AS idx, round(i / 100.0, 6) AS w_m_user, round(1 - i / 100.0, 6) AS w_m_month, round(rmse, 6) AS rmse FROM e")
def blend_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(en.score_blends(base_models(spark, sf_dir), en.pair_grid("m_user", "m_month")))


@query("WITH " + _BASE + ", w AS (SELECT i / 100.0 AS a, j / 100.0 AS b, (100 - i - j) / 100.0 AS c, row_number() OVER (ORDER BY i, j) - 1 AS idx FROM range(101) r(i), range(101) s(j) WHERE i + j <= 100), e AS (SELECT idx, a, b, c, sqrt(avg(pow(greatest(1, least(5, a * m_user + b * m_year + c * m_month)) - y, 2))) AS rmse FROM base, w GROUP BY ALL) SELECT CAST(idx AS INT) AS idx, round(a, 6) AS w_m_user, round(b, 6) AS w_m_year, round(c, 6) AS w_m_month, round(rmse, 6) AS rmse FROM e")
def simplex_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(en.score_blends(base_models(spark, sf_dir), en.simplex(_MODELS, 100)))


@query("WITH " + _BASE + ", e AS (SELECT i, sqrt(avg(pow(greatest(1, least(5, i / 100.0 * m_user + (1 - i / 100.0) * m_month)) - y, 2))) AS rmse FROM base, range(101) r(i) GROUP BY i) SELECT round(i / 100.0, 6) AS w_m_user, round(1 - i / 100.0, 6) AS w_m_month, round(rmse, 6) AS rmse FROM e ORDER BY round(rmse, 9), i LIMIT 1")
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(en.best(en.score_blends(base_models(spark, sf_dir), en.pair_grid("m_user", "m_month")), ["w_m_user", "w_m_month"]))


@query("WITH " + _BASE + ", r AS (SELECT model, sqrt(avg(pow(pred - y, 2))) AS rmse FROM long GROUP BY model) SELECT model, round(rmse, 6) AS rmse, round(1 / rmse / (SELECT sum(1 / rmse) FROM r), 6) AS weight FROM r")
def inverse_rmse_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(en.inverse_rmse_weights(en.long_form(base_models(spark, sf_dir), _MODELS)))


@query("WITH " + _BASE + " SELECT id, round(exp(0.6 * ln(m_user) + 0.4 * ln(m_month)), 6) AS geometric, round(1 / (0.6 / m_user + 0.4 / m_month), 6) AS harmonic, round(0.4 * m_user + 0.3 * m_year + 0.3 * m_month, 6) AS three FROM base")
def geo_harm_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = {"m_user": 0.6, "m_month": 0.4}
    return Q(base_models(spark, sf_dir).select("id", en.geometric(two).alias("geometric"), en.harmonic(two).alias("harmonic"), en.blend({"m_user": 0.4, "m_year": 0.3, "m_month": 0.3}, clip=False).alias("three")))


@query("WITH " + _BASE + ", s AS (SELECT avg(m_user) AS m, stddev_pop(m_user) AS sd, avg(y) AS tm, stddev_pop(y) AS ts FROM base) SELECT id, round(greatest(1, least(5, (m_user - m) * (ts / sd) + tm)), 6) AS learned, round(greatest(1, least(5, (m_user - m) * (1.422 / sd) + 3.941)), 6) AS fixed, round(greatest(1, least(5, (m_user - m) * (1.2 / sd) + m)), 6) AS own FROM base, s")
def variance_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_models(spark, sf_dir)
    learned = en.expand_variance(base, "m_user", target="y").withColumnRenamed("expanded", "learned")
    fixed = en.expand_variance(learned, "m_user", mean=F.lit(3.941), std=F.lit(1.422)).withColumnRenamed("expanded", "fixed")
    return Q(en.expand_variance(fixed, "m_user", std=F.lit(1.2)).select("id", "learned", "fixed", F.col("expanded").alias("own")))


@query("WITH " + _BASE + " SELECT id, round(greatest(1, least(5, 0.7 * m_month + 0.15 * m_user + 0.15 * m_year)), 6) AS pred FROM base")
def calibrated_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(base_models(spark, sf_dir).select("id", en.blend({"m_month": 0.7, "m_user": 0.15, "m_year": 0.15}).alias("pred")))


@query("WITH " + _BASE + ", p AS (SELECT i / 10.0 AS share, greatest(1, least(5, i / 10.0 * m_user + (1 - i / 10.0) * m_year)) AS pred FROM base, range(11) r(i)) SELECT round(share, 6) AS share, round(avg(pred), 6) AS mean, round(stddev_pop(pred), 6) AS std, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY share")
def blend_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(en.ladder(base_models(spark, sf_dir), "m_user", "m_year", [i / 10 for i in range(11)]))


@query("WITH " + _BASE + " SELECT CAST(count(*) AS BIGINT) AS n, round(avg(abs(m_user - m_month)), 6) AS mean_diff, round(max(abs(m_user - m_month)), 6) AS max_diff, round(corr(m_user, m_month), 6) + 0.0 AS corr, CAST(sum(CASE WHEN abs(m_user - m_month) > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_beyond FROM base")
def compare_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_models(spark, sf_dir)
    return Q(en.compare(base.select("id", F.col("m_user").alias("pred")), base.select("id", F.col("m_month").alias("pred"))))


@query("WITH " + _BASE + ", r AS (SELECT sqrt(avg(pow(m_month - y, 2))) AS o, sqrt(avg(pow(m_user - y, 2))) AS n FROM base) SELECT round(o, 6) AS old_rmse, round(n, 6) AS new_rmse, CASE WHEN n - o > 0.001 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM r")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(en.gate(base_models(spark, sf_dir), "m_month", "m_user"))


@query("WITH " + _BASE + """, s AS (SELECT fold, sqrt(avg(pow(m_user - y, 2))) AS x, sqrt(avg(pow(m_year - y, 2))) AS v FROM base GROUP BY fold), r AS (SELECT x, v, rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY v) AS ry FROM s)
  SELECT round(corr(x, v), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman, round(regr_slope(v, x), 6) + 0.0 AS slope, round(regr_intercept(v, x), 6) + 0.0 AS intercept, round(regr_r2(v, x), 6) AS r2, round(avg(v - x), 6) + 0.0 AS offset_mean, round(stddev_samp(v - x), 6) AS offset_std FROM r""")
def score_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_models(spark, sf_dir)
    scores = base.groupBy("fold").agg(en.rmse(F.col("m_user"), F.col("y")).alias("x"), en.rmse(F.col("m_year"), F.col("y")).alias("v"))
    return Q(en.association(scores, "x", "v"))


@query("WITH " + _BASE + ", s AS (SELECT stddev_pop(CASE WHEN fold = 0 THEN m_user END) AS a, stddev_pop(CASE WHEN fold = 1 THEN m_user END) AS b FROM base) SELECT round(a, 6) AS std_a, round(b, 6) AS std_b, round(least(a, b) / greatest(a, b), 6) AS ratio, CASE WHEN least(a, b) / greatest(a, b) < 0.5 THEN 'drift' WHEN least(a, b) / greatest(a, b) < 0.8 THEN 'warning' ELSE 'ok' END AS alert FROM s")
def drift_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(en.drift(base_models(spark, sf_dir), "m_user", 0, 1))


@query("WITH " + _BASE + " SELECT round(stddev_pop(m_month) / stddev_pop(y), 6) AS ratio, stddev_pop(m_month) / stddev_pop(y) < 0.5 AS compressed FROM base")
def compression_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(en.compression(base_models(spark, sf_dir), "m_month"))


# ---- assembly

_FEATURES = ["price", "m_user", "m_year"]


@query("WITH " + _BASE + """, h AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE price END AS price, m_user, m_year, (('0x' || substr(md5('split' || CAST(id AS VARCHAR)), 1, 8))::BIGINT % 5) = 4 AS scoring FROM base),
  m AS (SELECT quantile_cont(price, 0.5) AS pm FROM h WHERE NOT scoring), f AS (SELECT id, scoring, coalesce(price, pm) AS price, m_user, m_year FROM h, m),
  s AS (SELECT avg(price) AS pa, stddev_pop(price) AS ps, avg(m_user) AS ua, stddev_pop(m_user) AS us, avg(m_year) AS ya, stddev_pop(m_year) AS ys FROM f WHERE NOT scoring)
  SELECT id, scoring, round((price - pa) / ps, 6) + 0.0 AS price, round((m_user - ua) / us, 6) + 0.0 AS m_user, round((m_year - ya) / ys, 6) + 0.0 AS m_year FROM f, s""")
def assemble_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base_models(spark, sf_dir).select("id", is_scoring(F.col("id")).alias("scoring"), F.when(F.col("id") % 9 == 0, None).otherwise(F.col("price")).alias("price"), "m_user", "m_year")
    assemble.require(rows, _FEATURES)
    scaler = assemble.fit_scaler(rows.where("NOT scoring"), _FEATURES)
    return Q(assemble.apply_scaler(rows, scaler, _FEATURES))


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both splits with row features and user encodings, out of fold for training rows."""
    shape = {"purchased": F.col("purchased").cast("int"), "month": F.month("ts"), "weekday": F.dayofweek("ts")}
    train, test = (df.withColumns(shape) for df in split(spark, sf_dir))
    encoded = oof.target_encode(train, "user_id", smoothing=10.0, name="user_te").withColumnRenamed("user_te_count", "user_n")
    return encoded, oof.target_encode_scoring(test, train, "user_id", smoothing=10.0, name="user_te").withColumnRenamed("user_te_count", "user_n")


_ASSEMBLED = ["price", "purchased", "month", "weekday", "user_te", "user_n"]


_SHAPED = """t AS (SELECT id, user_id, fold, scoring, rating, price, CAST(purchased AS INT) AS purchased, month(ts) AS month, dayofweek(ts) + 1 AS weekday FROM folded), tr AS (SELECT * FROM t WHERE NOT scoring), g AS (SELECT avg(rating) AS prior FROM tr),
  o AS (SELECT c.user_id, c.fold, sum(r.rating) AS s, count(*) AS n FROM (SELECT DISTINCT user_id, fold FROM tr) c JOIN tr r ON c.user_id = r.user_id AND c.fold <> r.fold GROUP BY ALL), u AS (SELECT user_id, sum(rating) AS s, count(*) AS n FROM tr GROUP BY 1),
  f AS (SELECT t.*, CASE WHEN coalesce(o.n, u2.n) > 0 THEN (coalesce(o.s, u2.s) + 10.0 * prior) / (coalesce(o.n, u2.n) + 10.0) ELSE prior END AS user_te, coalesce(o.n, u2.n, 0) AS user_n
    FROM t LEFT JOIN o ON NOT t.scoring AND t.user_id = o.user_id AND t.fold = o.fold LEFT JOIN u u2 ON t.scoring AND t.user_id = u2.user_id, g),
  s AS (SELECT avg(price) AS a1, stddev_pop(price) AS s1, avg(purchased) AS a2, stddev_pop(purchased) AS s2, avg(month) AS a3, stddev_pop(month) AS s3, avg(weekday) AS a4, stddev_pop(weekday) AS s4, avg(user_te) AS a5, stddev_pop(user_te) AS s5, avg(user_n) AS a6, stddev_pop(user_n) AS s6 FROM f WHERE NOT scoring)"""


@query("WITH " + _SHAPED + """
  SELECT id, CASE WHEN scoring THEN 'test' ELSE 'train' END AS split, round((price - a1) / s1, 6) + 0.0 AS price, round((purchased - a2) / s2, 6) + 0.0 AS purchased, round((month - a3) / s3, 6) + 0.0 AS month, round((weekday - a4) / s4, 6) + 0.0 AS weekday,
  round((user_te - a5) / s5, 6) + 0.0 AS user_te, round((user_n - a6) / s6, 6) + 0.0 AS user_n FROM f, s""")
def assemble_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both splits end to end: row features, leak-free user encodings (out of fold for training rows, from all of them for scoring rows), scaling fitted on training rows, one vector a row, written and read back."""
    encoded, scored = _encoded(spark, sf_dir)
    rows = assemble.assemble(encoded, scored, _ASSEMBLED, io.scratch(spark, "assembled")).withColumn("v", vector_to_array("features"))
    return Q(rows.select("id", "split", *[F.col("v")[i].alias(c) for i, c in enumerate(_ASSEMBLED)]))


@query("WITH " + textual.NORMALIZED + textual.layers(4, 2) + ", " + _SHAPED + """, words AS (SELECT doc_id, length(coalesce(text, '')) AS chars, len(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9][a-z0-9]+)', 1)) AS words FROM documents)
  SELECT f.id, CASE WHEN scoring THEN 'test' ELSE 'train' END AS split, CAST(6 + 2 + 4 + 64 AS INT) AS width, round((price - a1) / s1, 6) + 0.0 AS price, round((user_te - a5) / s5, 6) + 0.0 AS user_te, round((user_n - a6) / s6, 6) + 0.0 AS user_n,
  round(coalesce(ln(1 + chars), 0), 6) AS chars, round(coalesce(ln(1 + words), 0), 6) AS words, round(coalesce(e0, 0), 6) + 0.0 AS e0, round(coalesce(e3, 0), 6) + 0.0 AS e3, round(coalesce(CAST(embedding[1] AS DOUBLE), 0), 6) + 0.0 AS v0, round(coalesce(CAST(embedding[64] AS DOUBLE), 0), 6) + 0.0 AS v63
  FROM f LEFT JOIN words ON words.doc_id = f.id LEFT JOIN final ON node = 'u' || user_id LEFT JOIN embeddings ON vec_id = f.id, s""")
def assemble_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, text, graph and dense vectors of both splits side by side, from tables in buckets of the row id: some of the 76 values of each row."""
    train, test = _encoded(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    text = docs.select("id", F.array(F.log1p(F.length("text")), F.log1p(F.size(tfidf.words(F.col("text"))))).alias("v"))
    nodes = textual.propagated(spark, sf_dir, 4, 2)
    users = split_join(folded(spark, sf_dir).select("id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node")), nodes, "node", "inner").select("id", "e")
    dense = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    blocks = {"text": (text, "v", 2), "graph": (users, "e", 4), "dense": (dense, "embedding", 64)}
    rows = assemble.assemble_blocks(train, test, _ASSEMBLED, blocks, io.scratch(spark, "blocks"))
    at = {"price": 0, "user_te": 4, "user_n": 5, "chars": 6, "words": 7, "e0": 8, "e3": 11, "v0": 12, "v63": 75}
    return Q(rows.select("id", "split", F.size("features").alias("width"), *[F.col("features")[i].alias(c) for c, i in at.items()]))


@query("""SELECT 'price' AS "column", CAST(sum(CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad FROM order_reviews UNION ALL SELECT 'rating', CAST(0 AS BIGINT)""")
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folded(spark, sf_dir).withColumn("price", F.when(F.col("id") % 9 == 0, None).otherwise(F.col("price")))
    return assemble.null_audit(rows, ["price", "rating"])


# ---- models


@query("""WITH g AS (SELECT c.fold, regr_slope(r.rating, r.price) AS a, regr_intercept(r.rating, r.price) AS b FROM (SELECT DISTINCT fold FROM folded) c JOIN folded r ON r.fold <> c.fold GROUP BY c.fold) SELECT id, round(greatest(1, least(5, a * price + b)), 6) AS pred FROM folded JOIN g USING (fold)""")
def ridge_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature and no penalty, so that SQL's regression functions are the oracle."""
    return Q(linear.ridge_oof(folded(spark, sf_dir), ["price"], alpha=0.0).select("id", "pred"))


@query()
def ridge_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties and feature subsets from one pass."""
    base = base_models(spark, sf_dir)
    features = ["price", *_MODELS]
    grams = linear.fold_grams(base, features)
    grid = linear.ridge_grid(grams, features, [0.01, 0.1, 1.0, 10.0, 100.0], {"all": features, "models": _MODELS, "price": ["price"]})
    return Q(spark.createDataFrame(grid, "subset string, alpha double, rmse double"))


@query("""WITH t AS (SELECT *, CAST(purchased AS INT) AS b FROM folded), s AS (SELECT c.fold, count(*) AS n, avg(r.price) AS mp, avg(r.b) AS mb, avg(r.rating) AS my, var_pop(r.price) * count(*) AS pp, var_pop(r.b) * count(*) AS bb, covar_pop(r.price, r.b) * count(*) AS pb,
  covar_pop(r.price, r.rating) * count(*) AS py, covar_pop(r.b, r.rating) * count(*) AS byy FROM (SELECT DISTINCT fold FROM t) c JOIN t r ON r.fold <> c.fold AND NOT r.scoring GROUP BY c.fold),
  w AS (SELECT fold, mp, mb, my, ((bb + 1) * py - pb * byy) / ((pp + 1) * (bb + 1) - pb * pb) AS wp, ((pp + 1) * byy - pb * py) / ((pp + 1) * (bb + 1) - pb * pb) AS wb FROM s)
  SELECT id, round(avg(greatest(1, least(5, my + wp * (price - mp) + wb * (b - mb)))), 6) AS pred FROM t, w WHERE scoring GROUP BY id""")
def ridge_test_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(spark, sf_dir)
    features = ["price", "purchased"]
    number = lambda df: df.withColumn("purchased", F.col("purchased").cast("int"))
    return Q(linear.ridge_scoring(linear.fold_grams(number(train), features), number(test), features).select("id", "pred"))


@query("""WITH g AS (SELECT c.fold, regr_slope(r.rating, r.price) AS a, regr_intercept(r.rating, r.price) AS b FROM (SELECT DISTINCT fold FROM folded) c JOIN folded r ON r.fold <> c.fold GROUP BY c.fold) SELECT 'intercept' AS feature, round(avg(b), 6) AS coefficient FROM g UNION ALL SELECT 'price', round(avg(a * 1000), 6) + 0.0 FROM g""")
def mean_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold models' mean coefficients; one feature (in thousands) and no penalty, so that SQL's regression functions are the oracle."""
    rows = folded(spark, sf_dir).withColumn("price", F.col("price") / 1000)
    found = linear.mean_coefficients(linear.fold_grams(rows, ["price"]), 0.0)
    return Q(spark.createDataFrame([("intercept", float(found[0])), ("price", float(found[1]))], "feature string, coefficient double"))


@query("""WITH s AS (SELECT c.fold, avg(r.price) AS mp, avg(r.rating) AS my, var_pop(r.price) AS v, covar_pop(r.price, r.rating) AS c FROM (SELECT DISTINCT fold FROM folded) c JOIN folded r ON r.fold <> c.fold GROUP BY c.fold),
  w AS (SELECT fold, mp, my, sign(c) * greatest(abs(c) - 5.0, 0) / (v + 5.0) AS w FROM s) SELECT id, round(greatest(1, least(5, my + w * (price - mp))), 6) AS pred FROM folded JOIN w USING (fold)""")
def elasticnet_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature, whose elastic net has a closed form."""
    return Q(linear.elastic_net_oof(folded(spark, sf_dir), ["price"], 10.0, 0.5).select("id", "pred"))


@query()
def elasticnet_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties and mixes by cross-validation, from one pass."""
    grams = linear.fold_grams(base_models(spark, sf_dir), _MODELS)
    return Q(spark.createDataFrame(linear.elastic_net_grid(grams, [0.001, 0.01, 0.1, 1.0], [0.1, 0.5, 0.9]), "alpha double, l1_ratio double, rmse double"))


@query()
def embedding_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on dense vectors: the label from all 64 dimensions, out of fold, for several penalties in one pass."""
    rows = tfidf.spread(table(spark, sf_dir, "embeddings").withColumn("fold", fold(F.col("vec_id"))), "embedding", 64)
    features = [f"dim_{i}" for i in range(64)]
    grid = linear.ridge_grid(linear.fold_grams(rows, features, target="label"), features, [0.1, 1.0, 10.0])
    return Q(spark.createDataFrame(grid, "subset string, alpha double, rmse double"))


@query()
def elasticnet_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(linear.elastic_net_oof(base_models(spark, sf_dir), _MODELS, 0.01, 0.5).select("id", "fold", "pred"))


@query()
def gbt_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 40 rounds, which stop early."""
    return Q(trees.gbt_oof(base_models(spark, sf_dir), ["price", *_MODELS], rounds=40, depth=4)[0].select("id", "fold", "pred"))


@query()
def gbt_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of trees that early stopping chose for each fold, of 40 at most."""
    out = trees.gbt_folds(base_models(spark, sf_dir), ["price", *_MODELS], rounds=40, depth=4)
    return spark.createDataFrame([(f, int(r["trees"]), 40) for f, r in enumerate(out.reports)], "fold int, trees int, most int")


@query()
def gbt_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(trees.gbt_oof(base_models(spark, sf_dir), ["price", *_MODELS], rounds=3, depth=3)[1])


@query()
def gbt_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's model is fitted on 20,000 rows, a stated bound; all rows are predicted."""
    return Q(trees.gbt_oof(base_models(spark, sf_dir), ["price", *_MODELS], rounds=3, depth=3, fit_rows=20_000)[0].select("id", "fold", "pred"))


@query()
def gbt_test_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring side of boosted trees: the mean of the fold models' clipped predictions."""
    train, test = both_sides(spark, sf_dir)
    return Q(trees.gbt_oof(train, _MODELS, rounds=3, depth=3, scoring=test)[2].select("id", "pred"))


@query()
def text_model_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regressions on hashed TF-IDF, weights and models fitted on the other folds, for the labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality IS NOT NULL")
    rows = tfidf.hashed_vectors(docs.join(labels, "doc_id"), "text", 12_000).select("doc_id", "quality", fold(F.col("doc_id")).alias("fold"), "tf")
    return Q(trees.text_oof(rows, "tf", "quality").select("doc_id", "fold", "quality", "score"))


@query()
def text_trees_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on 600 hashed dimensions, out of fold likewise: the AUC of each label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality IS NOT NULL")
    rows = tfidf.hashed_vectors(docs.join(labels, "doc_id"), "text", 600).select("doc_id", "quality", fold(F.col("doc_id")).alias("fold"), "tf")
    out = out_of_fold(rows, trees.boosted_text("tf", "quality", rounds=8, depth=3), name="score")
    return Q(en.auc(out.rows.select("doc_id", "quality", "score"), "score", "quality"))


@query()
def ordinal_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base_models(spark, sf_dir).select("id", "fold", "rating", "price", *_MODELS)
    return Q(linear.ordinal_oof(rows, ["price", *_MODELS], k=5).select("id", "fold", "pred"))


def _shape(df: DataFrame) -> DataFrame:
    return df.select("id", "price", F.month("ts").alias("month"), F.col("purchased").cast("int").alias("purchased"))


@query()
def adversarial_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(spark, sf_dir)
    return Q(trees.adversarial(_shape(train), _shape(test), ["price", "month", "purchased"])[0])


@query()
def shift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells the scoring set from the training set, with both sides' moments."""
    (train, test), features = map(_shape, split(spark, sf_dir)), ["price", "month", "purchased"]
    return Q(trees.shift_report(train, test, features, trees.adversarial(train, test, features)[1]))


@query()
def leak_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE of boosted trees with a column that contains the row's own rating against RMSE without: what a leak looks like."""
    rows = oof.deviations(base_models(spark, sf_dir), {"user": "user_id"}).select("id", "fold", "y", "rating", "user_dev", *_MODELS)
    rows = io.materialize(rows, io.scratch(spark, "leak-rows"))
    full, safe = (trees.gbt_oof(rows, features, rounds=40, depth=4)[0].agg(en.rmse(F.col("pred"), F.col("y")).alias(name)) for name, features in (("rmse_full", ["user_dev", *_MODELS]), ("rmse_safe", _MODELS)))
    out = full.crossJoin(safe)  # one row each
    return Q(out.withColumn("impact", F.col("rmse_full") - F.col("rmse_safe")))


_LEAK = """WITH pf AS (SELECT user_id, fold, sum(rating) AS s, count(*) AS n FROM folded GROUP BY ALL), pt AS (SELECT user_id, sum(s) AS all_s, sum(n) AS tn FROM pf GROUP BY 1), fp AS (SELECT c.fold, avg(r.rating) AS prior FROM (SELECT DISTINCT fold FROM folded) c JOIN folded r ON r.fold <> c.fold GROUP BY 1),
  t AS (SELECT id, fold, CAST(rating AS DOUBLE) AS y, rating - CASE WHEN tn > n THEN (all_s - s) / (tn - n) ELSE prior END AS user_dev FROM folded JOIN pf USING (user_id, fold) JOIN pt USING (user_id) JOIN fp USING (fold))"""


@query(_LEAK + """, s AS (SELECT c.fold, regr_slope(r.y, r.user_dev) AS a, regr_intercept(r.y, r.user_dev) AS b, avg(r.y) AS m FROM (SELECT DISTINCT fold FROM t) c JOIN t r ON r.fold <> c.fold GROUP BY c.fold)
  SELECT round(sqrt(avg(pow(greatest(1, least(5, a * user_dev + b)) - y, 2))), 5) AS rmse_full, round(sqrt(avg(pow(m - y, 2))), 5) AS rmse_safe, round(sqrt(avg(pow(greatest(1, least(5, a * user_dev + b)) - y, 2))) - sqrt(avg(pow(m - y, 2))), 5) AS impact FROM t JOIN s USING (fold)""")
def leak_impact_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for one leaking column and a straight line, against the mean of the other folds."""
    rows = oof.deviations(folded(spark, sf_dir).withColumns({"y": F.col("rating").cast("double"), "one": F.lit(0.0)}), {"user": "user_id"})
    leaky = linear.ridge_oof(rows, ["user_dev"], alpha=0.0).withColumnRenamed("pred", "leaky")
    both = linear.ridge_oof(leaky, ["one"], alpha=1.0).withColumnRenamed("pred", "safe")
    out = both.agg(en.rmse(F.col("leaky"), F.col("y")).alias("rmse_full"), en.rmse(F.col("safe"), F.col("y")).alias("rmse_safe"))
    return Q(out.withColumn("impact", F.col("rmse_full") - F.col("rmse_safe")), 5)


def both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(training rows with out-of-fold base predictions, scoring rows with those of all training rows)."""
    train, test = (df.withColumns({"yr": F.year("ts"), "mo": F.month("ts")}) for df in split(spark, sf_dir))
    keys = {"m_user": "user_id", "m_year": ["user_id", "yr"], "m_month": "mo"}
    scored = test
    for name, key in keys.items():
        scored = oof.target_encode_scoring(scored, train, key, smoothing=1.0, name=name)
    return oof.safe_target_encode(train.withColumn("y", F.col("rating").cast("double")), keys, smoothing=1.0), scored


def base_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(model, split, id, pred of four models, one of which covers half of the training rows; training rows; scoring rows)."""
    train, test = both_sides(spark, sf_dir)
    train, test = io.materialize(train, io.scratch(spark, "base-train")), io.materialize(test, io.scratch(spark, "base-test"))
    cells = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in _MODELS], F.struct(F.lit("m_part").alias("model"), F.when((F.col("split") == "test") | (F.col("id") % 2 == 0), F.col("m_user")).alias("pred"))))
    both = train.select("id", *_MODELS, F.lit("train").alias("split")).unionByName(test.select("id", *_MODELS, F.lit("test").alias("split")))
    return both.select("split", "id", cells), train, test


def _pooled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides for stacking, with the models that enter."""
    long, train, test = base_predictions(spark, sf_dir)
    wide, names, _ = en.pool(long, train.select("id", F.lit("train").alias("split")).unionByName(test.select("id", F.lit("test").alias("split"))))
    learned = split_join(train.select("id", "fold", "y"), wide.where("split = 'train'").drop("split"), "id", "inner")
    return learned, wide.where("split = 'test'").drop("split"), names


@query("""WITH k(model) AS (VALUES ('m_user'), ('m_year'), ('m_month'), ('m_part')), e AS (SELECT CASE WHEN scoring THEN 'test' ELSE 'train' END AS split, count(*) AS expected, sum(CASE WHEN scoring OR id % 2 = 0 THEN 1 ELSE 0 END) AS part FROM folded GROUP BY 1)
  SELECT model, split, CAST(CASE WHEN model = 'm_part' THEN part ELSE expected END AS BIGINT) AS n, CAST(expected AS BIGINT) AS expected, model <> 'm_part' AS enters FROM k, e""")
def stack_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which base models enter the stack, and what each has."""
    long, train, test = base_predictions(spark, sf_dir)
    return en.pool(long, train.select("id", F.lit("train").alias("split")).unionByName(test.select("id", F.lit("test").alias("split"))))[2]


@query()
def stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta-learners over the out-of-fold predictions of the models that are complete; the best by RMSE, with its predictions' spread."""
    train, test, names = _pooled(spark, sf_dir)
    return Q(st.stack(train, test, names, rounds=3).scores)


@query()
def stack_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best stack's prediction file for the scoring set: expanded, clipped, written, its ids checked, and read back."""
    train, test, names = _pooled(spark, sf_dir)
    return st.submission(st.stack(train, test, names, rounds=3), test, io.scratch(spark, "submission"))


@query("WITH " + _BASE + " SELECT id, round((m_user + m_year + m_month) / 3, 6) AS pred FROM base")
def mean_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(base_models(spark, sf_dir).select("id", en.mean_blend(_MODELS).alias("pred")))


def _preset_sql() -> str:
    each = [f"SELECT '{name}' AS preset, greatest(1, least(5, {' + '.join(f'{w!r} * m_{m}' for m, w in weights.items())})) AS pred, y FROM base" for name, weights in en.PRESETS.items()]
    return f", p AS ({' UNION ALL '.join(each)}) SELECT preset, round(avg(pred), 6) AS mean, round(stddev_pop(pred), 6) AS std, round(min(pred), 6) AS min, round(max(pred), 6) AS max, round(sqrt(avg(pow(pred - y, 2))), 6) AS rmse FROM p GROUP BY preset"


@query("WITH " + _BASE + _preset_sql())
def preset_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    blends = {name: en.blend({f"m_{m}": w for m, w in weights.items()}) for name, weights in en.PRESETS.items()}
    rows = base_models(spark, sf_dir).select("id", "y", *[b.alias(name) for name, b in blends.items()])
    return Q(en.profile(en.long_form(rows, list(blends))).withColumnRenamed("model", "preset"))


@query("WITH " + _BASE + ", p AS (SELECT i / 4.0 AS share, round(greatest(1, least(5, i / 4.0 * m_user + (1 - i / 4.0) * m_year)), 6) AS pred FROM base, range(5) r(i)) SELECT round(share, 6) AS share, round(avg(pred), 4) AS mean, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY share")
def blend_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ladder of blends written by one job, a prediction file set for each, and what the files hold."""
    rows = base_models(spark, sf_dir).select("id", "m_user", "m_year")
    shares = {f"{i * 25:03d}": i / 4 for i in range(5)}
    written = en.write_blends(rows, {name: en.blend({"m_user": x, "m_year": 1 - x}) for name, x in shares.items()}, io.scratch(spark, "blends"))
    wrong = en.missing_predictions(written, list(shares), rows).where("missing <> 0 OR extra <> 0")
    if not wrong.isEmpty():
        raise ValueError(f"incomplete outputs: {wrong.collect()}")  # a row for each blend
    return Q(written.groupBy((F.col("blend").cast("int") / 100.0).alias("share")).agg(F.round(F.avg("rating"), 4).alias("mean"), F.count(F.lit(1)).alias("n")))
