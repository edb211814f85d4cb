"""Queries: sources, cleaning, joins, statistics, profiling, scalar features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.functions import scalar as fn
from starling.operators import joins, sketches, stats
from starling.plans.registry import query
from starling.sources import io
from starling.sources.quoted_csv import read_quoted_csv
from starling.sources.views import is_scoring, order_reviews, reviews, table

Q = fn.rounded


# ---- sources and sinks


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS BIGINT) AS n_numbers,
  CAST(sum(CASE WHEN value BETWEEN 1 AND 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_accepted, CAST(sum(CASE WHEN value BETWEEN 1 AND 50 THEN 0 ELSE 1 END) AS BIGINT) AS n_rejected
  FROM events GROUP BY event_type""")
def reject_and_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").cast("string").alias("value"), F.get_json_object("props", "$.k").alias("k"))
    cast = io.cast_columns(rows, {"value": "double", "k": "double"})
    good, bad = io.reject_rows(cast, F.col("value").between(1, 50))
    both = good.withColumn("ok", F.lit(1)).unionByName(bad.withColumn("ok", F.lit(0)))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("n_numbers"), F.sum("ok").alias("n_accepted"), F.sum(1 - F.col("ok")).alias("n_rejected"))


def _csv_copy(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, list[str]]:
    df = table(spark, sf_dir, name)
    path = io.scratch(spark, f"csv-{name}")
    io.write_csv(df, path)
    return path, df.columns


@query("""SELECT p_type, CAST(count(*) AS BIGINT) AS n, round(sum(p_retailprice), 6) AS total_price, CAST(sum(p_size) AS BIGINT) AS total_size FROM part GROUP BY p_type""")
def scan_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, columns = _csv_copy(spark, sf_dir, "part")
    rows = io.cast_columns(io.read_text_csv(spark, path, columns), {"p_retailprice": "double", "p_size": "int"})
    return Q(rows.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_retailprice").alias("total_price"), F.sum("p_size").alias("total_size")))


@query("""SELECT s_nationkey, CAST(count(*) AS BIGINT) AS n, round(sum(s_acctbal), 6) AS total FROM supplier GROUP BY s_nationkey""")
def scan_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, columns = _csv_copy(spark, sf_dir, "supplier")
    return Q(io.read_text_csv(spark, path, columns, infer=True).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("total")))


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN text IS NULL THEN '' ELSE text END AS text, lang FROM documents")
def scan_multiline_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks, quotes and commas through a CSV file and back."""
    path = io.scratch(spark, "csv-documents")
    io.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    rows = read_quoted_csv(spark, path, ["doc_id", "text", "lang"])
    return io.cast_columns(rows, {"doc_id": "long"}).withColumn("text", F.coalesce("text", F.lit("")))


@query("""SELECT main_category, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM reviews ORDER BY id, prod_id, store_id, votes LIMIT 1000) GROUP BY main_category""")
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).orderBy("id", "prod_id", "store_id", "votes").limit(1000).groupBy("main_category").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT year(o_orderdate) AS y, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1""")
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.scratch(spark, "orders")
    io.write_parquet(table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")), path, partition_by=["y"], rows_per_file=500_000)
    rows = spark.read.parquet(path)
    return Q(rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.sum("o_totalprice").alias("total")), 4)


@query("""SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(list_filter(embedding, lambda x: x <> 0))) AS BIGINT) AS nnz FROM embeddings GROUP BY label""")
def libsvm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    path = io.scratch(spark, "libsvm")
    io.write_libsvm(table(spark, sf_dir, "embeddings"), path, "label", "embedding")
    rows = io.read_libsvm(spark, path, 64).select(F.col("label").cast("int").alias("label"), vector_to_array("features").alias("v"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.filter("v", lambda x: x != 0))).alias("nnz"))


@query("""SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(i - 1 AS INT) AS idx, round(CAST(embedding[i] AS DOUBLE), 6) + 0.0 AS val FROM embeddings, range(1, 65) r(i) WHERE embedding[i] <> 0""")
def sparse_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.scratch(spark, "sparse")
    io.write_parquet(io.sparse_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), path)
    return Q(spark.read.parquet(path))


@query("""SELECT CAST(id AS BIGINT) AS id, round(price / 10000.0, 6) AS rating, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra FROM order_reviews""")
def prediction_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_reviews(spark, sf_dir).select("id", (F.col("price") / 10000.0).alias("rating"))
    path = io.scratch(spark, "predictions")
    io.write_predictions(rows, path)
    read = io.cast_columns(io.read_text_csv(spark, path, ["id", "rating"]), {"id": "long", "rating": "double"})
    return read.crossJoin(F.broadcast(io.check_same_ids(rows, read, "id")))  # one row


@query("""SELECT name, value FROM (SELECT 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'total', round(sum(o_totalprice), 2) FROM orders)""")
def metrics_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.scratch(spark, "metrics")
    totals = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("t"))
    long = totals.select(F.inline(F.array(F.struct(F.lit("rows").alias("name"), F.col("n").alias("value")), F.struct(F.lit("total").alias("name"), F.col("t").alias("value")))))
    io.append_metrics(long.withColumn("run", F.lit(1)).withColumn("value", F.col("value") - 1), path)
    io.append_metrics(long.withColumn("run", F.lit(2)), path)
    return io.latest_metrics(spark, path)


@query("""SELECT name, value FROM (SELECT 'load.rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM events UNION ALL SELECT 'load.rejected', sum(CASE WHEN value BETWEEN 1 AND 50 THEN 0 ELSE 1 END) FROM events
  UNION ALL SELECT 'load.nulls.k', count(*) - count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) FROM events UNION ALL SELECT 'load.nulls.value', count(*) - count(value) FROM events UNION ALL SELECT 'run.step', 2)""")
def observed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a load, taken while it writes, merged into the metrics of an earlier run."""
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.get_json_object("props", "$.k").alias("k"))
    found = io.write_observed(io.cast_columns(rows, {"k": "double"}), io.scratch(spark, "observed"), valid=F.col("value").between(1, 50), nulls=["k", "value"])
    merged = io.merge_metrics({"run": {"step": 1}, "load": {"rows": -1}}, {"load": found, "run": {"step": 2}})
    return spark.createDataFrame(sorted((name, float(v)) for name, v in io.flat_metrics(merged).items()), "name string, value double")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM order_reviews GROUP BY user_id")
def reuse_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.scratch(spark, "artifact")
    counts = order_reviews(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    io.materialize(counts, path)
    return io.materialize(counts.limit(0), path)


# ---- cleaning and imputation

_CLEAN = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), 'https?://[^\t\n\v\f\r ]+', ' ', 'g'), '[^a-zA-Z0-9\t\n\v\f\r .,!?'']', ' ', 'g'), '[\t\n\v\f\r ]+', ' ', 'g')))"""


@query(f"SELECT doc_id, {_CLEAN.format('text')} AS cleaned FROM documents")
def clean_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT page_id, {_CLEAN.format('html')} AS cleaned FROM pages")
def clean_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.clean_text(F.col("html")).alias("cleaned"))


@query(r"SELECT doc_id, regexp_replace(lower(concat_ws(' ', source, text)), '[^a-z0-9\t\n\v\f\r ]', '', 'g') AS prepared FROM documents")
def text_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.vector_text(F.col("source"), F.col("text")).alias("prepared"))


@query("""SELECT a.conv_id, a.turn, trim(concat_ws(' ', coalesce(a.text, ''), coalesce(b.text, '')), ' ') AS combined FROM conversations a
  LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'""")
def combine_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    both = turns.where("role = 'user'").join(reply, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", fn.combine_text(F.col("text"), F.col("reply")).alias("combined"))


@query("""SELECT DISTINCT user_id, rating, purchased, price FROM order_reviews""")
def common_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = order_reviews(spark, sf_dir), reviews(spark, sf_dir)
    columns = [c for c in fn.common_columns(left, right) if c not in ("id", "ts")]
    return left.select(columns).distinct()


@query("SELECT id, user_id, purchased, ts FROM order_reviews")
def safe_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.safe_columns(order_reviews(spark, sf_dir), ["rating", "price", "not_there"])


@query("""WITH h AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS kind FROM part),
  m AS (SELECT quantile_cont(price, 0.5) AS med FROM h), k AS (SELECT kind AS mode FROM h WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)
  SELECT p_partkey, round(coalesce(price, med), 6) AS price, coalesce(kind, mode) AS kind, coalesce(kind, 'unknown') AS kind_or_unknown, price IS NULL AS price_imputed FROM h, m, k""")
def impute_median_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, None).otherwise(F.col("p_retailprice")).alias("price"), F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_type")).alias("kind")
    )
    flagged = holes.withColumn("price_imputed", F.col("price").isNull()).withColumn("kind_or_unknown", F.coalesce("kind", F.lit("unknown")))
    return Q(stats.mode_fill(stats.median_fill(flagged, ["price"]), "kind"))


@query("""SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, -1) AS toxic, coalesce(lang, 'unknown') AS lang FROM documents LEFT JOIN labels USING (doc_id)""")
def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.fillna({"quality": 0, "toxic": -1, "lang": "unknown"})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag, greatest(1.0, least(5.0, l_quantity / 8)) AS clipped,
  round(l_quantity / 7 * 2) / 2 AS halves FROM lineitem""")
def normalize_flags_clip_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    polluted = F.when(F.col("l_returnflag") == "R", "True").when(F.col("l_returnflag") == "A", "4").otherwise("False")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", fn.flag(polluted).alias("flag"), fn.clip(F.col("l_quantity") / 8).alias("clipped"), fn.half_steps(F.col("l_quantity") / 7).alias("halves"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '#42'), o_orderkey LIMIT 500")
def det_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sample_rows(table(spark, sf_dir, "orders"), "o_orderkey", 500).select("o_orderkey", "o_custkey")


# ---- joins


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_type, round(p_retailprice, 6) AS price, CAST(p_size AS INT) AS pi_l_linenumber FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def broadcast_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", F.col("p_retailprice").alias("price"), F.col("p_size").alias("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return Q(joins.join_dimension(rows, part, "l_partkey"))


@query("""WITH d AS (SELECT p_brand, min((p_retailprice, p_partkey)) AS m FROM part GROUP BY p_brand)
  SELECT p_partkey, p_brand, round(m[1], 6) AS first_price, CAST(m[2] AS BIGINT) AS first_part FROM part JOIN d USING (p_brand)""".replace("m[1]", "struct_extract(m, 1)").replace("m[2]", "struct_extract(m, 2)"))
def dedup_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    one = joins.unique_dimension(part.select("p_brand", F.col("p_retailprice").alias("first_price"), F.col("p_partkey").alias("first_part")), "p_brand", ["first_price", "first_part"])
    return Q(part.select("p_partkey", "p_brand").join(one, "p_brand", "left"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, n_name, r_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def two_hop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return joins.chain_lookup(rows, (supplier, "l_suppkey"), (nation, "s_nationkey"), (region, "n_regionkey")).select("l_orderkey", "l_partkey", "l_suppkey", "n_name", "r_name")


@query("""WITH p AS (SELECT user_id, main_category, avg(rating) AS m, count(*) AS n FROM reviews GROUP BY ALL)
  SELECT r.id, r.prod_id, r.user_id, r.main_category, round(p.m, 6) AS pair_mean, CAST(p.n AS BIGINT) AS pair_n FROM reviews r JOIN p ON r.user_id = p.user_id AND r.main_category = p.main_category""")
def composite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    pairs = rows.groupBy("user_id", "main_category").agg(F.avg("rating").alias("pair_mean"), F.count(F.lit(1)).alias("pair_n"))
    return Q(rows.select("id", "prod_id", "user_id", "main_category").transform(lambda r: joins.split_join(r, pairs, ["user_id", "main_category"])))


@query("""WITH a AS (SELECT prod_id, avg(rating) AS m FROM reviews GROUP BY 1), b AS (SELECT prod_id, sum(votes) AS v FROM reviews GROUP BY 1)
  SELECT prod_id, round(m, 6) AS m, round(v, 6) AS v, p_brand FROM a JOIN b USING (prod_id) JOIN part ON prod_id = p_partkey""")
def join_feature_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    a, b = rows.groupBy("prod_id").agg(F.avg("rating").alias("m")), rows.groupBy("prod_id").agg(F.sum("votes").alias("v"))
    return Q(joins.align("prod_id", a, b, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("prod_id"), "p_brand")))


@query("""SELECT id, year(ts) AS y, round(ln(1 + price), 6) AS lp, round((rating - 3) / 2.0, 6) AS r FROM order_reviews""")
def align_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_reviews(spark, sf_dir)
    tables = rows.select("id", F.year("ts").alias("y")), rows.select("id", F.log1p("price").alias("lp")), rows.select("id", ((F.col("rating") - 3) / 2.0).alias("r"))
    return Q(joins.align("id", *tables))


@query("""SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM (SELECT user_id, CASE WHEN scoring THEN 'test' ELSE 'train' END AS split FROM folded) GROUP BY split""")
def split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_reviews(spark, sf_dir)
    test = is_scoring(F.col("id"))
    both = joins.union_splits(rows.where(~test), rows.where(test).drop("rating"), ["id", "user_id"])
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id AS k FROM events), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
  SELECT CAST(sum(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_both, CAST(sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_left, CAST(sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_right FROM j""")
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.key_overlap(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), "k")


@query("""SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS n_users, CAST(count(DISTINCT prod_id) AS BIGINT) AS n_products FROM reviews""")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("prod_id").alias("n_products"))


# ---- statistics


@query("""SELECT user_id, round(avg(rating), 6) AS avg_rating, CAST(count(*) AS BIGINT) AS n_reviews, round(avg(votes), 6) AS avg_votes, round(avg(CASE WHEN purchased THEN 1.0 ELSE 0.0 END), 6) AS purchase_rate,
  round(stddev_pop(rating), 6) AS std_rating FROM reviews GROUP BY user_id""")
def user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.user_stats(reviews(spark, sf_dir)))


@query("""SELECT prod_id, round(avg(rating), 6) AS avg_rating, CAST(count(*) AS BIGINT) AS n_reviews, any_value(p_type) AS main_category, round(any_value(p_retailprice), 6) AS price FROM reviews JOIN part ON prod_id = p_partkey GROUP BY prod_id""")
def product_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("prod_id"), F.col("p_type").alias("main_category"), F.col("p_retailprice").alias("price"))
    return Q(stats.product_stats(reviews(spark, sf_dir), joins.unique_dimension(products, "prod_id", ["price"])))


@query("""WITH p AS (SELECT main_category, avg(price) AS avg_price FROM (SELECT DISTINCT main_category, price FROM reviews) GROUP BY 1)
  SELECT main_category, round(avg(rating), 6) AS avg_rating, round(stddev_pop(rating), 6) AS std_rating, CAST(count(*) AS BIGINT) AS n_reviews, round(any_value(avg_price), 6) AS avg_price FROM reviews JOIN p USING (main_category) GROUP BY main_category""")
def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.category_stats(reviews(spark, sf_dir)))


_EXT = """round(avg(rating), 6) AS mean_rating, CAST(count(*) AS BIGINT) AS n_reviews, round(coalesce(stddev_samp(rating), 0), 6) AS std_rating, round(quantile_cont(rating, 0.5), 6) AS median_rating, min(rating) AS min_rating,
  max(rating) AS max_rating, max(rating) - min(rating) AS rating_range, round(ln(1 + count(*)), 6) AS log_reviews"""


@query(f"SELECT user_id, {_EXT}, CASE WHEN count(*) >= 5 THEN 1 ELSE 0 END AS is_active FROM reviews GROUP BY user_id")
def user_stats_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.extended_stats(reviews(spark, sf_dir), "user_id", 5))


@query(f"SELECT prod_id, {_EXT}, CASE WHEN count(*) >= 10 THEN 1 ELSE 0 END AS is_popular FROM reviews GROUP BY prod_id")
def product_stats_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.extended_stats(reviews(spark, sf_dir), "prod_id", 10).withColumnRenamed("is_active", "is_popular"))


@query(f"SELECT main_category, {_EXT} FROM reviews GROUP BY main_category")
def category_stats_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.extended_stats(reviews(spark, sf_dir), "main_category"))


@query("""WITH i AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS store, p_retailprice FROM part), g AS (SELECT store, count(*) AS n, avg(p_retailprice) AS a, sum(p_retailprice) AS t FROM i WHERE store IS NOT NULL GROUP BY store)
  SELECT p_partkey, i.store, CAST(coalesce(n, 0) AS BIGINT) AS n_items, round(coalesce(a, 0), 6) AS avg_value, round(coalesce(t, 0), 4) AS total_value, CASE WHEN i.store IS NULL THEN 0 ELSE 1 END AS has_store FROM i LEFT JOIN g ON i.store = g.store""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, None).otherwise(F.col("p_brand")).alias("store"), "p_retailprice")
    return Q(stats.store_features(items, "p_partkey", "store", "p_retailprice")).withColumn("total_value", F.round("total_value", 4))


@query("""WITH u AS (SELECT user_id, avg(rating) AS um FROM reviews GROUP BY 1)
  SELECT user_id, main_category, round(avg(rating), 6) AS mean_rating, CAST(count(*) AS BIGINT) AS n_reviews, round(avg(rating) - any_value(um), 6) + 0.0 AS deviation FROM reviews JOIN u USING (user_id) GROUP BY user_id, main_category""")
def user_category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.pair_stats(reviews(spark, sf_dir)))


@query("""WITH p AS (SELECT prod_id, avg(rating) AS pm FROM reviews GROUP BY 1) SELECT user_id, round(avg(rating - pm), 6) + 0.0 AS mean_deviation FROM reviews JOIN p USING (prod_id) GROUP BY user_id""")
def user_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.mean_deviation(reviews(spark, sf_dir)))


@query("""WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) SELECT "column", round(100.0 * missing / n, 2) AS missing_pct FROM (
  SELECT 'text' AS "column", count(*) AS n, sum(CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 1 ELSE 0 END) AS missing FROM d UNION ALL SELECT 'lang', count(*), sum(CASE WHEN lang IS NULL OR trim(lang, ' ') = '' THEN 1 ELSE 0 END) FROM d
  UNION ALL SELECT 'quality', count(*), sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) FROM d UNION ALL SELECT 'toxic', count(*), sum(CASE WHEN toxic IS NULL THEN 1 ELSE 0 END) FROM d)""")
def missing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.missing_rates(rows, ["text", "lang", "quality", "toxic"])


@query("SELECT event_type AS value, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 2) AS pct FROM events GROUP BY event_type")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_distribution(table(spark, sf_dir, "events"), "event_type")


@query("""SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, CAST(sum(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros FROM events""")
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.numeric_summary(table(spark, sf_dir, "events"), "value"))


_EXACT = "SELECT event_type AS part, value AS v, user_id FROM events UNION ALL SELECT 'all', value, user_id FROM events"


@query(f"""WITH x AS ({_EXACT}) SELECT part, CAST(count(*) AS BIGINT) AS n, true AS median_close, true AS p99_close, true AS distinct_close FROM x GROUP BY part""")
def sketched_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians, 99 % quantiles and distinct users of each type of event and, merged from these sketches, of all events; each is held against the exact ranks and counts."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("part"), "value", "user_id")
    kept = io.materialize(sketches.sketch_groups(events, ["part"], "value", "user_id"), io.scratch(spark, "sketches"))
    whole = sketches.merged(kept).withColumn("part", F.lit("all"))
    told = sketches.asked(kept.unionByName(whole), {"median": 0.5, "p99": 0.99})
    both = events.unionByName(events.withColumn("part", F.lit("all"))).join(F.broadcast(told), "part")  # a row for each type
    share = lambda q: F.abs(F.avg((F.col("value") <= F.col(q)).cast("double")) - {"median": 0.5, "p99": 0.99}[q]) < 0.02
    out = both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), share("median").alias("median_close"), share("p99").alias("p99_close"), F.countDistinct("user_id").alias("exact"), F.first("n_distinct").alias("told"))
    return out.select("part", "n", "median_close", "p99_close", (F.abs(F.col("told") / F.col("exact") - 1) < 0.06).alias("distinct_close"))


@query("""SELECT epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_iso, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_iso FROM events""")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.time_range(table(spark, sf_dir, "events"), "ts")


@query("""SELECT prod_id AS key, round(avg(rating), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM reviews GROUP BY prod_id HAVING count(*) >= 30""")
def having_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.supported_means(reviews(spark, sf_dir), F.col("prod_id"), "rating", 30))


@query("SELECT prod_id, CAST(count(*) AS BIGINT) AS n FROM reviews GROUP BY prod_id ORDER BY n DESC, prod_id LIMIT 10")
def topk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_groups(reviews(spark, sf_dir), "prod_id", 10)


@query("""WITH v AS (SELECT CAST(n_chars AS DOUBLE) AS x FROM documents), b AS (SELECT min(x) AS low, quantile_cont(x, 0.99) AS high FROM v)
  SELECT CAST(least(floor((least(x, high) - low) / ((high - low) / 20)), 19) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM v, b GROUP BY 1""")
def histogram_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "documents"), "n_chars", 20, clip_quantile=0.99)


@query("""WITH v AS (SELECT ln(1 + n_chars) AS x FROM documents), b AS (SELECT min(x) AS low, max(x) AS high FROM v)
  SELECT CAST(least(floor((least(x, high) - low) / ((high - low) / 16)), 15) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM v, b GROUP BY 1""")
def histogram_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "documents"), "n_chars", 16, log=True)


@query("""SELECT round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6) AS median, round(stddev_samp(length(text)), 6) AS std, CAST(min(length(text)) AS DOUBLE) AS min, CAST(max(length(text)) AS DOUBLE) AS max,
  CAST(sum(CASE WHEN length(text) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros FROM documents""")
def text_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.numeric_summary(table(spark, sf_dir, "documents").select(F.length("text").alias("len")), "len"))


@query("SELECT year(ts) AS key, round(avg(rating), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM order_reviews GROUP BY 1")
def yearly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.supported_means(order_reviews(spark, sf_dir), F.year("ts"), "rating", 1))


@query("""SELECT 'price' AS feature, round(corr(price, rating), 6) + 0.0 AS corr FROM reviews UNION ALL SELECT 'votes', round(corr(votes, rating), 6) + 0.0 FROM reviews UNION ALL SELECT 'purchased', round(corr(CAST(purchased AS INT), rating), 6) + 0.0 FROM reviews""")
def feature_target_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.feature_target_corr(reviews(spark, sf_dir).withColumn("purchased", F.col("purchased").cast("int")), ["price", "votes", "purchased"], "rating"))


@query("""SELECT * FROM (SELECT 'price' AS feature, round(corr(price, rating), 6) + 0.0 AS corr FROM reviews UNION ALL SELECT 'votes', round(corr(votes, rating), 6) + 0.0 FROM reviews UNION ALL SELECT 'store_id', round(corr(store_id, rating), 6) + 0.0 FROM reviews) ORDER BY abs(corr) DESC, feature LIMIT 2""")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.top_features(stats.feature_target_corr(reviews(spark, sf_dir), ["price", "votes", "store_id"], "rating"), 2))


@query("""SELECT o_custkey AS user_id, CAST(min(o_orderkey) AS BIGINT) AS id, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey""")
def first_value_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return stats.first_per_group(rows, "user_id", ["id"])


@query("SELECT round(avg(m), 6) AS mean_of_means FROM (SELECT avg(rating) AS m FROM reviews GROUP BY user_id)")
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(stats.mean_of_means(reviews(spark, sf_dir), "user_id", "rating"))


# ---- windows and scalar features


@query("""SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice ASC NULLS LAST) AS price_rank, round(ln(1 + p_retailprice), 6) AS log_price,
  CASE WHEN p_retailprice < 1000 THEN 0 WHEN p_retailprice <= 1500 THEN 1 ELSE 2 END AS price_bucket FROM part""")
def price_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ranked = stats.dense_ranks(part, "p_brand", "p_retailprice", "price_rank")
    return Q(ranked.select("p_partkey", "price_rank", F.log1p("p_retailprice").alias("log_price"), fn.price_bucket(F.col("p_retailprice"), 1000, 1500).alias("price_bucket")))


@query("""SELECT id, year(ts) AS year, month(ts) AS month, day(ts) AS day, dayofweek(ts) + 1 AS weekday, hour(ts) AS hour, CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN month(ts) IN (11, 12) THEN 1 ELSE 0 END AS is_holiday_season FROM order_reviews""")
def temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return order_reviews(spark, sf_dir).select("id", *[x.alias(c) for c, x in fn.time_parts(F.timestamp_millis(millis)).items()])


@query("""SELECT doc_id, length(source) AS title_len, length(text) AS comment_len, round(length(source) / (length(text) + 1.0), 6) AS len_ratio, CASE WHEN regexp_matches(text, '[A-Z]') THEN 1 ELSE 0 END AS has_caps,
  CASE WHEN contains(text, '!') THEN 1 ELSE 0 END AS has_exclamation FROM documents""")
def text_length_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(table(spark, sf_dir, "documents").select("doc_id", *[x.alias(c) for c, x in fn.length_features(F.col("source"), F.col("text")).items()]))


_WS = r"regexp_replace(text, '[\t\n\v\f\r ]+', ' ', 'g')"


@query(rf"""SELECT doc_id, length(text) AS chars, CASE WHEN trim({_WS}, ' ') = '' THEN 0 ELSE len(string_split(trim({_WS}, ' '), ' ')) END AS words,
  round(length(regexp_replace(text, '[^!-/:-@\[-`{{-~]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE), 6) AS punct_ratio, round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE), 6) AS upper_ratio,
  round(length(regexp_replace(text, '[^0-9]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE), 6) AS digit_ratio FROM documents""")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(table(spark, sf_dir, "documents").select("doc_id", *[x.alias(c) for c, x in fn.text_stats(F.col("text")).items()]))


@query("""WITH l AS (SELECT p_partkey, string_split(p_name, ' ') AS items FROM part)
  SELECT p_partkey, len(items) AS n_items, CAST(list_sum(list_transform(items, lambda x: length(x))) AS INT) AS total_len, round(list_sum(list_transform(items, lambda x: length(x))) / CAST(len(items) AS DOUBLE), 6) AS mean_len, 1 AS has_items FROM l""")
def list_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = F.concat(F.lit("['"), F.regexp_replace("p_name", " ", "', '"), F.lit("']"))
    return Q(table(spark, sf_dir, "part").select("p_partkey", *[x.alias(c) for c, x in fn.list_features(literal).items()]))


@query("""WITH u AS (SELECT user_id, avg(rating) AS um, count(*) AS un FROM reviews GROUP BY 1), p AS (SELECT prod_id, avg(rating) AS pm, count(*) AS pn FROM reviews GROUP BY 1)
  SELECT DISTINCT user_id, prod_id, round(um - pm, 6) + 0.0 AS mean_diff, round((um + pm) / 2, 6) AS mean_avg, round(um / (pm + 1e-6), 6) AS mean_ratio, round(um * un, 6) AS user_weight, round(pm * pn, 6) AS prod_weight,
  round(ln(1 + un), 6) AS log_user_count, round(ln(1 + pn), 6) AS log_prod_count FROM reviews JOIN u USING (user_id) JOIN p USING (prod_id)""")
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    users = rows.groupBy("user_id").agg(F.avg("rating").alias("um"), F.count(F.lit(1)).alias("un"))
    products = rows.groupBy("prod_id").agg(F.avg("rating").alias("pm"), F.count(F.lit(1)).alias("pn"))
    both = joins.chain_lookup(rows.select("user_id", "prod_id").distinct(), (users, "user_id"), (products, "prod_id"))
    return Q(both.select("user_id", "prod_id", *[x.alias(c) for c, x in fn.interactions(F.col("um"), F.col("un"), F.col("pm"), F.col("pn")).items()]))
