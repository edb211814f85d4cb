"""Queries: lexicons, vectors, TF-IDF, SVD, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.functions import lexicon as lx, vectors as vec
from starling.functions.scalar import rounded as Q
from starling.operators import graph, tfidf
from starling.plans.registry import query
from starling.sources import io
from starling.sources.views import order_reviews, reviews, table

_WS = r"regexp_replace({0}, '[\t\n\v\f\r ]+', ' ', 'g')"
_TOK = "string_split(lower(trim(" + _WS + ", ' ')), ' ')"


_LEARNED = f"""marked AS (SELECT doc_id, max(quality) AS y FROM labels GROUP BY doc_id), seen AS (SELECT y, unnest(list_distinct({_TOK.format('text')})) AS word FROM documents JOIN marked USING (doc_id)),
  total AS (SELECT sum(y) AS t1, sum(1 - y) AS t0 FROM documents JOIN marked USING (doc_id)), counted AS (SELECT word, sum(y) AS n1, sum(1 - y) AS n0 FROM seen WHERE word <> '' GROUP BY word HAVING count(*) >= 3),
  lexicon AS (SELECT word, 4 * p AS valence, p AS polarity, abs(p) AS subjectivity FROM (SELECT word, (n1 / t1 - n0 / t0) / (n1 / t1 + n0 / t0) AS p FROM counted, total) WHERE p <> 0)"""


def _learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon of thousands of words, from the quality labels."""
    return lx.learned_lexicon(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")


@query("WITH " + _LEARNED + " SELECT word, round(valence, 6) + 0.0 AS valence, round(subjectivity, 6) AS subjectivity FROM lexicon")
def learned_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(_learned(spark, sf_dir).drop("polarity", "n_docs"))


@query("WITH " + _LEARNED + f""", pos AS (SELECT list(word) AS ws FROM (SELECT word FROM lexicon WHERE valence > 0 ORDER BY valence DESC, word LIMIT 100)), neg AS (SELECT list(word) AS ws FROM (SELECT word FROM lexicon WHERE valence < 0 ORDER BY valence, word LIMIT 100))
  SELECT doc_id, CAST(len(list_intersect(list_distinct({_TOK.format('text')}), pos.ws)) AS INT) AS pos_hits, CAST(len(list_intersect(list_distinct({_TOK.format('text')}), neg.ws)) AS INT) AS neg_hits FROM documents, pos, neg""")
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the 100 most positive and the 100 most negative words of the learned lexicon."""
    lexicon = io.materialize(_learned(spark, sf_dir), io.scratch(spark, "lexicon"))
    pos, neg = ([r["word"] for r in lexicon.where(where).orderBy(*order, "word").limit(100).collect()] for where, order in (("valence > 0", [F.desc("valence")]), ("valence < 0", [F.asc("valence")])))  # bounded lists
    return table(spark, sf_dir, "documents").select("doc_id", lx.hits(F.col("text"), pos).alias("pos_hits"), lx.hits(F.col("text"), neg).alias("neg_hits"))


@query("WITH " + _LEARNED + f""", tok AS (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS word FROM documents), h AS (SELECT doc_id, sum(CASE WHEN valence > 0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN valence < 0 THEN 1 ELSE 0 END) AS n FROM tok JOIN lexicon USING (word) GROUP BY 1)
  SELECT doc_id, CAST(coalesce(p, 0) AS BIGINT) AS pos_hits, CAST(coalesce(n, 0) AS BIGINT) AS neg_hits FROM documents LEFT JOIN h USING (doc_id)""")
def table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.table_hits(table(spark, sf_dir, "documents"), "doc_id", "text", io.materialize(_learned(spark, sf_dir), io.scratch(spark, "lexicon")))


def _valence_sql(source: str, key: str, lexicon: str = _LEARNED) -> str:
    return f"""{lexicon}, tok AS (SELECT {key}, unnest({_TOK.format('text')}) AS word FROM {source}), size AS (SELECT {key}, len({_TOK.format('text')}) AS size FROM {source}),
  h AS (SELECT {key}, sum(valence) AS s, sum(CASE WHEN valence > 0 THEN valence + 1 ELSE 0 END) AS p, sum(CASE WHEN valence < 0 THEN valence - 1 ELSE 0 END) AS n, count(*) AS c FROM tok JOIN lexicon USING (word) GROUP BY {key}),
  v AS (SELECT {key}, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(n, 0) AS n, size - coalesce(c, 0) AS neutral FROM size LEFT JOIN h USING ({key})),
  val AS (SELECT {key}, p / (p - n + neutral) AS pos, -n / (p - n + neutral) AS neg, neutral / (p - n + neutral) AS neu, s / sqrt(s * s + 15) AS compound FROM v)"""


@query("WITH " + _valence_sql("documents", "doc_id", _LEARNED) + " SELECT doc_id, round(pos, 6) AS pos, round(neg, 6) + 0.0 AS neg, round(neu, 6) AS neu, round(compound, 6) + 0.0 AS compound FROM val")
def valence_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(lx.valence(table(spark, sf_dir, "documents"), "doc_id", "text", _learned(spark, sf_dir)))


@query(f"""WITH {_LEARNED}, tok AS (SELECT doc_id, unnest({_TOK.format('text')}) AS word FROM documents), m AS (SELECT doc_id, avg(polarity) AS p, avg(subjectivity) AS s FROM tok JOIN lexicon USING (word) GROUP BY 1)
  SELECT doc_id, round(coalesce(p, 0), 6) + 0.0 AS polarity, round(coalesce(s, 0), 6) AS subjectivity FROM documents LEFT JOIN m USING (doc_id)""")
def polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(lx.polarity(table(spark, sf_dir, "documents"), "doc_id", "text", _learned(spark, sf_dir)))


@query("WITH turns AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS k, conv_id, turn, role, text FROM conversations), " + _valence_sql("turns", "k") + """
  SELECT a.conv_id, a.turn, round(abs(x.compound - y.compound), 6) AS disagreement FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' JOIN val x ON x.k = a.k JOIN val y ON y.k = b.k WHERE a.role = 'user'""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("k", F.concat_ws("/", "conv_id", "turn"))
    val = lx.valence(turns, "k", "text", _learned(spark, sf_dir)).select("k", "compound")
    both = turns.join(val, "k").select("conv_id", "turn", "role", "compound")
    reply = both.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("compound").alias("other"))
    return Q(both.where("role = 'user'").join(reply, ["conv_id", "turn"]).select("conv_id", "turn", F.abs(F.col("compound") - F.col("other")).alias("disagreement")))


@query("""SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 6) + 0.0 AS dot, CAST(len(a.embedding) + len(b.embedding) + 1 AS INT) AS width
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    d = vec.dot(F.col("embedding"), F.col("other"))
    return Q(rows.join(other, "vec_id").select("vec_id", d.alias("dot"), F.size(F.concat(F.col("embedding").cast("array<double>"), F.col("other").cast("array<double>"), F.array(d))).alias("width")))


@query("""WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings)
  SELECT CAST(count(*) AS BIGINT) AS n, round(avg(norm), 6) AS mean_norm, round(min(norm), 6) AS min_norm, round(max(norm), 6) AS max_norm, CAST(sum(CASE WHEN norm < 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_near_zero, avg(norm) < 0.1 AS is_near_zero FROM n""")
def embedding_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(vec.norm_health(table(spark, sf_dir, "embeddings"), "embedding"))


@query("SELECT CAST(i - 1 AS INT) AS dim, round(var_pop(CAST(embedding[i] AS DOUBLE)), 6) AS variance FROM embeddings, range(1, 65) r(i) GROUP BY i")
def embedding_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(vec.dimension_variance(table(spark, sf_dir, "embeddings"), "embedding"))


@query("""SELECT label, CAST(i - 1 AS INT) AS dim, round(sum(CASE WHEN vec_id % 3 <> 0 THEN CAST(embedding[i] AS DOUBLE) ELSE 0 END) / greatest(sum(CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END), 1e-9), 6) + 0.0 AS value FROM embeddings, range(1, 65) r(i) GROUP BY label, i""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    return Q(vec.masked_mean(rows, "label", "embedding", "mask"))


@query("""SELECT event_id, round(coalesce(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 0), 6) + 0.0 AS total, CAST(64 AS INT) AS width FROM events LEFT JOIN embeddings ON user_id * 4 = vec_id""")
def vector_lookup_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 4).alias("vec_id"))
    found = vec.lookup(rows, table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return Q(found.select("event_id", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("embedding").alias("width")))


@query("""SELECT id, rating, [CASE WHEN rating - 1 > 0 THEN 1 ELSE 0 END, CASE WHEN rating - 1 > 1 THEN 1 ELSE 0 END, CASE WHEN rating - 1 > 2 THEN 1 ELSE 0 END, CASE WHEN rating - 1 > 3 THEN 1 ELSE 0 END]::VARCHAR AS targets,
  round(1 + 4 / (1 + exp(-CAST(rating AS DOUBLE))), 6) AS decoded FROM order_reviews""")
def ordinal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = vec.ordinal_targets(F.col("rating"))
    text = F.concat(F.lit("["), F.concat_ws(", ", targets.cast("array<string>")), F.lit("]"))
    return Q(order_reviews(spark, sf_dir).select("id", "rating", text.alias("targets"), vec.ordinal_decode(F.array_repeat(F.col("rating").cast("double"), 4)).alias("decoded")))


# ---- TF-IDF


_TF = "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms}) AS term FROM documents) GROUP BY ALL)"
_WORDS = "regexp_extract_all(lower(text), '([a-z0-9][a-z0-9]+)', 1)"
_WEIGH = """, n AS (SELECT count(DISTINCT doc_id) AS n_docs FROM tf), vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT {size}),
  w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n_docs) / (1.0 + df)) + 1) AS w FROM tf JOIN vocab USING (term), n)
  SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


def _once(counts: DataFrame) -> DataFrame:
    """Written, as the vocabulary, the number of documents and the weights all read it."""
    return io.materialize(counts, io.scratch(counts.sparkSession, "term-counts"))


def _weights(docs: DataFrame, size: int, terms: tfidf.Terms = tfidf.words) -> DataFrame:
    """Counted anew for vocabulary and weights, each by one shuffle of the texts: written counts would have to be shuffled by document."""
    counts = tfidf.term_counts(docs, "doc_id", "text", terms)
    worded = docs.where(F.size(terms(F.coalesce("text", F.lit("")))) > 0)
    return tfidf.weigh(counts, tfidf.vocabulary(counts, "doc_id", size, worded), "doc_id")


@query("WITH " + _TF.format(terms="regexp_extract_all(lower(strip_accents(text)), '([a-z0-9][a-z0-9]+)', 1)") + _WEIGH.format(size=5000))
def tfidf_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(_weights(table(spark, sf_dir, "documents"), 5000, tfidf.plain_words))


@query("WITH ws AS (SELECT doc_id, " + _WORDS + " AS w FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ws) GROUP BY ALL)" + _WEIGH.format(size=2000))
def tfidf_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(tfidf.term_weights(table(spark, sf_dir, "documents"), "doc_id", "text", 2000, tfidf.words_and_pairs))


@query("WITH ws AS (SELECT doc_id, unnest(" + _WORDS + ") AS w FROM documents), wc AS (SELECT doc_id, ' ' || w || ' ' AS w, count(*) AS c FROM ws GROUP BY ALL), g AS (SELECT doc_id, c, unnest(list_transform(range(1, greatest(length(w) - n + 2, 1)), lambda i: substr(w, i, n))) AS term FROM wc, range(3, 6) r(n)), tf AS (SELECT doc_id, term, CAST(sum(c) AS BIGINT) AS tf FROM g GROUP BY ALL)" + _WEIGH.format(size=1000))
def tfidf_char_wb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(tfidf.char_weights(table(spark, sf_dir, "documents"), "doc_id", "text", 1000))


@query("WITH ws AS (SELECT doc_id, unnest(" + _WORDS + ") AS w FROM documents), wc AS (SELECT doc_id, ' ' || w || ' ' AS w, count(*) AS c FROM ws GROUP BY ALL), g AS (SELECT doc_id, c, unnest(list_transform(range(1, greatest(length(w) - n + 2, 1)), lambda i: substr(w, i, n))) AS term FROM wc, range(3, 6) r(n)), tf AS (SELECT doc_id, term, CAST(sum(c) AS BIGINT) AS tf FROM g GROUP BY ALL), weighed AS (SELECT * FROM ("
    + "WITH x AS (SELECT 1)" + _WEIGH.format(size=30_000).replace("round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6)", "w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))") + ")) SELECT doc_id, CAST(count(*) AS BIGINT) AS nnz, round(sum(weight), 3) AS total FROM weighed GROUP BY doc_id")
def tfidf_char_30k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30,000 character grams: entries and total weight of each document's vector."""
    weights = tfidf.char_weights(table(spark, sf_dir, "documents"), "doc_id", "text", 30_000)
    return weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nnz"), F.round(F.sum("weight"), 3).alias("total"))


@query("WITH " + _TF.format(terms=_WORDS) + """, n AS (SELECT count(DISTINCT doc_id) AS n_docs FROM tf) SELECT term, CAST(sum(tf) AS BIGINT) AS cf, CAST(count(*) AS BIGINT) AS df, round(ln((1 + any_value(n_docs)) / (1.0 + count(*))) + 1, 6) AS idf FROM tf, n GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 500""")
def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted vocabulary through its saved table."""
    counts = tfidf.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return Q(io.materialize(tfidf.vocabulary(counts, "doc_id", 500), io.scratch(spark, "vocabulary")))


@query("WITH " + _TF.format(terms=_WORDS) + """, vocab AS (SELECT term, sum(tf) AS cf FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 5000) SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS nnz, round(count(*) / (count(DISTINCT doc_id) * 5000.0), 6) AS density FROM tf JOIN vocab USING (term)""")
def tfidf_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(tfidf.density(_weights(table(spark, sf_dir, "documents"), 5000), "doc_id", 5000))


@query("""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9][a-z0-9]+)', 1)) AS term FROM documents) GROUP BY ALL), n AS (SELECT count(DISTINCT doc_id) AS n_docs FROM tf),
  vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 2000), b AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '([a-z0-9][a-z0-9]+)', 1)) AS term FROM benchmark) GROUP BY ALL),
  w AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + n_docs) / (1.0 + df)) + 1) AS w FROM b JOIN vocab USING (term), n) SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w""")
def tfidf_transform_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on documents, applied to the benchmark's texts; unseen terms drop out."""
    vocab = tfidf.vocabulary(tfidf.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", 2000)
    return Q(tfidf.weigh(tfidf.term_counts(table(spark, sf_dir, "benchmark"), "item_id", "text"), vocab, "item_id"))


_HASHED_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda x: x <> '')"
_MD5 = "('0x' || substr(md5(gram), 1, 8))::BIGINT"


@query(f"""WITH ws AS (SELECT doc_id, {_HASHED_WORDS} AS w FROM documents), g AS (SELECT doc_id, k AS level, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram FROM ws, range(1, 4) r(k)),
  tf AS (SELECT doc_id, CASE level WHEN 1 THEN {_MD5} % 16668 ELSE 16668 + (level - 2) * 16666 + {_MD5} % 16666 END AS idx, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n_docs FROM documents), df AS (SELECT idx, count(*) AS df FROM tf GROUP BY idx HAVING count(*) >= 2)
  SELECT doc_id, CAST(idx AS INT) AS idx, round(tf * ln((1 + n_docs) / (1.0 + df)), 6) AS val FROM tf JOIN df USING (idx), n WHERE df < n_docs""")
def tfidf_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, pairs and triples in 50,000 dimensions; one row an entry."""
    docs = table(spark, sf_dir, "documents")
    counts = _once(tfidf.hashed_counts(docs, "doc_id", "text"))
    return Q(tfidf.hashed_weights(counts, docs, "doc_id"))


@query()
def svd_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text embeddings: TF-IDF of 1,000 terms and its first 16 components, with the benchmark's texts projected alongside."""
    vocab, rows = tfidf.sparse_rows(table(spark, sf_dir, "documents"), "doc_id", "text", 1000)
    v, values = tfidf.truncated_svd(rows, 1000, 16)
    items = tfidf.term_counts(table(spark, sf_dir, "benchmark"), "item_id", "text")
    fresh = tfidf.indexed(tfidf.weigh(items, vocab, "item_id"), vocab, "item_id").withColumnRenamed("item_id", "doc_id")
    both = tfidf.project(rows, v, "doc_id").withColumn("split", F.lit("train")).unionByName(tfidf.project(fresh, v, "doc_id").withColumn("split", F.lit("test")))
    return tfidf.spread(both.withColumn("explained", F.lit(round(tfidf.explained_share(rows, values), 6))), "embedding", 16)


@query()
def svd_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    """512 components of up to 50,000 terms: each one's singular value and the share explained up to it."""
    vocab, rows = tfidf.sparse_rows(table(spark, sf_dir, "documents"), "doc_id", "text", 50_000)
    _, values = tfidf.truncated_svd(rows, max(vocab.count(), 1), 512, passes=1)
    total = tfidf.explained_share(rows, values)
    upto = (values**2).cumsum() / max((values**2).sum(), 1e-300) * total
    return Q(spark.createDataFrame([(i, float(s), float(x)) for i, (s, x) in enumerate(zip(values, upto, strict=True))], "component int, singular double, explained double"), 4)


@query()
def svd_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same embedding of product names."""
    _, rows = tfidf.sparse_rows(table(spark, sf_dir, "part"), "p_partkey", "p_name", 500)
    v, _ = tfidf.truncated_svd(rows, 500, 8)
    return Q(tfidf.spread(tfidf.project(rows, v, "p_partkey"), "embedding", 8), 4)


# ---- graph

_EDGES = """pairs AS (SELECT user_id, prod_id, CAST(count(*) AS DOUBLE) AS w FROM reviews GROUP BY ALL), edges AS (SELECT 'u' || user_id AS src, 'i' || prod_id AS dst, w FROM pairs UNION ALL SELECT 'i' || prod_id, 'u' || user_id, w FROM pairs)"""
NORMALIZED = _EDGES + ", deg AS (SELECT src, greatest(sum(w), 1) AS d FROM edges GROUP BY src), norm AS (SELECT e.src, e.dst, e.w / sqrt(a.d * b.d) AS w FROM edges e JOIN deg a ON e.src = a.src JOIN deg b ON e.dst = b.src)"


@query("WITH " + _EDGES + " SELECT src, dst, w FROM edges")
def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bipartite_edges(reviews(spark, sf_dir))


@query("WITH " + NORMALIZED + " SELECT src, dst, round(w, 6) AS w FROM norm")
def normalized_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(graph.normalized(graph.bipartite_edges(reviews(spark, sf_dir))))


def _cells(spark: SparkSession, sf_dir: str, dims: int, counts: DataFrame | None = None) -> tuple[graph.Cells, DataFrame]:
    """(cells of the pairs' counts, starting vectors of all nodes)."""
    cells = graph.pair_cells(reviews(spark, sf_dir), dims, counts=counts)
    return cells, graph.hashed_vectors(cells.degrees.select(F.col("node").alias("src")), dims)


def _start(k: int) -> str:
    return f"('0x' || substr(md5(src || '#{k}'), 1, 6))::BIGINT / 16777216.0 - 0.5 AS e{k}"


def layers(dims: int, n: int) -> str:
    out = f", l0 AS (SELECT src AS node, {', '.join(_start(k) for k in range(dims))} FROM (SELECT DISTINCT src FROM edges))"
    for i in range(1, n + 1):
        out += f", l{i} AS (SELECT dst AS node, {', '.join(f'sum(w * e{k}) AS e{k}' for k in range(dims))} FROM norm JOIN l{i - 1} ON src = node GROUP BY dst)"
    union = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(n + 1))
    return out + f", final AS (SELECT node, {', '.join(f'sum(e{k}) / {n + 1} AS e{k}' for k in range(dims))} FROM ({union}) GROUP BY node)"


def propagated(spark: SparkSession, sf_dir: str, dims: int, n: int, counts: DataFrame | None = None) -> DataFrame:
    cells, start = _cells(spark, sf_dir, dims, counts)
    return graph.propagate(None, start, dims, n, cells)


@query("WITH " + NORMALIZED + layers(4, 3) + " SELECT node, round(e0, 6) + 0.0 AS e0, round(e1, 6) + 0.0 AS e1, round(e2, 6) + 0.0 AS e2, round(e3, 6) + 0.0 AS e3 FROM final")
def propagate_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = propagated(spark, sf_dir, 4, 3)
    return Q(out.select("node", *[F.col("e")[k].alias(f"e{k}") for k in range(4)]))


@query("WITH " + NORMALIZED + layers(64, 3) + f" SELECT node, round(sqrt({' + '.join(f'e{k} * e{k}' for k in range(64))}), 6) AS norm, round(e0, 6) + 0.0 AS e0, round(e63, 6) + 0.0 AS e63 FROM final")
def propagate_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of 64 dimensions, exported and read back: norms, first and last dimension."""
    out = io.materialize(propagated(spark, sf_dir, 64, 3), io.scratch(spark, "node-vectors"))
    return Q(out.select("node", vec.norm(F.col("e")).alias("norm"), F.col("e")[0].alias("e0"), F.col("e")[63].alias("e63")))


@query("WITH " + _EDGES + ", d AS (SELECT src, count(*) AS d FROM edges GROUP BY src) SELECT CAST(count(*) AS BIGINT) AS n_nodes, CAST(sum(d) AS BIGINT) AS n_edges, round(avg(d), 6) AS mean_degree, CAST(max(d) AS BIGINT) AS max_degree FROM d")
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(graph.degree_stats(graph.bipartite_edges(reviews(spark, sf_dir))))


#: Triples with negatives that the user has not: of 8 draws, the first that is none of the user's own.
_TRIPLES = NORMALIZED + layers(2, 1) + """, items AS (SELECT prod_id, row_number() OVER (ORDER BY prod_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT prod_id FROM reviews)),
  drawn AS (SELECT p.user_id, p.prod_id, x.prod_id AS neg, d FROM pairs p, range(8) k(d), items x WHERE x.r = ('0x' || substr(md5('42/' || d || '/' || p.user_id || '/' || p.prod_id), 1, 8))::BIGINT % x.n),
  t AS (SELECT 'u' || user_id AS u, 'i' || prod_id AS i, 'i' || arg_min(neg, d) AS j FROM drawn ANTI JOIN (SELECT user_id, prod_id AS neg FROM pairs) USING (user_id, neg) GROUP BY user_id, prod_id),
  s AS (SELECT u, i, j, a.e0 AS u0, a.e1 AS u1, b.e0 - c.e0 AS d0, b.e1 - c.e1 AS d1, a.e0 * (b.e0 - c.e0) + a.e1 * (b.e1 - c.e1) AS gap FROM t JOIN final a ON a.node = u JOIN final b ON b.node = i JOIN final c ON c.node = j)"""


def _triples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(triples, vectors of two dimensions after one layer)."""
    counts = graph.pair_counts(reviews(spark, sf_dir))
    vectors = io.materialize(propagated(spark, sf_dir, 2, 1, counts), io.scratch(spark, "node-vectors"))
    pairs = graph.with_negatives(counts.drop("w"), counts, "user_id", "prod_id", draws=8)
    return io.materialize(graph.named_triples(pairs, "user_id", "prod_id"), io.scratch(spark, "triples")), vectors


@query("WITH " + _TRIPLES + " SELECT round(avg(ln(1 + exp(-gap))), 6) AS loss, CAST(count(*) AS BIGINT) AS n FROM s")
def bpr_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(graph.bpr_loss(*_triples(spark, sf_dir)))


@query("WITH " + _TRIPLES + """, g AS (SELECT *, -1 / (1 + exp(gap)) / (SELECT count(*) FROM s) AS pull FROM s), parts AS (SELECT u AS node, pull * d0 AS e0, pull * d1 AS e1 FROM g UNION ALL SELECT i, pull * u0, pull * u1 FROM g UNION ALL SELECT j, -pull * u0, -pull * u1 FROM g)
  SELECT node, round(1e6 * sum(e0), 4) + 0.0 AS g0, round(1e6 * sum(e1), 4) + 0.0 AS g1 FROM parts GROUP BY node""")
def bpr_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss's gradient of each node's vector, in millionths."""
    triples, vectors = _triples(spark, sf_dir)
    slope = graph.bpr_gradient(triples, vectors, 2, triples.count())
    return Q(slope.select("node", *[(1e6 * F.col("e")[k]).alias(f"g{k}") for k in range(2)]), 4)


@query()
def bpr_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking loss before each of three gradient steps on eight dimensions, propagated over one layer."""
    counts = graph.pair_counts(reviews(spark, sf_dir))
    cells, start = _cells(spark, sf_dir, 8, counts)
    _, losses = graph.bpr_train(cells, counts.drop("w"), counts, start, 8, steps=3, rate=20_000.0, layers=1)
    return Q(spark.createDataFrame(list(enumerate(losses)), "step int, loss double"))


@query()
def warm_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singular vectors of the interactions as layer 0 of three layers of 64 dimensions, exported with the node numbering and read back: norms, and the variance that the start explains."""
    rows = reviews(spark, sf_dir)
    cells = graph.pair_cells(rows, 72)
    start, share = graph.svd_start(rows, dims=64, adjacent=cells)
    path = io.scratch(spark, "warm")
    graph.save_vectors(graph.propagate(None, start, 64, adjacent=cells), path)
    return Q(graph.load_vectors(spark, path).select("node", vec.norm(F.col("e")).alias("norm"), F.lit(share).alias("explained")), 4)


@query("""WITH u AS (SELECT user_id, avg(rating) AS m, count(*) AS n, coalesce(stddev_samp(rating), 0) AS s FROM reviews GROUP BY 1), p AS (SELECT prod_id, avg(rating) AS m, count(*) AS n, coalesce(stddev_samp(rating), 0) AS s FROM reviews GROUP BY 1),
  c AS (SELECT main_category, avg(rating) AS m, count(*) AS n FROM reviews GROUP BY 1), d AS (SELECT user_id, avg(rating - p.m) AS d FROM reviews JOIN p USING (prod_id) GROUP BY 1)
  SELECT DISTINCT user_id, prod_id, main_category, round(u.m, 6) AS user_mean, CAST(u.n AS BIGINT) AS user_count, round(u.s, 6) AS user_std, round(d, 6) + 0.0 AS user_deviation, round(p.m, 6) AS item_mean, CAST(p.n AS BIGINT) AS item_count, round(p.s, 6) AS item_std,
  round(c.m, 6) AS category_mean, CAST(c.n AS BIGINT) AS category_count, round(u.m - p.m, 6) + 0.0 AS mean_difference, round((u.m + p.m) / 2, 6) AS mean_of_both FROM reviews JOIN u USING (user_id) JOIN d USING (user_id) JOIN p USING (prod_id) JOIN c USING (main_category)""")
def graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q(graph.stat_features(reviews(spark, sf_dir)))


@query()
def svd_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm starts from the singular vectors of the interactions: each node's norm, and the variance explained."""
    vectors, share = graph.svd_start(reviews(spark, sf_dir))
    return Q(vectors.select("node", vec.norm(F.col("e")).alias("norm"), F.lit(share).alias("explained")), 4)


@query()
def als_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).select(F.col("user_id").cast("int"), F.col("prod_id").cast("int"))
    return graph.als_factors(rows).select("node", F.size("e").alias("width"), vec.norm(F.col("e")).alias("norm"))


