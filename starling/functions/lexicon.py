"""Lexicon features: hits, valence, polarity.

Lexicons are tables (word, valence, polarity, subjectivity), read from a path or learned from
labelled texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starling.operators.joins import BROADCAST_ROWS, split_join
from starling.sources.io import materialize, scratch


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon from Parquet, or from a CSV file with a header."""
    rows = spark.read.option("header", True).csv(path) if path.endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    return rows.select(F.lower("word").alias("word"), *[F.col(c).cast("double").alias(c) for c in ("valence", "polarity", "subjectivity")]).dropDuplicates(["word"])


def learned_lexicon(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", least: int = 3) -> DataFrame:
    """A lexicon from labelled texts: words of at least so many of them, scored by how their share of the texts of class 1 compares with that of class 0; n_docs counts a word's texts."""
    marked = labels.groupBy(key).agg(F.max(label).alias("y"))
    pairs = docs.join(marked, key).select("y", F.explode(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("word"))
    totals = marked.join(docs.select(key), key).agg(F.sum("y").alias("t1"), F.sum(1 - F.col("y")).alias("t0"))
    counts = pairs.where("word <> ''").groupBy("word").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).where(F.col("n1") + F.col("n0") >= least)
    a, b = F.col("n1") / F.nullif(F.col("t1"), F.lit(0)), F.col("n0") / F.nullif(F.col("t0"), F.lit(0))
    scored = counts.crossJoin(F.broadcast(totals)).select("word", ((a - b) / (a + b)).alias("polarity"), (F.col("n1") + F.col("n0")).alias("n_docs")).where("polarity <> 0")  # totals: one row
    return scored.select("word", (F.col("polarity") * 4).alias("valence"), "polarity", F.abs("polarity").alias("subjectivity"), "n_docs")


def table_hits(docs: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """key, pos_hits, neg_hits: distinct tokens of positive and of negative valence, for lexicons of any size."""
    pairs = docs.select(key, F.explode(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("word"))
    sums = split_join(pairs, words.select("word", "valence"), "word", "inner").groupBy(key).agg(F.count_if(F.col("valence") > 0).alias("pos_hits"), F.count_if(F.col("valence") < 0).alias("neg_hits"))
    return split_join(docs.select(key), sums, key).fillna(0, ["pos_hits", "neg_hits"])


def tokens(text: Column) -> Column:
    """Lower-cased parts between ASCII white space; an empty text has one, the empty one."""
    return F.split(F.lower(F.trim(text, F.lit(" \t\n\x0b\f\r"))), r"[ \t\n\x0B\f\r]+")


def hits(text: Column, words: list[str]) -> Column:
    """Distinct lower-cased tokens that are in the word list."""
    return F.size(F.array_intersect(F.array_distinct(tokens(F.coalesce(text, F.lit("")))), F.array(*[F.lit(w) for w in words])))


def scored_tokens(docs: DataFrame, key: str, text: str, words: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """key and the lexicon's columns for each token that it has.

    The lexicon is written. A part of ``most`` words at most goes to the texts: all of it if it is no
    larger, else the words of most labelled texts (``n_docs``). Only tokens that this part lacks are
    shuffled to the rest, without the common words that would be hot keys there.
    """
    spark = docs.sparkSession
    words = materialize(words, scratch(spark, "lexicon"))
    columns = [c for c in words.columns if c not in ("word", "n_docs")]
    found = docs.select(key, F.explode(tokens(F.coalesce(F.col(text), F.lit(""))))).toDF(key, "word")
    if words.limit(most + 1).count() <= most:
        return found.join(F.broadcast(words), "word").select(key, "word", *columns)
    if "n_docs" not in words.columns:
        return split_join(found, words, "word", "inner")
    common = materialize(words.orderBy(F.desc("n_docs"), "word").limit(most), scratch(spark, "common-words"))
    rest = words.join(F.broadcast(common), "word", "left_anti")
    near, far = found.join(F.broadcast(common), "word"), split_join(found.join(F.broadcast(common), "word", "left_anti"), rest, "word", "inner")
    return near.select(key, "word", *columns).unionByName(far.select(key, "word", *columns))


def valence(docs: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """key, pos, neg, neu (shares of the tokens' weight) and compound = s / sqrt(s² + 15); texts without hits are neutral."""
    sums = scored_tokens(docs, key, text, words).groupBy(key).agg(
        F.sum("valence").alias("s"), F.sum(F.when(F.col("valence") > 0, F.col("valence") + 1).otherwise(0.0)).alias("p"),
        F.sum(F.when(F.col("valence") < 0, F.col("valence") - 1).otherwise(0.0)).alias("n"), F.count(F.lit(1)).alias("hits"),
    )
    out = docs.select(key, F.size(tokens(F.coalesce(F.col(text), F.lit("")))).alias("size")).join(sums, key, "left").fillna(0, ["s", "p", "n", "hits"])
    neutral = F.col("size") - F.col("hits")
    total = F.col("p") - F.col("n") + neutral
    share = {"pos": F.col("p"), "neg": -F.col("n"), "neu": neutral.cast("double")}
    return out.select(key, *[F.when(total > 0, x / total).otherwise(0.0).alias(c) for c, x in share.items()], (F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15)).alias("compound"))


def polarity(docs: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """key, mean polarity and subjectivity of the tokens in the lexicon, 0 without any."""
    means = scored_tokens(docs, key, text, words).groupBy(key).agg(F.avg("polarity").alias("polarity"), F.avg("subjectivity").alias("subjectivity"))
    return docs.select(key).join(means, key, "left").fillna(0.0, ["polarity", "subjectivity"])
