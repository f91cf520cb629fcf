"""Describing clusters: keywords, samples, names, centroids, cohesion. Cluster-level tables stay small next to their members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convlens import lexicon as L
from convlens.session import checkpointed


def top_words(texts: DataFrame, by: Sequence[str], most: int, stop: Sequence[str] = L.STOP_WORDS, text: str = "text") -> DataFrame:
    """The most frequent words of three or more plain letters; of equals the first in the alphabet. Counted before any sort."""
    words = texts.select(*by, F.explode(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+")).alias("word"))
    counted = words.where(F.rlike("word", F.lit("^[a-z]{3,}$")) & ~F.col("word").isin(*stop)).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counted.orderBy(F.desc("n"), "word").limit(most)
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word")))
    return ranked.where(F.col("rank") <= most)


def _short_lists(terms: DataFrame, by: str, most: int = 1000) -> bool:
    """Whether no cluster has more than ``most`` terms and all clusters together are few."""
    sizes = terms.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("m")).first()
    return sizes["n"] * (sizes["m"] or 0) <= 1_000_000 and (sizes["m"] or 0) <= most


def tfidf_terms(texts: DataFrame, *, features: int = 10, most: int = 5, stop: Sequence[str] = L.STOP_WORDS, by: str = "cluster", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per cluster the terms of largest mean TF-IDF: words and pairs of words that follow each other once stop words are
    out, smoothed idf, unit rows, over its most frequent terms. A pair is no more frequent than either of its words, so these are
    found from the words that are no rarer than the last of the ``features`` most frequent ones, ties included, and from pairs of
    such words: a first reading counts words, a second one looks for these terms alone.
    """
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*stop))
    counted = texts.select(by, F.explode(words).alias("term")).groupBy(by, "term").agg(F.count(F.lit(1)).alias("total"))
    often = counted.withColumn("_r", F.rank().over(Window.partitionBy(by).orderBy(F.desc("total")))).where(F.col("_r") <= features)
    often = checkpointed(often.where(F.col(by).isNotNull()).select(by, "term"))
    few = lambda df: F.broadcast(df) if df.limit(1_000_001).count() <= 1_000_000 else df
    listed = often.groupBy(by).agg(F.sort_array(F.collect_set("term")).alias("_t")) if _short_lists(often, by) else None
    if listed is not None:
        # Rows hold the few words of their cluster, so texts give rows for these alone.
        held = texts.join(F.broadcast(listed), by).select(by, doc, words.alias("_w"), "_t")
        known = F.transform("_w", lambda w: F.when(F.array_contains("_t", w), w))
        singles = F.filter("_k", lambda w: w.isNotNull())
        # A pair has a blank, which no word has; the last word pairs with nothing.
        pairs = F.filter(F.zip_with("_k", F.slice("_k", F.lit(2), F.size("_k")), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
        terms = held.select(by, doc, known.alias("_k")).select(by, doc, F.explode(F.concat(singles, pairs)).alias("term"))
    else:
        each = texts.select(by, doc, words.alias("_w")).select(by, doc, F.explode(F.zip_with("_w", F.slice("_w", F.lit(2), F.size("_w")), lambda a, b: F.struct(a.alias("term"), b.alias("_b")))).alias("_p")).select(by, doc, "_p.*")
        firsts = each.join(few(often), [by, "term"])
        seconds = few(often.withColumnRenamed("term", "_b"))
        terms = firsts.select(by, doc, "term").unionByName(firsts.join(seconds, [by, "_b"]).select(by, doc, F.concat("term", F.lit(" "), "_b").alias("term")))
    tf = checkpointed(terms.groupBy(by, doc, "term").agg(F.count(F.lit(1)).alias("tf")))
    total = tf.groupBy(by, "term").agg(F.sum("tf").alias("total"))
    top = total.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("total"), "term"))).where(F.col("_r") <= features).select(by, "term")
    tf = tf.join(few(checkpointed(top)), [by, "term"])
    n = texts.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy(by, "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(df, [by, "term"]).join(n, by).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = weighted.groupBy(by, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l"))
    mean = weighted.join(length, [by, doc]).groupBy(by, "term").agg((F.sum(F.col("w") / F.col("_l")) / F.first("n")).alias("score"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "term"))).where(F.col("rank") <= most)


def representatives(members: DataFrame, messages: DataFrame, most: int = 3, chars: int = 150) -> DataFrame:
    """(cluster, conv_id, message): the first user message of the first conversations of each cluster."""
    first = members.withColumn("_n", F.row_number().over(Window.partitionBy("cluster").orderBy("conv_id"))).where(F.col("_n") <= most)
    said = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.join(said, "conv_id").select("cluster", "conv_id", F.substring("text", 1, chars).alias("message"))


def dominant(members: DataFrame, by: str, value: str, order: str, mixed_below: float = 0.6) -> DataFrame:
    """(by, name): the most frequent value, as ``Mixed - X`` below a share; of equals the first seen."""
    counted = members.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counted.groupBy(by).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), F.col(value).alias("v"))).alias("b"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    name = F.when((F.col("b.n") / F.col("all") < mixed_below) & (F.col("kinds") > 1), F.concat(F.lit("Mixed - "), F.col("b.v"))).otherwise(F.col("b.v"))
    return best.select(by, name.alias("name"), F.col("all").alias("size"))


def most_common(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group; of equals the greatest."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.max(F.struct("n", F.col(value).alias("v"))).alias("b")).select(*by, F.col("b.v").alias(value), F.col("b.n").alias("n"))


def top_rows(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def sample(rows: DataFrame, key: str, most: int, seed: str = "") -> DataFrame:
    """A repeatable sample without replacement: the least hashes of (key, seed)."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))).limit(most)


def keyword_index(keywords: DataFrame, least: int = 2) -> DataFrame:
    """(keyword, clusters, support): keywords of several clusters with the clusters' share of all members."""
    total = keywords.select("cluster", "size").distinct().agg(F.sum("size").alias("total"))
    shared = keywords.groupBy("keyword").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"), F.sum("size").alias("members")).where(F.size("clusters") >= least)
    return shared.crossJoin(F.broadcast(total)).select("keyword", "clusters", F.round(F.col("members") / F.col("total"), 6).alias("support"))
