"""Facets, patterns, privacy, discovery and search over clusters.

``facets`` is the long table (conv_id, cluster, facet, value); ``clusters`` is cluster-level (cluster, name, size, ...).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convlens.functions import text as T
from convlens.session import broadcast_if_few


def facet_distribution(facets: DataFrame) -> DataFrame:
    """(cluster, facet, value, n, share) of each facet's values in a cluster."""
    counted = facets.groupBy("cluster", "facet", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cluster", "facet")))


def facet_patterns(distribution: DataFrame, sizes: DataFrame, least_support: float = 0.1) -> DataFrame:
    """Single values and pairs of different facets, pairs as if independent inside a cluster."""
    total = sizes.agg(F.sum("size").alias("total"))
    sized = distribution.join(sizes, "cluster")
    label = lambda p: F.concat(F.col(f"{p}facet"), F.lit("="), F.col(f"{p}value"))
    single = sized.groupBy(label("").alias("pattern")).agg(F.sum(F.col("share") * F.col("size")).alias("weight"))
    a, b = sized.alias("a"), distribution.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.facet") < F.col("b.facet")))
    both = pairs.groupBy(F.concat(label("a."), F.lit(" AND "), label("b.")).alias("pattern")).agg(F.sum(F.col("a.share") * F.col("b.share") * F.col("a.size")).alias("weight"))
    support = single.unionByName(both).crossJoin(F.broadcast(total)).withColumn("support", F.col("weight") / F.col("total"))
    return support.where(F.col("support") >= least_support).select("pattern", "support", F.least(F.lit(1.0), F.col("support") / 0.5).alias("interestingness"))


def co_occurrence(facets: DataFrame) -> DataFrame:
    """Observed pairs of values of different facets in one conversation."""
    a, b = facets.alias("a"), facets.alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.facet") < F.col("b.facet")))
    return pairs.groupBy(F.col("a.facet").alias("facet_a"), F.col("a.value").alias("value_a"), F.col("b.facet").alias("facet_b"), F.col("b.value").alias("value_b")).agg(F.count(F.lit(1)).alias("n"))


def common_value(facets: DataFrame, least_rows: int = 10) -> DataFrame:
    """(value, n, percent): the most frequent value if more than a third of the conversations show it."""
    total = facets.agg(F.countDistinct("conv_id").alias("total"))
    top = facets.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(1)
    joined = top.crossJoin(F.broadcast(total)).where((F.col("total") >= least_rows) & (F.col("n") > F.expr("total div 3")))
    return joined.select("value", "n", F.expr("n * 100 div total").alias("percent"))


def trends(facets: DataFrame, least_rows: int = 20, factor: int = 2, least: int = 5) -> DataFrame:
    """Values seen more than ``factor`` times as often in the later half of conversations, by id."""
    from convlens.operators.conversations import numbered

    total = facets.agg(F.countDistinct("conv_id").alias("total"))
    placed = numbered(facets.select("conv_id").distinct(), "conv_id")
    halves = facets.join(placed, "conv_id").crossJoin(F.broadcast(total)).where(F.col("total") >= least_rows)
    late = F.col("position") >= F.expr("total div 2")
    by = halves.groupBy("value").agg(F.count(F.when(~late, 1)).alias("first_half"), F.count(F.when(late, 1)).alias("second_half"))
    grown = by.where((F.col("second_half") > F.col("first_half") * factor) & (F.col("second_half") > least))
    return grown.withColumn("increase", F.col("second_half") / F.greatest("first_half", F.lit(1)))


def overlay(facets: DataFrame, value: str) -> DataFrame:
    """(cluster, count, prevalence): how often a value occurs in each cluster."""
    return facets.groupBy("cluster").agg(F.count(F.when(F.col("value") == value, 1)).alias("count"), F.avg((F.col("value") == value).cast("double")).alias("prevalence"))


def numeric_overlay(rows: DataFrame, by: str, value: Column) -> DataFrame:
    return rows.groupBy(by).agg(
        F.count(value).alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def privacy_filter(clusters: DataFrame, k: int, merge: bool = True) -> DataFrame:
    """Clusters of k or more members; smaller ones together as one if they reach k, otherwise dropped."""
    large = clusters.where(F.col("size") >= k).select("name", "size", F.lit(1).cast("long").alias("parts"))
    if not merge:
        return large
    small = clusters.where(F.col("size") < k).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts")).where(F.col("size") >= k)
    return large.unionByName(small.select(F.lit("merged_small_clusters").alias("name"), "size", "parts"))


def size_audit(clusters: DataFrame, k: int) -> DataFrame:
    small = F.col("size") < k
    return clusters.agg(
        F.count(F.lit(1)).alias("clusters"), F.count(F.when(small, 1)).alias("small"), F.coalesce(F.sum(F.when(small, F.col("size"))), F.lit(0)).alias("small_members"),
    ).withColumn("compliant", F.col("small") == 0)


def anonymity_audit(texts: DataFrame, k: int) -> DataFrame:
    """Sizes of groups of equal text; members of groups under k are not anonymous."""
    groups = texts.groupBy(T.anonymity_group(F.col("text")).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.min("n").alias("least"), F.count(F.when(F.col("n") >= k, 1)).alias("compliant")).withColumn(
        "rate", F.round(F.col("compliant") / F.col("groups"), 6)
    )


def pii_audit(texts: DataFrame) -> DataFrame:
    redacted, counts = T.redact(F.col("text"))
    found = texts.select((redacted != F.col("text")).alias("_r"), *[c.alias(k) for k, c in counts.items()])
    return found.agg(*[F.sum(k).cast("long").alias(k) for k in counts], F.count(F.when(F.col("_r"), 1)).alias("redacted"), F.round(F.avg(F.col("_r").cast("double")), 6).alias("rate"))


def overall_score(pii_ok: Column, anonymity: Column, sizes_ok: Column) -> Column:
    return (F.when(pii_ok, 1.0).otherwise(0.5) + anonymity + F.when(sizes_ok, 1.0).otherwise(0.7)) / 3


def privacy_level(k: Column) -> Column:
    return F.when(k <= 5, "low").when(k <= 15, "medium").when(k <= 50, "high").otherwise("very high")


def cluster_privacy(size: Column, texts: Sequence[Column], k: int) -> Column:
    """0.3 for few members, 0.5 for each pattern that the cluster's own texts match, 1 at most."""
    hits = [F.when(reduce(lambda a, b: a | b, [T.pii_flags(t)[kind] for t in texts]), 0.5).otherwise(0.0) for kind in ("email", "phone", "ssn")]
    return F.least(F.lit(1.0), F.when(size < 2 * k, 0.3).otherwise(0.0) + reduce(lambda a, b: a + b, hits))


def search(clusters: DataFrame, term: str, most: int) -> DataFrame:
    """By relevance: 1 for the name, 0.5 for the summary, 0.3 for each keyword."""
    has = lambda c: F.contains(F.lower(c), F.lit(term.lower()))
    score = has(F.col("name")).cast("double") + has(F.col("summary")).cast("double") * 0.5 + F.size(F.filter("keywords", has)) * 0.3
    return clusters.select("cluster", "name", F.round(score, 6).alias("relevance")).where("relevance > 0").orderBy(F.desc("relevance"), "cluster").limit(most)


def recommendations(clusters: DataFrame, limit: int) -> DataFrame:
    """Small clusters first to half the limit, then the largest; by confidence."""
    outliers = clusters.where("size < 3").orderBy("cluster").limit(limit // 2).select("cluster", F.lit("outlier").alias("kind"), F.lit(0.7).alias("confidence"))
    n = outliers.agg(F.count(F.lit(1)).alias("_n"))
    largest = clusters.orderBy(F.desc("size"), "cluster").limit(limit).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("size"), "cluster")))
    trending = largest.crossJoin(F.broadcast(n)).where(F.col("_r") <= limit - F.col("_n")).select("cluster", F.lit("trending").alias("kind"), F.lit(0.8).alias("confidence"))
    return outliers.unionByName(trending)


def cluster_similarity(clusters: DataFrame, least: float = 0.3) -> DataFrame:
    """(a, b, similarity) over a cluster-level table: mean of size ratio and share of common name words."""
    a = clusters.select(F.col("cluster").alias("a"), F.col("name").alias("na"), F.col("size").alias("sa"))
    b = broadcast_if_few(clusters.select(F.col("cluster").alias("b"), F.col("name").alias("nb"), F.col("size").alias("sb")))
    wa, wb = F.split("na", r"\s+"), F.split("nb", r"\s+")
    words = F.size(F.filter(wa, lambda w: F.contains(F.col("nb"), w))) / F.greatest(F.size(wa), F.size(wb))
    score = (F.least("sa", "sb") / F.greatest("sa", "sb") + F.when(F.col("na") == F.col("nb"), 1.0).otherwise(words)) / 2
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", F.round(score, 6).alias("similarity")).where(F.col("similarity") > least)


def name_correlation(clusters: DataFrame, least: float = 0.3) -> DataFrame:
    a = clusters.select(F.col("cluster").alias("a"), F.length("name").alias("la"))
    b = broadcast_if_few(clusters.select(F.col("cluster").alias("b"), F.length("name").alias("lb")))
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", F.round(F.least("la", "lb") / F.greatest("la", "lb"), 6).alias("ratio")).where(F.col("ratio") > least)


def facet_condition(facets: DataFrame, facet: str, op: str, value: str | float) -> DataFrame:
    """Conversations (or, for ``prevalence``, clusters) that meet a condition on a facet."""
    v, own = F.col("value"), facets.where(F.col("facet") == facet)
    tests = {
        "equals": lambda: v == value, "contains": lambda: F.contains(v, F.lit(value)), "starts_with": lambda: v.startswith(value),
        "ends_with": lambda: v.endswith(value), "regex": lambda: F.rlike(v, F.lit(value)),
        "greater_than": lambda: v.try_cast("double") > value, "less_than": lambda: v.try_cast("double") < value,
    }
    if op == "prevalence":
        name, least = str(value).split(">=")
        return own.groupBy("cluster").agg(F.avg((v == name).cast("double")).alias("p")).where(F.col("p") >= float(least)).select("cluster")
    return own.where(tests[op]()).select("conv_id").distinct()


def metric_condition(clusters: DataFrame, metric: str, op: str, value: float, other: float | None = None) -> DataFrame:
    m = F.col(metric)
    tests = {">": m > value, "<": m < value, "=": m == value, ">=": m >= value, "<=": m <= value, "between": m.between(value, other if other is not None else value)}
    return clusters.where(tests[op])


def investigate(clusters: DataFrame, *, terms: Sequence[str] = (), conditions: Sequence[tuple] = (), order: str = "size") -> DataFrame:
    """Clusters that match all conditions and any term, in the order asked for."""
    for c in conditions:
        clusters = metric_condition(clusters, *c)
    low = F.lower(F.concat_ws(" ", "name", "summary"))
    hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(t.lower())).cast("int") for t in terms], F.lit(0))
    out = clusters.withColumn("matches", hits)
    if terms:
        out = out.where("matches > 0")
    orders = {"size": [F.desc("size")], "alphabetical": ["name"], "relevance": [F.desc("matches")], "creation": []}
    return out.orderBy(*orders[order], "cluster")


def cross_patterns(parents: DataFrame) -> DataFrame:
    """Parents with more than one child."""
    return parents.groupBy("parent").agg(F.count(F.lit(1)).alias("children")).where("children > 1")
