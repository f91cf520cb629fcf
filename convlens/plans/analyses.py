"""The three whole analyses: by keywords, by embeddings, and with privacy thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens import providers as P
from convlens.functions import text as T
from convlens.operators import clusters as K
from convlens.operators import conversations as C
from convlens.operators import insight as I
from convlens.operators import vectors as X
from convlens.plans.conversations import messages
from convlens.plans.registry import query
from convlens.session import checkpointed


def process(m: DataFrame) -> dict[str, DataFrame]:
    nested = C.nest(m)
    return {"conversations": C.categorized(nested), "clusters": C.category_clusters(nested, T.category_cascade(F.col("text"))), "statistics": C.corpus_stats(nested)}


def analyze(m: DataFrame, *, model: P.EmbeddingModel | None = None, k: int | None = None) -> dict[str, DataFrame]:
    """Copies out, embeddings, clusters, names, facets, and one wide row for each conversation by left joins on its id."""
    nested = checkpointed(C.first_by(C.nest(m), T.content_hash(F.col("text")), "conv_id"))
    vectors = checkpointed(P.embed(nested.select(F.col("conv_id").alias("id"), "text"), "text", model or P.StubEmbedding()).select("id", "v"))
    scaled = checkpointed(X.standardize(vectors))
    n = nested.count()
    labels = checkpointed(X.kmeans(scaled, k or max(1, min(50, round(n**0.5))), starts=2))
    texts = nested.select("conv_id", "text", T.category_scored(F.col("text")).alias("category"), F.round(T.sentiment_by_count(F.col("text")), 6).alias("sentiment"))
    wide = texts.join(labels.select(F.col("id").alias("conv_id"), F.col("label").alias("cluster")), "conv_id", "left").join(X.pca_2d(vectors).withColumnRenamed("id", "conv_id"), "conv_id", "left")
    names = K.dominant(wide, "cluster", "category", "conv_id")
    facets = nested.select("conv_id", F.explode(P.heuristic_facets(F.col("text"))).alias("f")).select("conv_id", "f.*")
    return {"conversations": wide, "clusters": names, "facets": facets, "keywords": K.top_words(wide, ["cluster"], 10)}


def analyze_private(m: DataFrame, *, eps: float = 0.9, k: int = 2, model: P.EmbeddingModel | None = None) -> dict[str, DataFrame]:
    """Redaction, density clusters of at least k, hierarchy of their centroids, and an audit."""
    nested = C.nest(m).withColumn("text", T.redact(F.col("text"))[0])
    nested = checkpointed(nested.select("conv_id", "text", T.anonymity_group(F.col("text")).alias("anonymity_group")))
    vectors = checkpointed(P.embed(nested.select(F.col("conv_id").alias("id"), "text"), "text", model or P.StubEmbedding()).select("id", "v"))
    labels = checkpointed(X.dbscan(vectors, eps, max(2, k), checkpointed).where("label >= 0"))
    sizes = labels.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= k)
    kept = labels.join(sizes, F.col("label") == F.col("cluster"), "left_semi")
    placed = checkpointed(vectors.join(kept, "id"))
    named = sizes.withColumn("name", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")))
    return {
        "clusters": X.cohesion(placed, "label"), "hierarchy": X.hierarchy(X.centroids(placed, "label"), "label"),
        "audit": I.size_audit(named, k).crossJoin(I.anonymity_audit(nested, k).withColumnsRenamed({"compliant": "anonymous_groups", "rate": "anonymous_rate"})),
    }


@query("analyze")
def analyze_query(spark, d):
    return analyze(messages(spark, d), k=8)["conversations"]


@query("analyze_private")
def analyze_private_query(spark, d):
    return analyze_private(messages(spark, d))["audit"]
