"""Queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.functions import vectors as V
from convlens.operators import graphs as G
from convlens.operators import vectors as X
from convlens.plans.registry import query
from convlens.session import checkpointed
from convlens.sources.writers import map_export

E = "e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
CENTS = "c AS (SELECT label, list(x ORDER BY p) AS m FROM (SELECT label, p, avg(v[p]) AS x FROM e, generate_series(1, 64) s(p) GROUP BY ALL) GROUP BY label)"
DIST = "list_distance"


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


@query("vec_normalize", f"WITH {E} SELECT id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total FROM e")
def vec_normalize(spark, d):
    n = V.normalize(F.col("v"))
    return vectors(spark, d).withColumn("n", n).select("id", F.round(F.col("n")[0], 6).alias("first"), F.round(F.aggregate("n", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("cosine_pairs", f"WITH {E} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS distance FROM e a JOIN e b ON b.id = a.id + 1")
def cosine_pairs(spark, d):
    a = vectors(spark, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("v").alias("w"))
    return a.join(b, "id").select(F.col("id").alias("a"), "b", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("cosine"), F.round(V.euclidean(F.col("v"), F.col("w")), 6).alias("distance"))


@query("knn", f"WITH {E}, p AS (SELECT a.id, b.id AS neighbour, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM e a, e b WHERE a.id <> b.id) SELECT id, neighbour, round(distance, 6) AS distance, rank FROM p WHERE rank <= 5")
def knn(spark, d):
    return X.nearest(vectors(spark, d), 5).select("id", "neighbour", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("centroids", f"WITH {E}, {CENTS} SELECT label, round(m[1], 6) AS first, round(m[64], 6) AS last, round(list_sum(m), 6) AS total FROM c")
def centroids(spark, d):
    c = X.centroids(vectors(spark, d), "label")
    return c.select("label", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.col("centroid")[63], 6).alias("last"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("cohesion", f"WITH {E}, {CENTS} SELECT label, count(*) AS size, round(avg(list_distance(v, m)), 6) AS cohesion FROM e JOIN c USING (label) GROUP BY label")
def cohesion(spark, d):
    return X.cohesion(vectors(spark, d), "label").select("label", "size", F.round("cohesion", 6).alias("cohesion"))


@query("standardize", f"WITH {E}, s AS (SELECT p, avg(v[p]) AS m, stddev_pop(v[p]) AS s FROM e, generate_series(1, 64) g(p) GROUP BY p) SELECT id, round(sum((v[p] - m) / s), 5) AS total FROM e, s GROUP BY id")
def standardize(spark, d):
    return X.standardize(vectors(spark, d)).select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("silhouette", f"""WITH {E}, p AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM e a, e b GROUP BY ALL),
s AS (SELECT id, label, max(CASE WHEN other = label AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN other <> label THEN t / n END) AS b FROM p GROUP BY ALL)
SELECT label, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s GROUP BY label""")
def silhouette(spark, d):
    return X.silhouette(vectors(spark, d), "label").groupBy("label").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query("calinski_harabasz", f"""WITH {E}, {CENTS}, w AS (SELECT sum(list_distance(v, m) ** 2) AS w, count(*) AS n FROM e JOIN c USING (label)),
a AS (SELECT list(x ORDER BY p) AS m FROM (SELECT p, avg(v[p]) AS x FROM e, generate_series(1, 64) s(p) GROUP BY p)), z AS (SELECT label, count(*) AS n FROM e GROUP BY label),
b AS (SELECT sum(z.n * list_distance(c.m, a.m) ** 2) AS b, count(*) AS k FROM c JOIN z USING (label), a) SELECT round(b / (k - 1) / (w / (n - k)), 6) AS score FROM w, b""")
def calinski_harabasz(spark, d):
    return X.calinski_harabasz(vectors(spark, d), "label").select(F.round("score", 6).alias("score"))


@query("davies_bouldin", f"WITH {E}, {CENTS}, s AS (SELECT label, m, avg(list_distance(v, m)) AS s FROM e JOIN c USING (label) GROUP BY ALL), r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.m, b.m)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label) SELECT round(avg(r), 6) AS score FROM r")
def davies_bouldin(spark, d):
    return X.davies_bouldin(vectors(spark, d), "label").select(F.round("score", 6).alias("score"))


@query("eps_estimate", f"WITH {E}, p AS (SELECT a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM e a, e b) SELECT round(median(d), 6) AS median, round(greatest(0.1, least(2.0, median(d))), 6) AS eps FROM p WHERE r = 4")
def eps_estimate(spark, d):
    return X.estimate_eps(vectors(spark, d)).select(F.round("median", 6).alias("median"), F.round("eps", 6).alias("eps"))


@query("dbscan", f"""WITH RECURSIVE {E}, p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM e a, e b WHERE list_distance(a.v, b.v) <= 1.15),
k AS MATERIALIZED (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 5), l AS MATERIALIZED (SELECT a, b FROM p WHERE a IN (FROM k) AND b IN (FROM k)),
r AS (SELECT id, id AS root FROM k UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id), m AS (SELECT id, min(root) AS root FROM r GROUP BY id),
n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM m)), c AS (SELECT id, label FROM m JOIN n USING (root)),
q AS (SELECT p.a AS id, min(label) AS label FROM p JOIN c ON p.b = c.id GROUP BY p.a)
SELECT e.id, CAST(coalesce(c.label, q.label, -1) AS INT) AS label FROM e LEFT JOIN c USING (id) LEFT JOIN q USING (id)""")
def dbscan(spark, d):
    return X.dbscan(vectors(spark, d), 1.15, 5, checkpointed)


@query("kmeans")
def kmeans(spark, d):
    return X.kmeans(vectors(spark, d), 10, starts=3)


@query("kmeans_metrics")
def kmeans_metrics(spark, d):
    v = vectors(spark, d).select("id", "v")
    labelled = v.join(X.kmeans(v, 8, starts=1), "id")
    return spark.createDataFrame([{k: float(x) for k, x in X.evaluate(labelled, "label").items()}])


@query("ward")
def ward(spark, d):
    return X.ward(vectors(spark, d), 10)


@query("hierarchy")
def hierarchy(spark, d):
    return X.hierarchy(X.centroids(vectors(spark, d), "label"), "label")


@query("level_hierarchy")
def level_hierarchy(spark, d):
    return X.level_hierarchy(vectors(spark, d), "label", threshold=0.2)


@query("pca_2d")
def pca_2d(spark, d):
    return X.pca_2d(vectors(spark, d))


@query("reduce_dimensions")
def reduce_dimensions(spark, d):
    return X.reduce_dimensions(vectors(spark, d), 16)


@query("random_2d")
def random_2d(spark, d):
    return X.random_2d(vectors(spark, d))


@query("force_layout")
def force_layout(spark, d):
    return X.force_layout(vectors(spark, d), checkpointed, rounds=30)


@query("neighbour_graph")
def neighbour_graph(spark, d):
    """Links of the approximate graph of 15 neighbours."""
    graph, _ = G.neighbour_graph(vectors(spark, d), 15, checkpointed)
    return graph.select("id", "neighbour", "distance", "rank")


@query("neighbour_recall")
def neighbour_recall(spark, d):
    """How many of the 15 nearest the graph has, for every fiftieth vector against all."""
    v = vectors(spark, d)
    return G.neighbour_recall(v, G.neighbour_graph(v, 15, checkpointed)[0], 15)


@query("umap_layout")
def umap_layout(spark, d):
    return G.umap(vectors(spark, d).select("id", "v"), checkpointed).select("id", F.col("x0").alias("x"), F.col("x1").alias("y"))


TRUST = f"""WITH {E}, q AS (SELECT * FROM e WHERE id % 50 = 0),
l AS (SELECT q.id, e.id AS other, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((q.v[1] - e.v[1]) * (q.v[1] - e.v[1]) + (q.v[2] - e.v[2]) * (q.v[2] - e.v[2])), e.id) AS place FROM q, e WHERE e.id <> q.id),
h AS (SELECT q.id, e.id AS other, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, e.v), e.id) AS rank FROM q, e WHERE e.id <> q.id),
p AS (SELECT CAST(coalesce(sum(greatest(rank - 5, 0)), 0) AS BIGINT) AS penalty FROM l JOIN h USING (id, other) WHERE place <= 5)
SELECT (SELECT count(*) FROM e) AS n, (SELECT count(*) FROM q) AS asked, penalty,
       round(1 - 2.0::DOUBLE * penalty / ((SELECT count(*) FROM q) * 5 * (2 * (SELECT count(*) FROM e) - 16)), 9) AS trustworthiness FROM p"""


@query("trustworthiness", TRUST)
def trustworthiness(spark, d):
    """Of the layout by the first two components, for every fiftieth vector against all."""
    v = vectors(spark, d).select("id", V.doubles(F.col("v")).alias("v"))
    return G.trustworthiness(v, v.select("id", F.slice("v", 1, 2).alias("v")), 5, 50).withColumn("trustworthiness", F.round("trustworthiness", 9))


@query("map_points", "SELECT vec_id AS id, coalesce('Cluster ' || CASE WHEN label < 5 THEN label END, 'cluster_' || label) AS cluster FROM embeddings")
def map_points(spark, d):
    v = vectors(spark, d)
    names = spark.createDataFrame([(i, f"Cluster {i}") for i in range(5)], "label int, name string")
    points = v.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("label").alias("cluster"))
    return map_export(points, names.withColumnRenamed("label", "cluster")).select("id", "cluster")


@query("outside_sample", "SELECT vec_id AS id FROM embeddings WHERE label <> 3 ORDER BY md5(vec_id || 'outside') LIMIT 10")
def outside_sample(spark, d):
    from convlens.operators.clusters import sample

    return sample(vectors(spark, d).where("label <> 3").select("id"), "id", 10, "outside")
