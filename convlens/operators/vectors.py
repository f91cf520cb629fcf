"""Operators over vectors (id, v): neighbours, centroids, cluster metrics, density clustering, projections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convlens.functions import vectors as V
from convlens.operators.ward import merges, ward


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


#: Blocks that a table is dealt to while they hold from LEAST to MOST rows: a vector goes to so many tasks, at every size between.
STRIPS, LEAST, MOST = 24, 2048, 32_768
#: Numbers in the tile of a matrix of distances that a task has at once.
TILE = 1_000_000


def blocks(df: DataFrame, size: int = 0) -> DataFrame:
    """Adds ``_b``, a block number by hash; blocks of vectors are compared with blocks, so work is matrix products."""
    rows = df.count()
    n = rows // (size or min(MOST, max(LEAST, rows // STRIPS))) + 1
    return df.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))


def block_pairs(df: DataFrame) -> DataFrame:
    """Rows dealt to tasks (i, j): the task has all vectors of block i as side 0 and of block j as side 1."""
    blocked = blocks(df)
    n = int(blocked.agg(F.coalesce(F.max("_b"), F.lit(0))).first()[0]) + 1
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return blocked.select("*", F.lit(0).alias("_side"), F.col("_b").alias("_i"), other.alias("_j")).unionByName(
        blocked.select("*", F.lit(1).alias("_side"), other.alias("_i"), F.col("_b").alias("_j"))
    )


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Differences, not the expansion of the square: equal vectors are exactly 0 apart.
    return np.sqrt(np.array([((b - row) ** 2).sum(1) for row in a])) if len(a) else np.zeros((0, len(b)))


def half_pairs(df: DataFrame) -> DataFrame:
    """Rows dealt to tasks (i, j), i <= j, each pair of blocks once: side 0 has block i, side 1 block j, both in one if they are equal."""
    blocked = blocks(df)
    n = int(blocked.agg(F.coalesce(F.max("_b"), F.lit(0))).first()[0]) + 1
    dealt = blocked.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.select("*", (F.col("_b") > F.col("_o")).cast("int").alias("_side"), F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))


def sides(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, other ids, other vectors) for both directions of a task of ``half_pairs``, ids ascending."""
    parts = [p.sort_values("id") for _, p in pdf.groupby("_side")]
    own = [(p["id"].to_numpy(), matrix(p["v"])) for p in parts]
    if pdf["_i"].iloc[0] == pdf["_j"].iloc[0]:
        return [(*own[0], *own[0])]
    return [(*own[0], *own[1]), (*own[1], *own[0])] if len(own) == 2 else []


def squares(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, squares of distances to all of b) for some rows of a at a time, by products of matrices and so rounded."""
    of_a, of_b = (a * a).sum(1), (b * b).sum(1)
    step = max(1, TILE // max(1, len(b)))
    for start in range(0, len(a), step):
        rows = slice(start, start + step)
        square = a[rows] @ b.T
        square *= -2
        square += of_a[rows, None]
        square += of_b
        yield start, square


def within(a: np.ndarray, b: np.ndarray, eps: float) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows of a, which of b are within ``eps``) for some rows at a time; differences decide where products leave room for doubt."""
    room = 1e-9 * (1 + (a * a).sum(1).max(initial=0) + (b * b).sum(1).max(initial=0))
    for start, square in squares(a, b):
        near = square <= eps * eps - room
        i, j = np.nonzero((square <= eps * eps + room) & ~near)
        for part in range(0, len(i), 65_536):
            p, q = i[part : part + 65_536], j[part : part + 65_536]
            near[p, q] = np.sqrt(((b[q] - a[start + p]) ** 2).sum(1)) <= eps
        yield slice(start, start + len(square)), near


def distinct_vectors(df: DataFrame, *by: str) -> DataFrame:
    """(by, v, id, w): of equal vectors the least id, and how many they are."""
    return df.groupBy(*by, "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))


def two_sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame] | None:
    """The two blocks of a task of ``half_pairs``, twice the same if it has one block with itself; None if one is missing."""
    a, b = (pdf[pdf["_side"] == side].sort_values("id") for side in (0, 1))
    if pdf["_i"].iloc[0] == pdf["_j"].iloc[0]:
        return a, a
    return (a, b) if len(a) and len(b) else None


def close_pairs(a: np.ndarray, b: np.ndarray, most: np.ndarray | float, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of pairs that may be within ``most``, or among the k nearest of a row.

    Products of matrices sort out the rest, with room for their rounding; the distances given are exact.
    """
    room = 1e-9 * (1 + (a * a).sum(1).max(initial=0) + (b * b).sum(1).max(initial=0))
    found = []
    for start, square in squares(a, b):
        bound = np.partition(square, k - 1, axis=1)[:, k - 1][:, None] if 0 < k < len(b) else np.full((1, 1), np.inf) if k else np.square(most)
        i, j = np.nonzero(square <= bound + room)
        found.append((i + start, j))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    out = np.empty(len(i))
    for start in range(0, len(i), 65_536):
        part = slice(start, start + 65_536)
        out[part] = np.sqrt(((b[j[part]] - a[i[part]]) ** 2).sum(1))
    return i, j, out


def nearest(df: DataFrame, k: int, with_self: bool = False) -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest by Euclid, ties to the smaller id; exact, each task keeps k."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, a, others, b in sides(pdf):
            i, j, d = close_pairs(a, b, np.inf, min(k + (not with_self), len(b)))
            if not with_self:
                keep = ids[i] != others[j]
                i, j, d = i[keep], j[keep], d[keep]
            order = np.lexsort((others[j], d, i))
            i, j, d = i[order], j[order], d[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            keep = rank < k
            out.append(pd.DataFrame({"id": ids[i[keep]], "neighbour": others[j[keep]], "distance": d[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "neighbour": [], "distance": []})

    found = half_pairs(df.select("id", "v")).groupBy("_i", "_j").applyInPandas(run, "id long, neighbour long, distance double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour")))
    return ranked.where(F.col("rank") <= k)


def pairs_within(df: DataFrame, eps: float) -> DataFrame:
    """(a, b) for all a, b within ``eps``, each with itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, a, others, b in sides(pdf):
            i, j, d = close_pairs(a, b, eps)
            out.append(pd.DataFrame({"a": ids[i[d <= eps]], "b": others[j[d <= eps]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []})

    return half_pairs(df.select("id", "v")).groupBy("_i", "_j").applyInPandas(run, "a long, b long")


def centroids(df: DataFrame, by: str) -> DataFrame:
    """(by, centroid, size) from partial sums by position."""
    mean = df.select(by, F.posexplode(V.doubles(F.col("v"))).alias("p", "x")).groupBy(by, "p").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("size"))


def cohesion(df: DataFrame, by: str) -> DataFrame:
    """(by, size, cohesion): mean distance to the centroid."""
    joined = df.join(centroids(df, by), by)
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias("size"), F.avg(V.euclidean(F.col("v"), F.col("centroid"))).alias("cohesion"))


def standardize(df: DataFrame) -> DataFrame:
    """Zero mean and unit population deviation by position; a constant position becomes 0."""
    stats = df.select(F.posexplode(V.doubles(F.col("v"))).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    arrays = stats.agg(F.array_sort(F.collect_list(F.struct("p", "m", "s"))).alias("_t"))
    scaled = F.zip_with(V.doubles(F.col("v")), F.col("_t"), lambda x, t: F.when(t["s"] > 0, (x - t["m"]) / t["s"]).otherwise(F.lit(0.0)))
    return df.crossJoin(F.broadcast(arrays)).withColumn("v", scaled).drop("_t")  # one row: means and deviations


def silhouette(df: DataFrame, by: str) -> DataFrame:
    """(id, by, silhouette) from exact mean distances to every cluster; 0 in a cluster of one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], by: [], "other": [], "total": []})]
        if (two := two_sides(pdf)) is not None:
            a, b = (side.sort_values(by) for side in two)
            x, y = matrix(a["v"]), matrix(b["v"])
            weigh, kinds, first = b["w"].to_numpy(float), *np.unique(b[by], return_index=True)
            scale = (x * x).sum(1).max() + (y * y).sum(1).max()
            for kind in a[by].unique():
                rows = np.flatnonzero(a[by] == kind)
                own, back = x[rows], np.zeros(len(b))
                of_a, total = a["w"].to_numpy(float)[rows], np.empty((len(rows), len(kinds)))
                for start, d in squares(own, y):
                    # Where products round too much, differences decide: equal vectors are exactly 0 apart.
                    i, j = np.nonzero(d <= 1e-4 * scale)
                    for part in range(0, len(i), 65_536):
                        p, q = i[part : part + 65_536], j[part : part + 65_536]
                        d[p, q] = ((y[q] - own[start + p]) ** 2).sum(1)
                    np.sqrt(d, out=d)
                    here = slice(start, start + len(d))
                    back += of_a[here] @ d
                    d *= weigh
                    total[here] = np.add.reduceat(d, first, axis=1)
                out.append(pd.DataFrame({"id": np.repeat(a["id"].to_numpy()[rows], len(kinds)), by: kind, "other": np.tile(kinds, len(rows)), "total": total.ravel()}))
                if two[0] is not two[1]:
                    out.append(pd.DataFrame({"id": b["id"], by: b[by], "other": kind, "total": back}))
        return pd.concat(out)

    points = distinct_vectors(df.select("id", by, "v"), by)
    sums = half_pairs(points).groupBy("_i", "_j").applyInPandas(run, f"id long, {by} int, other int, total double")
    sizes = df.groupBy(F.col(by).alias("other")).agg(F.count(F.lit(1)).alias("n"))
    each = sums.groupBy("id", by, "other").agg(F.sum("total").alias("total")).join(sizes, "other")
    own = F.col("other") == F.col(by)
    two = each.groupBy("id", by).agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b")
    )
    told = two.select("id", by, F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))
    value = told.join(points.select("id", by, "v"), ["id", by]).select(by, "v", "silhouette")
    return df.select("id", by, "v").join(value, [by, "v"]).select("id", by, "silhouette")


def calinski_harabasz(df: DataFrame, by: str) -> DataFrame:
    cents = centroids(df, by)
    whole = centroids(df.withColumn("_all", F.lit(0)), "_all").select(F.col("centroid").alias("_m"))
    within = df.join(cents, by).agg(F.sum(F.pow(V.euclidean(F.col("v"), F.col("centroid")), 2)).alias("w"), F.count(F.lit(1)).alias("n"))
    between = cents.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("size") * F.pow(V.euclidean(F.col("centroid"), F.col("_m")), 2)).alias("b"), F.count(F.lit(1)).alias("k"))
    return within.crossJoin(between).select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("score"))


def davies_bouldin(df: DataFrame, by: str) -> DataFrame:
    """Cluster-level table, so its pairs are few; of each cluster the worst other."""
    c = cohesion(df, by).join(centroids(df, by).drop("size"), by).select(by, "cohesion", "centroid")
    o = c.select(F.col(by).alias("_o"), F.col("cohesion").alias("_c"), F.col("centroid").alias("_v"))
    pairs = c.join(o, F.col(by) != F.col("_o"))
    worst = pairs.groupBy(by).agg(F.max((F.col("cohesion") + F.col("_c")) / V.euclidean(F.col("centroid"), F.col("_v"))).alias("r"))
    return worst.agg(F.avg("r").alias("score"))


def estimate_eps(df: DataFrame, low: float = 0.1, high: float = 2.0, k: int = 4) -> DataFrame:
    """Median distance to the k-th neighbour, a vector counted as its own first, and that clamped."""
    n = df.count()
    kth = nearest(df, min(k, max(n - 1, 1)), with_self=True).groupBy("id").agg(F.max("distance").alias("d"))
    median = kth.agg(F.median("d").alias("median"))
    return median.select("median", F.greatest(F.lit(low), F.least(F.lit(high), F.col("median"))).alias("eps"))


def connected(edges: DataFrame, checkpoint) -> DataFrame:
    """(node, root): least node reachable; ``checkpoint`` cuts the lineage of each round."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = checkpoint(both)
    roots = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = roots.join(near, "node", "left").join(jump, "root", "left")
        new = new.select("node", F.least("root", "near", "next").alias("root"), F.col("root").alias("old"))
        new = checkpoint(new)
        if not new.where("root <> old").head(1):
            return new.select("node", "root")
        roots = new.select("node", "root")


def united(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``parent`` (the root of each node, the least of its tree) once nodes i and j are linked."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j = a[apart], b[apart]
        parent[np.maximum(i, j)] = np.minimum(i, j)
        while (parent != (up := parent[parent])).any():
            parent = up


def dbscan(df: DataFrame, eps: float, least: int, checkpoint) -> DataFrame:
    """(id, label): clusters of core vectors numbered by their least core id, borders to the least cluster, noise -1.

    Equal vectors are compared once. A pair of blocks tells how many are near each vector, a forest of its links and the least cluster
    near a border, so no table has more rows than vectors times blocks, however many pairs are near.
    """
    points = checkpoint(distinct_vectors(df.select("id", "v")))

    def near_ones(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"id": [], "n": []}
        if (two := two_sides(pdf)) is not None:
            a, b = two
            n = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            of_a, of_b = a["w"].to_numpy(), b["w"].to_numpy()
            for rows, near in within(matrix(a["v"]), matrix(b["v"]), eps):
                n[0][rows] = near @ of_b
                n[1][:] += of_a[rows] @ near
            for side, own in zip(two if b is not a else two[:1], n):
                out["id"].append(side["id"].to_numpy())
                out["n"].append(own)
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()})

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        if (two := two_sides(pdf)) is None:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        a, b = two
        ids = np.concatenate([a["id"], b["id"]]) if b is not a else a["id"].to_numpy()
        first, parent = len(ids) - len(b), np.arange(len(ids))
        for rows, near in within(matrix(a["v"]), matrix(b["v"]), eps):
            i, j = np.nonzero(near)
            parent = united(parent, i + rows.start, j + first)
        linked = np.flatnonzero(parent != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[linked], "b": ids[parent[linked]]})

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "reach": []}, dtype=np.int64)]
        if (two := two_sides(pdf)) is not None:
            for a, b in (two, two[::-1]) if two[0] is not two[1] else (two,):
                a, b = a[a["label"].isna()], b[b["label"].notna()]
                if len(a) and len(b):
                    label = b["label"].to_numpy(np.int64)
                    none = np.iinfo(np.int64).max
                    reach = np.concatenate([np.where(near, label, none).min(1) for _, near in within(matrix(a["v"]), matrix(b["v"]), eps)])
                    out.append(pd.DataFrame({"a": a["id"], "reach": reach})[reach < none])
        return pd.concat(out)

    counted = half_pairs(points).groupBy("_i", "_j").applyInPandas(near_ones, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    core = checkpoint(counted.where(F.col("n") >= least).select("id").join(points.select("id", "v"), "id"))
    links = half_pairs(core).groupBy("_i", "_j").applyInPandas(forest, "a long, b long").union(core.select("id", "id"))
    roots = connected(links, checkpoint)
    named = roots.select("root").distinct().withColumn("label", F.row_number().over(Window.orderBy("root")) - 1)  # one row a cluster
    labels = roots.join(named, "root").select(F.col("node").alias("id"), F.col("label").cast("long").alias("label"))
    told = checkpoint(points.join(labels, "id", "left"))
    reached = half_pairs(told.select("id", "v", "label")).groupBy("_i", "_j").applyInPandas(borders, "a long, reach long").groupBy("a").agg(F.min("reach").alias("reach"))
    every = told.join(reached, F.col("id") == F.col("a"), "left").select("v", F.coalesce("label", "reach", F.lit(-1)).cast("int").alias("label"))
    return df.select("id", "v").join(every, "v").select("id", "label")


def kmeans(df: DataFrame, k: int, *, seed: int = 42, starts: int = 10, iterations: int = 300) -> DataFrame:
    """(id, label): the best of several starts by training cost; labels follow the least id of each cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = df.count()
    if min(k, n) <= 1:  # nothing to divide
        return df.select("id", F.lit(0).alias("label"))
    # A file of one row group would be one task in every round. Sorted, so that the first centres are the same in each run.
    parts = max(1, min(n // 1000, 2 * df.sparkSession.sparkContext.defaultParallelism))
    data = df.select("id", array_to_vector(V.doubles(F.col("v"))).alias("features")).repartition(parts, "id").sortWithinPartitions("id").persist()
    try:
        models = [KMeans(k=max(1, min(k, n)), seed=seed + s, maxIter=iterations, tol=1e-4).fit(data) for s in range(starts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        raw = best.transform(data).select("id", "prediction")
    finally:
        data.unpersist()
    order = raw.groupBy("prediction").agg(F.min("id").alias("first")).withColumn("label", F.row_number().over(Window.orderBy("first")) - 1)
    return raw.join(order, "prediction").select("id", F.col("label").cast("int").alias("label"))


def choose_k(df: DataFrame, most: int) -> int:
    """The k of best silhouette; with nothing to choose from min(5, max(2, n div 3))."""
    n, best = df.count(), None
    for k in range(2, min(most, n - 1) + 1):
        labels = kmeans(df, k, starts=1)
        s = silhouette(df.join(labels, "id"), "label").agg(F.avg("silhouette")).first()[0]
        best = max(best or (s, -k), (s, -k))
    return -best[1] if best else min(5, max(2, n // 3))


def composite_score(silhouette_: float, ch: float, db: float, k: int, outliers: float) -> float:
    """How clusterings are compared; a single cluster has 0, 0 and infinity."""
    return 0.4 * silhouette_ + 0.3 * min(1.0, ch / 1000) + 0.2 / (1 + db) + 0.1 * min(1.0, k / 10) - 0.3 * outliers


def evaluate(df: DataFrame, by: str) -> dict[str, float]:
    """Metrics without noise (label -1)."""
    kept = df.where(F.col(by) >= 0)
    k, n = kept.select(by).distinct().count(), df.count()
    outliers = 1 - kept.count() / n if n else 0.0
    if k <= 1:
        return {"silhouette": 0.0, "calinski_harabasz": 0.0, "davies_bouldin": float("inf"), "k": k, "outliers": outliers}
    return {
        "silhouette": silhouette(kept, by).agg(F.avg("silhouette")).first()[0],
        "calinski_harabasz": calinski_harabasz(kept, by).first()[0],
        "davies_bouldin": davies_bouldin(kept, by).first()[0],
        "k": k,
        "outliers": outliers,
    }


def auto_cluster(df: DataFrame, checkpoint, *, ks: Sequence[int], eps: float, least: int = 5) -> tuple[str, DataFrame]:
    """k-means for each k, density clustering and Ward for each k: the best composite score wins, first of equals."""
    scaled = checkpoint(standardize(df))
    tried = [(f"kmeans_{k}", kmeans(scaled, k, starts=1)) for k in ks] + [("dbscan", dbscan(scaled, eps, least, checkpoint))]
    tried += [(f"ward_{k}", ward(scaled, k)) for k in ks]
    scored = []
    for name, labels in tried:
        kept = checkpoint(labels)
        m = evaluate(scaled.join(kept, "id"), "label")
        scored.append((composite_score(m["silhouette"], m["calinski_harabasz"], m["davies_bouldin"], m["k"], m["outliers"]), name, kept))
    best = max(s for s, _, _ in scored)
    return next((name, labels) for s, name, labels in scored if s == best)


def hierarchy(cents: DataFrame, by: str) -> DataFrame:
    """(node, parent, level, height) of the dendrogram over all cluster centroids; the root has no parent. One task, as ``ward``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        n, tree = len(pdf), merges(matrix(pdf["centroid"]))
        names = [f"cluster_{c}" for c in pdf[by]] + [f"internal_{s}" for s in range(len(tree))]
        parent, level = [None] * len(names), [0] * len(names)
        for s in reversed(range(len(tree))):
            for i in tree[s][:2]:
                parent[i], level[i] = names[n + s], level[n + s] + 1
        return pd.DataFrame({"node": names, "parent": parent, "level": level, "height": [0.0] * n + [h for _, _, h in tree]})

    return cents.select(by, "centroid").groupBy().applyInPandas(run, "node string, parent string, level int, height double")


def greedy_merge(cents: DataFrame, by: str, threshold: float) -> DataFrame:
    """(by, seed): in order of id each unclaimed cluster claims the later ones whose centroid's cosine exceeds the threshold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        x = matrix(pdf["centroid"])
        size = np.linalg.norm(x, axis=1)
        x = x / np.where(size > 0, size, 1)[:, None]
        seed = np.full(len(x), -1)
        for i in range(len(x)):
            if seed[i] < 0:
                seed[(seed < 0) & (np.arange(len(x)) >= i) & ((x @ x[i] > threshold) | (np.arange(len(x)) == i))] = i
        return pd.DataFrame({by: pdf[by], "seed": pdf[by].to_numpy()[seed]})

    return cents.groupBy().applyInPandas(run, f"{by} int, seed int")


def level_hierarchy(df: DataFrame, by: str, *, threshold: float = 0.8, levels: int = 3) -> DataFrame:
    """(level, cluster, parent): merges of level on level until one cluster or no change is left. Cluster-level loop."""
    now, out = df.select("id", "v", F.col(by).cast("int").alias("c")), None
    for level in range(levels):
        cents = centroids(now, "c")
        claimed = greedy_merge(cents.select("c", "centroid"), "c", threshold).select(F.lit(level).alias("level"), F.col("c").alias("cluster"), F.col("seed").alias("parent"))
        out = claimed if out is None else out.unionByName(claimed)
        if claimed.where("cluster <> parent").count() == 0 or claimed.select("parent").distinct().count() <= 1:
            break
        now = now.join(claimed.select(F.col("cluster").alias("c"), "parent"), "c").select("id", "v", F.col("parent").alias("c"))
    return out


def scaled_2d(points: DataFrame) -> DataFrame:
    """(id, x, y) with each axis stretched to -1..1, 0 where it has no range."""
    r = points.agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    put = lambda c: F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), 2 * (F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}")) - 1).otherwise(0.0)
    return points.crossJoin(F.broadcast(r)).select("id", put("x").alias("x"), put("y").alias("y"))


def pca(df: DataFrame, k: int) -> DataFrame:
    """(id, v): k principal components of the centred vectors, the largest loading of each made positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.linalg import DenseMatrix  # noqa: F401

    data = df.select("id", array_to_vector(V.doubles(F.col("v"))).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="out").fit(data)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
    mean = df.select(F.posexplode(V.doubles(F.col("v"))).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x")).orderBy("p").collect()
    shift = np.array([r["x"] for r in mean]) @ loadings
    fixed = F.zip_with(vector_to_array("out"), F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(float(m)).alias("m")) for s, m in zip(signs, shift)]), lambda x, t: (x - t["m"]) * t["s"])
    return model.transform(data).select("id", fixed.alias("v"))


def pca_2d(df: DataFrame) -> DataFrame:
    return scaled_2d(pca(df, 2).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")))


def reduce_dimensions(df: DataFrame, target: int) -> DataFrame:
    """PCA to ``target`` dimensions, or the vectors as they are where they have no more."""
    first = df.select(F.size("v").alias("d")).head(1)
    return df if not first or first[0]["d"] <= target else pca(df, target)


def random_2d(df: DataFrame, seed: int = 27) -> DataFrame:
    first = df.select(F.size("v").alias("d")).head(1)
    d = first[0]["d"] if first else 1
    axes = np.random.default_rng(seed).standard_normal((2, d)) / np.sqrt(d)
    x, y = (V.dot(F.col("v"), F.array(*[F.lit(float(a)) for a in axis])) for axis in axes)
    return scaled_2d(df.select("id", x.alias("x"), y.alias("y")))


def numbered(df: DataFrame) -> DataFrame:
    """(id, n): rows numbered from 0 without gaps, block by block of ``blocks``."""
    b = blocks(df.select("id"))
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_size"))  # one row a block
    starts = sizes.select("_b", (F.sum("_size").over(Window.orderBy("_b")) - F.col("_size")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("id")) - 1
    return b.join(starts, "_b").select("id", (F.col("_start") + place).alias("n"))


def force_layout(df: DataFrame, checkpoint, *, neighbours: int = 15, rounds: int = 100, seed: int = 27) -> DataFrame:
    """(id, x, y) by attraction along the neighbour graph and repulsion from random points, drawn anew each round.

    One method at every size: each round joins the ends of all links and draws with their places; ``checkpoint`` cuts
    the lineage of each round. Draws and first places are hashes of the number of the row.
    """
    rows = checkpoint(numbered(df))
    total = rows.count()
    end = lambda name, n: rows.select(F.col("id").alias(name), F.col("n").alias(n))
    near = nearest(df, neighbours).select(F.col("id").alias("_id"), F.col("neighbour").alias("_other"), F.exp(-F.col("distance")).alias("w"))
    links = checkpoint(near.join(end("_id", "n"), "_id").join(end("_other", "m"), "_other").select("n", "m", "w"))
    part = lambda salt: (F.shiftrightunsigned(F.xxhash64("n", F.lit(seed), F.lit(salt)), 11) + 0.5) / float(1 << 53)
    far, turn = 0.1 * F.sqrt(-2 * F.log(part("far"))), 2 * np.pi * part("turn")
    at = checkpoint(rows.select("n", (far * F.cos(turn)).alias("x"), (far * F.sin(turn)).alias("y")))
    for r in range(rounds):
        other = F.pmod(F.xxhash64("n", "_draw", F.lit(seed), F.lit(r)), F.lit(total))
        draws = rows.select("n", F.explode(F.sequence(F.lit(1), F.lit(min(20, total)))).alias("_draw")).select("n", other.alias("m"), F.lit(None).cast("double").alias("w"))
        # Both sides are the same table under other names: where Spark broadcasts places, they go through the driver once.
        ends = at.select(F.col("n").alias("m"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        own = at.select(F.col("n").alias("_n"), F.col("x").alias("_x0"), F.col("y").alias("_y0"))
        both = links.unionByName(draws).join(ends, "m").join(own, F.col("n") == F.col("_n"))
        dx, dy = F.col("_x") - F.col("_x0"), F.col("_y") - F.col("_y0")
        push = lambda d: F.avg(F.when(F.col("w").isNull(), -d / (0.01 + dx * dx + dy * dy))) * 0.01
        pull = lambda d: F.coalesce(F.avg(F.col("w") * d), F.lit(0.0))
        moved = lambda c, d: (F.first(f"_{c}0") + 0.5 * (1 - r / rounds) * (pull(d) + push(d))).alias(c)
        at = checkpoint(both.groupBy("n").agg(moved("x", dx), moved("y", dy)))
    return scaled_2d(at.join(rows, "n").select("id", "x", "y"))

