"""Approximate neighbour graphs, layouts along them, and how far a layout can be trusted.

Vectors are (id, v). ``checkpoint`` writes a table and reads it again, to cut the lineage of rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convlens.functions import vectors as V
from convlens.operators import vectors as O

Checkpoint = Callable[[DataFrame], DataFrame]
#: Vectors that a task has at once, as far as they can be told apart: at least, and so many that there are about STRIPS tasks, MOST at most.
CELL, STRIPS, MOST = 4096, 24, 32_768
#: Vectors compared with each other in a leaf.
LEAF = 128


def cell_of(total: int) -> int:
    """A vector travels to each cell that refers to it, so their number does not follow the rows until cells have MOST."""
    return max(CELL, min(MOST, total // STRIPS))


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists as a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def mean_of(df: DataFrame) -> np.ndarray:
    """Mean by position: as many numbers as a vector has."""
    found = df.select(F.posexplode(V.doubles(F.col("v"))).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x")).collect()
    return np.array([r["x"] for r in sorted(found, key=lambda r: r["p"])])


def cells(df: DataFrame, total: int, trees: int, seed: int, checkpoint: Checkpoint) -> DataFrame:
    """(id, v, tree, cell): for each tree, cells of vectors on the same side of random planes through the mean, ``cell_of(total)`` of them at most.

    A cell has as few planes as keep it small. What no plane parts, such as equal vectors, is dealt to parts by hash.
    """
    most = cell_of(total)
    bits = max(1, math.ceil(math.log2(max(1, total / most)))) + 10
    mean = mean_of(df)
    planes = np.random.default_rng(seed).standard_normal((len(mean), trees * bits))
    power = 1 << np.arange(bits, dtype=np.int64)[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                side = ((rows_of(batch.column("v")) - mean) @ planes > 0).reshape(batch.num_rows, trees, bits)
                code = (side * power).sum(2)
                yield pa.record_batch({"id": batch.column("id"), "v": batch.column("v"), "codes": pa.array(list(code), pa.list_(pa.int64()))})

    coded = df.select("id", V.doubles(F.col("v")).alias("v")).mapInArrow(run, "id long, v array<double>, codes array<long>")
    placed = checkpoint(coded.select("id", "v", F.posexplode("codes").alias("tree", "code")))
    codes = placed.groupBy("tree", "code").agg(F.count(F.lit(1)).alias("n"))
    prefix = F.expr(f"shiftright(code, {bits} - depth)")
    sized = codes.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits)))).groupBy("tree", "depth", prefix.alias("prefix")).agg(F.sum("n").alias("n"))
    small = sized.where((F.col("n") <= most) | (F.col("depth") == bits))
    every = codes.select("tree", "code", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn("prefix", prefix)
    chosen = every.join(small, ["tree", "depth", "prefix"]).groupBy("tree", "code").agg(F.min(F.struct("depth", "prefix", "n")).alias("c"))
    part = F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("c.n") / most))
    return placed.join(chosen, ["tree", "code"]).select("id", "v", "tree", F.xxhash64("tree", "c.depth", "c.prefix", part).alias("cell"))


def halves(x: np.ndarray, draw: np.random.Generator) -> list[np.ndarray]:
    """Rows in leaves of LEAF at most, parted at medians of random directions."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        order = rows[np.argsort(x[rows] @ draw.standard_normal(x.shape[1]), kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def best_of(graph: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, distance, fresh, rank): the k least, ties to the smaller id; fresh if no row of the pair is old."""
    pairs = graph.repartition("id").groupBy("id", "neighbour").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)


def neighbour_graph(df: DataFrame, k: int, checkpoint: Checkpoint, *, trees: int = 4, rounds: int = 8, settled: float = 0.002, seed: int = 27) -> tuple[DataFrame, DataFrame]:
    """((id, neighbour, distance, rank), (id, v, block)): about the k nearest by Euclid, by descent.

    Leaves of random trees give the first neighbours. Then each round compares, for every vector, its neighbours and k of those whose
    neighbour it is (by hash) with one another: neighbours of a neighbour are likely neighbours. Lists are twice as long as asked for
    until the end, as short ones get stuck; it ends once fewer than ``settled`` of all links change. Vectors travel once to each block (the cells of the first tree) that refers to them. Work is in proportion to the
    rows, but for the logarithm in the trees. Null vectors and null ids are left out; equal vectors are at distance 0; ids
    must be distinct. With k or fewer other vectors, all are neighbours. An empty table gives an empty graph.
    """
    df = df.where("id is not null and v is not null").select("id", "v")
    total = df.count()
    if not total:
        none = df.sparkSession.createDataFrame([], "id long, neighbour long, distance double, rank int")
        return none, df.select("id", V.doubles(F.col("v")).alias("v"), F.lit(0).cast("long").alias("block"))
    asked, k = k, 2 * k
    dealt = checkpoint(cells(df, total, trees, seed, checkpoint))
    vectors = checkpoint(dealt.where("tree = 0").select("id", "v", F.col("cell").alias("block")))

    def leaves(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), rows_of(table.column("v"))
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        out = []
        for rows in halves(x, np.random.default_rng([seed, table.column("tree")[0].as_py()])):
            near = O.distances(x[rows], x[rows])
            np.fill_diagonal(near, np.inf)
            m = min(k, len(rows) - 1)
            best = np.argpartition(near, m - 1, axis=1)[:, :m] if 0 < m < len(rows) else np.zeros((len(rows), 0), int)
            out.append((np.repeat(ids[rows], m), ids[rows][best].ravel(), np.take_along_axis(near, best, 1).ravel()))
        a, b, d = (np.concatenate(p) for p in zip(*out))
        return pa.table({"id": a, "neighbour": b, "distance": d})

    first = dealt.groupBy("tree", "cell").applyInArrow(leaves, "id long, neighbour long, distance double")
    graph = checkpoint(best_of(first.withColumn("fresh", F.lit(True)), k))
    for _ in range(rounds if total > k + 1 else 1):
        # Dealt out by id once: of the rows whose neighbour it is k by hash, then the blocks, then what is distinct.
        both = graph.select("id", "neighbour", F.lit(False).alias("back")).union(graph.select("neighbour", "id", F.lit(True)))
        turn = F.row_number().over(Window.partitionBy("id", "back").orderBy(F.xxhash64("id", "neighbour"), "neighbour"))
        listed = both.repartition("id").withColumn("turn", turn).where(F.col("turn") <= k)
        lists = listed.join(vectors.select("id", "block"), "id").select("id", "neighbour", "block").distinct()
        reach = graph.groupBy("id").agg(F.max("distance").alias("reach"), F.count(F.lit(1)).alias("have"))
        known = vectors.join(reach, "id", "left").select("id", "v", F.when(F.col("have") >= k, F.col("reach")).otherwise(F.lit(math.inf)).alias("reach"))
        members = lists.select(F.col("block").alias("at"), F.col("neighbour").alias("id")).union(vectors.select("block", "id")).repartition("id").distinct().join(known, "id")
        found = lists.groupBy("block").cogroup(members.groupBy("at")).applyInArrow(lambda a, b: _meet(a, b, k), "id long, neighbour long, distance double")
        graph = checkpoint(best_of(graph.select("id", "neighbour", "distance", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True))), k))
        if graph.where("fresh").count() <= settled * k * total:
            break
    return graph.where(F.col("rank") <= asked).select("id", "neighbour", "distance", "rank"), vectors


def _meet(lists: pa.Table, members: pa.Table, k: int) -> pa.Table:
    """Of one block: pairs of vectors on one list that are nearer than what one of them has, the k nearest for each."""
    ids = members.column("id").to_numpy()
    order = np.argsort(ids)
    ids, x, reach = ids[order], rows_of(members.column("v"))[order], members.column("reach").to_numpy()[order]
    own, other = (np.searchsorted(ids, lists.column(c).to_numpy()) for c in ("id", "neighbour"))
    order = np.lexsort((other, own))
    own, other = own[order], other[order]
    nodes, start, size = np.unique(own, return_index=True, return_counts=True)
    out = []
    wide = int(size.max(initial=0)) + 1
    for at in range(0, len(nodes), 256):
        s, c = start[at : at + 256], size[at : at + 256]
        table = np.full((len(s), wide), -1)
        table[np.arange(wide)[None] < c[:, None]] = other[np.repeat(s, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
        table[np.arange(len(s)), c] = nodes[at : at + 256]
        y = x[table]
        norm = (y * y).sum(2)
        square = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(y, y.transpose(0, 2, 1))
        bound = np.square(np.where(table >= 0, reach[table], -1.0))
        good = (table[:, :, None] >= 0) & (table[:, None, :] >= 0) & (table[:, :, None] != table[:, None, :]) & (square < bound[:, :, None] + 1e-9 * (1 + norm[:, :, None]))
        n, i, j = np.nonzero(good)
        a, b = table[n, i], table[n, j]
        pair = np.unique(a * len(ids) + b)
        out.append(pair)
    pair = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    a, b = pair // len(ids), pair % len(ids)
    d = np.empty(len(a))
    for part in range(0, len(a), 65_536):
        rows = slice(part, part + 65_536)
        d[rows] = np.sqrt(((x[a[rows]] - x[b[rows]]) ** 2).sum(1))
    keep = d < reach[a]
    a, b, d = a[keep], b[keep], d[keep]
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return pa.table({"id": pa.array(ids[a[keep]]), "neighbour": pa.array(ids[b[keep]]), "distance": pa.array(d[keep])})


def neighbour_recall(df: DataFrame, graph: DataFrame, k: int, every: int = 50) -> DataFrame:
    """(id, found, k): how many of the k nearest the graph has, for each id that ``every`` divides, against all rows."""
    asked = df.where(F.col("id") % every == 0)
    true = nearest_of(asked, df, k)
    hits = true.join(graph.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
    return hits.groupBy("id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("k"))


def _against_all(asked: DataFrame, df: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run(asked, rows)`` for each pair of a block of the asked rows and a block of all."""
    own, rows = O.blocks(asked), O.blocks(df.select("id", "v"))
    n, m = (int(x.agg(F.coalesce(F.max("_b"), F.lit(0))).first()[0]) + 1 for x in (own, rows))
    left = own.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumnRenamed("_b", "_i")
    right = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumnRenamed("_b", "_j")
    left = left.toDF(*left.columns)  # both sides may come from one table
    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(run, schema)


def nearest_of(asked: DataFrame, df: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, distance, rank) of the asked rows' exact k nearest among all; ties to the smaller id."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        ids, others, x, y = a.column("id").to_numpy(), b.column("id").to_numpy(), rows_of(a.column("v")), rows_of(b.column("v"))
        i, j, d = O.close_pairs(x, y, np.inf, min(k + 1, len(others)))
        keep = ids[i] != others[j]
        i, j, d = i[keep], j[keep], d[keep]
        order = np.lexsort((others[j], d, i))
        i, j, d = i[order], j[order], d[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pa.table({"id": ids[i[keep]], "neighbour": others[j[keep]], "distance": d[keep]})

    found = _against_all(asked.select("id", "v"), df, run, "id long, neighbour long, distance double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)


def trustworthiness(df: DataFrame, layout: DataFrame, k: int = 5, every: int = 1) -> DataFrame:
    """One row (n, asked, penalty, trustworthiness) for a layout (id, v) of vectors (id, v).

    Of each id that ``every`` divides, those among its k nearest in the layout that are not so in the vectors cost their rank there less k.
    Ranks are exact: each block of asked vectors counts, in each block of all, who is nearer (of equally near ones the smaller id).
    1 where there are too few vectors for a rank beyond k.
    """
    chosen = F.col("id") % every == 0
    near = nearest_of(layout.where(chosen), layout, k).groupBy("id").agg(F.sort_array(F.collect_list("neighbour")).alias("near"))
    vectors = df.select("id", V.doubles(F.col("v")).alias("v"))
    pairs = near.select("id", F.explode("near").alias("other")).join(vectors.select(F.col("id").alias("other"), F.col("v").alias("w")), "other").join(vectors.where(chosen), "id")
    gaps = pairs.groupBy("id").agg(F.first("v").alias("v"), F.collect_list(F.struct("other", F.col("w"))).alias("to"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "before": pa.array([], pa.int64())})
        ids, others, x, y = a.column("id").to_numpy(), b.column("id").to_numpy(), rows_of(a.column("v")), rows_of(b.column("v"))
        out = []
        for i, to in enumerate(a.column("to").to_pylist()):
            d = np.sqrt(((y - x[i]) ** 2).sum(1))
            d[others == ids[i]] = np.inf
            for t in to:
                gap = np.sqrt(((np.array(t["w"]) - x[i]) ** 2).sum())
                out.append((ids[i], t["other"], int(((d < gap) | (d == gap) & (others < t["other"])).sum())))
        p, q, r = zip(*out) if out else ((), (), ())
        return pa.table({"id": pa.array(p, pa.int64()), "other": pa.array(q, pa.int64()), "before": pa.array(r, pa.int64())})

    ranks = _against_all(gaps, vectors, run, "id long, other long, before long").groupBy("id", "other").agg((F.sum("before") + 1).alias("rank"))
    penalty = ranks.agg(F.coalesce(F.sum(F.greatest(F.col("rank") - k, F.lit(0))), F.lit(0)).alias("penalty"))
    counts = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(chosen).alias("asked"))
    worst = F.col("asked") * k * (2 * F.col("n") - 3 * k - 1)
    score = F.when((F.col("n") > 2 * k) & (F.col("asked") > 0), 1 - 2.0 * F.col("penalty") / worst).otherwise(F.lit(1.0))
    return counts.crossJoin(penalty).select("n", "asked", "penalty", score.alias("trustworthiness"))  # one row each


def scales(distance: np.ndarray, steps: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(rho, sigma) by row: the least distance above 0, and the scale at which the weights add up to the logarithm of their number."""
    near = np.where(distance > 0, distance, np.inf).min(1, initial=np.inf)
    rho = np.where(np.isfinite(near), near, 0.0)
    goal = math.log2(max(2, distance.shape[1]))
    gap = np.maximum(0.0, distance - rho[:, None])
    low, high, sigma = np.zeros(len(gap)), np.full(len(gap), np.inf), np.ones(len(gap))
    for _ in range(steps):
        much = np.exp(-gap / sigma[:, None]).sum(1) > goal
        high, low = np.where(much, sigma, high), np.where(much, low, sigma)
        sigma = np.where(np.isfinite(high), (low + high) / 2, 2 * sigma)
        sigma = np.clip(sigma, 1e-12, 1e12)
    return rho, np.maximum(sigma, 1e-3 * np.maximum(distance.mean(1), 1e-12))


def fuzzy_graph(graph: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the union of the neighbours' memberships, p + q - p q for the two directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("d")], int)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                rho, sigma = scales(rows_of(part.column("d")))
                yield pa.record_batch({"id": part.column("id"), "neighbours": part.column("neighbours"), "d": part.column("d"), "rho": rho, "sigma": sigma})

    lists = graph.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "distance"))).alias("l")).select("id", F.col("l.neighbour").alias("neighbours"), F.col("l.distance").alias("d"))
    scaled = lists.mapInArrow(run, "id long, neighbours array<long>, d array<double>, rho double, sigma double")
    one = scaled.select("id", "rho", "sigma", F.explode(F.arrays_zip("neighbours", "d")).alias("n")).select("id", F.col("n.neighbours").alias("other"), F.exp(-F.greatest(F.lit(0.0), F.col("n.d") - F.col("rho")) / F.col("sigma")).alias("p"))
    both = one.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("p").alias("p"), F.min("p").alias("q"), F.count(F.lit(1)).alias("n"))
    return both.select("a", "b", F.when(F.col("n") == 2, F.col("p") + F.col("q") - F.col("p") * F.col("q")).otherwise(F.col("p")).alias("w"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) with which 1 / (1 + a d^(2b)) comes nearest to 1 up to ``min_dist`` and exp(-(d - min_dist) / spread) beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    goal = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(100):
        power = d ** (2 * b)
        value = 1 / (1 + a * power)
        slope = np.stack([-power * value**2, -2 * a * power * np.log(d) * value**2], 1)
        step = np.linalg.lstsq(slope, goal - value, rcond=None)[0]
        a, b = max(1e-3, a + 0.5 * step[0]), max(1e-2, b + 0.5 * step[1])
    return float(a), float(b)


def _columns(dims: int) -> list[str]:
    return [f"x{i}" for i in range(dims)]


def spectral_start(links: DataFrame, start: DataFrame, dims: int, checkpoint: Checkpoint, rounds: int = 6) -> DataFrame:
    """(id, x0, ...): ``start`` smoothed along the links (a, b, w) towards the first eigenvectors of the graph after the trivial one.

    Steps with (1 + D^-1/2 W D^-1/2) / 2, made orthogonal after every third; only the products of the columns reach the driver.
    """
    xs = _columns(dims)
    both = links.select("a", "b", "w").union(links.select("b", "a", "w"))
    degree = both.groupBy("a").agg(F.sum("w").alias("deg"))
    ends = checkpoint(both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("deg").alias("_d")), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("deg") * F.col("_d"))).alias("s")))
    now = start.join(degree.select(F.col("a").alias("id"), F.sqrt("deg").alias("t")), "id")

    def apart(df: DataFrame) -> DataFrame:
        """Columns orthogonal to the trivial one and to each other, of length 1."""
        names = ["t", *xs]
        dots = df.agg(*[F.sum(F.col(p) * F.col(q)).alias(f"{p}_{q}") for i, p in enumerate(names) for q in names[i:]]).first()
        gram = np.array([[dots[f"{p}_{q}"] if i <= j else dots[f"{q}_{p}"] for j, q in enumerate(names)] for i, p in enumerate(names)], float)
        inverse = np.linalg.inv(np.linalg.cholesky(gram + 1e-12 * np.trace(gram) * np.eye(len(names))))
        return df.select("id", "t", *[sum((F.col(c) * float(inverse[i + 1, j]) for j, c in enumerate(names[: i + 2])), F.lit(0.0)).alias(x) for i, x in enumerate(xs)])

    now = checkpoint(apart(now))
    for r in range(1, rounds + 1):
        moved = ends.join(now.withColumnRenamed("id", "b"), "b").groupBy("a").agg(*[F.sum(F.col("s") * F.col(x)).alias(f"_{x}") for x in xs]).withColumnRenamed("a", "id")
        now = checkpoint(now.join(moved, "id", "left").select("id", "t", *[(0.5 * (F.col(x) + F.coalesce(f"_{x}", F.lit(0.0)))).alias(x) for x in xs]))
        now = now if r % 3 and r < rounds else apart(now)
    return now.select("id", *[(F.col(x) / F.col("t")).alias(x) for x in xs])


def _descend(links: pa.Table, places: pa.Table, far: np.ndarray, a: float, b: float, rates: list[float], dims: int, draw: int, everyone: int) -> pa.Table:
    """Some epochs of one block: its own points move, those of other blocks stay where the round found them.

    Points are pushed off by five others each epoch: by own ones as often as these are among all, by far ones else.
    """
    ids = places.column("id").to_numpy()
    order = np.argsort(ids)
    ids, own = ids[order], places.column("own").to_numpy(zero_copy_only=False)[order]
    x = np.stack([places.column(c).to_numpy()[order] for c in _columns(dims)], 1)
    mine = np.flatnonzero(own)
    number = np.full(len(ids), -1)
    number[mine] = np.arange(len(mine))
    i, j = (np.searchsorted(ids, links.column(c).to_numpy()) for c in ("id", "other"))
    w, i = links.column("w").to_numpy(), number[i]
    total = np.maximum(np.bincount(i, w, len(mine)), 1e-12)[:, None]
    random = np.random.default_rng([draw, len(ids)])
    for rate in rates:
        here = x[mine]
        gap = here[i] - x[j]
        square = np.maximum((gap * gap).sum(1), 1e-12)
        pull = -2 * a * b * square ** (b - 1) / (1 + a * square**b)
        step = np.stack([np.bincount(i, w * np.clip(pull * gap[:, c], -4, 4), len(mine)) for c in range(dims)], 1) / total
        if len(far):
            for _ in range(5):
                near = random.random(len(mine)) < len(mine) / everyone
                other = np.where(near[:, None], here[random.integers(0, len(mine), len(mine))], far[random.integers(0, len(far), len(mine))])
                gap = here - other
                square = (gap * gap).sum(1)
                push = 2 * b / ((0.001 + square) * (1 + a * square**b))
                step += np.clip(push[:, None] * gap, -4, 4) * (square > 0)[:, None]
        x[mine] = here + rate * step
    return pa.table({"id": ids[mine]} | {c: x[mine, k] for k, c in enumerate(_columns(dims))})


def _step(*given) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda links, places: _descend(links, places, *given)


def umap(df: DataFrame, checkpoint: Checkpoint, *, dims: int = 2, neighbours: int = 15, min_dist: float = 0.1, rounds: int = 12, epochs: int = 12, seed: int = 27) -> DataFrame:
    """(id, x0, x1, ...): a layout in which near vectors by cosine are near, from the fuzzy union of their neighbourhoods.

    Neighbours come from ``neighbour_graph`` over unit vectors, the start from the graph's spectrum (smoothed principal components).
    Points then follow the gradient of the fuzzy cross entropy: in each round every block of near points takes ``epochs`` steps, with the rest of
    the world as the round before left it; pushes come from about 512 points that a hash draws anew each round. Rounds are few and
    each is linear in the links. Zero, null and repeated vectors: a zero vector stays zero; null ones are left out; repeats are at distance 0.
    Fewer than three vectors lie at 0. An empty table gives an empty layout.
    """
    xs = _columns(dims)
    unit = checkpoint(df.where("id is not null and v is not null").select("id", V.normalize(F.col("v")).alias("v")))
    graph, vectors = neighbour_graph(unit, neighbours, checkpoint, seed=seed)
    links = checkpoint(fuzzy_graph(graph))
    total = vectors.count()
    if total < 3:
        return vectors.select("id", *[F.lit(0.0).alias(x) for x in xs])
    size = vectors.select(F.size("v").alias("n")).first()["n"]
    start = O.pca(vectors.select("id", "v"), min(dims, size)).select("id", *[(F.col("v")[i] if i < size else F.lit(0.0)).alias(x) for i, x in enumerate(xs)])
    # A trace of noise parts equal rows and fills directions that the data lack.
    noise = lambda x: 1e-3 * ((F.pmod(F.xxhash64("id", F.lit(seed), F.lit(x)), F.lit(1 << 20)) / float(1 << 20)) - 0.5)
    start = checkpoint(start.select("id", *[(F.col(x) + noise(x)).alias(x) for x in xs]))
    at = spectral_start(links, start, dims, checkpoint)
    reach = at.agg(*[F.max(F.abs(x)).alias(x) for x in xs]).first()
    at = checkpoint(at.select("id", *[(F.col(x) * (10.0 / (reach[x] or 1.0)) + noise(x)).alias(x) for x in xs]))
    blocks = vectors.select("id", "block")
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other"), "w").union(links.select("b", "a", "w"))
    ends = checkpoint(both.join(blocks, "id"))
    own = blocks.select("block", "id", F.lit(True).alias("own"))
    away = ends.select("block", F.col("other").alias("id")).distinct().join(own, ["block", "id"], "left_anti").withColumn("own", F.lit(False))
    seen = checkpoint(own.unionByName(away))
    a, b = curve(min_dist)
    schema = "id long, " + ", ".join(f"{x} double" for x in xs)
    for r in range(rounds):
        rates = [0.7 * (1 - (r * epochs + e) / (rounds * epochs)) for e in range(epochs)]
        drawn = at.where(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(r)), F.lit(max(1, total // 512))) == 0).orderBy("id").limit(4096).collect()
        far = np.array([[p[x] for x in xs] for p in drawn]).reshape(-1, dims)
        moved = ends.groupBy("block").cogroup(seen.join(at, "id").groupBy("block")).applyInArrow(_step(far, a, b, rates, dims, seed + r, total), schema)
        at = checkpoint(moved)
    return at
