"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A vector is turned and cut into ``parts`` stretches; each stretch has a random code book of unit directions, and a
filter is one direction from each book. Several such codes, each with its own turn, even out what one book lacks. A vector's
score for a filter is the sum of its scores in the books, so all filters that it
exceeds are listed by decoding from the sorted partial sums without visiting the rest. Equal vectors form a class
first; the number of directions and the cap height follow the number of classes, so a filter holds about as many
vectors at every size.

Only numbers travel to the filters: the class and a sketch of 128 signs. Vectors that meet in a filter and agree in as many signs as
a pair at the threshold (less six standard deviations) does join a group; a filter with many vectors is cut into
blocks whose pairs are tasks of their own. Inside each connected group all pairs are then verified in double
precision, again in blocks, so links are exact counts and pairs are never written as rows. Vectors of different lengths do not link;
those of fewer than ``LOW`` components, which random directions tell apart badly, all meet in one filter for each
length.

Null, zero and non-finite vectors (or null components) link with nothing and are their own component. A cosine equal
to the threshold is a link. Repeated rows are classes of copies; rows repeating an id, or without one, are answered
each. Very long vectors are compared whole. Empty tables give an empty result. Only the named columns are read, so
other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.common import Scratch, claim, join_counted
from convlens.llm.groups import members_of, resolve

SIGNS = 128
LOW = 12


class Code:
    """Random product codes over ``dim`` dimensions: ``codes`` of them, each with ``parts`` books of ``size`` directions."""

    def __init__(self, dim: int, codes: int, parts: int, size: int, height: float, least: int, seed: int):
        draw = np.random.default_rng(seed)
        parts = min(parts, dim)
        self.cuts = np.linspace(0, dim, parts + 1).astype(int)
        # Random rotations spread whatever structure the dimensions have.
        self.rotations = [np.linalg.qr(draw.standard_normal((dim, dim)))[0] for _ in range(codes)]
        self.books = [[self.book(draw, size, b - a) for a, b in zip(self.cuts[:-1], self.cuts[1:])] for _ in range(codes)]
        self.size, self.height, self.least = size, height, least

    @staticmethod
    def book(draw: np.random.Generator, size: int, dim: int) -> np.ndarray:
        x = draw.standard_normal((size, dim))
        return x / np.linalg.norm(x, axis=1, keepdims=True) * math.sqrt(dim)

    def scores(self, unit: np.ndarray, code: int) -> list[np.ndarray]:
        turned = unit @ self.rotations[code].T
        return [turned[:, a:b] @ book.T for (a, b), book in zip(zip(self.cuts[:-1], self.cuts[1:]), self.books[code])]

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of the filters whose score reaches the height.

        Where a code has fewer than ``least`` of these, the height is lowered for this vector to its ``least`` best.
        """
        out: list[list[np.ndarray]] = [[] for _ in range(len(unit))]
        for code in range(len(self.books)):
            scores = self.scores(unit, code)
            half, offset = (len(scores) + 1) // 2, code * self.size ** len(scores)
            for row in range(len(unit)):
                left, right = self.sums([s[row] for s in scores[:half]]), self.sums([s[row] for s in scores[half:]])
                lo, ro = np.argsort(-left), np.argsort(-right)
                left, right = left[lo], right[ro]
                height = self.height
                fit = np.searchsorted(-right, left - height, side="right")
                if fit.sum() < self.least:
                    best = (left[: self.least, None] + right[None, : self.least]).ravel()
                    height = np.partition(best, max(0, len(best) - self.least))[max(0, len(best) - self.least)]
                    fit = np.searchsorted(-right, left - height + 1e-12, side="right")
                a = np.repeat(lo, fit)
                b = ro[np.arange(fit.sum()) - np.repeat(np.cumsum(fit) - fit, fit)]
                out[row].append(offset + a * len(right) + b)
        return [np.sort(np.concatenate(x)) for x in out]

    @staticmethod
    def sums(parts: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(1)
        for p in parts:
            total = (total[:, None] + p[None]).ravel()
        return total


def joint(height: float, cosine: float) -> float:
    """Chance that two vectors at this cosine both exceed a direction."""
    x = np.linspace(height, height + 8, 4001)
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    above = 0.5 * np.array([math.erfc((height - cosine * t) / math.sqrt(2 * (1 - cosine * cosine))) for t in x])
    return float(np.trapezoid(density * above, x))


def plan(n: int, cosine: float, per_filter: float, wanted: float, codes: int, parts: int) -> tuple[int, float]:
    """(directions a book, cap height): filters of about ``per_filter`` vectors, ``wanted`` of them shared by a pair."""
    height = NormalDist().inv_cdf(1 - min(0.05, per_filter / max(n, 1)))
    return max(2, math.ceil((wanted / codes / joint(height, cosine)) ** (1 / parts))), height


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, key): v in doubles and the hash of its bytes; both null for a vector that cannot link."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    v = F.when(~F.coalesce(bad, F.lit(True)), v)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256))


def sketch(unit: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Two numbers for each vector: its signs along SIGNS random directions."""
    planes = np.random.default_rng([seed, dim]).standard_normal((dim, SIGNS))
    return np.packbits(unit @ planes > 0, axis=1).view(np.int64)


def meeting(table: pa.Table, most: int) -> pa.Table:
    """Of one task: for each vector one other that it is connected with by sketches that differ in ``most`` signs at most."""
    order = pa.compute.sort_indices(table, [("dim", "ascending"), ("filter", "ascending"), ("cid", "ascending")])
    table = table.take(order)
    dim, node, cid, side, s0, s1 = (table.column(c).to_numpy() for c in ("dim", "filter", "cid", "side", "s0", "s1"))
    s0, s1 = s0.view(np.uint64), s1.view(np.uint64)  # of negative numbers the bits of the absolute value would be counted
    lone = table.column("lone").to_numpy(zero_copy_only=False)
    new = np.append(True, (node[1:] != node[:-1]) | (dim[1:] != dim[:-1]))
    last = np.append(np.flatnonzero(new)[1:], len(node))[np.cumsum(new) - 1]
    left, right = [], []
    # Each vector with the next, the one after it and so on, for all filters of the task at once.
    at, step = np.arange(len(node)), 1
    while len(at := at[at + step < last[at]]):
        other = at + step
        apart = np.bitwise_count(s0[at] ^ s0[other]).astype(np.int64) + np.bitwise_count(s1[at] ^ s1[other])
        near = (apart <= most) & (lone[at] | (side[at] != side[other]))
        left.append(at[near])
        right.append(other[near])
        step += 1
    root = cid.copy()
    if left:
        # Rows of one class in several filters count as one.
        _, own = np.unique(cid, return_inverse=True)
        a, b = own[np.concatenate(left)], own[np.concatenate(right)]
        least = np.unique(cid)
        while True:
            before = least.copy()
            low = np.minimum(least[a], least[b])
            np.minimum.at(least, a, low)
            np.minimum.at(least, b, low)
            if (before == least).all():
                break
        root = least[own]
    edges = np.unique(np.stack([cid, root], 1)[cid != root], axis=0)
    return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})


def cosines(cosine: float):
    def run(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a, b = (np.array([np.frombuffer(x) for x in side]) for side in (left, right))
        # In one order of summation for both directions and all blocks.
        return np.einsum("ik,jk->ij", a, b) >= cosine if a.shape[1] == b.shape[1] else np.zeros((len(a), len(b)), bool)

    return run


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, key): v in doubles and the hash of its bytes; both null for a vector that cannot link."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    v = F.when(~F.coalesce(bad, F.lit(True)), v)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256))


def near_duplicates(
    vectors: DataFrame,
    *,
    cosine: float = 0.95,
    per_filter: float = 8.0,
    wanted: float = 9.0,
    least: int = 4,
    codes: int = 4,
    parts: int = 2,
    block: int = 512,
    seed: int = 6,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id)."""
    scratch = scratch or Scratch(vectors.sparkSession, "caps")
    rows = scratch.put(clean(vectors, id_col, vector_col), "rows")
    usable = rows.where("key is not null")
    classes = usable.groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n_docs"), F.first("v").alias("v"))
    classes = scratch.put(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    size, height = plan(classes.count(), cosine, per_filter, wanted, codes, parts)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("caps")
        known: dict[int, Code] = {}
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column("v")).to_numpy()
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = x / np.abs(x).max(1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                if dim < LOW:
                    lists = [[0]] * len(unit)
                else:
                    known[dim] = known.get(dim) or Code(dim, codes, parts, size, height, least, seed)
                    lists = known[dim].filters(unit)
                signs = sketch(unit, dim, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("cid"), pa.array([dim] * len(unit), pa.int32()), pa.array([u.tobytes() for u in unit], pa.binary()),
                        pa.array(signs[:, 0]), pa.array(signs[:, 1]), pa.array(lists, pa.list_(pa.int64())),
                    ],
                    ["cid", "dim", "body", "s0", "s1", "filters"],
                )

    decoded = classes.select("cid", "v").mapInArrow(decode, "cid long, dim int, body binary, s0 long, s1 long, filters array<long>")
    decoded = scratch.put(decoded, "decoded")
    held = decoded.select("dim", F.explode("filters").alias("filter")).groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    held = scratch.put(held.withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")), "held")
    total = held.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    met = join_counted(decoded.select("cid", "dim", "s0", "s1", F.explode("filters").alias("filter")), held, ["dim", "filter"], total)
    met = met.withColumn("_own", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    one = F.col("_blocks") == 1
    dealt = met.select(
        "dim", "filter", "cid", "s0", "s1",
        (F.col("_own") > F.col("_other")).cast("int").alias("side"), (F.col("_own") == F.col("_other")).alias("lone"),
        F.when(one, F.pmod(F.xxhash64("dim", "filter"), F.lit(total // 4096 + 1))).otherwise(F.xxhash64("dim", "filter")).alias("_task"), one.alias("_one"),
        F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
    )
    turn = math.acos(cosine) / math.pi
    most = math.ceil(SIGNS * turn + 6 * math.sqrt(SIGNS * turn * (1 - turn)))
    edges = dealt.groupBy("_one", "_task", "_i", "_j").applyInArrow(lambda t: meeting(t, most), "a long, b long")
    edges = scratch.put(edges.distinct(), "edges")
    members = members_of(classes.select("key", "cid", "least", "n_docs"), edges, scratch)
    bodies = decoded.select("cid", "body").join(members.select("cid", "group"), "cid")
    answers = resolve(classes, members, bodies, cosines(cosine), scratch, block)
    n = answers.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    good = join_counted(usable.select("vec_id", "key"), answers.select("key", "class_id", "n_links", "_n"), ["key"], n)
    good = good.select("vec_id", "n_links", F.col("class_id").alias("component_id"))
    return good.unionByName(rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
