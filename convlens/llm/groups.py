"""Links inside groups of classes that may be linked, counted exactly without writing pairs.

A class stands for rows that are equal: (key, cid: its number, least: their least id, n_docs: how many they are).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.common import Scratch, components, join_counted

Linked = Callable[[list[bytes], list[bytes]], np.ndarray]


def roots_of(linked: np.ndarray) -> np.ndarray:
    """Least index reachable from each index over a symmetric boolean matrix."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            todo, root[i] = [i], i
            while todo:
                new = np.flatnonzero(linked[todo].any(0) & (root < 0))
                root[new] = i
                todo = new.tolist()
    return root


def verify(table: pa.Table, linked: Linked) -> pa.Table:
    """Of one task: weighted number of links of each class and one class that all it is connected with in this task share."""
    by: dict[int, list[int]] = {}
    for i, g in enumerate(table.column("group").to_pylist()):
        by.setdefault(g, []).append(i)
    keys, weights, sides, whole, bodies = (table.column(c).to_pylist() for c in ("cid", "n_docs", "side", "lone", "body"))
    out: list[tuple] = []
    for rows in by.values():
        rows = sorted(rows, key=lambda i: keys[i])
        left = [i for i in rows if sides[i] == 0]
        right = left if whole[rows[0]] else [i for i in rows if sides[i] == 1]
        if not left or not right:
            continue
        found = linked([bodies[i] for i in left], [bodies[i] for i in right])
        wl, wr = np.array([weights[i] for i in left]), np.array([weights[i] for i in right])
        if right is left:
            np.fill_diagonal(found, False)
            root = roots_of(found)
            out += [(keys[i], int(c), keys[left[r]]) for i, c, r in zip(left, found @ wr, root)]
        else:
            m = len(left)
            full = np.zeros((m + len(right),) * 2, bool)
            full[:m, m:], full[m:, :m] = found, found.T
            own, root = left + right, roots_of(full)
            counts = np.concatenate((found @ wr, wl @ found))
            out += [(keys[i], int(c), keys[own[r]]) for i, c, r in zip(own, counts, root)]
    k, c, r = zip(*out) if out else ((), (), ())
    return pa.table({"cid": pa.array(k, pa.int64()), "links": pa.array(c, pa.int64()), "root": pa.array(r, pa.int64())})


def members_of(classes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The classes that edges (a, b) reach, with the number of their connected group."""
    reached = components(edges, scratch, "candidates")
    groups = scratch.put(reached.select(F.col("node").alias("cid"), F.col("root").alias("group")).union(reached.select("root", "root").distinct()), "groups")
    return scratch.put(classes.join(groups, "cid"), "members")


def resolve(classes: DataFrame, members: DataFrame, bodies: DataFrame, linked: Linked, scratch: Scratch, block: int) -> DataFrame:
    """(key, group, class_id, n_links, _n) for each class, from the ``bodies(cid, group, body)`` of the members.

    All pairs of a group are compared. A large group is cut into blocks, and each pair of blocks is a task of its own.
    """
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("_size"), F.count(F.lit(1)).alias("_n"))
    few = members.count()
    sized = join_counted(bodies.join(members.select("cid", "n_docs"), "cid"), sizes, ["group"], few, spread=["cid"])
    one = F.col("_blocks") == 1
    cut = sized.withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int"))
    cut = cut.withColumn("_own", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = cut.select(
        "cid", "group", "body", "n_docs",
        (F.col("_own") > F.col("_other")).cast("int").alias("side"),
        (F.col("_own") == F.col("_other")).alias("lone"),
        F.when(one, F.pmod(F.xxhash64("group"), F.lit(few // block + 1))).otherwise(F.xxhash64("group")).alias("_task"),
        F.when(one, 0).otherwise(F.least("_own", "_other")).alias("_i"),
        F.when(one, 0).otherwise(F.greatest("_own", "_other")).alias("_j"),
        one.alias("_one"),
    )
    found = dealt.groupBy("_one", "_task", "_i", "_j").applyInArrow(lambda t: verify(t, linked), "cid long, links long, root long")
    found = scratch.put(found, "found")
    joined = components(found.where("cid != root").select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch, "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    ends = classes.select("key", "cid", "least", "n_docs").join(joined.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ends = scratch.put(ends.join(links, "cid", "left"), "ends")
    least = ends.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    answers = join_counted(ends, least, ["root"], ends.count())
    answers = answers.select("key", F.col("root").alias("group"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"), F.col("n_docs").alias("_n"))
    return scratch.put(answers, "answers")
