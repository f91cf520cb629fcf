"""Join of documents on the Jaccard similarity of their word n-grams: a MinHash LSH forest and exact verification.

Documents with equal n-gram sets form a class. Each class has a label in every tree of the forest: ``LEVELS`` MinHash
values of one byte each, packed in order into one number, so the sorted labels of a tree are its trie and the top bytes of a
label are its prefix at that depth. Whole labels are matched first; the similarities of the pairs found there, each
taken as often as pairs like it are missed at that depth, tell what share of all links each shorter prefix would
find, and prefixes are shortened until that share reaches ``recall``. Where none is found, the depth is that for pairs at the threshold.

Classes that meet at a node of that depth are joined to the node's first class where their labels agree often enough
to be similar (at 256 values, a similar pair fails with a chance of about 1e-9); those that do not are compared with
all of the node, in blocks. So chance meetings join no groups. Inside each connected group all pairs are then verified
exactly: a large group is cut into blocks, each pair of blocks is one task, and a task counts shared n-grams of whole
blocks by products of incidence matrices, so pairs are never written as rows. Links are counted exactly; copies are
counted through the number of documents of their class.

Words are what white space separates. A text of one to n - 1 words has one n-gram, all of it. Texts without words,
null or empty, link with nothing and are their own class. Very long texts are read whole. Rows that repeat a text are
linked with each other; rows that repeat an id, or have none, are answered each by their own text. Similarity equal to
the threshold is a link; of equal least ids any row stands for the class. An empty table gives an empty result. Only
the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.common import Scratch, claim, collect_garbage, components, join_counted, pieces_of, split_words, trim
from convlens.llm.groups import members_of, resolve

BUCKETS = 1 << 18
#: Values of a label; one byte each in a number of 64 bits.
LEVELS = 8


def met(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """Chance that a pair shares a prefix of this length in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(found: dict[int, int], threshold: float, trees: int, recall: float) -> int:
    """The longest prefix with which the forest finds ``recall`` of all links.

    ``found`` has the pairs that share a whole label by the number of values (of trees * LEVELS) in which they agree.
    Each stands for 1 / met(...) pairs; those somewhat under the threshold count too, as the number is an estimate.
    """
    agree = np.array(sorted(found), float) / (trees * LEVELS)
    pairs = np.array([found[k] for k in sorted(found)], float)
    links = agree >= threshold - 0.05
    similarity = np.maximum(agree[links], threshold) if links.any() else np.array([threshold])
    all_pairs = pairs[links] / met(similarity, LEVELS, trees) if links.any() else np.ones(1)
    depth = LEVELS
    while depth > 1 and (all_pairs * met(similarity, depth, trees)).sum() < recall * all_pairs.sum():
        depth -= 1
    return depth


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams."""
    codes, offsets, words = split_words(texts)
    by_word = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words] or [0], np.uint64)
    own = by_word[codes] if len(codes) else np.zeros(0, np.uint64)
    step, out = np.uint64(0x9E3779B97F4A7C15), []

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    grams = np.zeros(max(0, len(own) - n + 1), np.uint64)
    for k in range(n):
        grams = grams * step + own[k : k + len(grams)]
    grams = mixed(grams)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in own[a:b]:
                h = h * step + w
            out.append(mixed(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def signatures(docs: DataFrame, *, n: int, trees: int, seed: int, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """(doc_id, hash, row, key, labels): hash of the text, key of the n-gram set (null without words), label per tree."""
    draw = np.random.default_rng(seed)
    factors = draw.integers(0, 1 << 63, trees * LEVELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def labels(sets: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(s) for s in sets])
        mins = np.empty((trees * LEVELS, len(sets)), np.uint64)
        begin = 0
        while begin < len(sets):  # runs that stay in cache
            end, total = begin, 0
            while end < len(sets) and (end == begin or total + sizes[end] <= 32768):
                total, end = total + sizes[end], end + 1
            x, starts = np.concatenate(sets[begin:end]), np.cumsum(sizes[begin:end]) - sizes[begin:end]
            for k, f in enumerate(factors):
                mins[k, begin:end] = np.minimum.reduceat(x * f, starts)
            begin = end
        short = ((mins ^ (mins >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(56)
        out = np.zeros((trees, len(sets)), np.uint64)
        for k in range(LEVELS):
            out = out << np.uint64(8) | short[k::LEVELS]
        return out.view(np.int64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        for whole in batches:
            for batch in pieces_of(whole, "text", 2_000_000):
                sets = shingle_sets(batch.column("text"), n)
                some = np.array([len(s) > 0 for s in sets], bool)
                found = labels([s for s in sets if len(s)]) if some.any() else np.zeros((0, trees), np.int64)
                ends = np.concatenate(([0], np.cumsum(np.where(some, trees, 0))))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "hash", "row")), pa.array([set_key(s) for s in sets], pa.binary()), lists],
                    ["doc_id", "hash", "row", "key", "labels"],
                )
        trim()

    row = F.col(row_col) if row_col else F.lit(None)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), row.cast("long").alias("row"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, hash long, row long, key binary, labels array<long>")


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, agree): in how many values the labels of two classes agree."""
    for batch in batches:
        left, right = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("left", "right"))
        same = (left ^ right).view(np.uint8) == 0
        agree = same.reshape(batch.num_rows, -1).sum(1) if batch.num_rows else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(agree, pa.int32())], ["a", "b", "agree"])


def compare_node(table: pa.Table, least: int) -> pa.Table:
    """Of one task: for the rows marked ``alone`` of each node, one class of all that they agree with in ``least`` values."""
    nodes = list(zip(*(table.column(c).to_pylist() for c in ("tree", "prefix", "_i", "_j"))))
    cid, alone = table.column("cid").to_numpy(), table.column("alone").to_numpy(zero_copy_only=False)
    values = table.column("labels").combine_chunks().flatten().to_numpy().view(np.uint8).reshape(len(cid), -1)
    by: dict[tuple, list[int]] = {}
    for i, node in enumerate(nodes):
        by.setdefault(node, []).append(i)
    out: set[tuple[int, int]] = set()
    for rows in by.values():
        every = np.array(rows)
        root = {int(c): int(c) for c in cid[every]}

        def top(c: int, root: dict[int, int] = root) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i in every[alone[every]]:
            for c in cid[every[(values[every] == values[i]).sum(1) >= least]].tolist():
                low, high = sorted((top(c), top(int(cid[i]))))
                root[high] = low
        out.update((c, top(c)) for c in root if top(c) != c)
    a, b = zip(*sorted(out)) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def candidate_edges(classes: DataFrame, scratch: Scratch, *, threshold: float, trees: int, recall: float, block: int) -> DataFrame:
    """Edges (a, b) between class numbers whose connected groups hold every link that the forest finds."""
    labels = classes.select("cid", "labels")
    entries = labels.select("cid", F.posexplode("labels").alias("tree", "label"))
    # Lower than the threshold by six standard deviations of the share of agreeing values.
    least = int(trees * LEVELS * (threshold - 6 * (threshold * (1 - threshold) / (trees * LEVELS)) ** 0.5))

    def stars(depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows in nodes with company, nodes, pairs of a class and its node's first with their agreement)."""
        rows = entries.select("cid", "tree", F.shiftrightunsigned("label", 64 - 8 * depth).alias("prefix"))
        nodes = rows.groupBy("tree", "prefix").agg(F.min("cid").alias("root"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        nodes = scratch.put(nodes, f"nodes-{depth}")
        total = nodes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        rows = join_counted(rows, nodes, ["tree", "prefix"], total)
        pairs = rows.where("cid != root").select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct()
        company = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_n"))
        right = labels.select(F.col("cid").alias("b"), F.col("labels").alias("right")).join(company, "b")
        both = pairs.join(labels.select(F.col("cid").alias("a"), F.col("labels").alias("left")), "a")
        both = join_counted(both, right, ["b"], total, spread=["a"]).select("a", "b", "left", "right")
        return rows, nodes, scratch.put(both.mapInArrow(agreeing, "a long, b long, agree int"), f"stars-{depth}")

    rows, nodes, pairs = stars(LEVELS)
    found = {r["agree"]: r["n"] for r in pairs.groupBy("agree").agg(F.count(F.lit(1)).alias("n")).collect()}
    depth = prefix_length(found, threshold, trees, recall)
    if depth < LEVELS:
        rows, nodes, pairs = stars(depth)
    edges = pairs.where(F.col("agree") >= least).select("a", "b")
    apart = pairs.where(F.col("agree") < least).select(F.col("a").alias("cid"), F.col("b").alias("root"))
    several = nodes.where("_n > 2").withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")).drop("root", "_n")
    alone = rows.join(apart, ["cid", "root"]).select("cid", "tree", "prefix").join(several, ["tree", "prefix"])
    alone = scratch.put(alone, "alone")
    crowds = alone.groupBy("tree", "prefix").agg(F.first("_blocks").alias("_blocks"), F.lit(1).alias("_n"))
    others = rows.select("cid", "tree", "prefix").join(crowds.drop("_n"), ["tree", "prefix"])
    own, each = F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = others.select("*", own.alias("_i"), F.lit(False).alias("alone")).select("*", each.alias("_j"))
    dealt = dealt.unionByName(alone.select("*", own.alias("_j"), F.lit(True).alias("alone")).select("*", each.alias("_i")))
    one = F.col("_blocks") == 1
    tasks = alone.count() // block + 1
    dealt = dealt.withColumn("_task", F.when(one, F.pmod(F.xxhash64("tree", "prefix"), F.lit(tasks))).otherwise(F.xxhash64("tree", "prefix"))).join(labels, "cid")
    more = dealt.groupBy(one.alias("_one"), "_task", "_i", "_j").applyInArrow(lambda t: compare_node(t, least), "a long, b long")
    return scratch.put(edges.unionByName(more).distinct(), "edges")


def candidate_sets(docs: DataFrame, members: DataFrame, *, n: int, id_col: str, text_col: str) -> DataFrame:
    """The n-gram sets of the classes in ``members``, from the texts of their first documents."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    wanted = members.select(bucket(F.col("hash")).alias("_b")).distinct()
    # At most BUCKETS numbers: keeps most other texts out of the shuffle.
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")).withColumn("_b", bucket(F.col("hash")))
    texts = texts.join(F.broadcast(wanted), "_b", "left_semi").drop("_b")
    texts = texts.join(members.select("doc_id", "hash", "cid", "key", "group"), (texts["hash"] == members["hash"]) & texts["_id"].eqNullSafe(members["doc_id"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        for whole in batches:
            for batch in pieces_of(whole, "text", 2_000_000):
                sets = shingle_sets(batch.column("text"), n)
                right = [k == set_key(s) for k, s in zip(batch.column("key").to_pylist(), sets)]
                out = pa.RecordBatch.from_arrays(
                    [batch.column("cid"), batch.column("group"), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "group", "grams"]
                )
                yield out.filter(pa.array(right, pa.bool_()))
        trim()

    return texts.select("cid", "key", "group", "text").mapInArrow(run, "cid long, group long, grams binary").dropDuplicates(["cid"])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements for all pairs of two lists of sets; exact below 2**24."""
    both = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    values, place, times = np.unique(both, return_inverse=True, return_counts=True)
    several = times > 1
    column = np.cumsum(several) - 1
    keep = several[place]
    owner, place, width = owner[keep], column[place[keep]], int(several.sum())
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(left), len(right)))
    for a in range(0, width, 4096):
        i, j = np.searchsorted(place, (a, a + 4096))
        x = np.zeros((len(left) + len(right), min(4096, width - a)), np.float32)
        x[owner[i:j], place[i:j] - a] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out


def similar_sets(threshold: float):
    """Which pairs of two lists of n-gram sets are linked."""

    def run(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a, b = ([np.frombuffer(x, np.uint64) for x in side] for side in (left, right))
        shared = shared_counts(a, b)
        union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None] - shared
        return shared / union >= threshold

    return run


def linked(
    docs: DataFrame,
    *,
    n: int = 5,
    threshold: float = 0.8,
    trees: int = 32,
    recall: float = 0.9999,
    block: int = 256,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document: (doc_id, row, group, class_id, n_links).

    ``row`` is the number in ``row_col``. ``group`` numbers the documents that links lead to (null without words),
    class_id is the least id among them.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    signed = scratch.put(signatures(docs, n=n, trees=trees, seed=seed, id_col=id_col, text_col=text_col, row_col=row_col), "signed")
    worded = signed.where(F.col("key").isNotNull())
    first = F.min(F.struct("doc_id", "hash", "labels"))
    classes = worded.groupBy("key").agg(first.alias("f"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_docs"))
    classes = classes.select("key", F.monotonically_increasing_id().alias("cid"), "f.doc_id", "f.hash", "f.labels", "least", "n_docs")
    classes = scratch.put(classes, "classes")

    edges = candidate_edges(classes, scratch, threshold=threshold, trees=trees, recall=recall, block=4 * block)
    collect_garbage(docs.sparkSession)
    members = members_of(classes.drop("labels"), edges, scratch)
    sets = candidate_sets(docs, members, n=n, id_col=id_col, text_col=text_col)
    answers = resolve(classes, members, sets.withColumnRenamed("grams", "body"), similar_sets(threshold), scratch, block)
    total = answers.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    out = ["doc_id", "row", "group", "class_id", "n_links"]
    rows = join_counted(worded.select("doc_id", "row", "key"), answers, ["key"], total).select(*out)
    bare = signed.where(F.col("key").isNull()).select("doc_id", "row", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.unionByName(bare)


def similar(docs: DataFrame, **options) -> DataFrame:
    """One row per document: (doc_id, class_id, n_links). class_id is the least id that links lead to."""
    return linked(docs, **options).select("doc_id", "class_id", "n_links")
