"""Exact duplicates against a dictionary of texts, whatever collides."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlens.llm import exact
from convlens.llm.common import Scratch

from .conftest import prose


def expected(rows):
    """Sorted (doc_id, keep_id, group_size, sha256) of every row."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[low(t)], len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows), key=str)


def got(df):
    rows = df.collect()
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str), rows


TEXTS = ["Some Text", "some text", "SOME TEXT ", "É", "é", "", None, "a", "b", "A", "x" * 100_000, "X" + "x" * 99_999, prose(3, 4000)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a"), (None, "only null"), (None, "ONLY null"), (7, "a"), (7, "a"), (100, "hot")] + [(200 + i, "Hot") for i in range(300)]


@pytest.mark.parametrize("bits", [64, 5, 0])
def test_against_a_dictionary(spark, bits):
    """With few bits many texts share a key: chains give the same answers."""
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in ROWS], "doc_id long, text string, key int, chain string, n int").repartition(5)
    have, rows = got(exact.duplicates(docs, Scratch(spark, "test-exact"), capacity=2, key_bits=bits))
    assert have == expected(ROWS)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in rows}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.duplicates(docs, Scratch(spark, "test-exact")).count() == 0


def test_buckets_split_while_too_full():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    found = [b for p in range(8) for b in exact.split(keys[(keys >> np.uint64(61)) == p], 3, p, 100)]
    assert sum(n for _, _, n in found) == 5000 and max(n for _, _, n in found) <= 100
    for depth, prefix, n in found:
        assert np.count_nonzero(keys >> np.uint64(64 - depth) == np.uint64(prefix)) == n
        sibling = next((m for d, p, m in found if d == depth and p == prefix ^ 1), None)
        assert depth == 3 or sibling is None or n + sibling > 100
    same = np.full(5, 9, np.uint64)
    assert max(d for d, _, _ in exact.split(same, 1, 0, 2)) == 64


def test_adding_is_building_at_once(spark):
    """An index grown in steps has the entries and buckets of one built from all rows; ranges without new rows are not written again."""
    rows = [(i, f"text {i % 400}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keep = F.struct(F.lit(1).alias("known"), "doc_id", F.col("doc_id").alias("row"))
    every = docs.select(exact.key_of(exact.normal("text")).alias("key"), exact.normal("text").alias("text"), keep.alias("keep"), F.lit(1).cast("long").alias("n"), "doc_id")
    whole = exact.build(every.drop("doc_id"), 900, Scratch(spark, "test-exact"), capacity=16)
    grown = exact.build(every.where("doc_id < 500").drop("doc_id"), 500, Scratch(spark, "test-exact"), capacity=16)
    grown.add(every.where("doc_id >= 500 and doc_id < 502").drop("doc_id"))
    assert grown.live.where("generation = 1").count() >= 6
    grown.add(every.where("doc_id >= 502").drop("doc_id"))
    view = lambda df: sorted(map(str, df.collect()))
    assert view(grown.entries().select("key", "text", "keep", "n", "chain")) == view(whole.entries().select("key", "text", "keep", "n", "chain"))
    assert view(grown.directory) == view(whole.directory) and grown.depth() == whole.depth() > 4
