"""The mix against its closed form, and its contract."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convlens.llm import mixing as X


def filled(sizes: list[int], weights: list[float], passes: int) -> list[float]:
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > passes * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(passes * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def test_contract(spark, documents):
    rows, df = documents
    got = X.mix(df, block_words=16).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    for s, n, t in zip(names, sizes, filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)):
        assert {r["source_size"] for r in by[s]} == {n}
        assert by[s][0]["target"] == pytest.approx(t)
        assert sum(r["taken"] for r in by[s]) == round(t)
        assert all(r["taken"] <= 3 * r["size"] for r in by[s])
    again = X.mix(df.repartition(3), block_words=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([(0, 5000), (1, 2000), (2, 1000)], "source_id int, _want long")
    slots = X.schedule(targets, 10).where("slot < 400").groupBy("source_id").count().collect()
    assert {r["source_id"]: r["count"] for r in slots} == pytest.approx({0: 250, 1: 100, 2: 50}, abs=3)
    assert X.schedule(targets, 10).groupBy("source_id", "block").count().where("count > 1").count() == 0


def test_empty_and_bare(spark, documents):
    _, df = documents
    assert X.mix(df.where("false")).count() == 0
    bare = X.mix(df.where("doc_id in (3, 4)")).collect()
    assert [r["taken"] for r in bare] == [0, 0]


def slots_by_hand(wants: list[int], block: int) -> list[tuple[int, int]]:
    """(source, block) of each slot: golden-ratio points through cumulative weights, then what they did not reach."""
    blocks = [-(-w // block) for w in wants]
    used, out = [0] * len(wants), []
    for i in range(sum(blocks)):
        u = (i * X.GOLDEN % X.POINTS) / X.POINTS * sum(wants)
        s = next(k for k in range(len(wants)) if u < sum(wants[: k + 1]))
        out.append((s, used[s]) if used[s] < blocks[s] else None)
        used[s] += 1
    return out + [(s, b) for s in range(len(wants)) for b in range(used[s], blocks[s])]


def test_slots_against_a_schedule_by_hand(spark, documents):
    _, df = documents
    got = X.mix(df, block_words=16).collect()
    names = sorted({r["source"] for r in got if r["source"] is not None}) + [None]
    target = {r["source"]: r["target"] for r in got}
    slot = {x: i for i, x in enumerate(slots_by_hand([round(target[n]) for n in names], 16)) if x}
    for r in got:
        assert (r["first_slot"] is None) == (r["taken"] == 0)
        for c in r["copies"] or ():
            assert c["slot"] == slot[names.index(r["source"]), c["place"] // 16]
        assert sum(c["words"] for c in r["copies"] or ()) == r["taken"]
    # Each prefix of the mix is close to the weights.
    order = sorted(slot.items(), key=lambda x: x[1])[: len(slot) // 2]
    for k, n in enumerate(names):
        assert abs(sum(s == k for (s, _), _ in order) / len(order) - target[n] / sum(target.values())) < 0.05


def test_mixed_documents(spark, documents):
    """Rows that repeat an id or have none are told apart; the order is that of the slots."""
    rows, df = documents
    df = df.unionByName(spark.createDataFrame([(None, "one two three four", "a", "x", 1)] * 2, df.schema))
    out = X.mixed_documents(df, block_words=16)
    assert out.columns == df.columns
    want = Counter()
    for r in X.mix(df, block_words=16).collect():
        want[r["doc_id"], r["size"]] += sum(2 * c["words"] >= r["size"] for c in r["copies"] or ())
    got = out.collect()
    assert Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in got) == +want
    assert X.mixed_documents(df.where("false")).count() == 0


def test_order_of_the_mix(spark):
    df = spark.createDataFrame([(i, f"w{i} x y z", "ab"[i % 4 == 0]) for i in range(64)], "doc_id long, text string, source string")
    slot = {r["doc_id"]: r["first_slot"] for r in X.mix(df, passes=1, block_words=4).collect()}
    got = [slot[r["doc_id"]] for r in X.mixed_documents(df, passes=1, block_words=4).collect()]
    assert got == sorted(got) and len(set(got)) > 40


def test_null_order_and_weights(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "a b", "Z"), (3, "a b", "a")], "doc_id long, text string, source string")
    t = {r["source"]: r["target"] for r in X.mix(df).select("source", F.col("target")).collect()}
    assert t["Z"] > t["a"] > t[None]
