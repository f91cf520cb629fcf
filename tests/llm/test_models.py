"""Toxicity, quality and tool calls."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convlens.llm import quality as Q
from convlens.llm import toolcalls as T
from convlens.llm import toxicity as X

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        toxic, bad = i % 4 == 0, i % 5 == 0
        words = prose(1000 + i, 40 + i % 60).split()
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(["nastyword", "grimslur", "vileterm"]))
        if bad:
            words = [w + draw.choice(["$$$", "%%%", "###"]) for w in words]
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame([*rows, (9001, None, 1), (9002, "", 1), (9002, "", 1)], "doc_id long, text string, label int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("scores", "column", "bound"), [(X.toxicity_scores, "toxic", 0.7), (Q.quality_scores, "quality", 0.3)])
def test_held_out_accuracy(spark, labelled, scores, column, bound):
    docs, labels = labelled
    got = scores(docs, labels, learn_from=F.col("doc_id") % 3 != 1).select("doc_id", "score")
    assert got.count() == docs.count() and got.where("score between 0 and 1").count() == docs.count()
    rows = got.join(labels.where("doc_id % 3 = 1"), "doc_id").collect()
    assert np.mean([(r["score"] >= bound) == (r[column] == 1) for r in rows]) > 0.97


@pytest.mark.parametrize("scores", [X.toxicity_scores, Q.quality_scores])
def test_without_examples(spark, labelled, scores):
    docs, labels = labelled
    got = scores(docs, labels.where("false")).select("score").distinct().collect()
    assert len(got) == 1 and got[0]["score"] == pytest.approx(0.5)
    assert scores(docs.where("false"), labels).count() == 0


def test_index_equals_comparing_with_all():
    draw = np.random.default_rng(9)

    def vector():
        t = np.sort(draw.choice(40, draw.integers(1, 6), replace=False))
        w = draw.random(len(t))
        return t, w / np.linalg.norm(w)

    vectors = [vector() for _ in range(500)]
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    ends = np.concatenate(([0], np.cumsum([len(t) for t, _ in vectors])))
    index = X.Index(40, ends, *(np.concatenate(x) for x in zip(*vectors)), rank=np.arange(500)[::-1], block=16)
    for i in range(120):
        t, w = vector()
        q = np.zeros(40)
        q[t] = w
        cos = np.round(dense @ q, 12)
        cos[i] = 0  # left out below
        want = np.lexsort((np.arange(500)[::-1], -cos))[:10]
        want = want[cos[want] > 0]
        ids, best = index.search(t, w, 10, without=i)
        assert ids.tolist() == want.tolist() and np.allclose(best, cos[want])


def test_scores_equal_brute_force(spark, labelled):
    """All of it again, densely: counts, frequencies, weights, cosines with every example, votes and the step fit."""
    docs, labels = labelled
    docs = docs.unionByName(spark.createDataFrame([(0, "zz " * 5000, 1), (None, "nastyword here", 1), (9003, "never-seen glyphs: ¶¶ 12", 1)], docs.schema))
    got = X.toxicity_scores(docs, labels, learn_from=F.col("doc_id") % 3 != 1, examples=300).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    bags = [Counter(re.findall(r"[^\W\d_]+", t.lower())) for _, t in texts]
    hashed = labels.where("doc_id % 3 <> 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(300).collect()
    label = {r["doc_id"]: r["toxic"] for r in hashed}
    chosen = {}
    for (i, t), bag in zip(texts, bags):
        if i in label and (i not in chosen or t < chosen[i][0]):
            chosen[i] = (t, bag)
    ids = sorted(chosen)
    y = np.array([label[i] for i in ids], float)
    words = sorted({w for i in ids for w in chosen[i][1]})
    count = lambda bag: np.array([bag.get(w, 0) for w in words], float)
    sample = np.array([count(chosen[i][1]) for i in ids])
    everything = np.array([count(b) for b in bags])
    a, m, n1, n = (sample[y == 1] > 0).sum(0), (sample > 0).sum(0), y.sum(), len(y)
    table = np.array([[a, m - a], [n1 - a, n - n1 - m + a]], float)
    expected = table.sum(0, keepdims=True) * table.sum(1, keepdims=True) / n
    gain = (2 * np.where(table > 0, table * np.log(np.maximum(table, 1e-9) / expected), 0)).sum((0, 1))
    sure = np.maximum(0, gain - 7)
    weight = (np.log((len(texts) + 1) / ((everything > 0).sum(0) + 1)) + 1) * (sure / (sure + 40) + 0.02)
    unit = lambda x: (v := np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * weight) / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)

    def vote(cos):
        cos = np.round(cos, 12)
        near = [i for i in np.lexsort((np.arange(n), -cos))[:15] if cos[i] > 0]
        w = 1 / (1.05 - np.minimum(cos[near], 1))
        return (w * y[near]).sum() / w.sum() if near else None

    own = unit(sample)
    votes = []
    for i in range(n):
        cos = own @ own[i]
        cos[i] = 0
        votes.append(vote(cos) or 0.0)
    steps = X.isotonic(np.array(votes), y)
    cos = unit(everything) @ own.T
    want = {}
    for (i, t), c in zip(texts, cos):
        v = vote(c)
        want.setdefault(i, []).append((y.sum() + 0.1) / (n + 0.2) if v is None else np.interp(v, *steps))
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append(r["score"])
    assert found.keys() == want.keys()
    for i in want:
        assert np.allclose(sorted(found[i]), sorted(want[i]), atol=1e-9), i
    assert len({round(r["score"], 9) for r in got}) > 2


def test_quality_equals_a_direct_discriminant(spark, labelled):
    """Class means, shrunk covariances and log densities from the statistics of the labelled texts, without sums by parts."""
    docs, labels = labelled
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    label = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 5 <> 0").collect()}
    # Every row with doc_id % 5 = 0 is bad, so bad rows are labelled here by hand.
    label |= {i: 0 for i in range(0, 600, 10)}
    extra = spark.createDataFrame([(i, v, 0) for i, v in label.items()], labels.schema)
    got = {r["doc_id"]: r["score"] for r in Q.quality_scores(docs, extra).dropDuplicates(["doc_id"]).collect()}
    x = {i: Q.statistics(pa.array([t], pa.string()))[0] for i, t in texts.items()}
    learn = {c: np.rint(np.array([x[i] for i, v in label.items() if v == c]) * 4096) / 4096 for c in (0, 1)}
    n = {c: len(v) for c, v in learn.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in learn.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])

    def density(v, c):
        s = 0.9 * cov[c] + 0.1 * pooled
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        gap = v - learn[c].mean(0)
        return np.log(n[c]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * gap @ np.linalg.solve(s, gap)

    # The temperature: rows of one half are scored by what the other half gives.
    half = {r["doc_id"]: r["h"] for r in Q.features(docs).select("doc_id", F.pmod(F.xxhash64("x"), F.lit(2)).alias("h")).collect()}
    rounded = {i: np.rint(x[i] * 4096) / 4096 for i in label}
    every, odds = learn, {}
    for h in (0, 1):
        learn = {c: np.array([rounded[i] for i, v in label.items() if v == c and half[i] != h]) for c in (0, 1)}
        n = {c: len(v) for c, v in learn.items()}
        cov = {c: np.cov(v.T, bias=True) for c, v in learn.items()}
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        odds |= {i: density(x[i], 1) - density(x[i], 0) for i in label if half[i] == h}
    learn = every
    n = {c: len(v) for c, v in learn.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in learn.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    target = {0: 1 / (n[0] + 2), 1: (n[1] + 1) / (n[1] + 2)}
    loss = {t: sum(np.logaddexp(0, odds[i] / t) - target[v] * odds[i] / t for i, v in label.items()) for t in 10 ** np.linspace(0, 3, 61)}
    t = min(loss, key=loss.get)
    for i, v in x.items():
        want = 1 / (1 + np.exp(-(density(v, 1) - density(v, 0)) / t))
        assert got[i] == pytest.approx(want, abs=1e-6), i
    assert len(set(got.values())) > 590 and 0 < min(got.values()) and max(got.values()) < 1
    again = {r["doc_id"]: r["score"] for r in Q.quality_scores(docs.repartition(7), extra.repartition(3)).dropDuplicates(["doc_id"]).collect()}
    assert again == got


def test_isotonic_is_monotone():
    x, y = X.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all()


def test_statistics_of_odd_texts():
    x = Q.statistics(pa.array([None, "", "word", "same same same same", "$$$ %%% ###", "é ü 你 😀"]))
    assert x.shape == (6, len(Q.NAMES)) and np.isfinite(x).all()
    long = "a b " * 400_000 + "ü" * 400_000
    assert np.isfinite(Q.statistics(pa.array([long]))).all()


SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string"}}}}}


def run(spark, calls, results, schemas=SCHEMAS):
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>").withColumn("status", F.lit("clash"))
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    return T.link(c, r, schemas).orderBy("conv_id", "position").collect()


def test_links_and_order(spark):
    got = run(
        spark,
        [(1, 0, "a", "add", '{"a": 1.0}', ["c"]), (1, 2, "b", "add", '{"a": -1, "x": 2}', []), (1, 4, "c", "add", '{"b": ["x"], "a": 2}', None), (1, 6, "c", "add", "{}", []), (2, 0, "z", "other", "nope", ["q"])],
        [(1, 1, "a", "one"), (1, 3, "b", "two"), (1, 5, "c", "three"), (1, 7, "c", "late"), (2, 1, "k", "lost"), (2, 2, None, None)],
    )
    status = [(r["conv_id"], r["call_id"], r["status"]) for r in got]
    assert status == [(1, "b", "invalid_arguments"), (1, "c", "call"), (1, "a", "call"), (1, "c", "duplicate_call"), (1, "c", "duplicate_result"), (2, "z", "invalid_arguments"), (2, "k", "orphan_result"), (2, None, "orphan_result")]
    assert got[2]["json"] == '{"after":["c"],"arguments":{"a":1},"id":"a","name":"add","result":"one"}'
    assert got[0]["problems"] == ["$.a: below minimum", "$.x: not allowed"]
    assert got[5]["problems"] == ["$: not JSON", "unknown dependency q"]
    assert [r["position"] for r in got] == [0, 1, 2, 3, 4, 0, 1, 2]


def test_cycles_end(spark):
    got = run(spark, [(1, 0, "a", "add", '{"a": 1}', ["b"]), (1, 1, "b", "add", '{"a": 1}', ["a"]), (1, 2, "c", "add", '{"a": 1}', [])], [])
    assert {r["call_id"]: r["status"] for r in got}["c"] == "call" and "cyclic" in {r["status"] for r in got}


def test_topological_order(spark):
    draw = random.Random(5)
    calls = [(1, i, f"c{i}", "add", '{"a": 1}', sorted({f"c{j}" for j in draw.sample(range(12), 2) if (j * 5) % 12 < (i * 5) % 12})) for i in range(12)]
    got = run(spark, calls, [])
    place = {r["call_id"]: r["position"] for r in got}
    assert all(place[d] < place[c[2]] for c in calls for d in c[5])


def by_hand(calls, results, schemas):
    """Links one by one: the rows of ``link`` without their positions, and the places of linked calls."""
    out, first = [], {}
    for c in sorted((c for c in calls if c[0] is not None and c[2] is not None), key=lambda c: (c[0], c[2], c[1], c[3], c[4] or "")):
        first.setdefault((c[0], c[2]), c)
    answers = {}
    for r in sorted((r for r in results if r[0] is not None and r[2] is not None), key=lambda r: (r[0], r[2], r[1], r[3] or "")):
        answers.setdefault((r[0], r[2]), r)
    needs = {k: {(k[0], d) for d in c[5] or ()} & first.keys() for k, c in first.items()}

    def reach(k):
        seen, todo = set(), [k]
        while todo:
            for d in needs[todo.pop()] - seen:
                seen.add(d)
                todo.append(d)
        return seen

    on_cycle = {k for k in first if k in reach(k)}
    after_cycle = {k for k in first if reach(k) & on_cycle} | on_cycle
    place = {}

    def place_of(k):
        if k not in place:
            place[k] = max([(first[k][1], 0)] + [(place_of(d)[0], place_of(d)[1] + 1) for d in needs[k]])
        return place[k]

    for k in first.keys() - after_cycle:
        place_of(k)
    for r in results:
        k = (r[0], r[2])
        if answers.get(k) is not r or k not in first:
            out.append((r[0], r[1], r[2], "duplicate_result" if k in first else "orphan_result"))
    for c in calls:
        k = (c[0], c[2])
        if None not in k and first[k] is not c:
            out.append((c[0], c[1], c[2], "duplicate_call"))
            continue
        if k in after_cycle:
            status = "cyclic"
        else:
            try:
                bad = T.faults(json.loads(c[4]), schemas[c[3]]) if c[3] in schemas else ["unknown"]
            except (TypeError, ValueError):
                bad = ["no JSON"]
            unknown = [d for d in c[5] or () if (c[0], d) not in first]
            status = "invalid_arguments" if bad or unknown and None not in k else "call"
        out.append((c[0], c[1], c[2], status))
    return sorted(out, key=str), place


def test_links_against_brute_force(spark):
    draw = random.Random(21)
    bodies = ['{"a": 1}', '{"a": 1}', '{"a": -1}', "{", None, '{"a": 2, "b": ["x"]}']
    calls, results = [], []
    for conv in [*range(25), None]:
        names = [f"c{k}" for k in range(draw.randint(1, 7))]
        for turn in range(draw.randint(1, 9)):
            after = sorted(set(draw.choices([*names, "gone"], k=draw.choice([0, 0, 1, 2]))))
            calls.append((conv, turn, draw.choice([*names, *names, None]), draw.choice(["add", "add", "other"]), draw.choice(bodies), after))
            if draw.random() < 0.6:
                results.append((conv, turn, draw.choice([*names, "stray", None]), draw.choice(["r", None, "s"])))
    got = run(spark, calls, results)
    want, place = by_hand(calls, results, SCHEMAS)
    known = sorted(((r["conv_id"], r["turn"], r["call_id"], r["status"]) for r in got), key=str)
    settled = {"cyclic"}  # a call that only follows a cycle may count to it or not
    pairs = [(g, w) for g, w in zip(known, want)]
    assert len(known) == len(want)
    assert all(g == w or settled & {g[3], w[3]} and g[:3] == w[:3] for g, w in pairs)
    position = {(r["conv_id"], r["call_id"]): r["position"] for r in got if r["status"] in ("call", "invalid_arguments")}
    for k in place.keys() & position.keys():
        needed = [(k[0], d) for c in calls if (c[0], c[2]) == k for d in c[5]]
        first_needs = min((c for c in calls if (c[0], c[2]) == k), key=lambda c: (c[1], c[3], c[4] or ""))[5]
        assert all(position[k[0], d] < position[k] for d in first_needs if (k[0], d) in place and (k[0], d) in position), (k, needed)
    assert {r["status"] for r in got} == {"call", "invalid_arguments", "cyclic", "duplicate_call", "duplicate_result", "orphan_result"}


def test_plain_turns(spark):
    texts = [(1, 0, "system", "s"), (1, 1, "user", "q one"), (1, 2, "assistant", "x"), (1, 3, "user", None), (1, 4, "assistant", "y"), (2, 0, "assistant", "alone"), (3, 0, "other", "z")]
    texts += [(4 + i // 12, i % 12, "assistant" if i % 2 else "user", f"turn {i} of it") for i in range(96)]
    m = spark.createDataFrame(texts, "conv_id long, turn long, role string, text string")
    calls, results = T.from_turns(m)
    got = T.link(calls, results, T.TOOLS).orderBy("conv_id", "position").collect()
    assert len(got) == len(texts) - 1 + sum(1 for r in got if r["status"] in ("orphan_result", "duplicate_result")) - sum(1 for t in texts if t[2] == "assistant")
    assert {r["status"] for r in got} >= {"call", "invalid_arguments", "cyclic", "duplicate_call", "duplicate_result", "orphan_result"}
    first = [r for r in got if r["conv_id"] == 1]
    assert first[0]["call_id"] == "s:" + hashlib.md5(b"s").hexdigest()[0]
    assert [r["status"] for r in got if r["conv_id"] == 2] == ["orphan_result"]
    assert T.link(*(x.where("false") for x in (calls, results)), T.TOOLS).count() == 0


def test_canonical():
    assert T.canonical({"b": 1.0, "a": [True, None, "é"]}) == '{"a":[true,null,"é"],"b":1}'
