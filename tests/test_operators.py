"""Operators on small tables: invariants, ties, empty input."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convlens.functions import vectors as V
from convlens.operators import conversations as C
from convlens.operators import insight as I
from convlens.operators import metrics as M
from convlens.operators import vectors as X
from convlens.session import checkpointed
from convlens.sources import readers as R

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def messages(spark, convs):
    rows = [(i, t, r, x) for i, c in enumerate(convs) for t, (r, x) in enumerate(c)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


NORMAL = [("user", "Hello, I have a question"), ("assistant", "Please ask it"), ("user", "How do I do this?"), ("assistant", "Like so")]


def test_dedup_keeps_first(spark):
    nested = C.nest(messages(spark, [NORMAL, NORMAL[:2], NORMAL]))
    assert sorted(r["conv_id"] for r in C.first_by(nested, F.md5(F.col("text").cast("binary")), "conv_id").collect()) == [0, 1]


def test_format_issues(spark):
    got = C.format_issues(messages(spark, [NORMAL, [("user", "only one here")], [("user", "a"), ("user", "b")]])).collect()
    assert {(r["conv_id"], r["issue_type"]) for r in got} == {(1, "too_short"), (1, "missing_role"), (2, "missing_role"), (2, "invalid_format")}


@QUICK
@given(st.lists(st.integers(0, 50), max_size=30), st.integers(1, 60))
def test_budget_batches(spark, sizes, budget):
    df = spark.createDataFrame(list(enumerate(sizes)), "conv_id long, tokens long")
    got = sorted((r["conv_id"], r["batch"]) for r in C.batches_by_budget(df, budget).collect())
    assert [i for i, _ in got] == list(range(len(sizes)))
    total = {}
    for (i, b) in got:
        total.setdefault(b, []).append(sizes[i])
    assert sorted(total) == list(range(len(total)))
    assert all(sum(v) <= budget or len(v) == 1 or sum(v[:-1]) == 0 or sum(v) - v[-1] <= budget for v in total.values())


@pytest.mark.parametrize("size", [1, 7, 250, 300])
def test_fixed_batches(spark, size):
    got = C.batches_fixed(spark.range(250).withColumnRenamed("id", "conv_id"), size)
    assert got.select("batch").distinct().count() == -(-250 // size)


def test_truncation_keeps_ends(spark):
    m = messages(spark, [[("user", f"word {i} more words here") for i in range(10)]])
    kept = [r["turn"] for r in C.flatten(C.truncate_middle(C.nest(m), C.tokens(m), 20)).orderBy("turn").collect()]
    assert kept == [0, 1, 8, 9]


def test_privacy_filter(spark):
    small = spark.createDataFrame([("Large Cluster", 15), ("a", 2), ("b", 3)], "name string, size long")
    assert {tuple(r) for r in I.privacy_filter(small, 5).collect()} == {("Large Cluster", 15, 1), ("merged_small_clusters", 5, 2)}
    tiny = spark.createDataFrame([("x", 5), ("y", 2), ("z", 13)], "name string, size long")
    assert {r["name"] for r in I.privacy_filter(tiny, 5).collect()} == {"x", "z"}


@QUICK
@given(st.lists(st.floats(-1e30, 1e30), min_size=1, max_size=8))
def test_normalized_vectors(spark, v):
    got = spark.createDataFrame([(v,)], "v array<double>").select(V.normalize(F.col("v")).alias("n")).first()["n"]
    size = np.linalg.norm(got)
    assert size == 0 if not any(v) else abs(size - 1) < 1e-5


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")


def test_kmeans_edges(spark):
    assert X.kmeans(vectors(spark, []), 3).count() == 0
    assert [r["label"] for r in X.kmeans(vectors(spark, [[1, 2]]), 3, starts=1).collect()] == [0]
    labels = {r["id"]: r["label"] for r in X.kmeans(vectors(spark, [[0, 0], [0, 1], [9, 9], [9, 8]]), 2, starts=2).collect()}
    assert labels == {0: 0, 1: 0, 2: 1, 3: 1}


def test_ward_splits_far_groups(spark):
    labels = {r["id"]: r["label"] for r in X.ward(vectors(spark, [[0, 0], [9, 9], [0, 1], [9, 8]]), 2).collect()}
    assert labels == {0: 0, 2: 0, 1: 1, 3: 1}


def test_ward_beyond_4000_rows(spark):
    # By the halves of bisecting k-means the wide middle group would be cut; labels follow the least id.
    draw = np.random.default_rng(4)
    place = np.repeat([[0.0, 0], [6, 0], [13, 0]], [1400, 1400, 1400], axis=0)[draw.permutation(4200)]
    labels = [r["label"] for r in X.ward(vectors(spark, place + draw.normal(size=(4200, 2)) * 0.1), 3).orderBy("id").collect()]
    _, first, group = np.unique(place[:, 0], return_index=True, return_inverse=True)
    assert labels == list(np.argsort(np.argsort(first))[group])


@pytest.mark.parametrize("n", [2, 3, 40])
def test_merges_are_least_ward_steps(n):
    x = np.random.default_rng(n).normal(size=(n, 3))
    groups = {i: [i] for i in range(n)}
    for s, (a, b, height) in enumerate(X.merges(x)):
        cost = {(i, j): 2 * len(p) * len(q) / (len(p) + len(q)) * ((x[p].mean(0) - x[q].mean(0)) ** 2).sum() for i, p in groups.items() for j, q in groups.items() if i < j}
        least = min(cost, key=cost.get)
        assert {a, b} == set(least) and height == pytest.approx(cost[least] ** 0.5)
        groups[n + s] = groups.pop(a) + groups.pop(b)
    assert len(groups) == 1


@pytest.mark.parametrize("kind", ["copies", "far", "near", "bits"])
def test_merges_of_copies_and_near_copies(kind):
    draw = np.random.default_rng(8)
    x = {
        "copies": np.repeat(draw.normal(size=(5, 3)), 8, axis=0), "far": draw.normal(size=(40, 3)) * 1e-6 + 1e6 * (np.arange(40)[:, None] % 2),
        "near": np.repeat(draw.normal(size=(5, 3)), 8, axis=0) + 1e-5 * draw.normal(size=(40, 3)), "bits": draw.integers(0, 2, size=(40, 6)) * 1.0,
    }[kind]
    groups = {i: [i] for i in range(len(x))}
    for s, (a, b, height) in enumerate(X.merges(x)):
        cost = {(i, j): 2 * len(p) * len(q) / (len(p) + len(q)) * ((x[p].mean(0) - x[q].mean(0)) ** 2).sum() for i, p in groups.items() for j, q in groups.items() if i < j}
        room = 1e-18 * (1 + np.abs(x).max() ** 2)
        assert cost[min(a, b), max(a, b)] <= min(cost.values()) * (1 + 1e-6) + room and height**2 == pytest.approx(cost[min(a, b), max(a, b)], rel=1e-4, abs=room)
        groups[len(x) + s] = groups.pop(a) + groups.pop(b)
    assert len(groups) == 1


def test_merges_search_few_times(monkeypatch):
    # One search for each cluster and merge, many at once: products of matrices, not a pass over all rows for each step.
    calls, product = [], np.matmul
    monkeypatch.setattr(X.np, "matmul", lambda a, b, **how: calls.append(len(a)) or product(a, b, **how))
    tree = X.merges(np.random.default_rng(9).normal(size=(3000, 16)))
    assert len(tree) == 2999 and 0 < len(calls) < 600 and sum(calls) < 4 * 3000


def test_force_layout_sends_places_once(spark):
    plans = []

    def keep(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpointed(df)

    X.force_layout(keep(vectors(spark, np.random.default_rng(3).normal(size=(30, 3)).tolist())), keep, neighbours=3, rounds=1)
    assert "ReusedExchange" in plans[-1].partition("== Initial Plan ==")[0]


def test_hierarchy_keeps_all_clusters(spark):
    x = np.random.default_rng(5).normal(size=(4100, 2))
    cents = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "c int, centroid array<double>")
    got = {r["node"]: r for r in X.hierarchy(cents, "c").collect()}
    assert len(got) == 2 * 4100 - 1 and all(f"cluster_{i}" in got for i in range(4100))
    assert [r["node"] for r in got.values() if r["parent"] is None] == ["internal_4098"]
    assert all(r["parent"] is None and r["level"] == 0 or r["level"] == got[r["parent"]]["level"] + 1 and r["height"] <= got[r["parent"]]["height"] for r in got.values())


def test_dbscan_noise_and_borders(spark):
    x = [[0, 0], [0, 0.1], [0.1, 0], [5, 5], [5, 5.1], [5.1, 5], [20, 20]]
    labels = {r["id"]: r["label"] for r in X.dbscan(vectors(spark, x), 0.2, 3, checkpointed).collect()}
    assert labels == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: -1}


def test_auto_cluster_returns_labels(spark):
    x = np.random.default_rng(1).normal(size=(30, 4)) + np.repeat([[0], [9], [30]], 10, axis=0)
    name, labels = X.auto_cluster(vectors(spark, x), checkpointed, ks=(2, 3), eps=0.5)
    assert name.startswith(("kmeans", "ward", "dbscan")) and labels.count() == 30


def test_pca_range(spark):
    x = np.random.default_rng(2).normal(size=(20, 5))
    got = X.pca_2d(vectors(spark, x)).collect()
    assert max(r["x"] for r in got) == pytest.approx(1) and min(r["y"] for r in got) == pytest.approx(-1)


def test_force_layout_beyond_2000_rows(spark):
    draw = np.random.default_rng(3)
    # Groups of 16, so the 15 neighbours of a row are the rest of its group.
    df = vectors(spark, np.repeat(draw.normal(size=(132, 8)) * 5, 16, axis=0) + draw.normal(size=(2112, 8)) * 0.01)
    at = np.array([(r["x"], r["y"]) for r in X.force_layout(df, checkpointed, rounds=6).orderBy("id").collect()])
    flat = np.array([(r["x"], r["y"]) for r in X.pca_2d(df).orderBy("id").collect()])
    assert at.shape == (2112, 2) and np.abs(at).max() == pytest.approx(1)
    near = {(r["id"], r["neighbour"]) for r in X.nearest(df, 15).collect()}
    a, b = np.array(sorted(near)).T
    spread = lambda i, j: np.linalg.norm(at[i] - at[j], axis=1).mean()
    assert spread(a, b) < 0.6 * spread(a, draw.permutation(b)) and not np.allclose(at, flat, atol=0.2)


def test_circuit_breaker(spark):
    events = [(0, i, float(i), False) for i in range(5)] + [(0, 5, 10.0, True), (0, 6, 70.0, True), (0, 7, 71.0, True), (0, 8, 72.0, True)]
    df = spark.createDataFrame(events, "op int, seq long, at double, ok boolean")
    got = [r["state"] for r in M.circuit_breaker(df, "op", "seq").orderBy("seq").collect()]
    assert got == ["closed"] * 4 + ["open", "open", "half_open", "closed", "closed"]


def test_session_states(spark):
    rows = [("a", 1, "start"), ("a", 2, "pause"), ("a", 3, "resume"), ("a", 4, "complete"), ("a", 5, "fail"), ("b", 1, "pause")]
    got = {r["session_id"]: r["status"] for r in M.session_states(spark.createDataFrame(rows, "session_id string, seq long, event string")).collect()}
    assert got == {"a": "completed", "b": "created"}


def raw(spark, content, path="x"):
    return spark.createDataFrame([(path, content)], "path string, content string")


def test_readers(spark):
    csv = raw(spark, "conv_id,role,content\n1,user,Hello\n1,assistant,Hi\n2,user,Question, with comma\n2,assistant,Answer")
    got = R.parse_csv(csv).orderBy("conv", "turn").collect()
    assert [(r["conv"], r["turn"]) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1)] and got[2]["text"] == "Question, with comma"
    text = R.parse_text(raw(spark, "User: Hello\nAssistant: Hi there\n\nUser: How are you?"))
    assert [(r["role"], r["text"]) for r in text.orderBy("turn").collect()] == [("user", "Hello"), ("assistant", "Hi there"), ("user", "How are you?")]
    assert R.parse_json(raw(spark, '[{"messages": [{"role": "user", "content": "a"}]}, {"text": "b"}, {"other": 1}]')).count() == 2
    assert R.parse_json(raw(spark, '{"conversations": [{"messages": [{"role": "user", "content": "a"}]}]}')).count() == 1
    kinds = [R.detect_format(F.lit(c), F.lit(n)) for c, n in (('{"test": true}', ""), ("x", "data.json"), ("x", "data.csv"))]
    assert list(spark.range(1).select(*kinds).first()) == ["json", "json", "csv"]


def test_readers_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "hello"}]')
    (tmp_path / "b.txt").write_text("User: hi\nBot: ho")
    got = R.read(R.files(spark, str(tmp_path)))
    assert got.count() == 3 and R.with_ids(got).select("conv_id").distinct().count() == 2


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_greedy_pages_do_not_depend_on_ranges(spark, ranges):
    import random

    from convlens.operators import conversations as C

    draw = random.Random(ranges)
    rows = [(i, "ab"[i % 5 == 0], draw.choice([0, 1, 3, 8, 8, 20, 45])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, size long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        got = {r["id"]: r["page"] for r in C.greedy_pages(df, ["id"], "size", 30, "g").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in "ab":
        page, fill, first = 0, 0, True
        for i, h, size in rows:
            if h != g:
                continue
            if not first and fill + size > 30:
                page, fill = page + 1, 0
            fill, first = fill + size, False
            assert got[i] == page, (g, i)


def test_near_duplicates_by_rarest_messages(spark):
    """A greeting shared by all brings nobody together; pairs that agree enough are found, exact copies are not."""
    from convlens.operators import conversations as C

    rows = [(c, t, "user", "hi" if t == 0 else f"c{c % 3 if t < 9 else c} t{t}") for c in range(6) for t in range(10)]
    got = C.near_duplicates(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), 0.9).collect()
    assert sorted((r["a"], r["b"], r["similarity"]) for r in got) == [(0, 3, 0.9), (1, 4, 0.9), (2, 5, 0.9)]


def test_truncation_marks(spark):
    from convlens.operators import reports as P

    df = spark.createDataFrame([(1, 0, "it goes on and on..."), (1, 1, "cut here [truncated] then more"), (1, 2, "a whole message it is"), (1, 3, None)], "conv_id long, turn int, text string")
    got = sorted((r["turn"], r["issue_type"]) for r in P.content_quality_issues(df).collect())
    assert got == [(0, "truncated"), (1, "truncated"), (3, "low_quality")]


def test_templates_and_prompts():
    from convlens import providers as P

    own = [{"id": 1, "text": "a {name}"}]
    assert P.merge(own, P.dump([{"id": 1, "text": "other"}, {"id": 2, "text": "b"}])) == [own[0], {"id": 2, "text": "b"}]
    assert P.fill("a {name}", {"name": "x", "more": "y"}) == "a x"
    with pytest.raises(ValueError, match="missing: name"):
        P.fill("a {name}", {})
    with pytest.raises(ValueError, match="unknown provider"):
        P.create("nowhere")


def test_choice_of_k(spark):
    import random

    from convlens.operators import vectors as X

    draw = random.Random(2)
    rows = [(i, [10.0 * (i % 3) + draw.random(), 10.0 * (i % 3 == 1) + draw.random()]) for i in range(45)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert X.choose_k(df, 5) == 3 and X.choose_k(df.limit(2), 5) == 2


def test_recovering_model():
    from convlens import providers as P

    class Flaky:
        def __init__(self, bad):
            self.bad, self.calls = bad, 0

        def complete(self, prompts):
            self.calls += 1
            if self.calls <= self.bad:
                raise P.Unavailable
            return ["ok"] * len(prompts)

    assert P.Recovering([Flaky(2)]).complete(["a", "b"]) == ["ok", "ok"]
    never, second = Flaky(10**9), Flaky(0)
    model = P.Recovering([never, second], waits=(0.0,), failures=4)
    for _ in range(5):
        assert model.complete(["a"]) == ["ok"]
    assert never.calls == 4 and second.calls == 5
    with pytest.raises(P.Unavailable):
        P.Recovering([Flaky(9)], waits=()).complete(["a"])
    assert P.choose_version({"v1": 0.5, "v2": 0.9}, 0.5, "v1") == "v2" and P.choose_version({"v1": 0.5, "v2": 0.9}, 0.05, "v1") == "v1"


def test_prefix_examples(spark):
    from convlens.sources import readers as R

    templates = spark.createDataFrame([(t, i, "user" if i % 2 == 0 else "assistant", f"t{t} {i}") for t in range(3) for i in range(6)], "template long, turn int, role string, text string")
    got = R.prefix_examples(templates, 200).collect()
    turns = {}
    for r in got:
        turns.setdefault(r["conv_id"], []).append(r["turn"])
    assert len(turns) == 200 and all(sorted(t) == list(range(len(t))) and len(t) >= 2 for t in turns.values())
    assert 30 < sum("say more" in r["text"] for r in got) < 90
    assert sorted(map(str, got)) == sorted(map(str, R.prefix_examples(templates.repartition(3), 200).collect()))


def test_dense_clusters_write_no_pairs(spark):
    """All of 600 vectors (200 with copies) are near each other: the tables between hold vectors, not their pairs."""
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(size=(200, 3)) * 0.01] * 3 + [[[9.0, 9, 9]], [[0.62, 0, 0]]])
    written = []

    def kept(df):
        out = checkpointed(df)
        written.append(out.count())
        return out

    got = {r["id"]: r["label"] for r in X.dbscan(vectors(spark, x.tolist()), 0.6, 20, kept).collect()}
    assert len(got) == 602 and {got[i] for i in range(600)} == {0} and got[600] == -1
    reach = np.sqrt(((x[601] - x) ** 2).sum(1)) <= 0.6
    assert got[601] == (0 if reach.sum() > 1 else -1)
    assert max(written) <= 2 * 602


def test_density_clusters_over_many_blocks(spark, monkeypatch):
    """As brute force has them, with blocks of a few vectors."""
    monkeypatch.setattr(X, "LEAST", 8)
    draw = np.random.default_rng(7)
    x = np.round(draw.normal(size=(160, 2)) * 3, 1)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.7
    core = near.sum(1) >= 4
    root = np.where(core, np.arange(160), 160)
    for _ in range(160):
        root = np.where(core, np.where(near & core[None], root[None], 160).min(1), 160)
    number = {r: i for i, r in enumerate(sorted(set(root[core])))}
    want = [number[root[i]] if core[i] else min((number[root[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(160)]
    assert [r["label"] for r in X.dbscan(vectors(spark, x.tolist()), 0.7, 4, checkpointed).orderBy("id").collect()] == want


def test_silhouette_over_many_blocks_and_copies(spark, monkeypatch):
    """As by definition, and no vector goes to more tasks than there are strips."""
    monkeypatch.setattr(X, "LEAST", 8)
    draw = np.random.default_rng(3)
    x = np.concatenate([np.round(draw.normal(size=(90, 3)), 1)] * 2 + [np.full((30, 3), 5.0)])
    label = np.concatenate([np.arange(180) % 4, np.full(29, 4), [5]])
    df = spark.createDataFrame([(i, int(c), v) for i, (c, v) in enumerate(zip(label, x.tolist()))], "id long, label int, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(len(x)):
        mean = [d[i, label == c].sum() / max(1, (label == c).sum() - (c == label[i])) for c in range(6)]
        a, b = mean[label[i]], min(m for c, m in enumerate(mean) if c != label[i])
        want.append(0.0 if (label == label[i]).sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    got = [r["silhouette"] for r in X.silhouette(df, "label").orderBy("id").collect()]
    assert [0.0 if g is None or g != g else g for g in got] == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(X, "LEAST", 1)
    assert X.half_pairs(spark.range(5000)).groupBy("id").count().agg(F.max("count")).first()[0] <= X.STRIPS + 1


def test_tfidf_counts_only_pairs_of_frequent_words(spark, monkeypatch):
    """Against counting of all terms, by lists and by joins, with ties and a cluster of rare words; rows of pairs stay few."""
    from collections import Counter

    from convlens.operators import clusters as K

    texts = [(1, i, "red fox runs red fox " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(20)] + [(2, 50, "one two three"), (2, 51, "two three one two"), (2, 52, None), (None, 53, "red fox")]
    df = spark.createDataFrame(texts, "cluster int, doc_id int, text string")
    want = {}
    for c in (1, 2):
        tf = {d: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for k, d, t in texts if k == c for w in [(t or "").split()]}
        total = sum(tf.values(), Counter())
        top = sorted(total, key=lambda t: (-total[t], t))[:3]
        idf = {t: np.log((1 + len(tf)) / (1 + sum(t in x for x in tf.values()))) + 1 for t in top}
        score = dict.fromkeys(top, 0.0)
        for x in tf.values():
            length = np.sqrt(sum((x[t] * idf[t]) ** 2 for t in top))
            for t in top:
                score[t] += x[t] * idf[t] / length / len(tf) if length else 0
        want |= {(c, t): round(score[t], 9) for t in top}
    made = []
    monkeypatch.setattr(K, "checkpointed", lambda df: made.append(df.count()) or df)
    for lists in (True, False):
        monkeypatch.setattr(K, "_short_lists", lambda *a, lists=lists: lists)
        got = K.tfidf_terms(df, features=3, most=3, stop=("the",))
        assert {(r["cluster"], r["term"]): round(r["score"], 9) for r in got.collect()} == want
    assert len(made) == 6 and max(made) < 400
