"""Vector near-duplicates against all pairs."""

import numpy as np

from convlens.llm import caps as C


def brute(x, cosine=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[near[i]].min(initial=root[i]), root[i]) for i in range(len(x))])
        if (new == root).all():
            return near.sum(1), root
        root = new


def frame(spark, x, more=()):
    rows = [(i, [float(y) for y in v], 0) for i, v in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int")


def test_recall_and_precision(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(120, 64))
    x = np.concatenate([centres] + [c + draw.normal(size=(5, 64)) * draw.uniform(0.05, 0.3) for c in centres[:60]])
    links, root = brute(x)
    got = {r["vec_id"]: r for r in C.near_duplicates(frame(spark, x)).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(x))]) > 0.97


def test_copies_bad_vectors_and_blocks(spark):
    draw = np.random.default_rng(5)
    x = np.concatenate([np.repeat(draw.normal(size=(1, 16)), 30, axis=0), draw.normal(size=(1, 16)) + draw.normal(size=(40, 16)) * 0.05])
    bad = [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [None] * 16, 0), (104, [1.0], 0), (None, None, 0)]
    for block in (8, 512):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in C.near_duplicates(frame(spark, x, bad), block=block, wanted=25.0).collect()}
        assert all(got[i] == (29, 0) for i in range(30))
        assert all(got[i][1] == 30 and got[i][0] == 39 for i in range(30, 70))
        assert all(got[i] == (0, i) for i in [*range(100, 105), None])


def test_lengths_and_ids(spark):
    """Vectors of rare lengths link with each other, never across lengths; rows without an id or repeating one are answered each."""
    draw = np.random.default_rng(12)
    rows = [(i, draw.normal(size=40).tolist(), 0) for i in range(200)]
    one, other = draw.normal(size=20), draw.normal(size=20) * 0.02
    rows += [(300, [1.0, 0.01], 0), (301, [1.0, 0.02], 0), (302, [-0.01, 1.0], 0), (303, [0.01, 1.0], 0), (304, [1.0, 0.01, 0.0], 0)]
    rows += [(310, one.tolist(), 0), (311, (one + other).tolist(), 0), (None, (2 * one).tolist(), 0), (311, (one + other).tolist(), 1)]
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], r["component_id"]) for r in C.near_duplicates(frame(spark, [], rows), wanted=25.0).collect())
    assert [g for g in got if g[0] < 0 or g[0] >= 300] == [
        (-1, 3, 310), (300, 1, 300), (301, 1, 300), (302, 1, 302), (303, 1, 302), (304, 0, 304), (310, 3, 310), (311, 3, 310), (311, 3, 310)
    ]
    assert all(g[1] == 0 for g in got if 0 <= g[0] < 200)


def test_empty(spark):
    assert C.near_duplicates(frame(spark, np.zeros((0, 4)))).count() == 0
    assert [tuple(r) for r in C.near_duplicates(frame(spark, [], [(1, None, 0)])).collect()] == [(1, 0, 1)]


def test_decoding_lists_exactly_the_filters_above_the_height():
    code = C.Code(16, 2, 4, 5, 1.5, 1, 1)
    x = np.random.default_rng(6).normal(size=(20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = [[] for _ in x]
    for c in range(2):
        parts = code.scores(x, c)
        for i in range(len(x)):
            sums = (parts[0][i][:, None, None, None] + parts[1][i][:, None, None] + parts[2][i][:, None] + parts[3][i]).ravel()
            want[i] += (np.flatnonzero(sums >= min(1.5, sums.max() - 1e-12)) + c * 5**4).tolist()
    assert [f.tolist() for f in code.filters(x)] == want
