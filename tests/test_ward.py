import numpy as np
import pytest

from convlens.operators import ward as W


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(range(len(x)) if ids is None else ids, x)], "id long, v array<double>")


def cut(x, k):
    tree = W.merges(x)
    top = list(range(len(x)))
    names = [[i] for i in top]
    for i, j, _ in tree:
        names.append(names[i] + names[j])
    for i, j, _ in tree[: max(len(x) - k, 0)]:
        a, b = sorted((top[names[i][0]], top[names[j][0]]))
        top = [a if t == b else t for t in top]
    return np.unique(top, return_inverse=True)[1].tolist()


@pytest.mark.parametrize("kind", ["far", "near", "bits"])
def test_search_is_exact(kind):
    draw = np.random.default_rng(6)
    x = {"far": draw.normal(size=(3000, 5)), "near": np.repeat(draw.normal(size=(3, 5)), 1000, axis=0) + 1e-7 * draw.normal(size=(3000, 5)), "bits": draw.integers(0, 2, size=(3000, 8)) * 1.0}[kind]
    row, size = np.arange(3000) * 7, draw.integers(1, 40, size=3000) ** 2.0
    own = np.sort(draw.permutation(3000)[:300])
    search = W.Search(row[own], size[own], x[own])
    for part in np.array_split(draw.permutation(3000), [20, 700]):
        search.see(row[part], size[part], x[part])
    for at, i in enumerate(own):
        cost = 2 * size[i] * size / (size[i] + size) * ((x[i] - x) ** 2).sum(1)
        cost[i] = np.inf
        order = np.lexsort((row, cost))[: W.LISTED + 1]
        assert search.near[at].tolist() == row[order].tolist() and search.cost[at].tolist() == cost[order].tolist()


def test_searches_are_dealt_to_many_tasks(spark, monkeypatch):
    # Before, one task had all vectors and compared each with each.
    dealt, deal = [], type(spark.range(1)).repartitionById
    monkeypatch.setattr(type(spark.range(1)), "repartitionById", lambda df, n, *by: dealt.append(n) or deal(df, n, *by))
    monkeypatch.setattr(W, "ALONE", 1_500_000)
    draw = np.random.default_rng(7)
    x = np.concatenate((draw.normal(size=(2000, 4)), np.repeat(draw.normal(size=(5, 4)), 80, axis=0), np.repeat(draw.normal(size=(3, 4)), 200, axis=0) + 1e-6 * draw.normal(size=(600, 4))))[draw.permutation(3000)]
    ids = np.sort(draw.permutation(90_000)[:3000])
    got = W.ward(table(spark, x[(order := draw.permutation(3000))], ids[order]), 9).orderBy("id").collect()
    assert [r["id"] for r in got] == ids.tolist() and [r["label"] for r in got] == cut(x, 9)
    assert dealt[0] == 9 and len(dealt) > 1


def test_ward_edges(spark):
    labels = lambda x, k: [r["label"] for r in W.ward(table(spark, x), k).orderBy("id").collect()]
    assert labels([], 3) == [] and labels([[1, 2]], 3) == [0] and labels([[1, 2], [0, 0], [1, 2], [1, 2]], 3) == [0, 1, 0, 2] and labels([[0.0], [-0.0], [5]], 2) == [0, 0, 1]
    for wrong in ([[0, 1], [float("nan"), 1]], [[0, 1], [float("inf"), 1]], [[0, 1], [1]]):
        with pytest.raises(Exception, match="not finite|differ in length"):
            labels(wrong, 2)
