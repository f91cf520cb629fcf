"""Neighbour graphs and layouts against exact neighbours and ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlens.operators import graphs as G
from convlens.operators import vectors as O
from convlens.session import checkpointed


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def swarms(spark):
    """Six swarms in 20 dimensions."""
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.standard_normal(20) * 3 + draw.standard_normal((70, 20)) for _ in range(6)])
    return x, frame(spark, x)


def gaps(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("cell", [4096, 60])
def test_most_true_neighbours_are_found(spark, swarms, cell, monkeypatch):
    """In one cell, and where vectors have to be dealt to many."""
    monkeypatch.setattr(G, "CELL", cell)
    monkeypatch.setattr(G, "LEAF", 32)
    x, df = swarms
    graph, vectors = G.neighbour_graph(df, 10, checkpointed)
    assert vectors.count() == 420 and (vectors.select("block").distinct().count() > 6) == (cell == 60)
    d = gaps(x)
    true = np.argsort(d, 1)[:, :10]
    got = {}
    for r in graph.collect():
        got.setdefault(r["id"], {})[r["neighbour"]] = r["distance"]
    assert all(len(n) == 10 and i not in n for i, n in got.items())
    assert all(abs(d[i, j] - g) < 1e-9 for i, n in got.items() for j, g in n.items())
    assert np.mean([len(set(true[i]) & set(n)) / 10 for i, n in got.items()]) >= 0.95
    told = G.neighbour_recall(df, graph, 10).collect()
    assert len(told) == 9 and sum(r["found"] for r in told) == sum(len(set(true[i]) & set(got[i])) for i in range(0, 420, 50))


def test_equal_vectors_few_vectors_and_none(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(None, [1.0, 1.0]), (99, None)], "id long, v array<double>")
    graph, _ = G.neighbour_graph(same, 5, checkpointed)
    assert graph.count() == 200 and graph.where("distance <> 0").count() == 0
    few, _ = G.neighbour_graph(frame(spark, [[0.0], [1.0], [3.0]]), 5, checkpointed)
    assert sorted((r["id"], r["neighbour"], r["distance"]) for r in few.collect()) == [(0, 1, 1.0), (0, 2, 3.0), (1, 0, 1.0), (1, 2, 2.0), (2, 0, 3.0), (2, 1, 2.0)]
    none = same.where("false")
    assert G.neighbour_graph(none, 5, checkpointed)[0].count() == 0 and G.umap(none, checkpointed).count() == 0


def test_trustworthiness_by_ranks(spark, swarms):
    x, df = swarms
    layout = x[:, :2]
    high, low = gaps(x), gaps(layout)
    rank = np.argsort(np.argsort(high, 1, kind="stable"), 1) + 1
    for every in (1, 7):
        asked = range(0, len(x), every)
        penalty = sum(max(0, int(rank[i, j]) - 5) for i in asked for j in np.argsort(low[i], kind="stable")[:5])
        want = 1 - 2.0 * penalty / (len(asked) * 5 * (2 * len(x) - 16))
        got = G.trustworthiness(df, frame(spark, layout), 5, every).first()
        assert (got["n"], got["asked"], got["penalty"]) == (len(x), len(asked), penalty) and got["trustworthiness"] == pytest.approx(want)
    assert G.trustworthiness(df, df, 5).first()["trustworthiness"] == 1


def test_layout_can_be_trusted_more_than_principal_components(spark, swarms):
    x, df = swarms
    unit = frame(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    placed = G.umap(df, checkpointed, rounds=4)
    assert placed.count() == 420
    score = lambda layout, *c: G.trustworthiness(unit, layout.select("id", F.array(*c).alias("v")), 5).first()["trustworthiness"]
    ours, theirs = score(placed, "x0", "x1"), score(O.pca_2d(unit), "x", "y")
    assert ours > theirs and ours > 0.85


def test_scales_and_union(spark):
    d = np.array([[0.0, 1.0, 2.0, 4.0], [1.0, 1.0, 1.0, 1.0], [0.5, 0.7, 0.9, 1.1]])
    rho, sigma = G.scales(d)
    assert rho.tolist() == [1.0, 1.0, 0.5]
    weights = np.exp(-np.maximum(0, d[2] - rho[2]) / sigma[2])
    assert weights.sum() == pytest.approx(2.0, abs=1e-6)
    a, b = G.curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01
    graph = spark.createDataFrame([(1, 2, 1.0, 1), (1, 3, 2.0, 2), (2, 1, 1.0, 1), (2, 3, 1.5, 2)], "id long, neighbour long, distance double, rank int")
    got = {(r["a"], r["b"]): r["w"] for r in G.fuzzy_graph(graph).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)} and got[1, 2] == pytest.approx(1.0) and 0 < got[1, 3] < 1


def test_vectors_go_to_a_bounded_number_of_cells(spark, monkeypatch):
    """As rows grow cells do, up to MOST."""
    assert [G.cell_of(n) for n in (0, 50_000, 240_000, 10**9)] == [4096, 4096, 10_000, 32_768]
    for name, n in (("CELL", 4), ("STRIPS", 4), ("LEAF", 8)):
        monkeypatch.setattr(G, name, n)
    x = np.random.default_rng(3).standard_normal((160, 4))
    graph, vectors = G.neighbour_graph(frame(spark, x), 5, checkpointed)
    sizes = [r["count"] for r in vectors.groupBy("block").count().collect()]
    assert max(sizes) <= 40 and len(sizes) <= 16
    true = np.argsort(gaps(x), 1)[:, :5]
    got = {(r["id"], r["neighbour"]) for r in graph.collect()}
    assert np.mean([(i, j) in got for i in range(160) for j in true[i]]) >= 0.95
