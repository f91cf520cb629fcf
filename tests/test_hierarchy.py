"""Hierarchies by facets keep their members, whatever the model says."""

import pytest

from convlens.operators import naming as N
from convlens.providers import StubOrganiser


class Odd:
    """Says nothing, the same name twice, or letters that no category has."""

    def __init__(self, kind):
        self.kind = kind

    def complete(self, prompts):
        said = {"silent": "", "same": "Name: one\nDescription: d\nName: one\nDescription: e\n1 -> Z\n2 -> B\n99 -> A", "null": None}[self.kind]
        return [said for _ in prompts]


def frame(spark, n):
    rows = [(i, "ab"[i % 2] if i % 7 else None, f"n{i}", None if i % 5 == 0 else f"s{i}", [float(i % 10), float(i // 10)], "x") for i in range(n)]
    return spark.createDataFrame(rows, "cluster long, facet string, name string, summary string, v array<double>, part string")


@pytest.mark.parametrize("model", [StubOrganiser(), Odd("silent"), Odd("same"), Odd("null")])
def test_each_cluster_has_one_parent_of_its_facet(spark, model):
    rows = N.facet_hierarchy(frame(spark, 46), model, average=8).collect()
    levels = sorted({r["level"] for r in rows})
    by = {(r["level"], r["cluster"]): r for r in rows}
    assert len(by) == len(rows) and sum(r["level"] == 0 for r in rows) == 46 and levels == list(range(len(levels))) and len(levels) > 1
    sizes = [sum(r["level"] == k for r in rows) for k in levels]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    for r in rows:
        if r["level"] == levels[-1]:
            assert r["parent"] is None
        else:
            assert by[r["level"] + 1, r["parent"]]["facet"] == r["facet"]
    used = {(r["level"] + 1, r["parent"]) for r in rows if r["parent"] is not None}
    assert used == {k for k in by if k[0] > 0}


def test_empty_table_and_few_clusters(spark):
    assert N.facet_hierarchy(frame(spark, 4).where("false"), StubOrganiser()).count() == 0
    assert [r["parent"] for r in N.facet_hierarchy(frame(spark, 4), StubOrganiser()).collect()] == [None] * 4
