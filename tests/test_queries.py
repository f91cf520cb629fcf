"""Every registered query that has SQL gives the rows of that SQL on the smallest tables."""

import decimal
import os

import duckdb
import numpy as np
import pytest

from convlens.plans import registry

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, np.floating)):
        return None if v != v else float(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, np.ndarray)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name, tmp_path):
    """Each can be written and read again, with the schema it states and no column of nulls alone."""
    df = registry.queries()[name](spark, SF)
    df.write.parquet(f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in df.schema]
    n = back.count()
    assert n and all(back.where(f"`{c}` is not null").limit(1).count() for c in back.columns)


def test_shape_flags_read_all_turns(spark, tmp_path):
    rows = [(1, t, "user", "é ```and" + "x" * 1000 if t == 20 else "hi") for t in range(21)] + [(2, t, "user", "hi") for t in range(20, 24)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in registry.queries()["shape_flags"](spark, str(tmp_path)).collect()}
    assert got == {1: (True, True, True, True, True, False, "large"), 2: (False, False, False, False, True, False, "medium")}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
