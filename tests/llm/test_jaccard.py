"""The similarity join against all pairs."""

from collections import Counter

import numpy as np

from convlens.llm import jaccard as J


def sets(rows):
    out = []
    for i, t, _ in rows:
        w = (t or "").split()
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None))
    return out


def brute(rows, threshold=0.8):
    s = sets(rows)
    links, root = Counter(), list(range(len(s)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and len(x & y) / len(x | y) >= threshold:
                links[a] += 1
                links[b] += 1
                root[max(top(a), top(b), key=lambda k: s[k][0])] = min(top(a), top(b), key=lambda k: s[k][0])
    return sorted((s[i][0], s[top(i)][0], links[i]) for i in range(len(s)))


def test_against_all_pairs(spark, documents):
    rows, df = documents
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in J.similar(df).collect())
    assert got == brute(rows)


def test_large_group_in_blocks(spark):
    draw = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for p in draw.choice(60, draw.integers(0, 3), replace=False):
            words[p] = f"x{draw.integers(9)}"
        rows.append((i, " ".join(words), None))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for block in (7, 256):
        assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in J.similar(df, block=block).collect()) == brute(rows)


def test_empty(spark, documents):
    assert J.similar(documents[1].where("false")).count() == 0
    assert {(r["class_id"], r["n_links"]) for r in J.similar(documents[1].where("doc_id in (3, 4)")).collect()} == {(3, 0), (4, 0)}


def test_prefixes_are_shortened_until_the_recall_is_met():
    met = J.met
    none = J.prefix_length({}, 0.8, 32, 0.9999)
    assert met(0.8, none, 32) >= 0.9999 > met(0.8, none + 1, 32)
    # Near copies only: whole labels find them. Pairs close to the threshold: shorter prefixes.
    assert J.prefix_length({250: 1000}, 0.8, 32, 0.9999) == 8
    assert J.prefix_length({250: 1000, 206: 400}, 0.8, 32, 0.9999) == none
    assert J.prefix_length({250: 1000, 206: 400}, 0.8, 32, 0.9) > none


def test_chance_meetings(spark):
    """Texts that meet at a node without being similar, some of them linked past its first class, in small blocks."""
    draw = np.random.default_rng(11)
    theme = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = list(theme)
        for p in draw.choice(300, 30 if i % 3 else 12, replace=False):
            words[p] = f"x{i}q{p}"
        rows.append((i, " ".join(words), None))
        if i % 4 == 0:
            rows.append((100 + i, " ".join([*words[:299], "end"]), None))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in J.similar(df, block=5).collect()) == brute(rows)


def test_null_and_repeated_ids(spark):
    near = [f"w{i}" for i in range(80)]
    texts = [" ".join(near), " ".join([*near[:79], "z"]), "other words that stand alone here"]
    rows = [(None, texts[0], 0), (None, texts[0], 1), (None, texts[1], 2), (7, texts[1], 3), (7, texts[2], 4), (7, texts[2], 5), (None, None, 6), (7, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = {r["row"]: r for r in J.linked(df, row_col="row").collect()}
    assert [got[i]["n_links"] for i in range(8)] == [3, 3, 3, 3, 1, 1, 0, 0]
    assert [got[i]["class_id"] for i in range(8)] == [7, 7, 7, 7, 7, 7, None, 7]
    assert len({got[i]["group"] for i in range(4)}) == 1 and got[4]["group"] == got[5]["group"] != got[0]["group"] and got[6]["group"] is None
