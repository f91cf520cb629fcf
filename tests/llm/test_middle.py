"""The cuts and outputs of the fill-in-the-middle transformation against slicing."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convlens.llm import middle
from convlens.llm.common import Scratch

from .conftest import prose

DRAW = random.Random(4)
ODD = ["", None, "a", "<P>x", "é<S>", "<<P>>", "<" * 300 + "M>", "x" * 256, "é" * 128, "é" * 129, "😀" * 500, "<P", "S>", prose(9, 9000), "漢字" * 40_000, "x" * 70_000 + "<M>"]
TEXTS = ODD + ["".join(DRAW.choice("ab<PSM>é漢😀\n") for _ in range(DRAW.randrange(900))) for _ in range(60)] + [prose(i, 20 + i) for i in range(60)]


def sliced(doc_id, text):
    """By the definition: (form, n, prefix_chars, middle_chars, output)."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", n, None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", n, a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", n, a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [65536, 300, 7])
def test_against_slicing(spark, chunk):
    """The same wherever chunks end, in the midst of marks and code points too; repeated rows and a null id included."""
    texts = TEXTS if chunk > 7 else [t for t in TEXTS if len(t or "") < 500]
    rows = [*enumerate(texts), (3, texts[3]), (None, "some text without an id")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, form string, h1 int").repartition(3)
    out = middle.transform(docs, Scratch(spark, "test-fim"), chunk=chunk).withColumn("restored", middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["form"], r["n"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"], r["restored"]) for r in out)
    want = sorted((-1 if i is None else i, f, n, str(a), str(m), o, t or "") for i, t in rows for f, n, a, m, o in [sliced(i, t)])
    assert got == want and {g[1] for g in got} == {"plain", "psm", "spm"}


def test_functions_compose():
    """The function of a text is that of its parts, however it is cut and entered."""
    data = np.frombuffer("<P>é<<S>漢😀<M>\n".encode() * 3, np.uint8)
    rows = lambda part: np.concatenate((part, np.full(64 - len(part), middle.PAD, np.uint8)))[None]
    whole = middle.Functions.of(rows(data))
    for cut in range(len(data)):
        both = middle.Functions.of(rows(data[:cut])).then(middle.Functions.of(rows(data[cut:])))
        assert (both.end == whole.end).all() and (both.units == whole.units).all() and (both.marks == whole.marks).all()
    assert whole.units[0, 0] == len(data.tobytes().decode()) and whole.marks[0, 0] == 9


def test_cuts_of_slices():
    texts = pa.array([t or "" for t in TEXTS])[5:50]
    draws = [np.arange(len(texts)) * 7919 + k for k in (3, 11)]
    out = middle.cuts_of(texts, draws)
    for i, t in enumerate(texts.to_pylist()):
        cuts = sorted(int(d[i]) % (len(t) + 1) for d in draws)
        assert [int(x[i]) for x in out] == [len(t), sum(t.count(f"<{k}>") for k in "PSM"), *cuts, *(len(t[:c].encode()) for c in cuts)]


def test_empty_table(spark):
    assert middle.transform(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "test-fim")).count() == 0
