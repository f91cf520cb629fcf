"""Token counts against the tokenizer that the vocabulary file describes."""

import os

import pytest

from convlens.operators import bpe as B
from convlens.operators import conversations as C

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", "don't  stop\n\n\tnow ", "é ü 漢字 😀😀", "x" * 5000, "1234 5,678.90", "  wide　blanks", "I'll we've THEY'RE", "end \n", "a\r\nb\x0b\x0c", "ÀÉ́ ½ ² Ⅷ"]


@pytest.fixture(scope="module")
def encode():
    path = public.path("byte_bpe_50k.json")
    own = tokenizers.Tokenizer.from_file(path)
    return path, lambda t: len(own.encode(t or "", add_special_tokens=False).ids)


def test_odd_texts(spark, encode):
    path, size = encode
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD)], "id long, text string, n int")
    got = {r["id"]: r["tokens"] for r in B.counts(df, "id", path).collect()}
    assert got == {i: size(t) for i, t in enumerate(ODD)}
    assert B.counts(df.where("false"), "id", path).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_all_documents_and_conversations(spark, encode):
    path, size = encode
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r["doc_id"]: r["tokens"] for r in B.counts(docs, "doc_id", path).collect()} == {r["doc_id"]: size(r["text"]) for r in docs.collect()}
    messages = spark.read.parquet(f"{SF}/conversations.parquet")
    want = {}
    for r in messages.collect():
        want[r["conv_id"]] = want.get(r["conv_id"], 0) + size(r["text"])
    held = B.tokens(messages, path)
    assert {r["conv_id"]: r["tokens"] for r in held.collect()} == want
    assert C.token_stats(held, 100).first()["total"] == sum(want.values())


def test_no_piece_is_shuffled_and_few_are_kept(spark, encode, monkeypatch):
    path, size = encode
    texts = [f"word{i} " * 3 + "déjà vu " + "aaab" * i for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    monkeypatch.setattr(B, "CACHED", 5)
    got = B.counts(df, "id", path)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["tokens"] for r in got.collect()} == {i: size(t) for i, t in enumerate(texts)}
