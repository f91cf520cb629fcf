"""The token store against encoding each text alone."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from convlens.llm import tokens as K  # noqa: E402
from convlens.llm.common import Scratch  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x02.,!?'$%_-09aAzéßñ你😀² 　<|"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=6))
def test_encoder_equals_library(encoder, texts):
    ids, offsets = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_contractions_and_special_token(encoder):
    texts = ["it's John's, they'll&'s", "a <|endoftext|> b", "x's 'tis end.'s", "a \x02b c", "x \x02", "hello \x02world!", "\x02"]
    ids, offsets = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_new_words_are_encoded_without_arrays_of_their_own(monkeypatch):
    encoder, alone = K.Encoder(PATH), []
    monkeypatch.setattr(encoder, "letters_of", lambda piece, f=encoder.letters_of: alone.append(piece) or f(piece))
    monkeypatch.setattr(encoder, "whole", lambda text, f=encoder.whole: alone.append(text) or f(text))
    texts = ["So many plain words of letters and of more letters", "", "one\ntwo\nthree, four", "caf\u00e9 au lait"] * 3
    ids, offsets = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert "\n" not in alone and " many" not in alone


def test_gathered():
    ids, lengths, places = np.arange(6, dtype=np.uint16), np.array([2, 0, 3, 1]), np.array([2, 1, 0, 2], np.int32)
    assert K.gathered(ids, lengths, pa.array(places), 8).tolist() == [2, 3, 4, 0, 1, 2, 3, 4]
    assert K.gathered(ids[:0], lengths[:0], pa.array(places[:0]), 0).tolist() == []


def test_store_round_trip(spark, documents, encoder):
    rows, df = documents
    scratch = Scratch(spark, "test-tokens")
    store = K.write_store(df, PATH, scratch, mean=64)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in K.read_store(store).collect())
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    docs = store.where("not manifest").select("uid", F.arrays_zip("hi", "lo", "mine").alias("c"), F.col("mine").isNull().alias("all"))
    chunks = docs.select("all", F.explode("c").alias("c")).where("all or c.mine").select("c.hi", "c.lo")
    assert chunks.count() == chunks.distinct().count() < docs.select(F.explode("c")).count()
    assert K.damaged_packs(store).count() == 0


def test_damage_is_found(spark, documents):
    _, df = documents
    store = K.write_store(df.where("doc_id < 3"), PATH, Scratch(spark, "test-damage"))
    broken = store.withColumn("root", F.when(F.col("doc_id") == 0, F.lit(b"x")).otherwise(F.col("root")))
    assert K.damaged_packs(broken).count() == 1
    with pytest.raises(Exception, match="does not match"):
        K.read_store(broken).collect()


def test_missing_rows_are_found_on_reading(spark, documents):
    _, df = documents
    store = K.write_store(df.where("doc_id < 3"), PATH, Scratch(spark, "test-missing"))
    for lost in (store.where("manifest or doc_id <> 2"), store.where("not manifest")):
        with pytest.raises(Exception, match="does not match"):
            K.read_store(lost).collect()


def test_empty(spark, documents):
    _, df = documents
    assert K.read_store(K.write_store(df.where("false"), PATH, Scratch(spark, "test-empty"))).count() == 0


def test_common_chunks_and_hot_ids(spark, encoder):
    """A passage in more documents than the limit of common chunks, one id for a third of the rows, null ids."""
    line = " ".join(f"shared{i}word" for i in range(120))
    rows = [(5 if i % 3 == 0 else None if i % 50 == 0 else i, f"{i} own {i * 7} text. {line} tail {i}") for i in range(300)]
    store = K.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH, Scratch(spark, "test-common"))
    got = K.read_store(store).collect()
    want = sorted(zlib.crc32(np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()) for _, t in rows)
    assert sorted(r["ids_crc32"] for r in got) == want
    in_order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in in_order] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in in_order])))[:-1].tolist()
    assert [r["doc_id"] for r in in_order] == sorted((r["doc_id"] for r in got), key=lambda x: (x is not None, x))
    assert sum(r["n_stored"] for r in got) < 0.6 * sum(r["n_chunks"] for r in got)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=900), min_size=1, max_size=4))
def test_chunks_cover_and_are_bounded(texts):
    gear = np.random.default_rng(7).integers(0, 1 << 32, 16, dtype=np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    ends, counts = K.chunk_ends(np.concatenate(texts), offsets, gear, 32)
    assert counts.sum() == len(ends)
    for t, own in zip(texts, np.split(ends, np.cumsum(counts)[:-1])):
        alone, _ = K.chunk_ends(np.array(t), np.array([0, len(t)]), gear, 32)
        sizes = np.diff(alone, prepend=0)
        assert alone[-1] == len(t) and (sizes > 0).all() and (sizes <= 128).all() and (sizes[:-1] >= 16).all()
        assert (np.diff(own) == np.diff(alone)).all()
