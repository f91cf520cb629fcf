"""Collocations against counting, on odd texts."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from convlens.llm import phrases
from convlens.llm.common import Scratch


def counted(rows, longest, least, best):
    """By the definition: (lang, rank, phrase, a, l, r, n, score)."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        often = {p: c for p, c in own.items() if c >= least and len(p) > 1}
        inside = {(p[i : i + k], c) for p, c in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)}
        rows = []
        for p, a in often.items():
            if any((p, c) in inside for c in range(a, a + 1)):
                continue
            score, k = min((int(Fraction(1000 * a * n[lang], own[p[:k]] * own[p[k:]])), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[:best])]
    return sorted(out)


def made(spark, rows, tmp, **given):
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, f int, name string").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, Scratch(spark, "test-phrases"), **given).collect())


TEXTS = [
    ("the cat sat on the mat. The CAT sat on the mat", "en"), ("the cat sat on; the mat\nthe cat\tsat  on the mat", "en"), ("the the the the the the", "en"), ("ÉTÉ été, Été été", "fr"),
    ("a b c d e f", "de"), ("a b c d e f", "de"), ("a b, c d e f", "de"), (None, "en"), ("", None), ("   . ,", "fr"), ("new york new york", None), ("new york", None), ("new\x0byork new\x85york", "en"),
]


@pytest.mark.parametrize(("least", "longest", "best"), [(2, 5, 2000), (1, 5, 7), (3, 3, 2)])
def test_against_counting(spark, tmp_path, least, longest, best):
    assert made(spark, TEXTS, tmp_path, least=least, longest=longest, best=best) == counted(TEXTS, longest, least, best)


def test_many_texts_and_shuffled_joins(spark, tmp_path, monkeypatch):
    """The same where no table is small enough to be sent out, and blocks are small."""
    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(" ".join(draw.choice(words, 40)) + ". " + " ".join(draw.choice(words[:3], 30)), ["en", "xx"][i % 2]) for i in range(60)]
    monkeypatch.setattr(phrases, "few", lambda t: t)
    monkeypatch.setattr(phrases, "MOST", -1)
    assert made(spark, rows, tmp_path, least=20) == counted(rows, 5, 20, 2000)


def test_long_texts_are_cut_between_pieces():
    batch = pa.record_batch({"lang": ["a", "b", "a"], "text": ["x y. z " * 50, "k" * 400, "q"]})
    got = list(phrases.stretches(batch, 64))
    assert b"".join(d.tobytes() for lang, d in got if lang == "a") == ("x y. z " * 50 + "\nq\n").encode()
    assert all(d[-1] in phrases.ENDS for _, d in got) and max(len(d) for lang, d in got if lang == "a") <= 64
    assert [len(d) for lang, d in got if lang == "b"] == [401]


def test_scores_past_64_bits(spark):
    row = spark.createDataFrame([(10**12, 10**13, 3 * 10**12, 7 * 10**11)], "a long, n long, l long, r long")
    got = row.select(phrases._score(*(row[c] for c in "anlr"))).first()[0]
    assert got == 1000 * 10**12 * 10**13 // (3 * 10**12 * 7 * 10**11)


def test_empty_table(spark):
    assert made(spark, [], None) == []
    assert made(spark, [(None, None)], None, least=1) == []


def test_files_hold_few_blocks(spark, monkeypatch):
    """A task has a file's blocks at once, so a file has few of them however many a task makes."""
    monkeypatch.setattr(Scratch, "drop", lambda self, name="": None)
    scratch = Scratch(spark, "test-phrases")
    df = spark.createDataFrame([("a b c d. a b c d. " * 4, f"l{i}") for i in range(12)], "text string, lang string").coalesce(1)
    phrases.levels(df, scratch, 3, 2, "text", "lang")
    for name in ("blocks", "bodies-1", "bodies-2"):
        sizes = [r["count"] for r in spark.read.parquet(f"{scratch.path}/{name}").groupBy("_metadata.file_path").count().collect()]
        assert sum(sizes) > 9 and max(sizes) <= phrases.TOGETHER
