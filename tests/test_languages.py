"""Profiles of trigrams against counting, and texts without any."""

import math
from collections import Counter

from convlens.operators import languages as N

ROWS = [(1, "the cat and the dog, the end", "en"), (2, "der hund und die katze, das ende", "de"), (3, "le chien et le chat, la fin", "fr"), (4, None, "en"), (5, "", "de"), (6, "12 !! 34", "fr"), (7, "THE THE", None), (8, "x" * 50_000 + " the", None)]


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return [f" {w} "[i : i + 3] for w in words for i in range(len(w))]


def test_against_counting(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "id long, text string, language string, gram string")
    profile = N.profiles(df, most=10)
    counts, totals = Counter(), Counter()
    for _, text, lang in ROWS:
        for g in grams(text) if lang else ():
            counts[lang, g] += 1
            totals[lang] += 1
    chosen = {g for lang in totals for g in sorted((g for x, g in counts if x == lang), key=lambda g: (-counts[lang, g], g))[:10]}
    want = {(g, lang): round(1000 * math.log((counts[lang, g] + 1) / (totals[lang] + 1000))) for g in chosen for lang in totals}
    assert {(r["gram"], r["language"]): r["weight"] for r in profile.collect()} == want
    told = {r["id"]: (r["language"], r["grams"]) for r in N.by_profile(df, profile, "id").collect()}
    for i, text, _ in ROWS:
        own = [g for g in grams(text) if g in chosen]
        best = min(totals, key=lambda lang: (-sum(want[g, lang] for g in own), lang)) if own else "unknown"
        assert told[i] == (best, len(own))
    assert [told[i][0] for i in (1, 2, 3, 7)] == ["en", "de", "fr", "en"]
    assert N.by_profile(df, profile.where("false"), "id").where("language <> 'unknown'").count() == 0
    assert N.by_profile(df.where("false"), profile, "id").count() == 0


def test_trigrams_are_never_rows(spark, monkeypatch):
    """Neither for the profile nor for a text; stretches of few characters and a profile too large to go out give the same."""
    df = spark.createDataFrame([(i, t, lang) for i, t, lang in ROWS if i != 8] + [(9, "𝒳𝒴 der İ hund\u0000ß", None)], "id long, text string, language string")
    profile = N.profiles(df, most=10)
    told = N.by_profile(df, profile, "id")
    assert "Generate" not in told._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, told.collect()))
    monkeypatch.setattr(N, "STRETCH", 3)
    assert sorted(map(tuple, N.by_profile(df, N.profiles(df, most=10), "id").collect())) == want
    monkeypatch.setattr(N, "WEIGHTS", 1)
    assert sorted(map(tuple, N.by_profile(df, profile, "id").collect())) == want
