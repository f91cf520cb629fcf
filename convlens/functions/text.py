"""Scalar text functions: sentiment, category, topics, cleaning, languages, personal data, hashes, parsing."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens import lexicon as L


def any_of(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur at all."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def occurrences(text: Column, words: Sequence[str]) -> Column:
    """How often the words occur, each without overlap."""
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(re.escape(w))) for w in words])


def sentiment_by_count(text: Column, positive: Sequence[str] = L.POSITIVE, negative: Sequence[str] = L.NEGATIVE) -> Column:
    low = F.lower(text)
    p, n = occurrences(low, positive), occurrences(low, negative)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(F.lit(0.0))


def sentiment_by_presence(text: Column, positive: Sequence[str] = L.POSITIVE[:14], negative: Sequence[str] = L.NEGATIVE[:15]) -> Column:
    low = F.lower(text)
    p, n = hits(low, positive), hits(low, negative)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(F.lit(0.0))


def category_scored(text: Column, categories: Mapping[str, Sequence[str]] = L.CATEGORIES, default: str = "General") -> Column:
    """The category with most distinct matching words; of equals the first declared."""
    low = F.lower(text)
    scored = F.array(*[F.struct(hits(low, w).alias("n"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, (c, w) in enumerate(categories.items())])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["c"]).otherwise(F.lit(default))


def category_cascade(text: Column, categories: Mapping[str, Sequence[str]] = L.CASCADE, default: str = "General") -> Column:
    """The first category any of whose words occurs."""
    low = F.lower(text)
    return F.coalesce(*[F.when(any_of(low, w), F.lit(c)) for c, w in categories.items()], F.lit(default))


def topics(text: Column, topics_: Mapping[str, Sequence[str]] = L.TOPICS, most: int = 5) -> Column:
    low = F.lower(text)
    return F.slice(F.array_compact(F.array(*[F.when(any_of(low, w), F.lit(t)) for t, w in topics_.items()])), 1, most)


def sentiment_label(score: Column, bound: float = 0.2) -> Column:
    return F.when(score > bound, "positive").when(score < -bound, "negative").otherwise("neutral")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_unicode(form: str = "NFC"):
    """Spark has no normalisation function, so this one goes through Arrow, a few texts at a time as Python's own."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = pa.chunked_array([[None if t is None else unicodedata.normalize(form, t) for t in texts.slice(k, 64).to_pylist()] for k in range(0, len(texts), 64)], pa.string())
        return out.combine_chunks() if out.num_chunks != 1 else out.chunk(0)

    return run


def normalize_whitespace(text: Column, keep_lines: bool = False) -> Column:
    """Runs of white space as one blank; or line by line, with empty lines removed."""
    if not keep_lines:
        return strip(F.regexp_replace(text, r"\s+", " "))
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n"), lambda x: strip(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def fix_encoding(text: Column, table: Sequence[tuple[str, str]] = L.MOJIBAKE) -> Column:
    """Replaces known mis-decoded sequences, longest first, then drops control characters but line feed, return and tab."""
    ordered = sorted(table, key=lambda p: -len(p[0]))
    fixed = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), ordered, text)
    return F.regexp_replace(fixed, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def clean_text(text: Column, *, urls: bool = False, emails: bool = False, html: bool = True, special: bool = False, lower: bool = False) -> Column:
    if urls:
        text = F.regexp_replace(text, r"https?://\S+|www\.\S+", "[URL]")
    if emails:
        text = F.regexp_replace(text, r"\S+@\S+", "[EMAIL]")
    if html:
        text = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), L.ENTITIES, F.regexp_replace(text, "<[^>]+>", ""))
    if special:
        text = F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}_\s-]", "")
    return F.lower(text) if lower else text


def compose(*steps):
    """Normalisers one after the other."""
    return lambda text: reduce(lambda t, f: f(t), steps, text)


def pii_flags(text: Column, patterns: Mapping[str, str] = L.PII) -> dict[str, Column]:
    return {k: F.rlike(text, F.lit(p)) for k, p in patterns.items()}


def redact(text: Column, patterns: Mapping[str, tuple[str, str]] = L.REDACT) -> tuple[Column, dict[str, Column]]:
    """The redacted text, and how much of each kind was found; later kinds see what earlier ones left."""
    counts = {}
    for kind, (pattern, label) in patterns.items():
        counts[kind] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, label)
    return text, counts


def names_after(text: Column, indicators: Sequence[str] = L.NAME_INDICATORS, window: int = 50) -> Column:
    """Up to two words after the first hit of each indicator."""
    low = F.lower(text)

    def after(phrase: str) -> Column:
        at = F.locate(phrase, low)
        rest = strip(text.substr(at + len(phrase), F.lit(window)))
        return F.when((at > 0) & (rest != ""), F.array_join(F.slice(F.split(rest, r"\s+"), 1, 2), " "))

    return F.array_compact(F.array(*map(after, indicators)))


def mask_fields(fields: Column, names: Sequence[str] = ("password", "api_key", "token", "secret")) -> Column:
    low = [n.lower() for n in names]
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(low), F.lit("[REDACTED]")).otherwise(v))


def word_tokens(text: Column) -> Column:
    """Number of stretches between white space."""
    return F.when(strip(text) == "", 0).otherwise(F.size(F.split(strip(text), r"\s+")))


def script_language(text: Column, shortest: int = 10) -> tuple[Column, Column]:
    """(language, confidence) by the scripts that occur."""
    short = F.length(strip(text)) < shortest
    found = [(F.rlike(text, F.lit(f"[\\x{{{a}}}-\\x{{{b}}}]")), code) for code, a, b in L.SCRIPTS]
    code = F.coalesce(*[F.when(c, F.lit(k)) for c, k in found], F.lit("en"))
    confidence = F.when(found[0][0], 0.7).when(reduce(lambda a, b: a | b, [c for c, _ in found[1:]]), 0.6).otherwise(0.5)
    return F.when(short, "en").otherwise(code), F.when(short, 0.0).otherwise(confidence)


def _indicators(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    ranges = {"zh": "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]", "ja": "[\\x{3040}-\\x{30FF}]", "ko": "[\\x{AC00}-\\x{D7AF}]", "ar": "[\\x{0600}-\\x{06FF}]", "ru": "[\\x{0400}-\\x{04FF}]"}
    # Scripts need characters beyond Latin ones; most texts have none, and one test tells.
    other = F.rlike(text, F.lit("[\\x{0400}-\\x{04FF}\\x{0600}-\\x{06FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]"))
    scripts = {k: F.when(other, F.regexp_count(text, F.lit(r))).otherwise(0) for k, r in ranges.items()}
    return {"size": F.greatest(F.octet_length(text), F.lit(1)), **scripts, **{k: hits(low, w) for k, w in L.INDICATORS.items()}}


def _by_indicators(n: dict[str, Column]) -> tuple[Column, Column]:
    size = n["size"]
    rules = [
        ("zh", n["zh"] / size > 0.1, F.least(n["zh"] / size, F.lit(1.0))),
        ("ja", n["ja"] > 0, F.least(n["ja"] / size * 10, F.lit(1.0))),
        ("ko", n["ko"] > 0, F.least(n["ko"] / size * 10, F.lit(1.0))),
        ("ar", n["ar"] > 0, F.least(n["ar"] / size * 5, F.lit(1.0))),
        ("ru", n["ru"] > 0, F.least(n["ru"] / size * 5, F.lit(1.0))),
        ("de", (n["de"] >= 3) & (n["de"] > n["es"]) & (n["de"] > n["fr"]), F.least(n["de"] / 10, F.lit(0.9))),
        ("fr", (n["fr"] >= 3) & (n["fr"] > n["es"]), F.least(n["fr"] / 10, F.lit(0.9))),
        ("es", (n["es"] >= 3) & (n["es"] > F.floor(n["en"] / 2)), F.least(n["es"] / 10, F.lit(0.9))),
        ("en", n["en"] >= 5, F.least(n["en"] / 28, F.lit(0.95))),
    ]
    language = F.coalesce(*[F.when(c, F.lit(k)) for k, c, _ in rules], F.lit("unknown"))
    return language, F.coalesce(*[F.when(c, x) for _, c, x in rules], F.lit(0.0))


def indicator_language(text: Column) -> tuple[Column, Column]:
    """(language, confidence) by script shares, then by indicator words as substrings."""
    return _by_indicators(_indicators(text))


def with_indicator_language(rows: DataFrame, text: str = "text", language: str = "language", confidence: str = "confidence") -> DataFrame:
    """``indicator_language`` as two columns; the counts are columns of their own first, so each is taken once a row."""
    counts = _indicators(F.col(text))
    counted = rows.withColumns({f"_n_{k}": c for k, c in counts.items()})
    found = _by_indicators({k: F.col(f"_n_{k}") for k in counts})
    return counted.withColumns({language: found[0], confidence: found[1]}).drop(*[f"_n_{k}" for k in counts])


def language_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in L.LANGUAGE_NAMES.items() for x in p])[code], F.upper(code))


def content_hash(text: Column) -> Column:
    return F.md5(F.lower(strip(text)).cast("binary"))


def anonymity_group(text: Column) -> Column:
    return F.concat(F.lit("group_"), F.substring(F.md5(text.cast("binary")), 1, 8))


def format_duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
        .otherwise(F.format_string("%.1fh", seconds / 3600))
    )


def error_class(message: Column) -> Column:
    low = F.lower(message)
    return F.coalesce(*[F.when(any_of(low, w), F.lit(k)) for k, w in L.ERROR_CLASSES], F.lit("unknown"))


def retry_delay(attempt: Column, initial: float, factor: float, most: float) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(factor), attempt - 1), F.lit(most))


def cluster_radius(size: Column, level: Column) -> Column:
    return F.greatest(F.lit(20.0), F.least(F.lit(80.0), F.lit(30.0) + F.log(size + 1) * 5 * (1 - level * 0.1)))


def facet_number(answer: Column, low: int, high: int) -> Column:
    """A whole number, or the first digits in the answer, clamped; without any the middle."""
    whole, first = strip(answer).try_cast("int"), F.regexp_extract(answer, "([0-9]+)", 1).try_cast("int")
    found = F.coalesce(whole, first)
    return F.when(found.isNull(), (low + high) // 2).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), found)))


def facet_text(answer: Column, prefill: str) -> Column:
    plain = strip(answer)
    return strip(F.when(F.startswith(plain, F.lit(prefill)), F.substr(plain, F.lit(len(prefill) + 1))).otherwise(plain))


def name_and_description(answer: Column) -> Column:
    """Struct of both, null unless both are given."""
    name = strip(F.regexp_extract(answer, r"(?m)^\s*Name:(.*)$", 1))
    text = strip(F.regexp_extract(answer, r"(?m)^\s*Description:(.*)$", 1))
    return F.when((name != "") & (text != ""), F.struct(name.alias("name"), text.alias("description")))


def assignments(answer: Column, items: int, clusters: int) -> Column:
    """Zero-based cluster of each item from lines such as ``2 -> B``; the last wins, anything else is cluster 0."""
    pattern = r"(\d+)\s*->\s*([A-Z])"
    pairs = F.arrays_zip(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)).alias("i"), F.regexp_extract_all(answer, F.lit(pattern), F.lit(2)).alias("c"))

    def of(i: Column) -> Column:
        own = F.filter(pairs, lambda p: (p["i"].try_cast("int") == i) & (F.ascii(p["c"]) - 65 < clusters))
        return F.when(F.size(own) > 0, F.ascii(F.element_at(own, -1)["c"]) - 65).otherwise(0)

    return F.transform(F.sequence(F.lit(1), F.lit(items)), of)


def higher_level_names(answer: Column) -> Column:
    """Array of (name, description): after ``Name:`` in a line, the description in the next line or the same."""
    between = lambda line, mark: strip(F.element_at(F.split(line, mark), 2))
    lines = F.split(answer, "\r?\n")
    none = F.array().cast("array<struct<name:string,description:string>>")

    def step(state: Column, i: Column) -> Column:
        line, after = F.element_at(lines, i), F.try_element_at(lines, i + 1)
        below = F.coalesce(F.contains(after, F.lit("Description:")), F.lit(False))
        text = F.when(below, between(after, "Description:")).when(F.contains(line, F.lit("Description:")), between(line, "Description:"))
        here = F.contains(line, F.lit("Name:")) & ~state["skip"]
        named = F.struct(between(line, "Name:").alias("name"), text.alias("description"))
        out = F.when(here & text.isNotNull(), F.concat(state["out"], F.array(named))).otherwise(state["out"])
        return F.struct(out.alias("out"), (here & below).alias("skip"))

    return F.aggregate(F.sequence(F.lit(1), F.size(lines)), F.struct(none.alias("out"), F.lit(False).alias("skip")), step, lambda s: s["out"])


PATTERN = "struct<name:string,description:string,keywords:array<string>,confidence:double>"


def patterns(answer: Column) -> Column:
    """Array of (name, description, keywords, confidence) from the JSON in an answer, or from its lines."""
    text = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(text != "", text), f"patterns array<{PATTERN}>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # An object without patterns gives none; what is no JSON is read line by line.
    whole = F.when(F.get_json_object(text, "$").isNotNull(), F.coalesce(parsed["patterns"], F.array().cast(f"array<{PATTERN}>")))
    none = F.lit(None).cast(PATTERN)

    def step(state: Column, raw: Column) -> Column:
        line, now = strip(raw), state["now"]
        given = lambda mark: F.startswith(line, F.lit(mark))
        after = lambda mark: strip(F.substr(line, F.lit(len(mark) + 1)))
        changed = lambda **new: F.struct(*[new.get(c, now[c]).alias(c) for c in ("name", "description", "keywords", "confidence")])
        fresh = F.struct(after("Name:").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("keywords"), F.lit(None).cast("double").alias("confidence"))
        score = F.coalesce(after("Confidence:").try_cast("double"), F.lit(0.5))
        new = (
            F.when(given("Name:"), fresh)
            .when(now.isNull(), none)
            .when(given("Description:"), changed(description=after("Description:")))
            .when(given("Keywords:"), changed(keywords=F.transform(F.split(after("Keywords:"), ","), strip)))
            .when(given("Confidence:"), changed(confidence=score))
            .otherwise(now)
        )
        out = F.when(given("Name:") & now.isNotNull(), F.concat(state["out"], F.array(now))).otherwise(state["out"])
        return F.struct(out.alias("out"), new.alias("now"))

    start = F.struct(F.array().cast(f"array<{PATTERN}>").alias("out"), none.alias("now"))
    by_line = F.aggregate(F.split(answer, "\n"), start, step, lambda s: F.when(s["now"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["now"]))))
    return F.coalesce(whole, by_line)


def sentiment_percent(sentiment: Column) -> Column:
    return F.round(F.abs(sentiment) * 100).cast("int")


def pattern_privacy(keywords: Column, sensitive: Sequence[str] = L.SENSITIVE) -> Column:
    risky = F.size(F.filter(keywords, lambda k: any_of(F.lower(k), sensitive)))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(F.greatest(F.lit(0.1), 1 - risky / F.size(keywords)))
