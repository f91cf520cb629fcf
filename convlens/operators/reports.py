"""Reports over whole data sets: validation, data quality, languages, recommendations, recovery, prompts, listings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.functions import text as T
from convlens.operators import conversations as C

#: What is advised for each kind of issue.
ADVICE = {
    "too_short": "Consider filtering out very short conversations",
    "too_long": "Consider truncating very long conversations",
    "missing_role": "Ensure all conversations have both user and assistant messages",
    "pii": "Consider removing or masking PII before processing",
    "encoding_issue": "Fix encoding issues before processing",
}
#: Marks of texts that were cut.
CUT_ENDS = ("...", "\u2026")
CUT_MARKS = ("[truncated]", "[cut off]")


def truncated(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(text, F.lit(e)) for e in CUT_ENDS] + [F.contains(text, F.lit(m)) for m in CUT_MARKS])


def content_quality_issues(messages: DataFrame, *, least: int = 10, most: int = 10_000, words: int = 3) -> DataFrame:
    """(conv_id, turn, severity, issue_type, message) by bytes, words and marks of truncation."""
    text = F.coalesce("text", F.lit(""))
    size, n = F.octet_length(text), T.word_tokens(text)
    issue = lambda s, t, m: F.struct(F.lit(s).alias("severity"), F.lit(t).alias("issue_type"), m.alias("message"))
    found = F.array(
        F.when(size < least, issue("info", "low_quality", F.format_string("Very short message (%d chars)", size))).when(
            size > most, issue("warning", "too_long", F.format_string("Very long message (%d chars), may affect processing", size))
        ),
        F.when((n < words) & (size > 0), issue("info", "low_quality", F.format_string("Message has only %d words", n))),
        F.when(truncated(text), issue("warning", "truncated", F.lit("Message appears to be truncated"))),
    )
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.explode(F.filter(found, lambda i: i.isNotNull())).alias("i"))
    return rows.select("conv_id", "turn", "i.severity", "i.issue_type", "i.message")


def content_quality_score(messages: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: messages, low quality and truncated ones among the issues, and 1 less their share."""
    n = messages.agg(F.count(F.lit(1)).alias("messages"))
    bad = issues.agg(F.count(F.when(F.col("issue_type") == "low_quality", 1)).alias("low_quality"), F.count(F.when(F.col("issue_type") == "truncated", 1)).alias("cut"))
    return n.crossJoin(bad).select("messages", "low_quality", "cut", (1 - (F.col("low_quality") + F.col("cut")) / F.greatest("messages", F.lit(1))).alias("quality"))


def validate(messages: DataFrame, *, least_messages: int = 2, most_messages: int = 1000, least: int = 10, most: int = 50_000, roles: Sequence[str] = ("user", "assistant")) -> DataFrame:
    """Format, content, encoding and copies together, in one row: conversations, issues, errors, invalid, auto_fixable, quality, advice.

    ``errors`` are messages that are not UTF-8, ``invalid`` conversations with one. ``quality`` is the mean of three: the share of
    conversations without an error, 1 less a third of an issue of content for each conversation, and the share that repeat none.
    """
    nested = C.nest(messages)
    formats = C.format_issues(messages, least=least_messages, most=most_messages, roles=roles).select("issue_type", F.lit("f").alias("_k"))
    contents = C.content_issues(messages, least=least, most=most).select("issue_type", F.lit("c").alias("_k"))
    faults = C.encoding_issues(messages)
    whole = F.sha2(F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), ""), 256)
    copies = C.duplicate_issues(nested, whole, "conv_id").select(F.lit("duplicate").alias("issue_type"), F.lit("d").alias("_k"))
    kind = F.col("issue_type")
    # The kinds of issues are few; errors, which only encoding faults are, are told by kind.
    every = formats.unionByName(contents).unionByName(copies).unionByName(faults.select("issue_type", F.lit("e").alias("_k")))
    counts = every.agg(
        F.count(F.lit(1)).alias("issues"), F.count(F.when(kind == "encoding_issue", 1)).alias("errors"), F.count(F.when(F.col("_k") == "c", 1)).alias("_content"),
        F.count(F.when(kind == "duplicate", 1)).alias("_copies"), F.count(F.when(kind.isin("encoding_issue", "duplicate", "too_long"), 1)).alias("auto_fixable"),
        F.array_sort(F.collect_set(F.element_at(F.create_map(*[F.lit(x) for p in ADVICE.items() for x in p]), kind))).alias("_advice"),
    )
    n = F.col("conversations")
    quality = (1 - F.col("invalid") / n + F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_content") / (n * 3))) + (1 - F.col("_copies") / n)) / 3
    advice = F.concat("_advice", F.when(F.col("_copies") > 0, F.array(F.format_string("Remove %d duplicate conversations", "_copies"))).otherwise(F.array().cast("array<string>")))
    joined = nested.agg(F.count(F.lit(1)).alias("conversations")).crossJoin(counts).crossJoin(faults.agg(F.countDistinct("conv_id").alias("invalid")))
    return joined.select("conversations", "issues", "errors", "invalid", "auto_fixable", F.when(n > 0, quality).otherwise(0.0).alias("quality"), advice.alias("advice"))


def language_summary(messages: DataFrame, *, least_chars: int = 10, least_confidence: float = 0.5, default: str = "en") -> DataFrame:
    """One row: languages, the primary one, conversations of several languages, mean confidence over all conversations."""
    all_ = messages.agg(F.countDistinct("conv_id").alias("_all"))
    by = C.by_message_language(messages, T.indicator_language, least_chars=least_chars, least_confidence=least_confidence)
    per = by.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("mixed"), 1)).alias("mixed"), F.sum("confidence").alias("c"))
    one = per.agg(F.count(F.lit(1)).alias("languages"), F.max(F.struct("n", "language"))["language"].alias("p"), F.coalesce(F.sum("mixed"), F.lit(0)).alias("mixed"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("c"))
    return one.crossJoin(all_).select("languages", F.coalesce("p", F.lit(default)).alias("primary_language"), "mixed", (F.col("c") / F.greatest("_all", F.lit(1))).alias("confidence"))


def language_of_bytes(messages: DataFrame, *, least_bytes: int = 20, least_confidence: float = 0.7) -> DataFrame:
    """(conv_id, language, confidence, mixed): 0.8 of the mean confidence for several languages; ``unknown`` and 0 for none."""
    language, confidence = T.indicator_language(F.col("text"))
    known = messages.where(F.octet_length("text") >= least_bytes).select("conv_id", language.alias("language"), confidence.alias("c")).where(F.col("c") >= least_confidence)
    by = known.groupBy("conv_id", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"))
    best = by.groupBy("conv_id").agg(F.max(F.struct("n", "language"))["language"].alias("language"), (F.sum("c") / F.sum("n")).alias("c"), (F.count(F.lit(1)) > 1).alias("mixed"))
    out = messages.select("conv_id").distinct().join(best, "conv_id", "left")
    score = F.coalesce(F.col("c") * F.when(F.col("mixed"), 0.8).otherwise(1.0), F.lit(0.0))
    return out.select("conv_id", F.coalesce("language", F.lit("unknown")).alias("language"), score.alias("confidence"), F.coalesce("mixed", F.lit(False)).alias("mixed"))


def language_of_bytes_summary(detected: DataFrame) -> DataFrame:
    """One row over ``language_of_bytes``: unknown counts as English, a confidence as 0.1 at least."""
    named = detected.withColumn("language", F.when(F.col("language") == "unknown", "en").otherwise(F.col("language")))
    per = named.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("mixed"), 1)).alias("mixed"), F.sum(F.greatest("confidence", F.lit(0.1))).alias("c"))
    return per.agg(
        F.count(F.lit(1)).alias("languages"), F.coalesce(F.max(F.struct("n", "language"))["language"], F.lit("en")).alias("primary_language"),
        F.coalesce(F.sum("mixed"), F.lit(0)).alias("mixed"), (F.coalesce(F.sum("c"), F.lit(0.0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("confidence"),
    )


def data_quality(messages: DataFrame, limit: int, **options) -> DataFrame:
    """One row: half of it validation, three tenths conversations without errors, two tenths confidence in the language."""
    tokens = C.token_stats(C.tokens(messages), limit)
    rows = validate(messages, **options).crossJoin(language_summary(messages)).crossJoin(tokens)
    valid = F.col("conversations") - F.col("invalid")
    score = F.col("quality") * 0.5 + F.coalesce(valid / F.when(F.col("conversations") > 0, F.col("conversations")), F.lit(0.0)) * 0.3 + F.col("confidence") * 0.2
    more = F.filter(
        F.array(
            F.when(F.col("mixed") > F.col("languages") * 0.1, "Consider filtering conversations to a single language"),
            F.when(F.col("over_limit") > 0, F.format_string("Consider truncating %d conversations that exceed token limit", "over_limit")),
            F.when(F.col("average") > 3000, "Consider using smaller batch sizes due to high token counts"),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("conversations", valid.alias("valid"), "auto_fixable", score.alias("score"), F.array_join(F.concat("advice", more), "; ").alias("recommendations"))


def data_quality_bytes(messages: DataFrame, limit: int, *, content_quality: DataFrame, copies: DataFrame) -> DataFrame:
    """The other report: 0.4 validation, 0.2 language, 0.4 the share of conversations without errors; half a second for 1000 tokens."""
    languages = language_of_bytes_summary(language_of_bytes(messages))
    tokens = C.token_stats(C.tokens(messages), limit)
    n = messages.agg(F.countDistinct("conv_id").alias("conversations")).crossJoin(copies.agg(F.count(F.lit(1)).alias("copies")))
    n = n.crossJoin(C.encoding_issues(messages).agg(F.countDistinct("conv_id").alias("invalid")))
    rows = n.crossJoin(content_quality.select("quality")).crossJoin(languages).crossJoin(tokens)
    sound = 1 - F.col("invalid") / F.greatest("conversations", F.lit(1))
    validation = (sound + (1 - F.col("copies") / F.greatest("conversations", F.lit(1))) + F.col("quality")) / 3
    score = validation * 0.4 + F.col("confidence") * 0.2 + F.when(F.col("conversations") > 0, sound * 0.4).otherwise(0.0)
    advice = F.filter(
        F.array(
            F.when(F.col("languages") > 1, F.format_string("Dataset contains %d different languages. Consider separating by language for better results.", "languages")),
            F.when(F.col("over_limit") > 10, F.format_string("%d conversations exceed token limit. Enable truncation or increase limit.", "over_limit")),
            F.when(score < 0.5, "Data quality is low. Consider cleaning data before analysis."),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("conversations", F.col("copies").alias("auto_fixable"), (F.col("total") / 1000 * 0.5).alias("seconds"), score.alias("score"), F.array_join(advice, "; ").alias("recommendations"))


def recommended(conversations: Column, clusters: Column, sensitive: Column) -> dict[str, Column]:
    """Settings of the private analysis from the size of the data."""
    least = F.when(conversations < 100, 5).when(conversations < 1000, 10).otherwise(20)
    return {
        "min_cluster_size": F.when(sensitive, least * 2).otherwise(least), "merge_small": conversations < 100, "higher_prevalence": sensitive,
        "discovery": conversations >= 20, "investigation": conversations >= 20, "map": clusters >= 3,
    }


def suitable(conversations: Column, clusters: Column) -> Column:
    """Whether there are conversations and clusters, of two members each in the mean."""
    return (conversations > 0) & (clusters > 0) & (F.when(clusters > 0, F.floor(conversations / clusters)).otherwise(0) >= 2)


def analysis_summary(clusters: DataFrame, kept: DataFrame, level: str) -> DataFrame:
    """One row of totals from clusters (size) before and after the privacy filter (size, parts)."""
    before = clusters.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_conversations"), F.count(F.lit(1)).alias("total_clusters"))
    after = kept.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("visible_conversations"), F.count(F.lit(1)).alias("filtered_clusters"), F.coalesce(F.sum(F.when(F.col("parts") > 1, F.col("parts"))), F.lit(0)).alias("merged_clusters"))
    gone = (F.col("total_clusters") - F.col("filtered_clusters") - F.col("merged_clusters") + F.when(F.col("merged_clusters") > 0, 1).otherwise(0)).alias("redacted_clusters")
    return before.crossJoin(after).select("*", gone, F.lit(level).alias("privacy_level"))


def topic_summary(rows: DataFrame, topic: str, sentiment: Column, most: int = 10) -> DataFrame:
    """(topic, n, percent, sentiment, patterns): the most frequent topics; patterns are half of a topic's rows, 8 at most."""
    by = rows.groupBy(topic).agg(F.count(F.lit(1)).alias("n"), F.avg(sentiment).alias("sentiment"))
    total = by.agg(F.sum("n").alias("_all"))
    share = F.round(F.col("n") * 100 / F.col("_all"), 6).alias("percent")
    return by.crossJoin(total).orderBy(F.desc("n"), topic).limit(most).select(topic, "n", share, "sentiment", F.least(F.expr("n div 2"), F.lit(8)).alias("patterns"))


def recovery_statistics(calls: DataFrame) -> DataFrame:
    """One row over (attempts, ok, millis): errors, recovered, retries, success rate and mean time of what was recovered."""
    recovered = F.col("ok") & (F.col("attempts") > 1)
    one = calls.agg(
        F.count(F.when(~F.col("ok"), 1)).alias("total_errors"), F.count(F.when(recovered, 1)).alias("recovered"),
        F.coalesce(F.sum(F.when(recovered, F.col("attempts") - 1)), F.lit(0)).alias("retries"), F.avg(F.when(recovered, F.col("millis"))).alias("mean_millis"),
    )
    return one.withColumn("success_rate", F.when(F.col("total_errors") > 0, F.col("recovered") / F.col("total_errors") * 100))


def error_breakdown(messages: DataFrame, message: str) -> DataFrame:
    return messages.groupBy(T.error_class(F.col(message)).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def prompt_metrics(runs: DataFrame) -> DataFrame:
    """(template, kind, usage, success_rate, score): score is the rate times one hundredth more for each use."""
    by = runs.groupBy("template", "kind").agg(F.count(F.lit(1)).alias("usage"), F.avg(F.col("ok").cast("double")).alias("success_rate"))
    return by.withColumn("score", F.col("success_rate") * (1 + F.col("usage") / 100))


def best_templates(metrics: DataFrame) -> DataFrame:
    """The template of highest score of each kind; of equals the least."""
    return metrics.groupBy("kind").agg(F.max(F.struct("score", (-F.col("template")).alias("t"))).alias("b")).select("kind", (-F.col("b.t")).alias("template"), F.col("b.score").alias("score"))


def prompt_words(prompts: DataFrame, text: str, most: int = 10) -> DataFrame:
    """(word, n): the most frequent words of more than four characters."""
    words = prompts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word")).where(F.length("word") > 4)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(most)


def listed(rows: DataFrame, equal: dict[str, object], order: Sequence[Column], most: int | None = None) -> DataFrame:
    """Rows whose columns have the given values (none given: any), in order, the first ``most``."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    ordered = rows.orderBy(*order)
    return ordered if most is None else ordered.limit(most)


def patterns_of_cluster(patterns: DataFrame, cluster) -> DataFrame:
    """Patterns (pattern, clusters) that name the cluster."""
    return patterns.where(F.array_contains("clusters", cluster))


def least_by(providers: DataFrame, by: str, key: str = "provider") -> DataFrame:
    """The enabled provider of least priority or cost; of equals the least key."""
    return providers.where("enabled").agg(F.min(F.struct(by, key)).alias("m")).select(F.col(f"m.{key}").alias(key), F.col(f"m.{by}").alias(by))


def histogram(rows: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """(bucket, n) with upper bounds; one row a bucket that occurs."""
    bucket = F.coalesce(*[F.when(F.col(value) <= b, F.lit(str(b))) for b in bounds], F.lit("more"))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
