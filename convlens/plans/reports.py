"""Queries over the reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convlens.functions import text as T
from convlens.operators import conversations as C
from convlens.operators import insight as I
from convlens.operators import reports as P
from convlens.plans import sql as S
from convlens.plans.conversations import messages
from convlens.plans.documents import CLUSTERS, clusters, documents
from convlens.plans.events import events
from convlens.plans.registry import query
from convlens.session import checkpointed

_CUT = "(ends_with(text, '...') OR ends_with(text, '\u2026') OR contains(text, '[truncated]') OR contains(text, '[cut off]'))"
_MSG = "m AS (SELECT conv_id, turn, CASE WHEN turn = 1 THEN text || '...' ELSE text END AS text FROM conversations)"


def cut_messages(spark, d):
    """Second messages end in dots, so that marks of truncation occur."""
    return messages(spark, d).withColumn("text", F.when(F.col("turn") == 1, F.concat("text", F.lit("..."))).otherwise(F.col("text")))


_ISSUES = f"""i AS (SELECT conv_id, turn, 'info' AS severity, 'low_quality' AS issue_type, 'Very short message (' || strlen(text) || ' chars)' AS message FROM m WHERE strlen(text) < 60
UNION ALL SELECT conv_id, turn, 'warning', 'too_long', 'Very long message (' || strlen(text) || ' chars), may affect processing' FROM m WHERE strlen(text) > 1500
UNION ALL SELECT conv_id, turn, 'info', 'low_quality', 'Message has only ' || {S.words('text')} || ' words' FROM m WHERE {S.words('text')} < 8 AND strlen(text) > 0
UNION ALL SELECT conv_id, turn, 'warning', 'truncated', 'Message appears to be truncated' FROM m WHERE {_CUT})"""


@query("content_quality_issues", f"WITH {_MSG}, {_ISSUES} SELECT * FROM i")
def content_quality_issues(spark, d):
    return P.content_quality_issues(cut_messages(spark, d), least=60, most=1500, words=8)


_QUALITY = "q AS (SELECT count(*) FILTER (issue_type = 'low_quality') AS low_quality, count(*) FILTER (issue_type = 'truncated') AS cut FROM i), z AS (SELECT n AS messages, low_quality, cut, 1 - (low_quality + cut) / n AS quality FROM q, (SELECT count(*) AS n FROM m))"


@query("content_quality_score", f"WITH {_MSG}, {_ISSUES}, {_QUALITY} SELECT messages, low_quality, cut, round(quality, 6) AS quality FROM z")
def content_quality_score(spark, d):
    m = cut_messages(spark, d)
    return P.content_quality_score(m, P.content_quality_issues(m, least=60, most=1500, words=8)).withColumn("quality", F.round("quality", 6))


_PII = " + ".join(f"CAST({c} AS INT)" for c in S.flags("text", __import__("convlens.lexicon", fromlist=["PII"]).PII).values())
_VALID = f"""c AS (SELECT conv_id, count(*) AS n, list(DISTINCT role) AS roles, string_agg(text, '' ORDER BY turn) AS whole FROM conversations GROUP BY conv_id),
r AS (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
k AS (SELECT count(*) AS conversations, count(*) FILTER (n < 4) AS short, count(*) FILTER (n > 6) AS long, sum((NOT list_contains(roles, 'user'))::INT + (NOT list_contains(roles, 'assistant'))::INT + (NOT list_contains(roles, 'system'))::INT) AS missing, count(*) - count(DISTINCT whole) AS copies FROM c),
a AS (SELECT count(*) AS again FROM r WHERE role = p AND role <> 'system'),
t AS (SELECT count(*) FILTER (length(text) < 60) + count(*) FILTER (length(text) > 1500) AS sizes, coalesce(sum({_PII}), 0) AS pii FROM conversations),
v AS (SELECT conversations, CAST(short + long + missing + again + sizes + pii + copies AS BIGINT) AS issues, CAST(0 AS BIGINT) AS errors, CAST(long + copies AS BIGINT) AS auto_fixable,
(1.0 + greatest(0.0, least(1.0, 1 - (sizes + pii) / (conversations * 3))) + 1 - copies / conversations) / 3 AS quality,
concat_ws('; ', CASE WHEN pii > 0 THEN 'Consider removing or masking PII before processing' END, CASE WHEN short > 0 THEN 'Consider filtering out very short conversations' END, CASE WHEN long > 0 THEN 'Consider truncating very long conversations' END, CASE WHEN missing > 0 THEN 'Ensure all conversations have both user and assistant messages' END, CASE WHEN copies > 0 THEN 'Remove ' || copies || ' duplicate conversations' END) AS advice FROM k, a, t)"""
_OPTIONS = dict(least_messages=4, most_messages=6, least=60, most=1500, roles=("user", "assistant", "system"))


@query("validate", f"WITH {_VALID} SELECT conversations, issues, errors, auto_fixable, round(quality, 6) AS quality, list_aggregate(list_sort(string_split(advice, '; ')), 'string_agg', '; ') AS advice FROM v")
def validate(spark, d):
    return P.validate(messages(spark, d), **_OPTIONS).drop("invalid").withColumns({"quality": F.round("quality", 6), "advice": F.array_join(F.array_sort("advice"), "; ")})


def damaged(spark, d):
    """Every fifth conversation as bytes in Latin-1, which are not UTF-8 where a letter has an accent; the others as they are."""
    m = messages(spark, d)
    return C.decoded(m.withColumn("raw", F.when(F.col("conv_id") % 5 == 0, F.encode(F.regexp_replace("text", "[^\\x00-\\xff]", "?"), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))), "raw")


_FAULT = r"f AS (SELECT conv_id, turn FROM conversations WHERE conv_id % 5 = 0 AND regexp_matches(text, '[\x{80}-\x{ff}]'))"


@query("encoding_issues", f"WITH {_FAULT} SELECT conv_id, CAST(turn AS BIGINT) AS turn, 'encoding_issue' AS issue_type FROM f")
def encoding_issues(spark, d):
    return C.encoding_issues(damaged(spark, d)).drop("message")


@query("validate_bytes", f"WITH {_FAULT} SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, count(*) AS errors, count(DISTINCT conv_id) AS invalid, 1 - round(count(DISTINCT conv_id) / (SELECT count(DISTINCT conv_id) FROM conversations), 6) AS valid_ratio FROM f")
def validate_bytes(spark, d):
    """Validation of messages read as bytes."""
    v = P.validate(damaged(spark, d), **_OPTIONS)
    return v.select("conversations", "errors", "invalid", (1 - F.round(F.col("invalid") / F.col("conversations"), 6)).alias("valid_ratio"))


_LANG = f"""lm AS (SELECT conv_id, {S.language('text')[0]} AS language, {S.language('text')[1]} AS c FROM conversations WHERE length(text) > 10),
lb AS (SELECT conv_id, language, count(*) AS n, sum(c) AS c FROM lm WHERE c >= 0.5 GROUP BY ALL), lc AS (SELECT conv_id, max({{'n': n, 'language': language}}).language AS language, round(sum(c) / sum(n), 6) AS confidence, count(*) > 1 AS mixed FROM lb GROUP BY conv_id),
lp AS (SELECT language, count(*) AS n, count(*) FILTER (mixed) AS mixed, sum(confidence) AS c FROM lc GROUP BY language),
ls AS (SELECT count(*) AS languages, coalesce(max({{'n': n, 'language': language}}).language, 'en') AS primary_language, CAST(coalesce(sum(mixed), 0) AS BIGINT) AS mixed, coalesce(sum(c), 0) / (SELECT count(DISTINCT conv_id) FROM conversations) AS confidence FROM lp)"""


@query("language_summary", f"WITH {_LANG} SELECT languages, primary_language, mixed, round(confidence, 6) AS confidence FROM ls")
def language_summary(spark, d):
    return P.language_summary(messages(spark, d)).withColumn("confidence", F.round("confidence", 6))


_TOKENS = f"tk AS (SELECT conv_id, CAST(sum({S.words('text')}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id), ts AS (SELECT sum(tokens) AS total, avg(tokens) AS average, count(*) FILTER (tokens > 600) AS over_limit FROM tk)"


@query("data_quality", f"""WITH {_VALID}, {_LANG}, {_TOKENS} SELECT conversations, conversations AS valid, auto_fixable, round(quality * .5 + .3 + confidence * .2, 6)::DOUBLE AS score,
concat_ws('; ', nullif(advice, ''), CASE WHEN mixed > languages * .1 THEN 'Consider filtering conversations to a single language' END, CASE WHEN over_limit > 0 THEN 'Consider truncating ' || over_limit || ' conversations that exceed token limit' END, CASE WHEN average > 3000 THEN 'Consider using smaller batch sizes due to high token counts' END) AS recommendations FROM v, ls, ts""")
def data_quality(spark, d):
    order = {x: i for i, x in enumerate(("pii", "too_short", "too_long", "missing_role"))}
    assert set(order) <= set(P.ADVICE)
    r = P.data_quality(messages(spark, d), 600, **_OPTIONS)
    return r.withColumn("score", F.round("score", 6))


_BYTES = f"""bm AS (SELECT conv_id, {S.language('text')[0]} AS language, {S.language('text')[1]} AS c FROM conversations WHERE strlen(text) >= 20), bb AS (SELECT conv_id, language, count(*) AS n, sum(c) AS c FROM bm WHERE c >= 0.7 GROUP BY ALL),
bc AS (SELECT conv_id, max({{'n': n, 'language': language}}).language AS language, sum(c) / sum(n) * CASE WHEN count(*) > 1 THEN 0.8 ELSE 1.0 END AS confidence, count(*) > 1 AS mixed FROM bb GROUP BY conv_id),
bd AS (SELECT conv_id, coalesce(language, 'unknown') AS language, coalesce(confidence, 0) AS confidence, coalesce(mixed, false) AS mixed FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN bc USING (conv_id)),
bp AS (SELECT CASE language WHEN 'unknown' THEN 'en' ELSE language END AS language, count(*) AS n, sum(greatest(confidence, 0.1)) AS c FROM bd GROUP BY 1),
bs AS (SELECT count(*) AS languages, sum(c) / sum(n) AS confidence FROM bp)"""


@query("language_of_bytes", f"WITH {_BYTES} SELECT conv_id, language, round(confidence, 6)::DOUBLE AS confidence, mixed FROM bd")
def language_of_bytes(spark, d):
    return P.language_of_bytes(messages(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("data_quality_bytes", f"""WITH {_MSG}, {_ISSUES}, {_QUALITY}, {_BYTES}, {_TOKENS}, cp AS (SELECT count(*) AS conversations, count(*) - count(DISTINCT whole) AS copies FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS whole FROM conversations GROUP BY conv_id)),
sc AS (SELECT *, (1.0 + 1 - copies / conversations + quality) / 3 * .4 + confidence * .2 + .4 AS score FROM cp, z, bs, ts)
SELECT conversations, copies AS auto_fixable, round(total / 1000 * .5, 6)::DOUBLE AS seconds, round(score, 6)::DOUBLE AS score,
concat_ws('; ', CASE WHEN languages > 1 THEN 'Dataset contains ' || languages || ' different languages. Consider separating by language for better results.' END, CASE WHEN over_limit > 10 THEN over_limit || ' conversations exceed token limit. Enable truncation or increase limit.' END, CASE WHEN score < .5 THEN 'Data quality is low. Consider cleaning data before analysis.' END) AS recommendations FROM sc""")
def data_quality_bytes(spark, d):
    m = cut_messages(spark, d)
    quality = P.content_quality_score(m, P.content_quality_issues(m, least=60, most=1500, words=8))
    whole = messages(spark, d)
    copies = C.duplicate_issues(C.nest(whole), F.sha2("text", 256), "conv_id")
    return P.data_quality_bytes(whole, 600, content_quality=quality, copies=copies).withColumns({"score": F.round("score", 6), "seconds": F.round("seconds", 6)})


@query("recommend_config", """SELECT source, n AS conversations, CASE WHEN n < 100 THEN 5 WHEN n < 1000 THEN 10 ELSE 20 END * CASE WHEN s THEN 2 ELSE 1 END AS min_cluster_size, n < 100 AS merge_small, s AS higher_prevalence, n >= 20 AS discovery, n >= 20 AS investigation, k >= 3 AS map, n > 0 AND k > 0 AND n // k >= 2 AS suitable
FROM (SELECT source, count(*) AS n, count(DISTINCT lang) AS k, bool_or(contains(text, '@')) AS s FROM documents GROUP BY source)""")
def recommend_config(spark, d):
    by = documents(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("conversations"), F.countDistinct("lang").alias("k"), F.bool_or(F.contains("text", F.lit("@"))).alias("s"))
    n, k, s = F.col("conversations"), F.col("k"), F.col("s")
    return by.select("source", "conversations", *[c.alias(name) for name, c in P.recommended(n, k, s).items()], P.suitable(n, k).alias("suitable"))


@query("analysis_summary", f"""WITH {CLUSTERS}, l AS (SELECT size, 1 AS parts FROM c WHERE size >= 3 UNION ALL SELECT s, p FROM (SELECT sum(size) AS s, count(*) AS p FROM c WHERE size < 3) WHERE s >= 3),
a AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS visible_conversations, count(*) AS filtered_clusters, CAST(coalesce(sum(parts) FILTER (parts > 1), 0) AS BIGINT) AS merged_clusters FROM l), b AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total_conversations, count(*) AS total_clusters FROM c)
SELECT *, total_clusters - filtered_clusters - merged_clusters + CASE WHEN merged_clusters > 0 THEN 1 ELSE 0 END AS redacted_clusters, 'low' AS privacy_level FROM b, a""")
def analysis_summary(spark, d):
    c = clusters(spark, d)
    return P.analysis_summary(c, I.privacy_filter(c, 3), "low")


@query("topic_summary", f"SELECT source, n, round(n * 100 / sum(n) OVER (), 6)::DOUBLE AS percent, round(s, 6)::DOUBLE AS sentiment, least(n // 2, 8) AS patterns FROM (SELECT source, count(*) AS n, avg({S.presence('lower(text)', ('the', 'und', 'est'), ('with', 'der', 'los'))}) AS s FROM documents GROUP BY source) ORDER BY n DESC, source LIMIT 10")
def topic_summary(spark, d):
    mood = T.sentiment_by_presence(F.col("text"), ("the", "und", "est"), ("with", "der", "los"))
    return P.topic_summary(documents(spark, d), "source", mood).withColumn("sentiment", F.round("sentiment", 6))


_MOOD = f"round({S.presence('lower(text)', ('the', 'und', 'est'), ('with', 'der', 'los'))}, 6)"


@query("sentiment_labels", f"SELECT doc_id, CASE WHEN s > .2 THEN 'positive' WHEN s < -.2 THEN 'negative' ELSE 'neutral' END AS label, CAST(round(abs(s) * 100) AS INT) AS percent FROM (SELECT doc_id, {_MOOD} AS s FROM documents)")
def sentiment_labels(spark, d):
    s = F.round(T.sentiment_by_presence(F.col("text"), ("the", "und", "est"), ("with", "der", "los")), 6)
    rows = documents(spark, d).select("doc_id", s.alias("s"))
    return rows.select("doc_id", T.sentiment_label(F.col("s"), 0.2).alias("label"), T.sentiment_percent(F.col("s")).alias("percent"))


@query("higher_level_names", """SELECT doc_id, source AS name, lang AS description FROM documents UNION ALL SELECT doc_id, 'Two Description: both', 'both' FROM documents""")
def higher_level_names(spark, d):
    answer = F.concat(F.lit("Groups:\nName: "), "source", F.lit("\n  Description: "), "lang", F.lit(" \nName: lost\n\nName: Two Description: both"))
    return documents(spark, d).select("doc_id", F.explode(T.higher_level_names(answer)).alias("g")).select("doc_id", "g.name", "g.description")


@query("pattern_answers", """SELECT doc_id, source AS name, lang AS description, 2 AS keywords, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS confidence FROM documents""")
def pattern_answers(spark, d):
    json = F.concat(F.lit('Here: {"patterns": [{"name": "'), "source", F.lit('", "description": "'), "lang", F.lit('", "keywords": ["a", "b"], "confidence": 0.25}]} done'))
    lines = F.concat(F.lit("Name: "), "source", F.lit("\nDescription: "), "lang", F.lit("\nKeywords: a, b\nConfidence: high"))
    found = T.patterns(F.when(F.col("doc_id") % 2 == 0, lines).otherwise(json))
    return documents(spark, d).select("doc_id", F.explode(found).alias("p")).select("doc_id", "p.name", "p.description", F.size("p.keywords").alias("keywords"), "p.confidence")


@query("patterns_of_cluster", "SELECT lang AS pattern, len(list(DISTINCT source)) AS clusters FROM documents GROUP BY lang HAVING list_contains(list(DISTINCT source), 'src1')")
def patterns_of_cluster(spark, d):
    p = documents(spark, d).groupBy(F.col("lang").alias("pattern")).agg(F.collect_set("source").alias("clusters"))
    return P.patterns_of_cluster(p, "src1").select("pattern", F.size("clusters").cast("long").alias("clusters"))


_RUNS = "(SELECT event_id, user_id % 4 + 1 AS attempts, event_type <> 'error' AS ok, value AS millis, user_id % 7 AS template, event_type FROM events)"


def runs(spark, d):
    e = events(spark, d)
    return e.select("event_id", (F.col("user_id") % 4 + 1).alias("attempts"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("millis"), (F.col("user_id") % 7).cast("long").alias("template"), "event_type")


@query("recovery_statistics", f"SELECT count(*) FILTER (NOT ok) AS total_errors, count(*) FILTER (ok AND attempts > 1) AS recovered, CAST(coalesce(sum(attempts - 1) FILTER (ok AND attempts > 1), 0) AS BIGINT) AS retries, round(avg(millis) FILTER (ok AND attempts > 1), 6) AS mean_millis, round(count(*) FILTER (ok AND attempts > 1) / count(*) FILTER (NOT ok) * 100, 6) AS success_rate FROM {_RUNS}")
def recovery_statistics(spark, d):
    return P.recovery_statistics(runs(spark, d)).withColumns({"mean_millis": F.round("mean_millis", 6), "success_rate": F.round("success_rate", 6)})


@query("error_breakdown", "SELECT CASE event_type WHEN 'error' THEN 'timeout' WHEN 'purchase' THEN 'rate_limit' WHEN 'view' THEN 'network' ELSE 'unknown' END AS error_type, count(*) AS n FROM events GROUP BY 1")
def error_breakdown(spark, d):
    said = F.when(F.col("event_type") == "error", "Request timed out").when(F.col("event_type") == "purchase", "429 Too Many Requests").when(F.col("event_type") == "view", "Connection reset").otherwise(F.col("event_type"))
    return P.error_breakdown(events(spark, d).select(said.alias("message")), "message")


_METRICS = f"pm AS (SELECT template, template % 2 AS kind, count(*) AS usage, avg(ok::INT) AS success_rate FROM {_RUNS} GROUP BY ALL), ps AS (SELECT *, success_rate * (1 + usage / 100) AS score FROM pm)"


def metrics(spark, d):
    return P.prompt_metrics(runs(spark, d).withColumn("kind", F.col("template") % 2))


@query("prompt_metrics", f"WITH {_METRICS} SELECT template, kind, usage, round(success_rate, 6) AS success_rate, round(score, 6) AS score FROM ps")
def prompt_metrics(spark, d):
    return metrics(spark, d).withColumns({"success_rate": F.round("success_rate", 6), "score": F.round("score", 6)})


@query("best_templates", f"WITH {_METRICS} SELECT kind, template, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, template) AS r FROM ps) WHERE r = 1")
def best_templates(spark, d):
    return P.best_templates(metrics(spark, d)).withColumn("score", F.round("score", 6))


@query("prompt_words", "WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM conversations) SELECT word, count(*) AS n FROM w WHERE length(word) > 4 GROUP BY word ORDER BY n DESC, word LIMIT 10")
def prompt_words(spark, d):
    return P.prompt_words(messages(spark, d), "text")


@query("template_list", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#11' ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def template_list(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet")
    return P.listed(rows, {"p_brand": "Brand#11", "p_size": None}, [F.desc("p_retailprice"), F.col("p_partkey")], 20).select("p_partkey", "p_name")


def providers(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("provider"), F.col("s_nationkey").alias("priority"), F.col("s_acctbal").alias("cost"), (F.col("s_acctbal") > 0).alias("enabled"))


@query("provider_choice", """WITH p AS (SELECT s_suppkey AS provider, s_nationkey AS priority, s_acctbal AS cost FROM supplier WHERE s_acctbal > 0)
SELECT 'priority' AS rule, (SELECT provider FROM p ORDER BY priority, provider LIMIT 1) AS provider UNION ALL SELECT 'cost', (SELECT provider FROM p ORDER BY cost, provider LIMIT 1)""")
def provider_choice(spark, d):
    p = providers(spark, d)
    choose = lambda by: P.least_by(p, by).select(F.lit(by).alias("rule"), "provider")
    return choose("priority").unionByName(choose("cost"))


@query("value_histogram", "SELECT CASE WHEN value <= 10 THEN '10' WHEN value <= 50 THEN '50' WHEN value <= 100 THEN '100' ELSE 'more' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def value_histogram(spark, d):
    return P.histogram(events(spark, d), "value", (10, 50, 100))


@query("privacy_scores", """SELECT source, n, round(((CASE WHEN p THEN .5 ELSE 1.0 END) + k / n + (CASE WHEN n >= 100 THEN 1.0 ELSE .7 END)) / 3, 6)::DOUBLE AS score, CASE WHEN k <= 5 THEN 'low' WHEN k <= 15 THEN 'medium' WHEN k <= 50 THEN 'high' ELSE 'very high' END AS level
FROM (SELECT source, count(*) AS n, count(DISTINCT lang) * 5 AS k, bool_or(contains(text, '@')) AS p FROM documents GROUP BY source)""")
def privacy_scores(spark, d):
    by = documents(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("lang") * 5).alias("k"), F.bool_or(F.contains("text", F.lit("@"))).alias("p"))
    score = I.overall_score(~F.col("p"), F.col("k") / F.col("n"), F.col("n") >= 100)
    return by.select("source", "n", F.round(score, 6).alias("score"), I.privacy_level(F.col("k")).alias("level"))


@query("cross_patterns", "SELECT source AS parent, count(*) AS children FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source HAVING count(*) > 1")
def cross_patterns(spark, d):
    return I.cross_patterns(documents(spark, d).select(F.col("source").alias("parent"), "lang").distinct())


@query("composed_cleaning", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 'the', 'THE', 'g')) AS text FROM documents")
def composed_cleaning(spark, d):
    clean = T.compose(T.strip, lambda t: F.replace(t, F.lit("the"), F.lit("THE")))
    return documents(spark, d).select("doc_id", F.md5(clean(F.col("text")).cast("binary")).alias("text"))


@query("vote_names", """WITH w AS (SELECT source AS cluster, doc_id, string_split_regex(regexp_replace(left(text, 500), '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM documents WHERE n_chars > 100),
k AS (SELECT * FROM w WHERE len(w) >= 4), r AS (SELECT cluster, array_to_string(w[1:4], ' ') AS name, row_number() OVER (PARTITION BY cluster, r ORDER BY md5(doc_id || ':' || r)) AS n FROM k, range(3) AS x(r)),
v AS (SELECT cluster, name, count(*) AS votes FROM r WHERE n = 1 GROUP BY ALL) SELECT cluster, name, votes FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY votes DESC, name DESC) AS n FROM v) WHERE n = 1""")
def vote_names(spark, d):
    """Sources named by the stub, which takes the first words of its first example."""
    from convlens.operators import naming as N
    from convlens.providers import StubText

    members = documents(spark, d).where("n_chars > 100").select(F.col("source").alias("cluster"), F.col("doc_id").alias("id"), "text")
    words = F.split(T.strip(F.left("text", F.lit(500))), r"\s+")
    return N.vote_names(members.where(F.size(words) >= 4), StubText()).select("cluster", "name", "votes")


@query("named_hierarchy")
def named_hierarchy(spark, d):
    from convlens.operators import naming as N
    from convlens.operators import vectors as X
    from convlens.plans.vectors import vectors
    from convlens.providers import StubText

    fine = vectors(spark, d).withColumn("label", (F.col("label") * 6 + F.col("id") % 6).cast("int"))
    c = X.centroids(fine, "label").select(F.col("label").alias("cluster"), F.col("centroid").alias("v"), F.concat(F.lit("cluster "), F.col("label").cast("string")).alias("name"))
    return N.named_hierarchy(c, StubText()).withColumn("top", F.col("parent").isNull()).withColumn("parent", F.coalesce("parent", F.lit(-1)))


@query("facet_hierarchy", """WITH c AS (SELECT lang AS facet, source AS name, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT lang, source FROM documents)),
k AS (SELECT *, i % greatest(n // 3, 1) AS k FROM c), p AS (SELECT facet, k, count(*) AS size FROM k GROUP BY ALL)
SELECT 0 AS level, k.facet, k.name, f.name || ' (' || least(size, 10) || ')' AS parent FROM k JOIN p ON p.facet = k.facet AND p.k = k.k JOIN c AS f ON f.facet = k.facet AND f.i = k.k
UNION ALL SELECT 1, p.facet, f.name || ' (' || least(size, 10) || ')', NULL FROM p JOIN c AS f ON f.facet = p.facet AND f.i = p.k""")
def facet_hierarchy(spark, d):
    """Sources as clusters of each language's facet, one level up by the stub's names, assignments and renamings."""
    from convlens.operators import naming as N
    from convlens.providers import StubOrganiser

    by = documents(spark, d).groupBy(F.col("lang").alias("facet"), F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("size"))
    number = F.dense_rank().over(Window.orderBy("facet", "name")).cast("long")  # one row for each language and source
    c = by.select(number.alias("cluster"), "facet", "name", F.col("n").cast("string").alias("summary"), F.array(F.col("n").cast("double"), "size").alias("v"))
    found = checkpointed(N.facet_hierarchy(c, StubOrganiser(), average=1000, most_levels=1, least_top=0))
    names = found.select((F.col("level") - 1).alias("level"), F.col("cluster").alias("parent"), F.col("name").alias("above"))
    return found.join(names, ["level", "parent"], "left").select("level", "facet", "name", F.col("above").alias("parent"))


@query("diverse_examples", "SELECT * FROM (VALUES ('Bug Report', 26::BIGINT), ('Support', 26), ('Feedback', 25), ('Sales', 25)) AS v(category, n)")
def diverse_examples(spark, d):
    from convlens.sources import readers as R

    return R.diverse_examples(spark, 102).groupBy("category").agg(F.count_distinct("conv_id").alias("n"))


@query("session_copy", "SELECT 'copy' AS session_id, event_id, event_type FROM events WHERE user_id = 3")
def session_copy(spark, d):
    from convlens.sources import writers as W

    own = events(spark, d).where("user_id = 3").select(F.col("user_id").cast("string").alias("session_id"), "event_id", "event_type")
    return W.session_copy(own, "copy")


@query("log_lines", """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS line FROM events""")
def log_lines(spark, d):
    from convlens.sources import writers as W

    return W.log_lines(events(spark, d).select("event_id", "event_type"))


@query("estimates", """SELECT source, n * CASE WHEN source LIKE '%1' THEN 0.5 WHEN source LIKE '%2' THEN 1.0 ELSE 0.75 END::DOUBLE AS seconds, round(n * CASE WHEN source LIKE '%1' THEN 0.002 ELSE 0.0 END, 6)::DOUBLE AS dollars FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def estimates(spark, d):
    from convlens.providers import estimates

    by = documents(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    provider = F.when(F.col("source").endswith("1"), "openai").when(F.col("source").endswith("2"), "ollama").otherwise("other")
    seconds, dollars = estimates(provider, F.lit("gpt-4o-mini"), F.col("n"))
    return by.select("source", seconds.alias("seconds"), F.round(dollars, 6).alias("dollars"))
