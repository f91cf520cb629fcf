"""Queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convlens import lexicon as L
from convlens.functions import text as T
from convlens.operators import conversations as C
from convlens.plans import sql as S
from convlens.plans.registry import query


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.nest(messages(spark, sf_dir))


CONV = "c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n_messages FROM conversations GROUP BY conv_id)"
TOKENS = f"t AS (SELECT conv_id, CAST(sum({S.words('text')}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id)"


@query("conv_process", f"WITH {CONV} SELECT conv_id, {S.cascade('lower(text)', L.CASCADE)} AS category, round({S.presence('lower(text)', L.POSITIVE[:14], L.NEGATIVE[:15])}, 6) AS sentiment, n_messages, left(text, 200) AS preview FROM c")
def conv_process(spark, d):
    return C.categorized(nested(spark, d))


@query("conv_process_custom", f"WITH {CONV} SELECT conv_id, {S.cascade('lower(text)', L.FREQUENT)} AS category, round({S.presence('lower(text)', ('the', 'und', 'est'), ('with', 'der', 'los'))}, 6) AS sentiment FROM c")
def conv_process_custom(spark, d):
    t = F.col("text")
    return nested(spark, d).select("conv_id", T.category_cascade(t, L.FREQUENT).alias("category"), F.round(T.sentiment_by_presence(t, ("the", "und", "est"), ("with", "der", "los")), 6).alias("sentiment"))


@query("category_clusters", f"""WITH {CONV}, k AS (SELECT {S.cascade('lower(text)', L.FREQUENT)} AS name, conv_id FROM c),
g AS (SELECT name, count(*) AS count, min(conv_id) AS first_conv FROM k GROUP BY name)
SELECT row_number() OVER (ORDER BY first_conv) AS cluster_id, name, count, first_conv,
CASE WHEN name = 'General' THEN 'General conversation topics and discussions' ELSE 'Various conversation topics' END AS description, CASE WHEN name = 'General' THEN 'conversation,discussion,chat' ELSE '' END AS keywords FROM g""")
def category_clusters(spark, d):
    return C.category_clusters(nested(spark, d), T.category_cascade(F.col("text"), L.FREQUENT))


@query("corpus_stats", f"WITH {CONV} SELECT count(*) AS conversations, CAST(sum(n_messages) AS BIGINT) AS messages, min(n_messages) AS least, max(n_messages) AS most, CAST(sum(n_messages) AS BIGINT) // count(*) AS average FROM c")
def corpus_stats(spark, d):
    return C.corpus_stats(nested(spark, d))


@query("sentiment_count", f"WITH {CONV} SELECT conv_id, round({S.counts('lower(text)', ('the', 'and', 'great', 'und'), ('with', 'der', 'bad'))}, 6) AS sentiment, round({S.counts('lower(text)', L.POSITIVE, L.NEGATIVE)}, 6) AS standard FROM c")
def sentiment_count(spark, d):
    t = F.col("text")
    custom = T.sentiment_by_count(t, ("the", "and", "great", "und"), ("with", "der", "bad"))
    return nested(spark, d).select("conv_id", F.round(custom, 6).alias("sentiment"), F.round(T.sentiment_by_count(t), 6).alias("standard"))


@query("category_scored", f"WITH {CONV} SELECT conv_id, {S.scored('lower(text)', L.FREQUENT)} AS category, {S.scored('lower(text)', L.CATEGORIES)} AS standard FROM c")
def category_scored(spark, d):
    return nested(spark, d).select("conv_id", T.category_scored(F.col("text"), L.FREQUENT).alias("category"), T.category_scored(F.col("text")).alias("standard"))


@query("category_short_cascade", f"WITH {CONV} SELECT conv_id, {S.cascade('lower(text)', L.CASCADE_SHORT)} AS category, round({S.presence('lower(text)', L.POSITIVE[:12], L.NEGATIVE[:13])}, 6) AS sentiment FROM c")
def category_short_cascade(spark, d):
    t = F.col("text")
    return nested(spark, d).select("conv_id", T.category_cascade(t, L.CASCADE_SHORT).alias("category"), F.round(T.sentiment_by_presence(t, L.POSITIVE[:12], L.NEGATIVE[:13]), 6).alias("sentiment"))


@query("topics", f"WITH {CONV} SELECT conv_id, list_aggregate({S.topics('lower(text)', L.FREQUENT)}, 'string_agg', ',') AS topics FROM c")
def topics(spark, d):
    found = F.array_join(T.topics(F.col("text"), L.FREQUENT), ",")
    return nested(spark, d).select("conv_id", F.when(found != "", found).alias("topics"))


@query("role_texts", """SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS user_text,
coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS assistant_text, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id""")
def role_texts(spark, d):
    say = lambda r: F.array_join(F.transform(C.of_role(F.col("messages"), r), lambda m: m["content"]), " ")
    return nested(spark, d).select("conv_id", say("user").alias("user_text"), say("assistant").alias("assistant_text"), C.prompt_text(F.col("messages")).alias("prompt"))


@query("format_issues", """WITH n AS (SELECT conv_id, count(*) AS n, list(DISTINCT role) AS roles FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(NULL AS BIGINT) AS turn, 'warning' AS severity, 'too_short' AS issue_type, 'Conversation has only ' || n || ' messages' AS message FROM n WHERE n < 4
UNION ALL SELECT conv_id, NULL, 'warning', 'too_long', 'Conversation has ' || n || ' messages, may be truncated' FROM n WHERE n > 6
UNION ALL SELECT conv_id, NULL, 'warning', 'missing_role', 'Missing ''' || r || ''' role in conversation' FROM n, (VALUES ('user'), ('assistant'), ('system')) v(r) WHERE NOT list_contains(roles, r)
UNION ALL SELECT conv_id, turn, 'info', 'invalid_format', 'Consecutive messages from same role: ' || role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'assistant' ELSE role END AS role FROM conversations)) WHERE role = p AND role <> 'system'""")
def format_issues(spark, d):
    m = messages(spark, d)
    # With every fifth message given to the assistant, roles repeat, so that the rule has something to find.
    again = m.withColumn("role", F.when(F.col("turn") % 5 == 4, "assistant").otherwise(F.col("role")))
    gaps = C.format_issues(again, least=0, most=1 << 30, roles=())
    return C.format_issues(m, least=4, most=6, roles=("user", "assistant", "system")).where("issue_type <> 'invalid_format'").unionByName(gaps)


@query("content_issues", f"""SELECT conv_id, turn, 'low_quality' AS issue_type, 'Message content too short (' || length(text) || ' chars)' AS message FROM conversations WHERE length(text) < 60
UNION ALL SELECT conv_id, turn, 'truncated', 'Message content too long (' || length(text) || ' chars)' FROM conversations WHERE length(text) > 1500
UNION ALL SELECT conv_id, turn, 'pii', 'Potential ' || k || ' detected' FROM (SELECT conv_id, turn, unnest([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in S.flags('text', L.PII).items())}]) AS k FROM conversations) WHERE k IS NOT NULL""")
def content_issues(spark, d):
    return C.content_issues(messages(spark, d), least=60, most=1500)


@query("content_score", "SELECT n, issues, round(greatest(0.0, least(1.0, 1 - issues / (n * 3.0))), 6) AS score FROM (SELECT count(DISTINCT conv_id) AS n, count(*) FILTER (length(text) < 60 OR length(text) > 1500) AS issues FROM conversations)")
def content_score(spark, d):
    m = messages(spark, d)
    return C.content_score(m, C.content_issues(m, least=60, most=1500, patterns={}))


@query("quality_filter", """SELECT conv_id, round(CASE WHEN n < 2 THEN .5 ELSE 1.0 END * CASE WHEN mean < 300 THEN .7 ELSE 1.0 END * CASE WHEN u = 0 OR a = 0 THEN .5 ELSE 1.0 END, 6)::DOUBLE AS quality FROM
(SELECT conv_id, count(*) AS n, avg(length(text)) AS mean, max((role = 'user')::INT) AS u, max((role = 'assistant')::INT) AS a FROM conversations GROUP BY conv_id)""")
def quality_filter(spark, d):
    return C.quality(messages(spark, d), short=300)


@query("quality_bytes", """SELECT conv_id, round(CASE WHEN n < 2 THEN .5 ELSE 1.0 END * CASE WHEN b // n < 300 THEN .7 ELSE 1.0 END * CASE WHEN u = 0 OR a = 0 THEN .6 ELSE 1.0 END, 6)::DOUBLE AS quality FROM
(SELECT conv_id, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS b, max((role = 'user')::INT) AS u, max((role = 'assistant')::INT) AS a FROM conversations GROUP BY conv_id)""")
def quality_bytes(spark, d):
    return C.quality_bytes(messages(spark, d), short=300)


@query("token_stats", f"WITH {TOKENS} SELECT CAST(sum(tokens) AS BIGINT) AS total, round(avg(tokens), 6) AS average, min(tokens) AS least, max(tokens) AS most, count(*) FILTER (tokens > 600) AS over_limit FROM t")
def token_stats(spark, d):
    return C.token_stats(C.tokens(messages(spark, d)), 600)


@query("token_buckets", f"WITH {TOKENS} SELECT CASE WHEN tokens <= 500 THEN '0-500' WHEN tokens <= 1000 THEN '501-1000' WHEN tokens <= 2000 THEN '1001-2000' WHEN tokens <= 4000 THEN '2001-4000' ELSE '4000+' END AS bucket, count(*) AS conversations FROM t GROUP BY 1")
def token_buckets(spark, d):
    return C.token_buckets(C.tokens(messages(spark, d)))


@query("token_buckets_fine", f"WITH t AS (SELECT conv_id, CAST(sum({S.words('text')} + {S.words('role')} + 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id) SELECT CASE WHEN tokens <= 100 THEN '0-100' WHEN tokens <= 500 THEN '101-500' WHEN tokens <= 1000 THEN '501-1000' WHEN tokens <= 2000 THEN '1001-2000' WHEN tokens <= 4000 THEN '2001-4000' ELSE '4000+' END AS bucket, count(*) AS conversations FROM t GROUP BY 1")
def token_buckets_fine(spark, d):
    return C.token_buckets(C.tokens_with_roles(messages(spark, d)), (100, 500, 1000, 2000, 4000))


@query("token_estimate", "SELECT conv_id, CAST(sum(strlen(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def token_estimate(spark, d):
    return messages(spark, d).groupBy("conv_id").agg(F.sum(F.expr("octet_length(text) div 4")).alias("tokens"))


@query("truncate_middle", f"""WITH {TOKENS}, p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
k AS (SELECT p.*, tokens, greatest(2, CAST(floor(n * 200.0 / tokens) AS INT)) AS keep FROM p JOIN t USING (conv_id))
SELECT conv_id, turn, role, length(text) AS chars FROM k WHERE tokens <= 200 OR n <= 2 OR p <= keep // 2 OR p > n - (keep - keep // 2)""")
def truncate_middle(spark, d):
    m = messages(spark, d)
    return C.flatten(C.truncate_middle(C.nest(m), C.tokens(m), 200)).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("truncate_tail", """WITH s AS (SELECT *, sum(strlen(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS l FROM s WHERE s <= 300) SELECT conv_id, turn, role, text FROM f WHERE NOT (l = 1 AND role = 'user')""")
def truncate_tail(spark, d):
    return C.truncate_tail(messages(spark, d), 300)


@query("truncate_head", f"""WITH c AS (SELECT *, {S.words('text')} + {S.words('role')} + 4 AS t FROM conversations), u AS (SELECT *, sum(t) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM c)
SELECT conv_id, turn, role, CASE WHEN u <= 200 THEN text ELSE array_to_string(string_split_regex({S.strip('text')}, '\\s+')[1:CAST(greatest(200 - (u - t) - 5, 0) AS BIGINT)], ' ') || '... [truncated]' END AS text
FROM u WHERE u <= 200 OR (200 - (u - t) > 10 AND u - t <= 200)""")
def truncate_head(spark, d):
    return C.truncate_head(messages(spark, d), 200)


@query("batch_fixed", "SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) // 30 AS batch FROM (SELECT DISTINCT conv_id FROM conversations)")
def batch_fixed(spark, d):
    return C.batches_fixed(messages(spark, d).select("conv_id").distinct(), 30)


@query("batch_budget", f"""WITH RECURSIVE {TOKENS}, o AS (SELECT *, row_number() OVER (ORDER BY conv_id) AS p FROM t),
r AS (SELECT conv_id, p, CAST(0 AS BIGINT) AS batch, tokens AS s FROM o WHERE p = 1
UNION ALL SELECT o.conv_id, o.p, CASE WHEN r.s + o.tokens > 4000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.s + o.tokens > 4000 THEN o.tokens ELSE r.s + o.tokens END FROM r JOIN o ON o.p = r.p + 1)
SELECT conv_id, batch FROM r""")
def batch_budget(spark, d):
    return C.batches_by_budget(C.tokens(messages(spark, d)), 4000)


@query("batch_language", f"""WITH {CONV}, l AS (SELECT conv_id, {S.language('text')[0]} AS language FROM c) SELECT conv_id, language, (row_number() OVER (PARTITION BY language ORDER BY conv_id) - 1) // 20 AS batch FROM l""")
def batch_language(spark, d):
    return C.batches_by_language(nested(spark, d).select("conv_id", T.indicator_language(F.col("text"))[0].alias("language")), 20)


@query("language_stats", f"""WITH m AS (SELECT conv_id, {S.language('text')[0]} AS language, {S.language('text')[1]} AS confidence FROM conversations WHERE length(text) > 10),
b AS (SELECT conv_id, language, count(*) AS n, sum(confidence) AS c FROM m WHERE confidence >= 0.3 GROUP BY ALL)
SELECT conv_id, max(row(n, language)).language AS language, round(sum(c) / sum(n), 6) AS confidence, count(*) > 1 AS mixed FROM b GROUP BY conv_id""".replace("max(row(n, language)).language", "max({'n': n, 'language': language}).language"))
def language_stats(spark, d):
    return C.by_message_language(messages(spark, d), T.indicator_language, least_chars=10, least_confidence=0.3)


@query("near_duplicates", """WITH m AS (SELECT doc_id AS conv_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS p, len(string_split(text, chr(10))) AS n FROM documents),
w AS (SELECT conv_id, any_value(n) AS n, string_agg(text, chr(10) ORDER BY p) AS whole FROM m GROUP BY conv_id), o AS (SELECT min(conv_id) AS conv_id FROM w GROUP BY whole), k AS (SELECT * FROM m WHERE conv_id IN (SELECT conv_id FROM o))
SELECT a.conv_id AS a, b.conv_id AS b, round(count(*) / max(a.n), 6)::DOUBLE AS similarity FROM k a JOIN k b ON a.n = b.n AND a.p = b.p AND a.text = b.text AND a.conv_id < b.conv_id GROUP BY ALL HAVING count(*) / max(a.n) >= 0.7""")
def near_duplicates(spark, d):
    """Documents as conversations of their lines; those of the conversations table agree nowhere."""
    lines = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("conv_id"), F.posexplode(F.split("text", "\n")).alias("turn", "text"))
    return C.near_duplicates(lines.withColumn("role", F.lit("user")), 0.7)


@query("top_words", f"""WITH w AS (SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS word FROM conversations)
SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]{{3,}}') AND word NOT IN {S.listed(L.STOP_WORDS)} GROUP BY word ORDER BY n DESC, word LIMIT 10""")
def top_words(spark, d):
    from convlens.operators.clusters import top_words

    return top_words(messages(spark, d), [], 10).select("word", "n")


@query("representative_messages", f"""WITH {CONV}, k AS (SELECT conv_id, {S.cascade('lower(text)', L.FREQUENT)} AS cluster FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY conv_id) AS n FROM k),
u AS (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT cluster, conv_id, left(text, 150) AS message FROM r JOIN u USING (conv_id) WHERE n <= 3""")
def representative_messages(spark, d):
    from convlens.operators.clusters import representatives

    n = nested(spark, d).select("conv_id", T.category_cascade(F.col("text"), L.FREQUENT).alias("cluster"))
    return representatives(n, messages(spark, d))


@query("sample_preview", "SELECT conv_id, string_agg(role || ': ' || left(text, 100), chr(10) ORDER BY turn) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p <= 3 AND conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY 1 LIMIT 5) GROUP BY conv_id")
def sample_preview(spark, d):
    first = nested(spark, d).orderBy("conv_id").limit(5)
    lines = F.transform(F.slice("messages", 1, 3), lambda m: F.concat(m["role"], F.lit(": "), F.substring(m["content"], 1, 100)))
    return first.select("conv_id", F.array_join(lines, "\n").alias("preview"))


@query("result_json", f"""WITH {CONV} SELECT conv_id, '{{"conv_id":' || conv_id || ',"category":"' || {S.cascade('lower(text)', L.FREQUENT)} || '","n_messages":' || n_messages || '}}' AS json FROM c""")
def result_json(spark, d):
    n = nested(spark, d).select("conv_id", T.category_cascade(F.col("text"), L.FREQUENT).alias("category"), "n_messages")
    return n.select("conv_id", F.to_json(F.struct("conv_id", "category", "n_messages")).alias("json"))


CASUAL = r"(?i)\b(hey|hi|hello|thanks|okay|sure|yeah|lol|btw|fyi)\b"
TECHNICAL = r"(?i)\b(analyze|analysis|correlation|regression|hypothesis|methodology|framework|architecture|implementation|optimization|algorithm)\b"


@query("shape_flags", f"""SELECT conv_id, bool_or(regexp_matches(text, '```|def |class |function')) AS code, bool_or(contains(lower(text), 'and')) AS analytical, bool_or(length(text) > 1000) AS complex,
bool_or(regexp_matches(text, '[^\\x00-\\x7F]')) AS multilingual, bool_or(regexp_matches(text, '{CASUAL}')) AS casual, bool_or(regexp_matches(text, '{TECHNICAL}')) AS technical, CASE WHEN count(*) <= 3 THEN 'small' WHEN count(*) <= 6 THEN 'medium' ELSE 'large' END AS size FROM conversations GROUP BY conv_id""")
def shape_flags(spark, d):
    t = F.col("text")
    return messages(spark, d).groupBy("conv_id").agg(
        F.bool_or(F.rlike(t, F.lit("```|def |class |function"))).alias("code"), F.bool_or(F.contains(F.lower(t), F.lit("and"))).alias("analytical"),
        F.bool_or(F.length(t) > 1000).alias("complex"), F.bool_or(F.rlike(t, F.lit(r"[^\x00-\x7F]"))).alias("multilingual"),
        F.bool_or(F.rlike(t, F.lit(CASUAL))).alias("casual"), F.bool_or(F.rlike(t, F.lit(TECHNICAL))).alias("technical"),
        F.when(F.count(F.lit(1)) <= 3, "small").when(F.count(F.lit(1)) <= 6, "medium").otherwise("large").alias("size"),
    )


@query("suggest_batching", "SELECT CASE WHEN languages > 1 THEN 'language' WHEN most > 8000 THEN 'token' ELSE 'fixed' END AS kind, CASE WHEN languages > 1 THEN 50 WHEN most > 8000 THEN CAST(least(100, floor(100000 / greatest(average, 1))) AS INT) ELSE 100 END AS size FROM (SELECT count(DISTINCT lang) AS languages, max(n_chars) AS most, avg(n_chars) AS average FROM documents)")
def suggest_batching(spark, d):
    r = spark.read.parquet(f"{d}/documents.parquet").agg(F.countDistinct("lang").alias("l"), F.max("n_chars").alias("m"), F.avg("n_chars").alias("a")).first()
    return spark.createDataFrame([C.suggest_batching(r["l"], r["m"], r["a"])], "kind string, size int")


@query("preprocess")
def preprocess(spark, d):
    return C.preprocess(messages(spark, d), limit=200, remove_pii=True)


@query("roles_window", "SELECT conv_id, turn, role, lag(role) OVER w AS last_role, CAST(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS users FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def roles_window(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages(spark, d).select("conv_id", "turn", "role", F.lag("role").over(w).alias("last_role"), F.sum((F.col("role") == "user").cast("int")).over(w).alias("users"))
