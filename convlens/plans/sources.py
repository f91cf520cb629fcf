"""Queries over parsers, exports and streams; file contents are made from ``conversations``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from convlens import providers as P
from convlens.functions import text as T
from convlens.operators import conversations as C
from convlens.operators import metrics as M
from convlens.plans import sql as S
from convlens.plans.conversations import messages, nested
from convlens.plans.events import SESSION_STATES
from convlens.plans.registry import query
from convlens.sources import readers as R
from convlens.sources import writers as W
from convlens.streaming import streams as X

FLAT = "m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, regexp_replace(text, '\\s+', ' ', 'g') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations)"


def flat(spark, d):
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    return messages(spark, d).select("conv_id", "turn", role.alias("role"), F.regexp_replace("text", r"\s+", " ").alias("text"))


def contents(spark, d, line, between="\n", head="", tail=""):
    rows = flat(spark, d).withColumn("line", line)
    grouped = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]), between).alias("content"))
    return grouped.select(F.col("conv_id").cast("string").alias("path"), F.concat(F.lit(head), "content", F.lit(tail)).alias("content"))


def parsed(df):
    return df.select(F.col("path").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.md5(T.strip(F.col("text")).cast("binary")).alias("text"))


EXPECTED = f"WITH {FLAT} SELECT conv_id, p AS turn, role, md5({S.strip('text')}) AS text FROM m"


@query("parse_text", EXPECTED)
def parse_text(spark, d):
    raw = contents(spark, d, F.concat(F.when(F.col("role") == "user", "Human").otherwise("BOT"), F.lit(": "), "text"), "\n\n")
    return parsed(R.parse_text(raw))


@query("parse_text_joined", f"WITH {FLAT} SELECT conv_id, p AS turn, role, md5({S.strip('text')} || chr(10) || 'more') AS text FROM m")
def parse_text_joined(spark, d):
    raw = contents(spark, d, F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), "text", F.lit("\nmore")))
    return parsed(R.parse_text(raw, join_lines=True))


@query("parse_csv", EXPECTED)
def parse_csv(spark, d):
    raw = contents(spark, d, F.concat(F.lit("7,"), "role", F.lit(',"'), "text", F.lit('"')), head="conv_id,role,content\n")
    return parsed(R.parse_csv(raw))


@query("parse_csv_plain", EXPECTED)
def parse_csv_plain(spark, d):
    return parsed(R.parse_csv_plain(contents(spark, d, F.concat(F.lit("7,"), "role", F.lit(","), "text"), head="any line\n")))


@query("parse_json", EXPECTED)
def parse_json(spark, d):
    line = F.to_json(F.struct("role", F.col("text").alias("content")))
    return parsed(R.parse_json(contents(spark, d, line, ",", '{"conversations": [{"messages": [', "]}]}")))


@query("detect_format", "SELECT conv_id, k AS kind FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('csv'), ('json'), ('text')) v(k)")
def detect_format(spark, d):
    csv = contents(spark, d, F.concat(F.lit("7,"), "role", F.lit(",x,y,z")))
    json = contents(spark, d, F.to_json(F.struct("role")), ",", "[", "]")
    text = contents(spark, d, F.concat(F.lit("User: "), "role"))
    both = csv.unionByName(json).unionByName(text)
    return both.select(F.col("path").cast("long").alias("conv_id"), R.detect_format(F.col("content"), F.col("path")).alias("kind"))


@query("csv_runs", "SELECT conv_id, count(DISTINCT g) AS conversations FROM (SELECT conv_id, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT *, CASE WHEN lag(turn // 2) OVER (PARTITION BY conv_id ORDER BY turn) <> turn // 2 THEN 1 ELSE 0 END AS n FROM conversations)) GROUP BY conv_id")
def csv_runs(spark, d):
    raw = contents(spark, d, F.concat(F.expr("cast(turn div 2 as string)"), F.lit(","), "role", F.lit(","), "text"))
    return R.parse_csv(raw).groupBy(F.col("path").cast("long").alias("conv_id")).agg(F.countDistinct("conv").alias("conversations"))


@query("upload_stats", "SELECT conv_id, 'text' AS format, CAST(1 AS BIGINT) AS conversations FROM (SELECT DISTINCT conv_id FROM conversations)")
def upload_stats(spark, d):
    raw = contents(spark, d, F.concat(F.lit("User: "), "role"))
    return R.file_stats(raw, R.read(raw)).select(F.col("path").cast("long").alias("conv_id"), "format", "conversations")


@query("examples")
def examples(spark, d):
    return R.examples(spark, 40)


@query("cluster_export", f"WITH c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY conv_id) SELECT n AS cluster, conv_id, text FROM c WHERE n = 4")
def cluster_export(spark, d):
    n = nested(spark, d)
    return W.cluster_export(n.select("conv_id", F.col("n_messages").alias("cluster")), n, 4)


@query("partial_results", "SELECT 'conversations' AS type, 'total' AS data, count(DISTINCT conv_id) AS count FROM conversations UNION ALL SELECT 'messages', 'total', count(*) FROM conversations")
def partial_results(spark, d):
    return W.partial_results(messages(spark, d).agg(F.countDistinct("conv_id").alias("conversations"), F.count(F.lit(1)).alias("messages")))


@query("split_pages", """WITH RECURSIVE l AS (SELECT conv_id * 1000 + turn AS id, text AS line, strlen(text) + 1 AS n, row_number() OVER (ORDER BY conv_id, turn) AS p FROM conversations),
r AS (SELECT id, line, p, CAST(0 AS BIGINT) AS page, n AS s FROM l WHERE p = 1 UNION ALL
SELECT l.id, l.line, l.p, CASE WHEN r.s + l.n > 10000 THEN r.page + 1 ELSE r.page END, CASE WHEN r.s + l.n > 10000 THEN l.n ELSE r.s + l.n END FROM r JOIN l ON l.p = r.p + 1) SELECT id, line, page FROM r""")
def split_pages(spark, d):
    return W.split_by_bytes(messages(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("line")), "id", 10_000)


@query("store_round_trip", "SELECT conv_id, turn, role, md5(text) AS text FROM conversations")
def store_round_trip(spark, d):
    """Conversations as one JSON value a row and back."""
    blob = nested(spark, d).select("conv_id", F.to_json("messages").alias("json"))
    back = blob.select("conv_id", F.from_json("json", "array<struct<turn:bigint,role:string,content:string>>").alias("messages"))
    return C.flatten(back).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text"))


_PARSE = "SELECT doc_id, coalesce(CASE WHEN n IS NULL THEN NULL ELSE least(5, greatest(1, n)) END, 3) AS score FROM (SELECT doc_id, TRY_CAST(regexp_extract(text, '([0-9]+)', 1) AS INT) AS n FROM documents)"


@query("facet_numbers", _PARSE)
def facet_numbers(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", T.facet_number(F.col("text"), 1, 5).alias("score"))


@query("facet_texts", "SELECT conv_id, turn, 'Billing' AS value FROM conversations")
def facet_texts(spark, d):
    return messages(spark, d).select("conv_id", "turn", T.facet_text(F.lit("  Category:  Billing  "), "Category: ").alias("value"))


@query("name_descriptions", f"WITH {FLAT} SELECT conv_id, turn, role AS name, {S.strip('text')} AS description FROM m WHERE {S.strip('text')} <> ''")
def name_descriptions(spark, d):
    answer = F.concat(F.lit("Sure.\nName: "), "role", F.lit("\nDescription: "), "text")
    got = flat(spark, d).select("conv_id", "turn", T.name_and_description(answer).alias("g"))
    return got.where("g is not null").select("conv_id", "turn", "g.name", "g.description")


@query("assignments", "SELECT DISTINCT conv_id, 0 AS a1, CAST(conv_id % 3 AS INT) AS a2, 0 AS a3 FROM conversations")
def assignments(spark, d):
    ids = messages(spark, d).select("conv_id").distinct()
    letter = F.char(F.lit(65) + F.col("conv_id") % 3)
    a = T.assignments(F.concat(F.lit("1 -> A\n2 -> B\n2 -> "), letter, F.lit("\n3 -> Z\n9 -> B")), 3, 3)
    return ids.withColumn("a", a).select("conv_id", *[F.col("a")[i].alias(f"a{i + 1}") for i in range(3)])


def _events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return X.stream(spark, f"{d}/event[s].parquet", schema, bytes_per_trigger=256_000_000)  # a pattern, so that one file will do as well


def _told(df, mode: str):
    """What a stream tells, in files of the shared folder."""
    from convlens.session import shared_folder

    return X.to_files(df, f"{shared_folder(df.sparkSession)}/convlens/stream-{uuid.uuid4().hex}", mode)


@query("stream_totals", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def stream_totals(spark, d):
    return _told(X.running_totals(_events(spark, d)), "complete").select("event_type", "n", F.round("mean", 6).alias("mean"))


@query("stream_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    told = _told(X.tumbling(_events(spark, d)), "update").groupBy("start", "event_type").agg(F.max("n").alias("n"))  # the last of each window
    return told.select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("stream_dedup", "SELECT event_id FROM events")
def stream_dedup(spark, d):
    return _told(X.deduplicated(_events(spark, d)), "append").select("event_id")


@query("stream_sessions", """WITH e AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT *, sum((gap IS NULL OR gap >= 1800000000)::INT) OVER (PARTITION BY user_id ORDER BY us) AS s FROM e)
SELECT user_id, min(us) AS start, max(us) + 1800000000 AS "end", count(*) AS n FROM s GROUP BY user_id, s HAVING max(us) + 1800000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000""")
def stream_sessions(spark, d):
    out = _told(X.sessions(_events(spark, d)), "append")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("stream_mean", """WITH RECURSIVE e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events),
r AS (SELECT event_type, p, value AS level FROM e WHERE p = 1 UNION ALL SELECT e.event_type, e.p, 0.5 * r.level + 0.5 * e.value FROM r JOIN e ON e.event_type = r.event_type AND e.p = r.p + 1)
SELECT event_type, round(max_by(level, p), 6) AS level, max(p) AS n FROM r GROUP BY event_type""")
def stream_mean(spark, d):
    told = _told(X.running_mean(_events(spark, d)), "update").groupBy("event_type").agg(F.max_by("level", "n").alias("level"), F.max("n").alias("n"))
    return told.withColumn("level", F.round("level", 6))


@query("stream_session_states", SESSION_STATES)
def stream_session_states(spark, d):
    """The rows of ``session_states``, from the machine that keeps its state between micro-batches."""
    verb = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "view", "pause").when(F.col("event_type") == "click", "resume").when(F.col("event_type") == "purchase", "complete").otherwise("fail")
    given = _events(spark, d).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), verb.alias("event"), "ts")
    told = _told(X.session_stream(given, M.MOVES), "update")
    return told.groupBy("session_id").agg(F.max_by(F.struct("status", "events"), F.struct("last", "events")).alias("m")).select("session_id", "m.status", "m.events")


@query("stream_insights", "SELECT 'event' AS facet, event_type AS value, count(*) AS n, count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) AS pattern FROM events GROUP BY event_type")
def stream_insights(spark, d):
    """Counts that micro-batches added up, and the pattern that the last one told."""
    from convlens.session import shared_folder

    folder = f"{shared_folder(spark)}/convlens/insights-{uuid.uuid4().hex}"
    facets = _events(spark, d).select(F.col("event_id").alias("conv_id"), F.lit("event").alias("facet"), F.col("event_type").alias("value"))
    X.run_batches(facets, f"{folder}/check", X.batch_insights(folder)).awaitTermination()
    told = X.latest(spark, f"{folder}/insights").where("kind = 'pattern'").select("facet", "value", F.lit(True).alias("pattern"))
    return X.latest(spark, f"{folder}/counts").join(told, ["facet", "value"], "left").select("facet", "value", "n", F.coalesce("pattern", F.lit(False)).alias("pattern"))


@query("stream_users", "SELECT event_type, count(*) AS n, true AS within FROM events GROUP BY event_type")
def stream_users(spark, d):
    """Distinct users by type from the sketches of hours; ``within``: the exact number is within 3 %."""
    live = _told(X.live_users(_events(spark, d)), "update")
    last = live.groupBy("event_type", "start").agg(F.max_by(F.struct("n", "sketch"), "n").alias("m")).select("event_type", "m.*")
    exact = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    told = X.merged_users(last, "event_type").join(exact, "event_type")
    return told.select("event_type", "n", (F.abs(F.col("users") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within"))


@query("files_round_trip", "SELECT doc_id, lang, source FROM documents")
def files_round_trip(spark, d):
    """Written as JSON and as CSV, read strictly, and joined."""
    from convlens.session import shared_folder

    folder = f"{shared_folder(spark)}/convlens/files-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source")
    W.write_json(rows.select("doc_id", "lang"), f"{folder}/json")
    W.write_csv(rows.select("doc_id", "source"), f"{folder}/csv")
    back = spark.read.schema("doc_id long, lang string").option("mode", "FAILFAST").json(f"{folder}/json")
    return back.join(R.table_csv(spark, f"{folder}/csv", "doc_id long, source string"), "doc_id")


@query("facet_answers", """SELECT doc_id, 'lines' AS kind, lang AS value, 0.25::DOUBLE AS confidence FROM documents UNION ALL SELECT doc_id, 'lists', source, 0.5 FROM documents UNION ALL SELECT doc_id, 'pairs', lang, 0.6 FROM documents""")
def facet_answers(spark, d):
    """What a model may answer, in its three forms, read by the parsers."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source")
    lines = P.facet_lines(F.concat(F.lit("Name: language\nValue: "), "lang", F.lit("\nConfidence: 0.25")))
    lists = P.facet_lists(F.concat(F.lit('So: [[{"name": "source", "value": "'), "source", F.lit('", "confidence": 0.5}]] done')), 2)
    pairs = P.facet_pairs(F.concat(F.lit("Language = "), "lang", F.lit(", mood: fine")))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("a")) for k, a in (("lines", lines), ("lists", lists[0]), ("pairs", pairs))])
    out = docs.select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.kind", F.explode("e.a").alias("f"))
    return out.select("doc_id", "kind", "f.value", "f.confidence")


@query("model_answers", """SELECT conv_id, turn, 'Name: Conversation: ' || array_to_string(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')[1:3], ' ') AS named FROM conversations WHERE role = 'system'""")
def model_answers(spark, d):
    """The stub model names a prompt by its first words; each distinct prompt is asked once."""
    _, question, prefill, *_ = P.MAIN_FACETS[0]
    asked = messages(spark, d).where("role = 'system'").withColumn("prompt", P.facet_prompt(F.col("text"), question, prefill))
    return P.complete(asked, "prompt", P.create("stub")).select("conv_id", "turn", F.split("answer", "\n")[0].alias("named"))
