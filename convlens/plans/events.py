"""Queries over ``events``: calls of components (event type), with errors as failures, and bookkeeping tables derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.operators import metrics as M
from convlens.plans.registry import query


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def calls(spark, d):
    return events(spark, d).select((F.col("user_id") % 10).alias("component"), "event_id", "ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration"))


CALLS = "c AS (SELECT user_id % 10 AS component, event_id, ts, event_type <> 'error' AS ok, value AS duration FROM events)"
RATED = f"{CALLS}, g AS (SELECT component, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, avg(duration) AS latency FROM c GROUP BY component), h AS (SELECT *, failed / calls AS error_rate FROM g), s AS (SELECT *, CASE WHEN error_rate < .01 THEN 'healthy' WHEN error_rate < .05 THEN 'degraded' WHEN error_rate < .2 THEN 'unhealthy' ELSE 'critical' END AS status FROM h), p AS (SELECT *, CASE status WHEN 'healthy' THEN 100 WHEN 'degraded' THEN 75 WHEN 'unhealthy' THEN 50 ELSE 0 END AS points FROM s)"


@query("health_by_component", f"WITH {RATED} SELECT component, calls, failed, round(latency, 6) AS latency, round(error_rate, 6) AS error_rate, status, points FROM p")
def health_by_component(spark, d):
    return M.component_health(calls(spark, d)).withColumn("latency", F.round("latency", 6)).withColumn("error_rate", F.round("error_rate", 6))


@query("overall_health", f"WITH {RATED} SELECT round(avg(points), 6) AS score, CASE WHEN avg(points) >= 90 THEN 'healthy' WHEN avg(points) >= 70 THEN 'degraded' WHEN avg(points) >= 50 THEN 'unhealthy' ELSE 'critical' END AS status FROM p")
def overall_health(spark, d):
    return M.overall_health(M.component_health(calls(spark, d))).withColumn("score", F.round("score", 6))


@query("resource_status", "SELECT event_id, CASE WHEN value % 100 < 70 THEN 'healthy' WHEN value % 100 < 80 THEN 'degraded' WHEN value % 100 < 90 THEN 'unhealthy' ELSE 'critical' END AS status FROM events")
def resource_status(spark, d):
    return events(spark, d).select("event_id", M.resource_status(F.col("value") % 100).alias("status"))


@query("throughput", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6), 6) AS per_minute FROM events GROUP BY event_type")
def throughput(spark, d):
    minutes = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 60e6
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.count(F.lit(1)) / minutes, 6).alias("per_minute"))


@query("sliding_last_n", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100")
def sliding_last_n(spark, d):
    return M.last_n(events(spark, d), 100, ["event_type"], ["ts", "event_id"]).select("event_type", "event_id")


@query("trailing_total", "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 2) AS total FROM events")
def trailing_total(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return events(spark, d).select("event_id", F.round(F.sum("value").over(w), 2).alias("total"))


@query("usage_summary", "WITH n AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT (SELECT value FROM n ORDER BY ts DESC, event_id DESC LIMIT 1) AS current, round(avg(value), 6) AS average, max(value) AS peak FROM n")
def usage_summary(spark, d):
    return M.usage_summary(events(spark, d), 100, "value", ["ts", "event_id"]).withColumn("average", F.round("average", 6))


@query("slowest_components", f"WITH {CALLS} SELECT component, round(avg(duration), 6) AS mean FROM c GROUP BY component ORDER BY round(avg(duration), 9) DESC, component LIMIT 5")
def slowest_components(spark, d):
    return M.slowest(calls(spark, d), 5, "component", "duration").withColumn("mean", F.round("mean", 6))


@query("recent_events", "SELECT event_id, epoch_us(ts) AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, d):
    return events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", micros("ts").alias("at"))


@query("events_by_severity", "SELECT event_id FROM events WHERE event_type = 'error' AND value > 50 AND ts >= TIMESTAMP '2024-01-02'")
def events_by_severity(spark, d):
    return events(spark, d).where("event_type = 'error' and value > 50 and ts >= timestamp_ntz '2024-01-02'").select("event_id")


@query("events_per_second", "SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 999999 PRECEDING AND CURRENT ROW) AS rate FROM events")
def events_per_second(spark, d):
    # Rows of one second lie in the same or the neighbouring minute, so minutes are the groups and edges are sent twice.
    e = events(spark, d).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    minute = F.floor(F.col("at") / 60_000_000)
    sent = e.select("*", minute.alias("m"), F.lit(True).alias("own")).unionByName(e.where(F.floor((F.col("at") + 999_999) / 60_000_000) > minute).select("*", (minute + 1).alias("m"), F.lit(False).alias("own")))
    from pyspark.sql.window import Window

    w = Window.partitionBy("m").orderBy("at").rangeBetween(-999_999, 0)
    return sent.withColumn("rate", F.count(F.lit(1)).over(w)).where("own").select("event_id", "rate")


@query("user_sessions", """WITH l AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events),
s AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark, d):
    return M.sessions(events(spark, d), "user_id", "ts", 1800).select("user_id", micros("start").alias("start"), micros("end").alias("end"), "n")


@query("tumbling_counts", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    return events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(micros("w.start").alias("start"), "event_type", "n", "total")


@query("sliding_counts", "SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k)) AS start, count(*) AS n FROM events, generate_series(0, 1) g(k) GROUP BY ALL")
def sliding_counts(spark, d):
    return events(spark, d).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(micros("w.start").alias("start"), "n")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS json FROM events")
def json_props(spark, d):
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("json"))


@query("ttl_valid", "SELECT event_id FROM events WHERE user_id % 4 = 0 OR ts + to_seconds(CAST(user_id % 4 * 86400 AS BIGINT)) > TIMESTAMP '2024-01-03'")
def ttl_valid(spark, d):
    ttl = (F.col("user_id") % 4 * 86400).cast("decimal(18,6)")
    return events(spark, d).where(M.valid_at(F.col("ts").cast("timestamp"), ttl, F.lit("2024-01-03").cast("timestamp"))).select("event_id")


@query("upsert_progress", """WITH o AS (SELECT user_id, min(event_id) AS batch, 0 AS retries FROM events WHERE event_type = 'view' GROUP BY user_id), n AS (SELECT user_id, max(event_id) AS batch FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.batch, o.batch) AS batch, CAST(coalesce(o.retries, 0) + CASE WHEN o.user_id IS NOT NULL AND n.user_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS retries FROM o FULL JOIN n ON o.user_id = n.user_id""")
def upsert_progress(spark, d):
    e = events(spark, d)
    old = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("batch"), F.lit(0).alias("retries"))
    new = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("batch"))
    return M.upsert(old, new, ["user_id"], "retries")


@query("latest_by_user", "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_by_user(spark, d):
    return M.latest(events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("cleanup_cascade", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-03')")
def cleanup_cascade(spark, d):
    e = events(spark, d)
    users = e.groupBy("user_id").agg(F.max("ts").alias("seen"))
    return M.delete_older(users, e.select("event_id", "user_id"), "user_id", "seen", F.lit("2024-01-03").cast("timestamp_ntz"))[1].select("event_id")


@query("last_successful_batch", "SELECT user_id AS session_id, max(event_id) FILTER (event_type = 'purchase') AS last FROM events GROUP BY user_id")
def last_successful_batch(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("batch"), F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"))
    return M.last_successful_batch(rows)


@query("round_robin", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) % 3 AS provider FROM events")
def round_robin(spark, d):
    return M.round_robin(events(spark, d).select("event_id"), "event_id", 3)


@query("table_counts", "SELECT 'events' AS \"table\", count(*) AS rows FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations")
def table_counts(spark, d):
    return M.table_counts({t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("events", "documents", "conversations")})


@query("retry_delays", "SELECT event_id, least(0.5 * power(2.0, event_id % 8), 30.0)::DOUBLE AS delay FROM events")
def retry_delays(spark, d):
    from convlens.functions.text import retry_delay

    return events(spark, d).select("event_id", retry_delay(F.col("event_id") % 8 + 1, 0.5, 2.0, 30.0).alias("delay"))


@query("error_classes", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'purchase' THEN 'rate_limit' WHEN event_type = 'view' THEN 'network' ELSE 'unknown' END AS class FROM events""")
def error_classes(spark, d):
    from convlens.functions.text import error_class

    message = F.when(F.col("event_type") == "error", "Request timed out").when(F.col("event_type") == "purchase", "429 Too Many Requests").when(F.col("event_type") == "view", "Connection reset").otherwise("other")
    return events(spark, d).select("event_id", error_class(message).alias("class"))


@query("durations", "SELECT event_id, CASE WHEN s < 60 THEN format('{:.1f}s', s) WHEN s < 3600 THEN format('{:.1f}m', s / 60.0) ELSE format('{:.1f}h', s / 3600.0) END AS label FROM (SELECT event_id, ((event_id % 500) * 360)::DOUBLE AS s FROM events)")
def durations(spark, d):
    from convlens.functions.text import format_duration

    return events(spark, d).select("event_id", format_duration((F.col("event_id") % 500 * 360).cast("double")).alias("label"))


@query("masked_fields", "SELECT event_id, '[REDACTED]' AS secret, event_type AS plain FROM events")
def masked_fields(spark, d):
    from convlens.functions.text import mask_fields

    m = mask_fields(F.create_map(F.lit("Password"), F.lit("x"), F.lit("plain"), F.col("event_type")))
    return events(spark, d).select("event_id", m["Password"].alias("secret"), m["plain"].alias("plain"))


@query("prometheus_lines", f"WITH {CALLS} SELECT 'convlens_calls{{component=\"' || component || '\"}} ' || count(*) AS line FROM c GROUP BY component")
def prometheus_lines(spark, d):
    m = calls(spark, d).groupBy(F.col("component").cast("string").alias("component")).agg(F.count(F.lit(1)).alias("value")).withColumn("name", F.lit("calls"))
    return M.prometheus(m)


@query("counters", "SELECT event_type, count(*) AS counter, max_by(value, event_id) AS gauge, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type")
def counters(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("counter"), F.max_by("value", "event_id").alias("gauge"), F.median("value").alias("median"))


@query("timers", "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, unnest([50, 90, 99]) AS percentile, true AS within FROM events GROUP BY event_type")
def timers(spark, d):
    """Percentiles by type, merged from sketches of each type and hour; ``within``: the exact rank is within 1 % of the asked one."""
    e = events(spark, d)
    hourly = M.value_sketches(e.withColumn("hour", F.date_trunc("hour", "ts")), "value", ["event_type", "hour"])
    merged = M.merged_sketches(hourly, ["event_type"])
    asked = F.explode(F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(f"p{p}").alias("at")) for p in (50, 90, 99)]))
    told = merged.select("event_type", "n", "least", "most", F.round("mean", 6).alias("mean"), asked.alias("q")).select("*", "q.*").drop("q")
    ranks = e.join(F.broadcast(told), "event_type").groupBy("event_type", "percentile").agg(F.count_if(F.col("value") <= F.col("at")).alias("upto"), F.count_if(F.col("value") < F.col("at")).alias("below"))
    goal = F.col("percentile") / 100
    within = (F.col("below") / F.col("n") <= goal + 0.01) & (F.col("upto") / F.col("n") >= goal - 0.01)
    return told.join(ranks, ["event_type", "percentile"]).select("event_type", "n", "least", "most", "mean", "percentile", within.alias("within"))


@query("pivot_types", "SELECT user_id % 10 AS component, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")
def pivot_types(spark, d):
    return calls(spark, d).join(events(spark, d).select("event_id", "event_type"), "event_id").groupBy("component").pivot("event_type", ["view", "error"]).agg(F.count(F.lit(1))).na.fill(0)


@query("moving_average", """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
r AS (SELECT user_id, event_id, p, value AS level FROM e WHERE p = 1 UNION ALL SELECT e.user_id, e.event_id, e.p, 0.9::DOUBLE * r.level + (1 - 0.9::DOUBLE) * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.p = r.p + 1)
SELECT user_id, event_id, round(level, 6) AS level FROM r""")
def moving_average(spark, d):
    return M.moving_average(events(spark, d), "user_id", ["event_id"], "value", 0.9).withColumn("level", F.round("level", 6))


@query("circuit_breaker", """WITH RECURSIVE e AS (SELECT user_id % 10 AS op, event_id AS seq, epoch_us(ts) / 1e6 AS tick, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS p FROM events),
z AS (SELECT op, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS p, 'closed' AS state, 0 AS bad, 0 AS good, 0.0::DOUBLE AS since FROM (SELECT DISTINCT op FROM e)),
r AS (SELECT * FROM z UNION ALL SELECT op, seq, p,
  CASE WHEN s = 'closed' THEN CASE WHEN NOT ok AND bad + 1 >= 2 THEN 'open' ELSE 'closed' END WHEN s = 'half_open' THEN CASE WHEN NOT ok THEN 'open' WHEN g + 1 >= 2 THEN 'closed' ELSE 'half_open' END ELSE s END,
  CASE WHEN s = 'closed' THEN CASE WHEN ok THEN 0 ELSE bad + 1 END WHEN s = 'half_open' AND ok AND g + 1 >= 2 THEN 0 ELSE bad END,
  CASE WHEN s = 'half_open' THEN CASE WHEN ok THEN g + 1 ELSE 0 END ELSE g END,
  CASE WHEN NOT ok AND (s = 'half_open' OR s = 'closed' AND bad + 1 >= 2) THEN tick ELSE since END
  FROM (SELECT e.op, e.seq, e.p, e.tick, e.ok, r.bad, r.since, CASE WHEN r.state = 'open' AND e.tick - r.since >= 60 THEN 'half_open' ELSE r.state END AS s, CASE WHEN r.state = 'open' AND e.tick - r.since >= 60 THEN 0 ELSE r.good END AS g FROM r JOIN e ON e.op = r.op AND e.p = r.p + 1))
SELECT op, seq, state FROM r WHERE p > 0""")
def circuit_breaker(spark, d):
    e = events(spark, d).select((F.col("user_id") % 10).alias("op"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "error").alias("ok"))
    return M.circuit_breaker(e, "op", "seq", failures=2)


SESSION_STATES = """WITH RECURSIVE e AS (SELECT user_id AS session_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'pause' WHEN 'click' THEN 'resume' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS verb, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
r AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS p, 'created' AS status FROM e UNION ALL SELECT e.session_id, e.p, CASE WHEN status = 'created' AND verb = 'start' THEN 'running' WHEN status = 'running' AND verb = 'pause' THEN 'paused' WHEN status = 'paused' AND verb = 'resume' THEN 'running'
WHEN status = 'running' AND verb = 'complete' THEN 'completed' WHEN status = 'running' AND verb = 'fail' THEN 'failed' ELSE status END FROM r JOIN e ON e.session_id = r.session_id AND e.p = r.p + 1)
SELECT session_id, max_by(status, p) AS status, least(max(p), 100) AS events FROM r GROUP BY session_id"""


@query("session_states", SESSION_STATES)
def session_states(spark, d):
    verb = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "view", "pause").when(F.col("event_type") == "click", "resume").when(F.col("event_type") == "purchase", "complete").otherwise("fail")
    return M.session_states(events(spark, d).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), verb.alias("event")))


@query("cost", "SELECT round(sum(n_chars // 4) * 0.00001, 6) AS embedding, round(sum(n_chars // 4) * 0.00002, 6) AS llm, count(*) AS conversations, round(sum(n_chars // 4) * 0.00003 / count(*), 9) AS each FROM documents")
def cost(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.expr("n_chars div 4").alias("tokens"))
    return M.cost(t).select(F.round("embedding", 6).alias("embedding"), F.round("llm", 6).alias("llm"), "conversations", F.round("each", 9).alias("each"))


@query("cache_evict", """WITH l AS (SELECT event_id AS key, ts FROM events WHERE user_id % 4 = 0 OR ts + to_seconds(user_id % 4 * 86400) > TIMESTAMP '2024-01-03'), n AS (SELECT count(*) AS n FROM l)
SELECT key FROM (SELECT key, row_number() OVER (ORDER BY ts DESC, key) AS r FROM l), n WHERE n <= 1000 OR r <= n - n // 4""")
def cache_evict(spark, d):
    c = events(spark, d).select(F.col("event_id").alias("key"), F.col("ts").cast("timestamp").alias("created"), (F.col("user_id") % 4 * 86400).cast("decimal(18,6)").alias("ttl"))
    return M.evict(c, F.lit("2024-01-03").cast("timestamp"), 1000).select("key")


@query("order_size_audit", "SELECT count(*) AS clusters, count(*) FILTER (n < 25) AS small, CAST(coalesce(sum(n) FILTER (n < 25), 0) AS BIGINT) AS small_members, count(*) FILTER (n < 25) = 0 AS compliant FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def order_size_audit(spark, d):
    from convlens.operators.insight import size_audit

    return size_audit(spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("name")).agg(F.count(F.lit(1)).alias("size")), 25)
