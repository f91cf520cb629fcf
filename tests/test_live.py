"""Session machines, insights, sketches and reports of running streams."""

import pytest
from pyspark.sql import functions as F

from convlens.operators import metrics as M
from convlens.streaming import streams as X

SCHEMA = "session_id long, seq long, event string, ts timestamp"


def put(spark, folder, rows):
    made = spark.createDataFrame(rows, "session_id long, seq long, event string, s long").select("session_id", "seq", "event", F.timestamp_seconds("s").alias("ts"))
    made.coalesce(1).write.mode("append").parquet(folder)
    return made


def last_rows(table):
    return {r["session_id"]: (r["status"], r["events"]) for r in table.groupBy("session_id").agg(F.max_by(F.struct("status", "events"), "last").alias("m")).select("session_id", "m.*").collect()}


def test_session_stream_gives_what_the_batch_gives(spark, tmp_path):
    verbs = ["start", "pause", "resume", "complete", "fail", "cancel"]
    rows = [(i % 7, i, verbs[(i * i + i // 7) % 6], 1_700_000_000 + 10 * i) for i in range(210)]
    for k in range(3):
        put(spark, f"{tmp_path}/in", rows[70 * k : 70 * k + 70])
    source = X.stream(spark, f"{tmp_path}/in", SCHEMA)
    got = last_rows(X.to_memory(X.session_stream(source, M.MOVES), "t_sessions", "update"))
    batch = spark.createDataFrame(rows, "session_id long, seq long, event string, s long")
    assert got == {r["session_id"]: (r["status"], r["events"]) for r in M.session_states(batch).collect()}


def test_sessions_expire_by_event_time_and_late_rows_are_dropped(spark, tmp_path):
    start = 1_700_000_000
    parts = [[(1, 1, "start", start), (2, 2, "start", start), (2, 3, "complete", start + 5)], [(3, 4, "start", start + 7200)], [(1, 5, "pause", start + 60), (3, 6, "pause", start + 7300)], [(3, 7, "resume", start + 7400)]]
    for rows in parts:
        put(spark, f"{tmp_path}/in", rows)
    out = X.to_memory(X.session_stream(X.stream(spark, f"{tmp_path}/in", SCHEMA), M.MOVES, expire_ms=1_800_000), "t_expiry", "update").collect()
    told = {}
    for r in out:
        told.setdefault(r["session_id"], []).append(r["status"])
    assert told[1][-1] == "expired" and "paused" not in told[1]  # its second event came after the watermark
    assert told[2] == ["completed"] and "expired" not in told[3] and told[3][-1] == "running"


def test_insights_of_a_killed_run_equal_the_batch(spark, tmp_path):
    rows = [(i, "topic", "abc"[(i // 10 + i) % 3 if i < 80 else 2]) for i in range(120)] + [(500 + i, "tone", "calm") for i in range(5)]
    for k in range(4):
        spark.createDataFrame(rows[k * 32 : k * 32 + 32], "conv_id long, facet string, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    handle, fail = X.batch_insights(f"{tmp_path}/out"), [True]

    def breaks(df, batch):
        handle(df, batch)
        if batch == 2 and fail.pop():
            raise RuntimeError("killed after it wrote")

    source = lambda: X.stream(spark, f"{tmp_path}/in", "conv_id long, facet string, value string")
    fail.append(True)
    with pytest.raises(Exception, match="killed"):
        X.run_batches(source(), f"{tmp_path}/check", breaks).awaitTermination()
    fail[:] = [False]
    X.run_batches(source(), f"{tmp_path}/check", handle).awaitTermination()
    counts = {(r["facet"], r["value"]): r["n"] for r in X.latest(spark, f"{tmp_path}/out/counts").collect()}
    want = {}
    for _, facet, value in rows:
        want[facet, value] = want.get((facet, value), 0) + 1
    assert counts == want
    found = X.latest(spark, f"{tmp_path}/out/insights").collect()
    assert {(r["facet"], r["value"], r["n"]) for r in found if r["kind"] == "pattern"} == {(f, *max((n, v) for (g, v), n in want.items() if g == f)[::-1]) for f in ("topic", "tone")}


def test_distinct_users_from_merged_sketches(spark, tmp_path):
    rows = [(i, 1_700_000_000 + 30 * i, (i * 7919) % 3000, "ab"[i % 2]) for i in range(8000)]
    rows.append((9999, 1_800_000_000, 1, "a"))  # closes the windows
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type")
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    live = X.to_memory(X.live_users(X.stream(spark, f"{tmp_path}/in", df.schema)), "t_live", "append")
    got = {r["event_type"]: (r["n"], r["users"]) for r in X.merged_users(live, "event_type").collect()}
    for kind in "ab":
        own = [r for r in rows[:8000] if r[3] == kind]
        assert got[kind][0] == len(own) and abs(got[kind][1] - len({r[2] for r in own})) <= 0.03 * 3000


def test_listener_counts_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, k)], "id long, value int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    listener = X.Progress(lambda kind, told: got.append(kind))
    spark.streams.addListener(listener)
    try:
        X.run_batches(X.stream(spark, f"{tmp_path}/in", "id long, value int"), f"{tmp_path}/check", X.append_batch(f"{tmp_path}/out")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    counts = listener.counts()
    assert counts["started"] == 1 and counts["batch_completed"] == 3 and counts["completed"] == 1 and got == [k for k, _ in listener.seen]


