"""Streams give what a batch over the same rows gives, and runs go on where they stopped."""

from pyspark.sql import functions as F

from convlens.streaming import streams as X

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def folder(spark, tmp_path, parts=3):
    rows = [(i, 1_700_000_000 + 60 * i, i % 4, "ab"[i % 2], float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value")
    for k in range(parts):
        df.where(F.expr(f"event_id div 30 = {k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), df


def test_totals_match_batch(spark, tmp_path):
    path, df = folder(spark, tmp_path)
    got = X.to_memory(X.running_totals(X.stream(spark, path, df.schema)), "t_totals", "complete")
    assert {(r["event_type"], r["n"]) for r in got.collect()} == {("a", 45), ("b", 45)}


def test_running_mean(spark, tmp_path):
    path, df = folder(spark, tmp_path)
    got = X.to_memory(X.running_mean(X.stream(spark, path, df.schema)), "t_mean", "update")
    assert got.groupBy("event_type").agg(F.max("n").alias("n")).where("n = 45").count() == 2


def test_resumable_batches(spark, tmp_path):
    path, df = folder(spark, tmp_path)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        X.run_batches(X.stream(spark, path, df.schema), check, X.append_batch(out)).awaitTermination()
    assert spark.read.parquet(out).count() == 90


def test_late_rows_are_dropped(spark, tmp_path):
    path, df = folder(spark, tmp_path, 3)
    df.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000))).withColumn("event_id", F.lit(999).cast("long")).coalesce(1).write.mode("append").parquet(path)
    got = X.to_memory(X.deduplicated(X.stream(spark, path, df.schema)), "t_late", "append")
    assert got.count() in (90, 91)


def test_pause_and_go_on(spark, tmp_path):
    from convlens.streaming import streams as X

    for i in range(4):
        spark.createDataFrame([(k, i) for k in range(3)], "id long, value int").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    paths = f"{tmp_path}/in/*"
    source = lambda: X.stream(spark, paths, "id long, value int")
    handle = X.append_batch(f"{tmp_path}/out")
    assert X.run_some(source(), f"{tmp_path}/check", handle, 2) == 2
    assert len(list((tmp_path / "out").iterdir())) == 2
    assert X.run_some(source(), f"{tmp_path}/check", handle, 9) == 2
    got = X.finalise(spark, f"{tmp_path}/out", "id").collect()
    assert len(got) == 3 and spark.read.parquet(f"{tmp_path}/out").count() == 12


def test_files_are_taken_by_bytes_and_told_in_files(spark, tmp_path):
    """Three files make one micro-batch, and what the stream tells is read from files, not from the driver's memory."""
    path, df = folder(spark, tmp_path)
    taken = X.stream(spark, path, df.schema, bytes_per_trigger=1_000_000)
    got = X.to_files(X.running_mean(taken), str(tmp_path / "mean"), "update")
    level = {"a": None, "b": None}
    for i in range(90):
        level["ab"[i % 2]] = float(i) if level["ab"[i % 2]] is None else 0.5 * level["ab"[i % 2]] + 0.5 * i
    assert {r["event_type"]: (r["level"], r["n"]) for r in got.collect()} == {k: (v, 45) for k, v in level.items()}
    assert got.inputFiles() and got.count() == 2
    told = X.to_files(X.deduplicated(X.stream(spark, path, df.schema, bytes_per_trigger=1_000_000)), str(tmp_path / "dedup"), "append")
    assert sorted(r["event_id"] for r in told.collect()) == list(range(90))
    totals = X.to_files(X.running_totals(X.stream(spark, path, df.schema)), str(tmp_path / "totals"), "complete")
    assert sorted((r["event_type"], r["n"]) for r in totals.collect()) == [("a", 45), ("b", 45)]
