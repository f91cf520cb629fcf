"""Structured Streaming: running aggregates, windows with watermarks, sketches, insights per micro-batch, resumable runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convlens.operators import insight as I


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, bytes_per_trigger: int = 0) -> DataFrame:
    """Files of a folder as they come; ``ts`` becomes a timestamp with zone, since watermarks need one.

    With ``bytes_per_trigger`` a micro-batch has so many bytes of files (one file at least), whatever their number: what each micro-batch
    costs, its state written and read again, then follows the bytes and not the files.
    """
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    read = spark.readStream.schema(schema).option(*limit).parquet(path)
    return read.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in read.columns else read


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    agg = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return agg.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_totals(events: DataFrame) -> DataFrame:
    """Counts and distinct users by type; for update or complete mode."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"), F.avg("value").alias("mean"))


def running_mean(events: DataFrame, keep: float = 0.5) -> DataFrame:
    """Exponential mean per type, kept as state between micro-batches."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, n = state.get if state.exists else (None, 0)
        # 16 bytes a row, whatever the table's columns; a part is let go once its two columns are copied.
        ids, values = (np.concatenate(x) for x in zip(*((p["event_id"].to_numpy(copy=True), p["value"].to_numpy(float, copy=True)) for p in parts)))
        for start in range(0, len(order := np.argsort(ids, kind="stable")), 65_536):
            for x in values[order[start : start + 65_536]].tolist():
                level = x if level is None else keep * level + (1 - keep) * x
        state.update((level, n + len(ids)))
        yield pd.DataFrame({"event_type": [key[0]], "level": [level], "n": [n + len(ids)]})

    return events.select("event_type", "event_id", "value").groupBy("event_type").applyInPandasWithState(step, "event_type string, level double, n long", "level double, n long", "update", GroupStateTimeout.NoTimeout)


def live_users(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", lg: int = 14) -> DataFrame:
    """(start, event_type, n, sketch): a mergeable HLL sketch of the users of each window, for append mode."""
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("user_id", lg).alias("sketch"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "sketch")


def merged_users(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, n, users): distinct users over all windows of a group, from the sketches alone."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))


def insights(facets: DataFrame) -> DataFrame:
    """Common values and trends of what has come so far."""
    common = I.common_value(facets).select(F.lit("pattern").alias("kind"), "value", F.col("n").cast("long").alias("n"))
    rising = I.trends(facets).select(F.lit("trend").alias("kind"), "value", F.col("second_half").cast("long").alias("n"))
    return common.unionByName(rising)


def add_counts(path: str, by: list[str]) -> Callable[[DataFrame, int], None]:
    """Adds each batch's counts by value to a table of versions, one a batch; a batch that is repeated starts from the one before it.

    The table below ``path`` has (by, n, first, last) under ``version=<batch>``: first and last batch in which the value came.
    """

    def handle(df: DataFrame, batch: int) -> None:
        new = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, "n", F.lit(batch).alias("first"), F.lit(batch).alias("last"))
        if batch and (older := latest(df.sparkSession, path, batch)) is not None:
            new = older.unionByName(new).groupBy(*by).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        new.write.mode("overwrite").parquet(f"{path}/version={batch}")

    return handle


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table's last version (before that of a batch); None if there is none. A version counts once it is written as a whole."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    there = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("version=")]
    whole = [int(p.getName().split("=")[1]) for p in there if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    versions = [v for v in whole if before is None or v < before]
    return spark.read.parquet(f"{path}/version={max(versions)}") if versions else None


def batch_insights(path: str, min_rate: float = 0.1) -> Callable[[DataFrame, int], None]:
    """Per micro-batch of facets (conv_id, facet, value): counts added to those before, and what they say now under ``insights/version=<batch>``.

    (kind, facet, value, n): ``pattern`` is the most frequent value of a facet, ``trend`` each value that came in the newest batch
    with more than ``min_rate`` of all its occurrences.
    """
    add = add_counts(f"{path}/counts", ["facet", "value"])

    def handle(df: DataFrame, batch: int) -> None:
        df = df.where("facet is not null and value is not null")
        add(df, batch)
        spark = df.sparkSession
        now = latest(spark, f"{path}/counts")
        common = now.groupBy("facet").agg(F.max(F.struct("n", F.col("value"))).alias("m")).select(F.lit("pattern").alias("kind"), "facet", "m.value", "m.n")
        newest = df.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("new")).join(now, ["facet", "value"])
        rising = newest.where((F.col("new") > min_rate * F.col("n")) & (F.col("first") < batch)).select(F.lit("trend").alias("kind"), "facet", "value", F.col("new").alias("n"))
        common.unionByName(rising).write.mode("overwrite").parquet(f"{path}/insights/version={batch}")

    return handle


class Progress(StreamingQueryListener):
    """What a run reports, as rows by kind for subscribers: ``subscribe`` gets each as it comes."""

    def __init__(self, subscribe: Callable[[str, dict], None] | None = None):
        self.seen: list[tuple[str, dict]] = []
        self.subscribe = subscribe

    def _note(self, kind: str, **told) -> None:
        self.seen.append((kind, told))
        if self.subscribe:
            self.subscribe(kind, told)

    def onQueryStarted(self, event) -> None:
        self._note("started", id=str(event.id), name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._note("batch_completed" if p.numInputRows else "idle", id=str(p.id), batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._note("idle", id=str(event.id))

    def onQueryTerminated(self, event) -> None:
        self._note("failed" if event.exception else "completed", id=str(event.id), error=event.exception)

    def counts(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for kind, _ in self.seen:
            out[kind] = out.get(kind, 0) + 1
        return out


ENDS = ("completed", "failed", "cancelled")


def session_stream(events: DataFrame, moves: dict[tuple[str, str], str], *, late: str = "10 minutes", expire_ms: int = 0) -> DataFrame:
    """(session_id, status, events, last) after each micro-batch with events of a session, from (session_id, seq, event, ts); for update mode.

    Keyed state holds a session's status, number of events (100 at most are told) and time of its last event. With ``expire_ms``, a session
    without events for so long in event time, as the watermark has it, is told as ``expired`` and forgotten unless it has ended; rows
    later than the watermark are dropped. Rows with a null session are left out; the events of one micro-batch go by seq, those of a later
    one come after.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, last = state.get if state.exists else ("created", 0, 0)
        if state.hasTimedOut:
            state.remove()
            if status not in ENDS:
                yield pd.DataFrame({"session_id": [key[0]], "status": ["expired"], "events": [min(n, 100)], "last": [last]})
            return
        rows = pd.concat(list(parts)).sort_values(["seq", "event"])
        if expire_ms:
            rows = rows[rows["at_ms"] >= state.getCurrentWatermarkMs()]
        for event in rows["event"]:
            status = moves.get((status, event), status)
        if len(rows):
            n, last = n + len(rows), max(last, int(rows["at_ms"].max()))
            yield pd.DataFrame({"session_id": [key[0]], "status": [status], "events": [min(n, 100)], "last": [last]})
        if n:
            state.update((status, n, last))
            if expire_ms:
                state.setTimeoutTimestamp(max(last + expire_ms, state.getCurrentWatermarkMs() + 1))

    given = events.where("session_id is not null").withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    timeout = GroupStateTimeout.EventTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout
    return given.groupBy("session_id").applyInPandasWithState(step, "session_id long, status string, events long, last long", "status string, events long, last long", "update", timeout)


def run_batches(source: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """All that is there, micro-batch by micro-batch; a stopped or failed run goes on after its last complete batch.

    ``handle`` gets the batch id, so a batch that is run again can overwrite what it wrote the first time.
    """
    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, so that a repeated batch replaces itself."""

    def handle(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return handle


def to_memory(df: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there into a table in memory, for tests and small results."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def to_files(df: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs a stream over what is there into files below ``path``, a folder for each micro-batch; rows never come to the driver.

    The table has what all micro-batches told (``append``, ``update``) or the last one (``complete``).
    """
    handle = append_batch(path) if mode != "complete" else lambda d, batch: d.write.mode("overwrite").parquet(f"{path}/batch=0")
    df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", f"{path}-check").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch=*")


def run_some(source: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], most: int) -> int:
    """As many as ``most`` micro-batches, then a pause: the number run. Another call with the same checkpoint goes on."""
    done = 0

    def counted(df: DataFrame, batch: int) -> None:
        nonlocal done
        if done >= most:
            raise InterruptedError("paused")
        handle(df, batch)
        done += 1

    query = source.writeStream.foreachBatch(counted).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception as e:  # the stream reports the pause as its failure
        if "paused" not in str(e):
            raise
    return done


def finalise(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The union of all batches' results; of a key that several batches gave, the row of the latest."""
    parts = spark.read.parquet(path)
    rest = [c for c in parts.columns if c not in (key, "batch")]
    return parts.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(key, "_r.*")
