"""Operational metrics, recovery and bookkeeping tables.

Calls are rows (component, ts, ok, duration); stores are append logs whose latest row per key counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def health_status(error_rate: Column) -> Column:
    return F.when(error_rate < 0.01, "healthy").when(error_rate < 0.05, "degraded").when(error_rate < 0.20, "unhealthy").otherwise("critical")


def health_points(status: Column) -> Column:
    return F.when(status == "healthy", 100).when(status == "degraded", 75).when(status == "unhealthy", 50).otherwise(0)


def component_health(calls: DataFrame) -> DataFrame:
    by = calls.groupBy("component").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.avg("duration").alias("latency"))
    rated = by.withColumn("error_rate", F.col("failed") / F.col("calls"))
    return rated.withColumn("status", health_status(F.col("error_rate"))).withColumn("points", health_points(F.col("status")))


def overall_health(components: DataFrame) -> DataFrame:
    mean = components.agg(F.avg("points").alias("score"))
    return mean.withColumn("status", F.when(F.col("score") >= 90, "healthy").when(F.col("score") >= 70, "degraded").when(F.col("score") >= 50, "unhealthy").otherwise("critical"))


def resource_status(percent: Column) -> Column:
    return F.when(percent < 70, "healthy").when(percent < 80, "degraded").when(percent < 90, "unhealthy").otherwise("critical")


def last_n(rows: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest n rows of each group; a rank filter, which Spark also applies before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def usage_summary(rows: DataFrame, n: int, value: str, order: Sequence[str]) -> DataFrame:
    """(current, average, peak) of the newest n."""
    newest = rows.orderBy(*[F.desc(c) for c in order]).limit(n)
    return newest.agg(F.max_by(value, F.struct(*order)).alias("current"), F.avg(value).alias("average"), F.max(value).alias("peak"))


def slowest(rows: DataFrame, most: int, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(value).alias("mean")).orderBy(F.desc(F.round("mean", 9)), by).limit(most)


def moving_average(rows: DataFrame, by: str, order: Sequence[str], value: str, keep: float) -> DataFrame:
    """Exponential mean per key over ordered rows: keep * old + (1 - keep) * new, started by the first value.

    One ordered stream per key in constant memory, since each step needs the one before.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, level = None, None
        for b in batches:
            out = []
            for k, x in zip(b.column(by).to_pylist(), b.column("_x").to_pylist()):
                level = x if level is None or k != key else keep * level + (1 - keep) * x
                key = k
                out.append(level)
            yield pa.RecordBatch.from_arrays([b.column(by), b.column("_at"), pa.array(out, pa.float64())], [by, "_at", "level"])

    kind = rows.schema[by].dataType.simpleString()
    sent = rows.select(by, F.col(order[0]).cast("long").alias("_at"), F.col(value).cast("double").alias("_x"))
    return sent.repartition(by).sortWithinPartitions(by, "_at").mapInArrow(run, f"{by} {kind}, _at long, level double").withColumnRenamed("_at", order[0])


def per_second(rows: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of rows in the second up to each row."""
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-999_999, 0)
    return rows.withColumn("rate", F.count(F.lit(1)).over(w))


def sessions(rows: DataFrame, by: str, ts: str, gap_seconds: int) -> DataFrame:
    """(by, start, end, n): rows of a key less than the gap apart."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(by).orderBy(ts)
    marked = rows.withColumn("_new", F.coalesce((at - F.lag(at).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    numbered = marked.withColumn("_s", F.sum("_new").over(w))
    return numbered.groupBy(by, "_s").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n")).drop("_s")


def valid_at(created: Column, ttl: Column, now: Column) -> Column:
    """A time to live of zero never ends."""
    return (ttl == 0) | (created + F.make_dt_interval(secs=ttl) > now)


def latest(log: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The newest row of each key by an aggregate, so only one row per key and task is shuffled."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], counter: str) -> DataFrame:
    """New rows replace old ones of the same key and count up; others stay; new keys start at zero."""
    o = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c not in key], F.lit(True).alias("_old"))
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in old.columns if c not in (*key, counter)], F.lit(True).alias("_new"))
    both = o.join(n, list(key), "full_outer")
    cols = [F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in old.columns if c not in (*key, counter)]
    count = F.coalesce(F.col(f"_o_{counter}"), F.lit(0)) + F.when(F.col("_new") & F.coalesce("_old", F.lit(False)), 1).otherwise(0)
    return both.select(*key, *cols, count.alias(counter))


def evict(cache: DataFrame, now: Column, most: int) -> DataFrame:
    """Drops expired rows, then the oldest quarter if more than ``most`` are left."""
    live = cache.where(valid_at(F.col("created"), F.col("ttl"), now))
    n = live.count()
    return live if n <= most else live.orderBy(F.desc("created"), "key").limit(n - n // 4)


def delete_older(parents: DataFrame, children: DataFrame, key: str, ts: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Parents from the cutoff on, and the children that still have one."""
    kept = parents.where(F.col(ts) >= cutoff)
    return kept, children.join(kept.select(key), key, "left_semi")


def last_successful_batch(batches: DataFrame) -> DataFrame:
    return batches.groupBy("session_id").agg(F.max(F.when(F.col("status") == "completed", F.col("batch"))).alias("last"))


def round_robin(rows: DataFrame, order: str, providers: int) -> DataFrame:
    from convlens.operators.conversations import numbered

    return numbered(rows, order).select(order, (F.col("position") % providers).alias("provider"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def circuit_breaker(events: DataFrame, by: str, order: str, *, failures: int = 5, wait_seconds: float = 60.0, successes: int = 2) -> DataFrame:
    """(by, order, state) after each call: closed, open after so many failures in a row, half open after the wait.

    ``events`` has (by, order, at in seconds, ok). An ordered replay per key, in constant memory.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, bad, good, since = None, "closed", 0, 0, 0.0
        for b in batches:
            out = []
            for k, at, ok in zip(b.column(by).to_pylist(), b.column("at").to_pylist(), b.column("ok").to_pylist()):
                if k != key:
                    key, state, bad, good = k, "closed", 0, 0
                if state == "open" and at - since >= wait_seconds:
                    state, good = "half_open", 0
                if state == "closed":
                    bad = 0 if ok else bad + 1
                    if bad >= failures:
                        state, since = "open", at
                elif state == "half_open":
                    good = good + 1 if ok else 0
                    if not ok:
                        state, since = "open", at
                    elif good >= successes:
                        state, bad = "closed", 0
                out.append(state)
            yield pa.RecordBatch.from_arrays([b.column(by), b.column("_o"), pa.array(out, pa.string())], [by, order, "state"])

    kind = events.schema[by].dataType.simpleString()
    sent = events.select(by, F.col(order).cast("long").alias("_o"), F.col("at").cast("double"), "ok")
    return sent.repartition(by).sortWithinPartitions(by, "_o").mapInArrow(run, f"{by} {kind}, {order} long, state string")


def value_sketches(rows: DataFrame, value: str, by: list[str], k: int = 400) -> DataFrame:
    """(by, n, least, most, total, sketch): timers of each group with a mergeable KLL sketch of their values; nulls are left out."""
    x = F.col(value).cast("double")
    return rows.where(x.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.sum(x).alias("total"), F.kll_sketch_agg_double(x, k).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str], at: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(by, n, least, most, mean, p50, ...): percentiles of wider groups from the sketches alone; their rank is within 1 % of the asked one."""
    up = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("_t"), F.kll_merge_agg_double("sketch").alias("_s"))
    return up.select(*by, "n", "least", "most", (F.col("_t") / F.col("n")).alias("mean"), *[F.kll_sketch_get_quantile_double("_s", F.lit(float(q))).alias(f"p{round(100 * q)}") for q in at])


MOVES = {
    ("created", "start"): "running", ("running", "pause"): "paused", ("paused", "resume"): "running", ("running", "complete"): "completed",
    ("running", "fail"): "failed", ("created", "cancel"): "cancelled", ("running", "cancel"): "cancelled", ("paused", "cancel"): "cancelled",
}


def session_states(events: DataFrame) -> DataFrame:
    """(session_id, status, events): the machine created, running, paused, completed, failed, cancelled; ends stay ends."""
    step = F.create_map(*[F.lit(x) for (s, e), t in MOVES.items() for x in (f"{s}:{e}", t)])
    ordered = F.array_sort(F.collect_list(F.struct("seq", "event")))
    grouped = events.groupBy("session_id").agg(ordered.alias("_e"))
    status = F.aggregate("_e", F.lit("created"), lambda s, e: F.coalesce(step[F.concat_ws(":", s, e["event"])], s))
    return grouped.select("session_id", status.alias("status"), F.least(F.size("_e"), F.lit(100)).cast("long").alias("events"))


def prometheus(metrics: DataFrame, prefix: str = "convlens") -> DataFrame:
    return metrics.select(F.concat(F.lit(prefix + "_"), "name", F.lit('{component="'), "component", F.lit('"} '), F.col("value").cast("string")).alias("line"))


def cost(tokens: DataFrame, embedding_rate: float = 0.00001, llm_rate: float = 0.00002) -> DataFrame:
    t = F.sum("tokens")
    return tokens.agg((t * embedding_rate).alias("embedding"), (t * llm_rate).alias("llm"), F.count(F.lit(1)).alias("conversations")).withColumn(
        "each", (F.col("embedding") + F.col("llm")) / F.col("conversations")
    )


