"""Writing results: JSON and CSV files, exports of clusters and maps, greedy splits by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.operators.conversations import greedy_pages


def write_json(df: DataFrame, path: str, most_rows: int = 0) -> None:
    """JSON lines; ``_SUCCESS`` marks a complete result."""
    df.write.mode("overwrite").option("maxRecordsPerFile", most_rows).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def partial_results(counts: DataFrame) -> DataFrame:
    """(type, data, count) of a one-row table of counters."""
    names = counts.columns
    pairs = ", ".join(f"'{n}', cast({n} as bigint)" for n in names)
    return counts.selectExpr(f"stack({len(names)}, {pairs}) as (type, count)").select("type", F.lit("total").alias("data"), "count")


def cluster_export(assignment: DataFrame, nested: DataFrame, cluster) -> DataFrame:
    """Member conversations of one cluster."""
    return assignment.where(F.col("cluster") == cluster).join(nested, "conv_id").select("cluster", "conv_id", "text")


def map_export(points: DataFrame, names: DataFrame) -> DataFrame:
    """{id, x, y, cluster} per point with a fallback name."""
    joined = points.join(names, "cluster", "left")
    return joined.select("id", "x", "y", F.coalesce("name", F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))).alias("cluster"))


def split_by_bytes(lines: DataFrame, order: str, most: int) -> DataFrame:
    """Adds ``page``: greedy pages of at most ``most`` bytes with line ends, in order; a longer line is alone."""
    sized = lines.select(order, "line").withColumn("_bytes", F.coalesce(F.octet_length("line"), F.lit(0)) + 1)
    return greedy_pages(sized, [order], "_bytes", most).select(order, "line", "page")


def session_copy(session: DataFrame, new_id: str, column: str = "session_id") -> DataFrame:
    """A session's rows under a new id, for export and import."""
    return session.withColumn(column, F.lit(new_id))


def log_lines(logs: DataFrame) -> DataFrame:
    """(line): each row of a log as JSON."""
    return logs.select(F.to_json(F.struct(*logs.columns)).alias("line"))
