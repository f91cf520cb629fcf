"""Session defaults, and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def session(app: str = "convlens", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive plans, skew joins and UTC; sizes follow the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": os.environ.get("CONVLENS_UI", "false"),
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="convlens-"))
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: it survives lost executors and has no lineage."""
    path = f"{shared_folder(df.sparkSession)}/convlens/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Marked to be sent to all tasks if it has at most ``most`` rows; otherwise left to the plan."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
