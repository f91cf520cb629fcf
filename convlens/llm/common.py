"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark import Broadcast
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and
    all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="convlens-"))
    return base.rstrip("/")


#: How to let go of what this thread has opened inside ``owned``; None outside of it.
_OPENED: ContextVar[list[Callable[[], None]] | None] = ContextVar("opened", default=None)


def _own(let_go: Callable[[], None]) -> None:
    if (opened := _OPENED.get()) is not None:
        opened.append(let_go)


@contextlib.contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Folders and broadcasts that this thread opens inside go at the end, those of an inner ``owned`` at its end.

    For a caller that has written by then what it needs of them. What other threads, or callers further out, have opened stays.
    """
    mine: list[Callable[[], None]] = []
    token = _OPENED.set(mine)
    try:
        yield
    finally:
        _OPENED.reset(token)
        for let_go in reversed(mine):
            let_go()
        collect_garbage(spark)


def shared(spark: SparkSession, value) -> Broadcast:
    """A broadcast value; inside ``owned`` it goes with the rest."""
    sent = spark.sparkContext.broadcast(value)
    _own(sent.destroy)
    return sent


class Scratch:
    """Tables written below the shared folder to cut lineage; each survives the loss of an executor."""

    def __init__(self, spark: SparkSession, what: str):
        _own(self.drop)
        self.spark = spark
        self.path = f"{shared_folder(spark)}/convlens/{what}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, partitioned_by: list[str] | None = None, rows_per_file: int = 0) -> DataFrame:
        """``rows_per_file`` is for rows of megabytes: writers hold a hundred rows at least before they look at their bytes, readers all of a file's up to 4096."""
        path = f"{self.path}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
        if partitioned_by:
            writer = writer.partitionBy(*partitioned_by)
        writer.parquet(path)
        return self.get(name, df.schema)

    def get(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Up to so many rows of a few numbers go out to all tasks; more are joined by a shuffle.
FEW = 2_000_000


def few(rows: DataFrame) -> DataFrame:
    """Rows of a written table, marked to be broadcast if they are at most FEW."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def written(make: Callable[[], DataFrame], scratch: Scratch) -> DataFrame:
    """What ``make`` gives, as a table that goes out to all tasks if it is small; what was opened for it is let go."""
    with owned(scratch.spark):
        table = scratch.put(make(), "ids")
    return few(table)


def free_name(docs: DataFrame, base: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while any(c.startswith(base.lower()) for c in taken):
        base += "_"
    return base


def _bare_scan(docs: DataFrame) -> bool:
    """Whether each row stands for one row of the files of one folder: a scan with filters and projections at most."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() != "LogicalRelation":
        return False
    relation = node.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.location().rootPaths().size() == 1


def numbered(docs: DataFrame, row_col: str, scratch: Scratch) -> DataFrame:
    """The rows with a number of their own that every reading gives alike.

    Rows of a scan of files are numbered by their file and their place in it. All else may repeat or reorder rows of files (explode, join,
    union), so there a copy is written with the numbers.
    """
    if "_metadata" in docs.columns or not _bare_scan(docs):
        return scratch.put(docs.withColumn(row_col, F.monotonically_increasing_id()), "numbered")
    path, place = f"{row_col}path", f"{row_col}place"
    found = scratch.put(docs.select(F.col("_metadata.file_path").alias(path)).distinct().withColumn(row_col, F.monotonically_increasing_id()), "files")
    parts = found.agg(F.max(F.shiftright(row_col, 33))).first()[0] or 0
    files = found.select(path, (F.shiftright(row_col, 33) + (parts + 1) * F.col(row_col).bitwiseAND(F.lit((1 << 33) - 1))).alias(row_col))
    placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    number = F.shiftleft(row_col, 36).bitwiseOR(F.col(place))
    return placed.join(few(files), path).withColumn(row_col, number).select(*docs.columns, row_col)


def whole_text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def pieces_of(batch: pa.RecordBatch, text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text holds about ``most`` bytes at most, so memory does not follow the batch size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def collect_garbage(spark: SparkSession) -> None:
    """Frees the shuffle files of finished jobs: Spark deletes them once nothing in the driver refers to their plans."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> None:
    """The driver's JVM gives back what it has freed outside its heap: hundreds of MB after many plans, mostly of their compilation.

    A public command of the JVM's management beans; a JVM that lacks it keeps its memory.
    """
    gateway = spark.sparkContext._gateway
    java = gateway.jvm.java.lang
    with contextlib.suppress(Py4JError, PySparkException):
        # The bean's own class is closed to callers, its interface is open.
        kinds, given = gateway.new_array(java.Class, 4), gateway.new_array(java.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = java.Class.forName(name)
        given[0], given[1] = gateway.jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), given)


#: What operators keep in a Python worker between tasks, and for whom it is kept.
KEPT: list[dict] = []
_OWNER: list[str] = [""]


def claim(owner: str) -> None:
    """At the start of a task: what other operators have kept in this Python worker goes."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for kept in KEPT:
            kept.clear()
        trim()


def trim() -> None:
    """Gives freed memory back at the end of a task: Python workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Whitespace-separated words: code of each word in order, offsets by text, and the words by code."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        keep = codes != empty
        owner = np.repeat(np.arange(len(lengths)), lengths)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=len(lengths)))))
        codes = codes[keep]
    return codes, offsets.astype(np.int64), coded.dictionary


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``coded_words`` with the words as a list."""
    codes, offsets, words = coded_words(texts)
    return codes, offsets, words.to_pylist()


def bytes_of(texts: pa.Array) -> np.ndarray:
    """The bytes of all texts in a row; no text may be null."""
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    first, last = edges[texts.offset], edges[texts.offset + len(texts)]
    return np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def prefix_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running total of ``value`` by group over (bucket, order), in two levels.

    Only the totals of buckets are summed along a group, so no task holds more than one bucket of rows.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_total"))
    along = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, bucket, F.coalesce(F.sum("_total").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [*group, bucket])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside")
    )


def frequent(total: int) -> int:
    """A key with more of ``total`` rows than this is common; at most 65536 keys are, at every size."""
    return max(64, total >> 16)


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, count: str = "_n", spread: list[str] | None = None, salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with one row for each key, where ``count`` says how many rows have it (of ``total``).

    The rows of a common key are dealt to ``salts`` parts by a hash of their ``spread`` columns (all, if not given). Only
    the common keys go out to all tasks, 65536 of them at most; each other key has too few rows to be a hot one.
    """
    often = F.col(count) > frequent(total)
    common = F.broadcast(keyed.where(often).select(*on, F.lit(True).alias("_common")))
    salt = F.when(F.col("_common"), F.pmod(F.xxhash64(*(spread or rows.columns)), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    dealt = rows.join(common, on, "left").withColumn("_salt", salt).drop("_common")
    offered = keyed.withColumn("_salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(count)
    return dealt.join(offered, [*on, "_salt"]).drop("_salt")


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root) for every node but the roots; root is the least node.

    Alternates the large-star and small-star steps; each is one aggregation and one equi-join in which nodes with very
    many neighbours are no hot keys. Every round is written to the shared folder.
    """

    def star(pairs: DataFrame, large: bool, n: int) -> DataFrame:
        if large:
            both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("_n"))
            out = join_counted(both, least, ["a"], 2 * n).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
            links = join_counted(down, least, ["a"], n)
            out = links.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.put(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), f"{name}-0")
    before, k = None, 0
    while (seen := state(now)) != before and seen[0]:
        before, k = seen, k + 1
        # Few rows make few files.
        parts = 2 * seen[0] // 500_000 + 1
        half = scratch.put(star(now, True, seen[0]).coalesce(parts), f"{name}-{k}-large")
        now = scratch.put(star(half, False, seen[0]).coalesce(parts), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        scratch.drop(f"{name}-{k}-large")
        collect_garbage(scratch.spark)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
