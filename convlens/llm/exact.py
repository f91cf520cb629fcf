"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z. An index entry is one distinct text under the 64-bit hash of it. The key space
is cut into ranges of equal width, one for each owner task; how many follows the number of texts. Tasks that read documents
first reduce what repeats among their own rows to one, so a text that a third of all rows share reaches its owner once from each
task. The owner sorts its entries by key and text and goes through them once: entries of one key are a chain, and neighbours are
compared byte by byte, in constant memory however long a chain is. It writes its range as one file.

The directory has the buckets: a bucket holds the keys with a common prefix and splits by the next bit while it has more
than ``capacity`` keys, and the directory doubles until its prefixes are as long as the deepest bucket's. Buckets of an
owner lie in its file as one range of keys, so a look-up reads the file's row groups of that range. Keys that are equal in all bits
cannot be split; they stay a chain. ``add`` puts further documents in: only ranges with new entries are written again,
in a new generation, and only their buckets split.

Of equal texts, the row with the largest id stays; null ids are less than all others, and of rows with one id the one
read last stays. Null texts count as empty, and empty texts are equal. Very long texts are compared whole. An empty
table gives an empty index and result. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.llm.common import Scratch, claim, few, join_counted, pieces_of, trim, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that an owner's range has in the mean at most, and at least so many owners.
RANGE, LEAST = 1 << 15, 6
ENTRY = "key long, text string, keep struct<known:int,doc_id:long,row:long>, n long"
_OWNED = "owner int, key long, chain int, text string, keep struct<known:int,doc_id:long,row:long>, n long"


def normal(text_col: str) -> Column:
    return F.translate(whole_text(text_col), UPPER, LOWER)


def _order(keep: pa.Array) -> list[tuple]:
    return list(zip(*(keep.field(c).to_pylist() for c in ("known", "doc_id", "row"))))


def _reduced(batches: Iterator[pa.RecordBatch], most: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Rows of a task with equal texts become one. Texts met twice are held back, ``most`` bytes of them; the rest go on at once."""
    claim("exact")
    held: dict[int, list[list]] = {}
    size, schema = 0, None

    def flush() -> pa.RecordBatch:
        rows = [(key, *entry) for key, chain in held.items() for entry in chain]
        keep = [dict(zip(("known", "doc_id", "row"), r[2])) for r in rows]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(keep, schema.field("keep").type), pa.array([r[3] for r in rows], pa.int64())], schema=schema)

    for whole in batches:
        schema = whole.schema
        for batch in pieces_of(whole, "text", 1 << 23):
            keys = batch.column("key").to_numpy()
            _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            if held:
                again |= np.isin(keys, np.fromiter(held, np.int64, len(held)))
            if not again.all():
                yield batch.filter(pa.array(~again))
            several = batch.filter(pa.array(again))
            for key, text, keep, n in zip(several.column("key").to_pylist(), several.column("text").to_pylist(), _order(several.column("keep")), several.column("n").to_pylist()):
                chain = held.setdefault(key, [])
                for entry in chain:
                    if entry[0] == text:
                        entry[1], entry[2] = max(entry[1], keep, key=_rank), entry[2] + n
                        break
                else:
                    chain.append([text, keep, n])
                    size += len(text)
            if size > most:
                yield flush()
                held.clear()
                size = 0
    if held:
        yield flush()
    trim()


def _rank(keep: tuple) -> tuple:
    return keep[0], keep[1] or 0, keep[2]


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One owner's entries in the order of key and text: equal neighbours become one, a chain's texts are numbered."""
    claim("exact")
    key, text, chain, keep, n, owner = None, None, 0, None, 0, 0
    for whole in batches:
        for batch in pieces_of(whole, "text", 1 << 23):
            keys, texts, keeps, counts, owners = batch.column("key").to_numpy(), batch.column("text"), _order(batch.column("keep")), batch.column("n").to_pylist(), batch.column("owner").to_pylist()
            out: list[tuple] = []
            for i in range(batch.num_rows):
                here = int(keys[i])
                if here == key and (body := texts[i].as_py()) == text:
                    keep, n = max(keep, keeps[i], key=_rank), n + counts[i]
                    continue
                if key is not None:
                    out.append((owner, key, chain, text, keep, n))
                chain = chain + 1 if here == key else 0
                key, text, keep, n, owner = here, texts[i].as_py(), keeps[i], counts[i], owners[i]
            yield _batch(out)
    if key is not None:
        yield _batch([(owner, key, chain, text, keep, n)])
    trim()


_KEEP = pa.struct([("known", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    o, k, c, t, keep, n = zip(*rows) if rows else ((),) * 6
    parts = [pa.array([x[j] for x in keep], f.type) for j, f in enumerate(_KEEP)]
    return pa.record_batch({"owner": pa.array(o, pa.int32()), "key": pa.array(k, pa.int64()), "chain": pa.array(c, pa.int32()), "text": pa.array(t, pa.string()), "keep": pa.StructArray.from_arrays(parts, fields=list(_KEEP)), "n": pa.array(n, pa.int64())})


def split(keys: np.ndarray, depth: int, prefix: int, capacity: int) -> list[tuple[int, int, int]]:
    """(depth, prefix, keys) of the buckets for sorted distinct unsigned keys that share a prefix of ``depth`` bits."""
    if len(keys) <= capacity or depth == 64:
        return [(depth, prefix, len(keys))]
    middle = np.uint64((2 * prefix + 1) << (63 - depth))
    at = int(np.searchsorted(keys, middle))
    return split(keys[:at], depth + 1, 2 * prefix, capacity) + split(keys[at:], depth + 1, 2 * prefix + 1, capacity)


class Index:
    """Entries and directory below a scratch folder; ``bits`` of a key name its owner."""

    def __init__(self, scratch: Scratch, bits: int, capacity: int):
        self.scratch, self.bits, self.capacity = scratch, bits, capacity
        self.generation = 0
        self.live: DataFrame | None = None  # (owner, generation) of each range
        self.directory: DataFrame | None = None

    def owner(self, key: str = "key") -> Column:
        return F.shiftrightunsigned(key, 64 - self.bits).cast("int")

    def entries(self) -> DataFrame:
        """(owner, key, chain, text, keep, n), one row for each distinct text."""
        if self.generation == 1:
            return self.scratch.get("entries-1", _OWNED)
        every = [self.scratch.get(f"entries-{g}", _OWNED).withColumn("generation", F.lit(g)) for g in range(1, self.generation + 1)]
        rows = every[0]
        for more in every[1:]:
            rows = rows.unionByName(more)
        return rows.join(few(self.live), ["owner", "generation"]).drop("generation")

    def add(self, rows: DataFrame) -> Index:
        """Puts in rows (key, text, keep, n); ranges without new entries stay as they are."""
        new = rows.select("key", "text", "keep", "n").mapInArrow(_reduced, ENTRY).withColumn("owner", self.owner())
        if self.generation:
            touched = self.scratch.put(rows.select(self.owner().alias("owner")).distinct(), f"touched-{self.generation + 1}")
            new = new.unionByName(self.entries().drop("chain").join(few(touched), "owner"))
        dealt = new.repartitionById(1 << self.bits, F.col("owner")).sortWithinPartitions("key", "text")
        self.generation += 1
        written = self.scratch.put(dealt.select("owner", "key", "text", "keep", "n").mapInArrow(_owned, _OWNED), f"entries-{self.generation}")
        ranges = written.select("owner").distinct().withColumn("generation", F.lit(self.generation))
        buckets = self._buckets(written)
        if self.live is not None:
            ranges = self.live.join(few(touched), "owner", "left_anti").unionByName(ranges)
            buckets = self.directory.join(few(touched), "owner", "left_anti").unionByName(buckets)
        self.live = self.scratch.put(ranges, f"live-{self.generation}")
        self.directory = self.scratch.put(buckets, f"directory-{self.generation}")
        return self

    def _buckets(self, entries: DataFrame) -> DataFrame:
        bits, capacity = self.bits, self.capacity

        def cut(table: pa.Table) -> pa.Table:
            owner = table.column("owner")[0].as_py()
            keys = np.sort(table.column("key").to_numpy().view(np.uint64))
            found = split(keys, bits, owner, capacity)
            return pa.table({"owner": pa.array([owner] * len(found), pa.int32()), "depth": pa.array([d for d, _, _ in found], pa.int32()), "prefix": pa.array(np.array([p for _, p, _ in found], np.uint64).view(np.int64)), "keys": pa.array([k for _, _, k in found], pa.int64())})

        return entries.where("chain = 0").select("owner", "key").groupBy("owner").applyInArrow(cut, "owner int, depth int, prefix long, keys long")

    def depth(self) -> int:
        """Global depth: the directory has 2^depth slots."""
        return self.directory.agg(F.max("depth")).first()[0] or self.bits

    def chained(self) -> DataFrame:
        """Keys under which several texts stand."""
        return self.entries().where("chain > 0").select("key").distinct()


def build(rows: DataFrame, total: int, scratch: Scratch, capacity: int = 1024) -> Index:
    """Index of rows (key, text, keep, n), ``total`` of them."""
    return Index(scratch, max(1, (max(LEAST, -(-total // RANGE)) - 1).bit_length()), capacity).add(rows)


def key_of(text: Column, key_bits: int = 64) -> Column:
    """The 64-bit hash; with fewer bits the rest are zero, so that texts collide."""
    return F.shiftleft(F.xxhash64(text), 64 - key_bits) if key_bits < 64 else F.xxhash64(text)


def duplicates(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, key_bits: int = 64) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) for every row."""
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal(text_col).alias("text"))
    read = read.select(F.monotonically_increasing_id().alias("row"), "doc_id", key_of(F.col("text"), key_bits).alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")
    rows = scratch.put(read, "rows")
    keep = F.struct(F.col("doc_id").isNotNull().cast("int").alias("known"), "doc_id", "row")
    total = rows.count()
    index = build(rows.select("key", "text", keep.alias("keep"), F.lit(1).cast("long").alias("n")), total, scratch, capacity)
    answer = index.entries().select("key", "chain", "text", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), F.col("n").alias("group_size"))
    chained, texts = index.chained(), None
    lone = answer.select("key", "keep_id", "keep_row", "group_size").withColumn("_n", F.col("group_size"))
    if not chained.isEmpty():
        chained = few(scratch.put(chained, "chained"))
        lone = lone.join(chained, "key", "left_anti")
        texts = rows.join(chained, "key").join(answer.drop("chain").join(chained, "key"), ["key", "text"]).drop("text")
    found = join_counted(rows.drop("text"), lone, ["key"], total, spread=["row"])
    columns = ["row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"]
    return found.select(*columns) if texts is None else found.select(*columns).unionByName(texts.select(*columns))
