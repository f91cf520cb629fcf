"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, shuffled by a hash, form one stream of words that is read again from its start when it
ends. The schedule's slots all take blocks of equally many words: slot i goes to the source in whose share of the
cumulative weights the golden-ratio point frac(i * phi) falls, and the r-th slot of a source takes the r-th block of
that source's stream. A source stops at its target; slots that come after that are skipped, and blocks that the
points have not yet reached when the schedule ends are appended, source by source. What a document gives and where it
stands in the mix are read from the slots of the blocks it lies in.

Null or empty texts have size 0 and are taken 0 times; very long texts lie in many blocks. A null source is a source
of its own, last in order. Ties in the shuffle are broken by id and size. Repeated rows, and rows that repeat an id or
have none, are rows like others. An empty table gives an empty result. Only the named columns are read, so other
columns may have any name. No step gathers all sources or a whole source in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convlens.llm.common import Scratch, free_name, numbered, prefix_sum, written

#: Fractional part of the golden ratio as a multiple of 2**-62: points are exact integers.
GOLDEN = 2850178567708297085
POINTS = 1 << 62
CELLS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORDS)), F.lit(0)).cast("long")


def ranked(rows: DataFrame, order: Column, name: str, out: str, scratch: Scratch) -> DataFrame:
    """Rows with their place in the order, from the sizes of sorted ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.put(placed, name).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    ranges = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(ranges), "_part")
    return joined.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], passes: int, scratch: Scratch) -> DataFrame:
    """(source, source_id, source_size, target): shares of all words by weight, none above ``passes`` times its size.

    Round by round the sources that the level of the open ones would overfill are filled, and what is left is shared
    anew by weight, until none is above.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = ranked(by, F.col("source").asc_nulls_last(), "sources", "source_id", scratch)
    listed = listed.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("source_id") % len(weights) + 1).cast("int")))
    listed = scratch.put(listed.withColumn("_cap", F.lit(float(passes)) * F.col("source_size")), "listed")
    everything, level = listed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0], 0.0
    while True:
        full = F.col("_cap") < F.col("_w") * level
        caps, open_weight = listed.agg(F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("_w")))).first()
        if not open_weight or (everything - caps) / open_weight <= level:
            break
        level = (everything - caps) / open_weight
    return listed.select("source", "source_id", "source_size", F.least("_cap", F.lit(level) * F.col("_w")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    passes: int = 3,
    block_words: int = 1024,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Row by row (doc_id, row, source, size, source_size, target, taken, first_slot, copies).

    ``taken`` is how many words the mix takes, repeats counted; ``first_slot`` the first slot that takes of the document;
    ``copies`` has for each pass over the source its first slot, the place in the stream and the words taken. ``row``
    is the number in ``row_col``.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    row = (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row")
    rows = docs.select(F.col(id_col).alias("doc_id"), row, F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    rows = scratch.put(rows, "sizes")
    targets = scratch.put(source_targets(rows, weights, passes, scratch), "targets")
    named = targets.withColumn("_want", F.round("target").cast("long"))

    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    stream = rows.join(named, rows["source"].eqNullSafe(named["source"])).select(
        "doc_id", "row", rows["source"], "size", "source_id", "source_size", "target", "_want", key.alias("_key")
    )
    # Some thousand rows in a bucket of the largest source, at every size.
    digits = min(8, max(3, math.ceil(math.log(rows.count() + 1, 16)) - 3))
    filled = stream.where("size > 0").withColumn("_bucket", F.substring("_key", 1, digits))
    filled = prefix_sum(filled, ["source_id"], "_bucket", ["_key", "doc_id", "size", "row"], "size", "_start")

    block = F.lit(block_words)
    passed = filled.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    passed = passed.withColumn("_from", F.col("_start") + F.col("_pass") * F.col("source_size"))
    passed = passed.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_want")))
    reached = passed.where("_to > _from").withColumn("block", F.explode(F.sequence(F.expr(f"_from div {block_words}"), F.expr(f"(_to - 1) div {block_words}"))))
    inside = F.least(F.col("_to"), (F.col("block") + 1) * block) - F.greatest(F.col("_from"), F.col("block") * block)
    parts = reached.select("source_id", "block", "_start", "_from", inside.alias("_words"))
    slots = schedule(named, block_words)
    got = parts.join(slots, ["source_id", "block"]).groupBy("source_id", "_start", "_from").agg(F.sum("_words").alias("words"), F.min("slot").alias("slot"))
    copies = F.array_sort(F.collect_list(F.struct("slot", F.col("_from").alias("place"), "words"))).alias("copies")  # as many as passes
    got = got.groupBy("source_id", "_start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), copies)
    kept = filled.select("doc_id", "row", "source", "size", "source_id", "source_size", "target", "_start").join(got, ["source_id", "_start"], "left")
    out = ["doc_id", "row", "source", "size", "source_size", "target"]
    taken = kept.select(*out, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "copies")
    none = stream.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return taken.unionByName(none, allowMissingColumns=True)


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """(slot, source_id, block): which block of which source each slot takes; each wanted block of a source once.

    ``targets`` has (source_id, _want), the words wanted of each source.
    """
    spark = targets.sparkSession
    needs = targets.where("_want > 0").select("source_id", F.col("_want").cast("long").alias("_want"), F.ceil(F.col("_want") / block_words).cast("long").alias("_blocks"))
    n, words = needs.agg(F.coalesce(F.sum("_blocks"), F.lit(0)), F.coalesce(F.sum("_want"), F.lit(0))).first()
    along = lambda df, value, out: prefix_sum(df.withColumn("_all", F.lit(1)).withColumn("_part", F.expr("source_id div 4096")), ["_all"], "_part", ["source_id"], value, out).drop("_all", "_part")
    share = along(needs, "_want", "_words")
    share = share.withColumn("_lo", F.col("_words") / F.lit(float(words))).withColumn("_hi", (F.col("_words") + F.col("_want")) / F.lit(float(words)))
    cell = lambda c: F.floor(F.col(c) * CELLS).cast("int")
    cells = share.withColumn("_cell", F.explode(F.sequence(cell("_lo"), F.least(cell("_hi"), F.lit(CELLS - 1)))))

    point = F.expr(f"cast(pmod(cast(id as decimal(19,0)) * cast({GOLDEN} as decimal(19,0)), cast({POINTS} as decimal(19,0))) as double) / {float(POINTS)!r}")
    points = spark.range(int(n)).withColumn("_u", point)
    points = points.withColumn("_cell", F.least(F.floor(F.col("_u") * CELLS).cast("int"), F.lit(CELLS - 1)))
    drawn = points.join(cells, "_cell").where("_u >= _lo and _u < _hi").select(F.col("id").alias("slot"), "source_id", "_blocks")
    places = prefix_sum(
        drawn.withColumn("_run", F.expr("slot div 65536")).withColumn("_one", F.lit(1)), ["source_id"], "_run", ["slot"], "_one", "block"
    )
    taken = places.where("block < _blocks").select("slot", "source_id", F.col("block").cast("long").alias("block"))
    have = drawn.groupBy("source_id").agg(F.count(F.lit(1)).alias("_have"))
    short = needs.join(have, "source_id", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).where("_have < _blocks")
    short = along(short.withColumn("_more", F.col("_blocks") - F.col("_have")), "_more", "_earlier")
    tail = short.select("source_id", "_have", "_earlier", F.explode(F.sequence("_have", F.col("_blocks") - 1)).alias("block"))
    tail = tail.select((F.lit(n) + F.col("_earlier") + F.col("block") - F.col("_have")).cast("long").alias("slot"), "source_id", "block")
    return taken.unionByName(tail)


def mixed_documents(docs: DataFrame, *, scratch: Scratch | None = None, **options) -> DataFrame:
    """The documents in the order of the mix's slots, once for each pass that takes at least half of their words.

    Each row is followed by a number of its own, so rows that repeat an id or have none are told apart.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixed")
    row_col, copy = free_name(docs, "_row"), free_name(docs, "_copy")
    rows = numbered(docs, row_col, scratch)

    def copies() -> DataFrame:
        taken = mix(rows, row_col=row_col, **options).where("taken > 0")
        kept = taken.select("row", F.explode(F.filter("copies", lambda c: c["words"] * 2 >= F.col("size"))).alias("_copy"))
        return kept.select(F.col("row").alias(row_col), F.struct("_copy.slot", "_copy.place").alias(copy))

    joined = rows.join(written(copies, scratch), row_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartitionByRange(n, copy).sortWithinPartitions(copy).select(*docs.columns)
