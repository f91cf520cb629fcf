"""Operators over conversations.

``messages`` is the long form (conv_id, turn, role, text); ``nested`` has one row per conversation. All messages of a
conversation meet in one shuffle by conv_id; what follows reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convlens import lexicon as L
from convlens.functions import text as T
from convlens.session import checkpointed


def nest(messages: DataFrame) -> DataFrame:
    """(conv_id, messages, text, n_messages), messages in turn order."""
    grouped = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    joined = F.array_join(F.transform("messages", lambda m: m["content"]), " ")
    return grouped.select("conv_id", "messages", joined.alias("text"), F.size("messages").cast("long").alias("n_messages"))


def flatten(nested: DataFrame) -> DataFrame:
    return nested.select("conv_id", F.explode("messages").alias("m")).select("conv_id", "m.turn", "m.role", F.col("m.content").alias("text"))


def prompt_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def of_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def categorized(nested: DataFrame) -> DataFrame:
    """The keyword path: category, sentiment and a preview of each conversation."""
    return nested.select(
        "conv_id", T.category_cascade(F.col("text")).alias("category"), F.round(T.sentiment_by_presence(F.col("text")), 6).alias("sentiment"),
        "n_messages", F.substring("text", 1, 200).alias("preview"),
    )


def category_clusters(nested: DataFrame, category: Column) -> DataFrame:
    """Clusters by category, numbered in the order in which categories are first seen, with description and keywords."""
    by = nested.groupBy(category.alias("name")).agg(F.count(F.lit(1)).alias("count"), F.min("conv_id").alias("first_conv"))
    about = F.create_map(*[F.lit(x) for p in L.CATEGORY_TEXT.items() for x in p])
    keywords = F.create_map(*[x for k, w in L.CATEGORY_KEYWORDS.items() for x in (F.lit(k), F.lit(",".join(w)))])
    numbered = by.withColumn("cluster_id", F.row_number().over(Window.orderBy("first_conv")).cast("long"))
    return numbered.select("cluster_id", "name", "count", "first_conv", F.coalesce(about[F.col("name")], F.lit("Various conversation topics")).alias("description"), F.coalesce(keywords[F.col("name")], F.lit("")).alias("keywords"))


def corpus_stats(nested: DataFrame) -> DataFrame:
    n = F.col("n_messages")
    return nested.agg(F.count(F.lit(1)).alias("conversations"), F.sum(n).alias("messages"), F.min(n).alias("least"), F.max(n).alias("most")).select(
        "*", F.expr("messages div conversations").alias("average")
    )


def first_by(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key by ``order``, an id: least ids from a partial aggregation, then a semi-join on the id."""
    return df.join(df.groupBy(key.alias("_key")).agg(F.min(order).alias(order)).select(order), order, "left_semi")


def duplicate_issues(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Later rows of a key with the first row they repeat; one aggregation and one join, not a sort per key."""
    keyed = df.select(order, key.alias("_key"))
    first = keyed.groupBy("_key").agg(F.min(order).alias("original"))
    return keyed.join(first, "_key").where(F.col(order) > F.col("original")).select(order, "original")


def format_issues(messages: DataFrame, *, least: int = 2, most: int = 1000, roles: Sequence[str] = ("user", "assistant")) -> DataFrame:
    """(conv_id, turn, severity, issue_type, message), turn null for issues of a conversation."""
    n = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("role").alias("roles"))
    none = F.lit(None).cast("long")
    size = F.when(F.col("n") < least, F.struct(F.lit("too_short").alias("t"), F.format_string("Conversation has only %d messages", "n").alias("m"))).when(
        F.col("n") > most, F.struct(F.lit("too_long").alias("t"), F.format_string("Conversation has %d messages, may be truncated", "n").alias("m"))
    )
    sizes = n.withColumn("i", size).where("i is not null").select("conv_id", none.alias("turn"), F.lit("warning").alias("severity"), F.col("i.t").alias("issue_type"), F.col("i.m").alias("message"))
    missing = n.select("conv_id", F.explode(F.array_except(F.array(*map(F.lit, roles)), "roles")).alias("role"))
    missing = missing.select("conv_id", none.alias("turn"), F.lit("warning").alias("severity"), F.lit("missing_role").alias("issue_type"), F.format_string("Missing '%s' role in conversation", "role").alias("message"))
    last = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    again = messages.withColumn("_last", last).where("role = _last and role <> 'system'")
    again = again.select("conv_id", F.col("turn").cast("long"), F.lit("info").alias("severity"), F.lit("invalid_format").alias("issue_type"), F.concat(F.lit("Consecutive messages from same role: "), "role").alias("message"))
    return sizes.unionByName(missing).unionByName(again)


def content_issues(messages: DataFrame, *, least: int = 10, most: int = 50_000, patterns: Mapping[str, str] = L.PII) -> DataFrame:
    """(conv_id, turn, issue_type, message) of each message in one pass."""
    n = F.length("text")
    found = [
        F.when(n < least, F.struct(F.lit("low_quality").alias("t"), F.format_string("Message content too short (%d chars)", n).alias("m"))),
        F.when(n > most, F.struct(F.lit("truncated").alias("t"), F.format_string("Message content too long (%d chars)", n).alias("m"))),
        *[F.when(c, F.struct(F.lit("pii").alias("t"), F.lit(f"Potential {k} detected").alias("m"))) for k, c in T.pii_flags(F.col("text"), patterns).items()],
    ]
    return messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.explode(F.array_compact(F.array(*found))).alias("i")).select("conv_id", "turn", F.col("i.t").alias("issue_type"), F.col("i.m").alias("message"))


def encoding_issues(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, issue_type, message): an error for each message whose bytes, read as a string, are not UTF-8."""
    bad = messages.where("text is not null and not is_valid_utf8(text)")
    told = F.format_string("Message content is not valid UTF-8 (%d bytes)", F.octet_length("text"))
    return bad.select("conv_id", F.col("turn").cast("long").alias("turn"), F.lit("encoding_issue").alias("issue_type"), told.alias("message"))


def decoded(messages: DataFrame, raw: str) -> DataFrame:
    """Messages with the bytes of a column as their text, faults kept for ``encoding_issues``."""
    return messages.withColumn("text", F.col(raw).cast("string")).drop(*([raw] if raw != "text" else []))


def content_score(messages: DataFrame, issues: DataFrame) -> DataFrame:
    """Quality of a set of conversations: 1 less issues over three times their number, within 0 and 1."""
    n = messages.agg(F.countDistinct("conv_id").alias("n"))
    return n.crossJoin(issues.agg(F.count(F.lit(1)).alias("issues"))).select(
        "n", "issues", F.round(F.when(F.col("n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("issues") / (F.col("n") * 3)))), 6).alias("score")
    )


def quality(messages: DataFrame, *, short: int = 50) -> DataFrame:
    """(conv_id, quality): the product of a factor for few messages, short ones and a missing side."""
    has = lambda r: F.max((F.col("role") == r).cast("int"))
    by = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean"), has("user").alias("u"), has("assistant").alias("a"))
    q = F.when(F.col("n") < 2, 0.5).otherwise(1.0) * F.when(F.col("mean") < short, 0.7).otherwise(1.0) * F.when((F.col("u") == 0) | (F.col("a") == 0), 0.5).otherwise(1.0)
    return by.select("conv_id", F.round(q, 6).alias("quality"))


def quality_bytes(messages: DataFrame, *, short: int = 20) -> DataFrame:
    """The variant by bytes: whole-number mean under ``short``, a missing side by 0.6."""
    has = lambda r: F.max((F.col("role") == r).cast("int"))
    by = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"), has("user").alias("u"), has("assistant").alias("a"))
    q = F.when(F.col("n") < 2, 0.5).otherwise(1.0) * F.when(F.expr("b div n") < short, 0.7).otherwise(1.0) * F.when((F.col("u") == 0) | (F.col("a") == 0), 0.6).otherwise(1.0)
    return by.select("conv_id", F.round(q, 6).alias("quality"))


def tokens(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.sum(T.word_tokens(F.col("text"))).cast("long").alias("tokens"))


def tokens_with_roles(messages: DataFrame) -> DataFrame:
    """Words of text and role, and four more for each message."""
    return messages.groupBy("conv_id").agg(F.sum(T.word_tokens(F.col("text")) + T.word_tokens(F.col("role")) + 4).cast("long").alias("tokens"))


def token_stats(counted: DataFrame, limit: int) -> DataFrame:
    t = F.col("tokens")
    return counted.agg(
        F.sum(t).alias("total"), F.round(F.avg(t), 6).alias("average"), F.min(t).alias("least"), F.max(t).alias("most"),
        F.count(F.when(t > limit, 1)).alias("over_limit"),
    )


def token_buckets(counted: DataFrame, bounds: Sequence[int] = (500, 1000, 2000, 4000)) -> DataFrame:
    labels = [f"{a + 1 if a else 0}-{b}" for a, b in zip((0, *bounds[:-1]), bounds)]
    bucket = F.coalesce(*[F.when(F.col("tokens") <= b, F.lit(label)) for b, label in zip(bounds, labels)], F.lit(f"{bounds[-1]}+"))
    return counted.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("conversations"))


def by_message_language(messages: DataFrame, detect, *, least_chars: int, least_confidence: float) -> DataFrame:
    """(conv_id, language, confidence, mixed): the most frequent language of a conversation's messages."""
    language, confidence = detect(F.col("text"))
    known = messages.where(F.length("text") > least_chars).select("conv_id", language.alias("language"), confidence.alias("confidence")).where(F.col("confidence") >= least_confidence)
    by = known.groupBy("conv_id", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    return by.groupBy("conv_id").agg(
        F.max(F.struct("n", "language"))["language"].alias("language"), F.round(F.sum("c") / F.sum("n"), 6).alias("confidence"), (F.count(F.lit(1)) > 1).alias("mixed")
    )


def batches_fixed(nested: DataFrame, size: int) -> DataFrame:
    """(conv_id, batch): position in id order div size, from positions in ranges of ids, not one sorted task."""
    return numbered(nested, "conv_id").select("conv_id", F.expr(f"position div {size}").alias("batch"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds the zero-based ``position`` in the order of the columns: sorted ranges are written, then their sizes are added up."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(placed).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))  # one row a range
    return placed.join(starts, "_part").withColumn("position", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def batches_by_language(languages: DataFrame, size: int) -> DataFrame:
    placed = numbered(languages, "language", "conv_id")
    first = placed.groupBy("language").agg(F.min("position").alias("_first"))
    of = F.expr(f"cast((position - _first) div {size} as bigint)").alias("batch")
    return placed.alias("p").join(first.alias("f"), F.col("p.language").eqNullSafe(F.col("f.language"))).select("conv_id", "p.language", of)


def page_ways(sizes: Sequence[int], most: int) -> list[tuple[int, int, int]]:
    """What greedy paging does to a stretch of items, for every way it can be entered: (room, pages, fill).

    With ``room`` or more left in the open page, up to the next entry's, the items that fit there join it, and the rest
    makes ``pages`` new pages, the last filled to ``fill``. Ways soon meet, so there are few different ones.
    """
    import numpy as np

    n, ends = len(sizes), np.concatenate(([0], np.cumsum(sizes)))
    after = np.maximum(np.arange(n) + 1, np.searchsorted(ends, ends[:-1] + most, side="right") - 1).tolist()
    known, out = {n: (0, 0)}, []
    for j in range(n + 1):
        if j and ends[j] > most:
            break
        if j < n and ends[j + 1] == ends[j]:
            continue
        path, at = [], j
        while at not in known:
            path.append(at)
            at = after[at]
        for i in reversed(path):
            pages, fill = known[after[i]]
            known[i] = (pages + 1, fill if pages else int(ends[n] - ends[i]))
        if not out or out[-1][1:] != known[j]:
            out.append((int(ends[j]), *known[j]))
    return out


def greedy_pages(rows: DataFrame, order: Sequence[str], size: str, most: int, group: str | None = None) -> DataFrame:
    """Adds ``page``: greedy pages of at most ``most``, in order; an item that is larger is alone.

    Sorted ranges are paged in parallel for every way they can be entered; the ways are then chained from range to range on the
    driver, a few numbers each, and a second pass gives every item its page. The answer does not depend on the ranges.
    """
    import numpy as np
    import pyarrow as pa

    spark = rows.sparkSession
    keyed = rows.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit(""))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.repartitionByRange(n, "_g", *order).sortWithinPartitions("_g", *order).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(placed).withColumn("_part", F.shiftright("_at", 33))
    light = placed.select("_part", "_g", "_at", F.col(size).cast("long").alias("_size"))

    def ways(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_at", "ascending")])
        room, pages, fill = zip(*page_ways(t.column("_size").to_numpy(), most))
        own = [pa.array([t.column(c)[0].as_py()] * len(room), k) for c, k in (("_part", pa.int64()), ("_g", pa.string()), ("_size", pa.int64()))]
        return pa.table([*own, *(pa.array(x, pa.int64()) for x in (room, pages, fill))], ["_part", "_g", "lead", "room", "pages", "fill"])

    found = light.groupBy("_part", "_g").applyInArrow(ways, "_part long, _g string, lead long, room long, pages long, fill long")
    begins, key, steps, lead, state = [], None, [], 0, (None, -1, 0)

    def enter(key: tuple[str, int], steps: list[tuple[int, int, int]], lead: int, state: tuple) -> tuple:
        """Notes how a range is entered; what it leaves behind: (group, last page, fill)."""
        # A group begins in an empty page, unless its first item is too large for one.
        group_, page, fill = state if state[0] == key[0] else (key[0], -1, None) if lead > most else (key[0], 0, 0)
        room = -1 if fill is None else most - fill
        begins.append((key[1], key[0], room, page))
        used, pages, last = max((s for s in steps if s[0] <= room), default=steps[0])
        return group_, page + pages, last if pages else (fill or 0) + used

    for r in found.orderBy("_g", "_part", "room").toLocalIterator():
        if (r["_g"], r["_part"]) != key:
            state = enter(key, steps, lead, state) if key else state
            key, steps, lead = (r["_g"], r["_part"]), [], r["lead"]
        steps.append((r["room"], r["pages"], r["fill"]))
    if key:
        enter(key, steps, lead, state)
    starts = spark.createDataFrame(begins, "_part long, _g string, _room long, _page long")

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_at", "ascending")])
        sizes, room, page = t.column("_size").to_numpy(), t.column("_room")[0].as_py(), t.column("_page")[0].as_py()
        ends, out = np.concatenate(([0], np.cumsum(sizes))), np.full(len(sizes), page, np.int64)
        j = max(0, int(np.searchsorted(ends, room, side="right")) - 1) if room >= 0 else 0
        while j < len(sizes):
            after = max(j + 1, int(np.searchsorted(ends, ends[j] + most, side="right")) - 1)
            page += 1
            out[j:after] = page
            j = after
        return pa.table({"_at": t.column("_at"), "page": pa.array(out)})

    paged = light.join(starts, ["_part", "_g"]).groupBy("_part", "_g").applyInArrow(place, "_at long, page long")
    return placed.join(paged, "_at").drop("_at", "_part", "_g")


def batches_by_budget(counted: DataFrame, budget: int, group: str | None = None) -> DataFrame:
    """Greedy batches: a new one when the sum would pass the budget; an oversize item is alone."""
    paged = greedy_pages(counted.select("conv_id", "tokens", *([group] if group else [])), ["conv_id"], "tokens", budget, group)
    return paged.select("conv_id", *([group] if group else []), F.col("page").alias("batch"))


def suggest_batching(languages: int, most_tokens: float, average: float) -> tuple[str, int]:
    if languages > 1:
        return "language", 50
    return ("token", int(min(100, 100_000 / max(average, 1)))) if most_tokens > 8000 else ("fixed", 100)


def truncate_middle(nested: DataFrame, counted: DataFrame, limit: int) -> DataFrame:
    """Over the limit and with more than two messages: the first half and the last half of what the share allows."""
    n = F.size("messages")
    keep = F.greatest(F.lit(2), F.floor(n * limit / F.col("tokens")).cast("int"))
    head = F.floor(keep / 2).cast("int")
    cut = F.concat(F.slice("messages", F.lit(1), head), F.slice("messages", n - (keep - head) + 1, keep - head))
    return nested.join(counted, "conv_id").withColumn("messages", F.when((F.col("tokens") > limit) & (n > 2), cut).otherwise(F.col("messages")))


def truncate_head(messages: DataFrame, limit: int, suffix: str = "... [truncated]", spare: int = 10) -> DataFrame:
    """Whole messages while they fit, then the words that still fit of the next if more than ``spare`` do."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    counted = messages.withColumn("_t", T.word_tokens(F.col("text")) + T.word_tokens(F.col("role")) + 4)
    used = counted.withColumn("_used", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    used = used.withColumn("_left", F.lit(limit) - (F.col("_used") - F.col("_t")))
    part = F.concat(F.array_join(F.slice(F.split(T.strip(F.col("text")), r"\s+"), F.lit(1), F.greatest(F.col("_left") - 5, F.lit(0)).cast("int")), " "), F.lit(suffix))
    kept = used.where((F.col("_used") <= limit) | ((F.col("_left") > spare) & (F.col("_used") - F.col("_t") <= limit)))
    return kept.select("conv_id", "turn", "role", F.when(F.col("_used") <= limit, F.col("text")).otherwise(part).alias("text"))


def truncate_tail(messages: DataFrame, limit: int) -> DataFrame:
    """The newest messages within the budget of bytes div 4; a user message that would end the result goes."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    fits = messages.withColumn("_sum", F.sum(F.expr("octet_length(text) div 4")).over(back.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= limit)
    newest = fits.withColumn("_last", F.row_number().over(back))
    return newest.where("not (_last = 1 and role = 'user')").select("conv_id", "turn", "role", "text")


def near_duplicates(messages: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs (a, b, similarity) of conversations of equal length that agree in enough positions, exact copies left out.

    Copies are first reduced to one. Of n positions a pair agrees in n * threshold at least, so it shares one of any
    n - ceil(n * threshold) + 1; a conversation is looked up only by those of its messages that fewest others have at
    their place, so a greeting that all share brings nobody together. Pairs that meet are compared in all positions.
    """
    keyed = messages.select("conv_id", "turn", F.xxhash64("role", "text").alias("h"))
    whole = keyed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "h"))).alias("m"))
    whole = whole.select("conv_id", F.transform("m", lambda x: x["h"]).alias("hs"), F.size("m").alias("n"))
    single = whole.groupBy(F.xxhash64("hs").alias("_all"), "n").agg(F.min_by("hs", "conv_id").alias("hs"), F.min("conv_id").alias("conv_id")).drop("_all")
    placed = single.select("conv_id", "n", F.posexplode("hs").alias("p", "h"))
    often = placed.groupBy("n", "p", "h").agg(F.count(F.lit(1)).alias("_often"))
    most = F.expr(f"cast(n - ceil(n * {threshold}D - 1e-9) + 1 as int)")
    rarest = placed.join(often, ["n", "p", "h"]).groupBy("conv_id", "n").agg(F.array_sort(F.collect_list(F.struct("_often", "p", "h"))).alias("r"))
    looked = rarest.select("conv_id", "n", F.explode(F.slice("r", F.lit(1), most)).alias("r")).where("r._often > 1").select("conv_id", "n", "r.p", "r.h")
    a, b = looked.alias("a"), looked.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("n", "p", "h")]
    pairs = a.join(b, [*same, F.col("a.conv_id") < F.col("b.conv_id")]).select(F.col("a.conv_id").alias("a"), F.col("b.conv_id").alias("b")).distinct()
    sides = pairs.join(single.select(F.col("conv_id").alias("a"), "n", F.col("hs").alias("_x")), "a").join(single.select(F.col("conv_id").alias("b"), F.col("hs").alias("_y")), "b")
    agreed = F.size(F.filter(F.zip_with("_x", "_y", lambda x, y: x == y), lambda e: e)) / F.col("n")
    return sides.withColumn("_s", agreed).where(F.col("_s") >= threshold).select("a", "b", F.round("_s", 6).alias("similarity"))


def preprocess(messages: DataFrame, *, dedup: bool = True, clean=T.normalize_whitespace, remove_pii: bool = False, limit: int = 4000, least_quality: float = 0.3) -> DataFrame:
    """Empty, normalise, copies, truncate, quality: the steps of the active variant in their order."""
    rows = messages.withColumn("text", clean(F.col("text")))
    if remove_pii:
        rows = rows.withColumn("text", T.redact(F.col("text"))[0])
    nested = nest(rows).where("n_messages > 0")
    if dedup:
        nested = first_by(nested, F.sha2(F.array_join(F.transform("messages", lambda m: m["content"]), ""), 256), "conv_id")
    cut = truncate_middle(nested, tokens(flatten(nested)), limit).select("conv_id", "messages")
    good = quality(flatten(cut)).where(F.col("quality") >= least_quality)
    return flatten(cut.join(good.select("conv_id"), "conv_id", "left_semi"))
