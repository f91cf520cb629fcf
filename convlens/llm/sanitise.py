"""Personal data and the terms that give it away, by DataFrame functions only.

Base kinds, leftmost and non-overlapping per kind: ``email``, ``ip`` (parts at most 255), ``card`` (12 to 19 digits
that pass the Luhn check) and ``phone`` (9 to 15 digits). A match that fails its check is dropped without a retry.
Every base value is a protected entity. From the corpus it is estimated how much of an entity's information a term
gives away: log(p(entity | term) / p(entity)) / log(1 / p(entity)), from the documents that hold both, anywhere in the
text, all documents with the term, and all documents. A term is a run of four letters or more. Terms at or above
``disclosure`` are spans of kind ``term`` in the documents that hold the entity, if they have support: the entity stands
in at least ``support`` texts with the term in which its contexts differ (copies, and near copies with the same
contexts, count once), or the term is close to it in as many different contexts. ``sanitised`` replaces values and
terms: terms are generalised to ``[WORD]``, or
removed from ``removal`` on.

Positions come from the match lengths and the lengths of what lies between, both in code points. Spans are end
exclusive, ordered by start, then kind as listed. Null and empty texts have none; very long texts are read whole. Every
row is a document, in all counts alike; rows are answered by id and hash of the text, so repeated rows alike. A share
equal to the threshold discloses. An empty table gives an empty result. Only the named columns are read, so other
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.llm.common import Scratch, whole_text

KINDS = ("email", "ip", "card", "phone", "term")
#: Possessive loops: nothing follows them that could need a step back, and Java runs them without recursion. An e-mail
#: can only start where a run of its characters does or where the last match ended, so long runs are read once.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Shorter runs of digits could not pass, and runs are always taken whole.
CARD = r"[0-9](?:[\x20-]?[0-9]){11}(?:[\x20-]?[0-9])*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"\p{L}{4,}+"
BUCKETS = 1 << 20
#: Stands for a null id.
NO_ID = -(1 << 63)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside a lambda an expression would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(lengths: Column) -> Column:
    """Exclusive running sums of an array variable, by blocks, so the work does not grow with the square of its size."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = 64
    sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / block).cast("int")), lambda b: total(F.slice(lengths, b * block + 1, F.lit(block))))

    def along(blocks: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(lengths) - 1),
            lambda i: total(F.slice(blocks, F.lit(1), F.floor(i / block).cast("int"))) + total(F.slice(lengths, F.floor(i / block).cast("int") * block + 1, i % block)),
        )

    return let(sums, along)


def matches(text: Column, pattern: str) -> Column:
    """All matches as an array of (value, start, end); the pattern runs twice over the text, for matches and for gaps."""

    def spans(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        steps = F.zip_with(gaps, values, lambda g, v: F.length(g) + F.length(v))

        def placed(steps: Column) -> Column:
            ends = F.zip_with(prefix_sums(steps), steps, lambda a, b: a + b)
            return F.zip_with(values, ends, lambda v, e: F.struct(v.alias("value"), (e - F.length(v)).cast("long").alias("start"), e.cast("long").alias("end")))

        none = F.array().cast("array<struct<value:string,start:bigint,end:bigint>>")
        return F.when(F.size(values) > 0, let(steps, placed)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.reverse(digits(value))

    def step(total: Column, i: Column) -> Column:
        x = d.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def valid_ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(short) > 3, False).otherwise(F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, value), kind by its place in KINDS, in order."""
    n_digits = lambda m: F.length(digits(m["value"]))
    none = F.array().cast("array<struct<value:string,start:bigint,end:bigint>>")
    found = (
        F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none),
        F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), F.filter(matches(text, IP), lambda m: valid_ip(m["value"]))).otherwise(none),
        F.when(
            F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")),
            F.filter(matches(text, CARD), lambda m: F.when(n_digits(m).between(12, 19), luhn(m["value"])).otherwise(False)),
        ).otherwise(none),
        F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda m: n_digits(m).between(9, 15))).otherwise(none),
    )
    return F.array_sort(F.concat(*[typed(a, k) for k, a in enumerate(found)]))


def typed(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def context(text: Column, start: Column, end: Column, near: int) -> tuple[Column, Column]:
    """What stands within ``near`` characters before and after, without a word that the cut splits."""
    left = F.greatest(start - near, F.lit(0))
    before = text.substr((left + 1).cast("int"), (start - left).cast("int"))
    before = F.when(left > 0, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
    after = F.regexp_replace(text.substr((end + 1).cast("int"), F.lit(near)), r"\p{L}+$", "")
    return before, after


def find(
    docs: DataFrame, *, disclosure: float = 0.8, support: int = 3, near: int = 100, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, hash, spans, terms): all spans as (start, kind, end, value), and the revealing terms with their disclosure."""
    scratch = scratch or Scratch(docs.sparkSession, "sanitise")
    # Rows without an id are joined like others.
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), whole_text(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))

    def close_to(s: Column) -> Column:
        before, after = context(F.col("text"), s["start"], s["end"], near)
        words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", before, after)), F.lit(WORD), F.lit(0)))
        return F.struct(F.lower(s["value"]).alias("entity"), F.xxhash64(before, after).alias("context"), words.alias("words"))

    marked = texts.withColumn("base", base_spans(F.col("text"))).select("doc_id", "hash", "base", F.transform("base", close_to).alias("near"))
    marked = scratch.put(marked, "base")
    n = marked.count()
    some = marked.where(F.size("base") > 0)
    held = some.select("doc_id", "hash", F.explode("near").alias("e"))
    held = held.select("doc_id", "hash", "e.entity", "e.context", "e.words")
    close = held.select("entity", "hash", "context", F.explode("words").alias("term"))
    contexts = close.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("_contexts")).where(F.col("_contexts") >= support)
    contexts = scratch.put(contexts, "contexts")
    # Documents are rows: an entity counts once in each, and rows that repeat one count again, as they do for terms and in
    # all. Near copies have the same contexts of the entity, so they are seen as one.
    in_rows = some.select("hash", F.explode(F.array_distinct(F.transform("near", lambda e: e["entity"]))).alias("entity"))
    copies = in_rows.groupBy("entity", "hash").agg(F.count(F.lit(1)).alias("_copies"))
    seen = held.groupBy("entity", "hash").agg(F.xxhash64(F.sort_array(F.collect_set("context"))).alias("_seen"))
    each = scratch.put(copies.join(seen, ["entity", "hash"]), "each")
    times = F.count_distinct("_seen").alias("_times")
    entities = each.groupBy("entity").agg(F.sum("_copies").alias("_docs"), times).join(contexts.select("entity", F.lit(1).alias("_close")).distinct(), "entity", "left")
    entities = entities.where((F.col("_times") >= support) | F.col("_close").isNotNull()).where(F.col("_docs") < n)
    each = scratch.put(each.join(entities.select("entity", "_docs"), "entity"), "held")

    words_of = lambda text: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))).alias("term")
    in_docs = scratch.put(texts.select(words_of(F.col("text"))).groupBy("term").agg(F.count(F.lit(1)).alias("_df")), "terms")
    # Only bucket numbers go out, at most BUCKETS of them; they keep most other texts out of the shuffle. Of the base
    # values only e-mails have letters; their words do not count as words of the text.
    bucket = F.pmod("hash", F.lit(BUCKETS))
    holding = texts.withColumn("_b", bucket).join(F.broadcast(each.select(bucket.alias("_b")).distinct()), "_b", "left_semi")
    holding = holding.join(each.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])
    outside = F.when(F.contains("text", F.lit("@")), F.regexp_replace("text", EMAIL, " ")).otherwise(F.col("text"))
    # The share asks for df <= both * (n / docs) ** (1 - disclosure), and both is at most docs.
    most = F.col("_docs") * F.pow(n / F.col("_docs"), F.lit(1 - disclosure)) * (1 + 1e-9)
    whole = each.join(holding.select("hash", words_of(outside)).join(in_docs, "term"), "hash")
    whole = whole.unionByName(close.select("entity", "hash", "term").distinct().join(each, ["entity", "hash"]).join(in_docs, "term")).where(F.col("_df") <= most)
    one = whole.groupBy("entity", "term", "hash").agg(*[F.first(c).alias(c) for c in ("_copies", "_seen", "_docs", "_df")])
    pairs = one.groupBy("entity", "term").agg(F.sum("_copies").alias("_both"), times, F.first("_docs").alias("_docs"), F.first("_df").alias("_df"))
    pairs = pairs.join(contexts, ["entity", "term"], "left").where((F.col("_times") >= support) | F.col("_contexts").isNotNull())
    share = F.log(F.col("_both") / F.col("_df") * n / F.col("_docs")) / F.log(n / F.col("_docs"))
    told = pairs.withColumn("share", share).where(F.col("share") >= disclosure)
    told = scratch.put(told.select("entity", "term", "share"), "told")

    marks = held.select("doc_id", "hash", "entity").distinct().join(told, "entity").groupBy("doc_id", "hash", "term").agg(F.max("share").alias("share"))
    marks = scratch.put(marks.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("term", "share")).alias("terms")), "marks")
    row = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(BUCKETS))
    few = F.broadcast(marks.select(row.alias("_b")).distinct())
    read = texts.withColumn("_b", row).join(few, "_b", "left_semi").join(marks, ["doc_id", "hash"])
    words = F.filter(matches(F.col("text"), WORD), lambda m: F.exists("terms", lambda t: t["term"] == F.lower(m["value"])))
    extra = read.select("doc_id", "hash", "terms", typed(words, 4).alias("extra")).dropDuplicates(["doc_id", "hash"])
    nothing = F.array().cast(marked.schema["base"].dataType)
    joined = marked.select("doc_id", "hash", "base").join(extra, ["doc_id", "hash"], "left")
    return joined.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "hash", F.array_sort(F.concat("base", F.coalesce("extra", nothing))).alias("spans"), "terms")


def named(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column, terms: Column, removal: float = 0.95) -> Column:
    """The text with values replaced by their kind, and revealing terms generalised or removed."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit("[WORD]"))
    gone = lambda s: F.exists(F.coalesce(terms, F.array().cast("array<struct<term:string,share:double>>")), lambda t: (t["term"] == F.lower(s["value"])) & (t["share"] >= removal))

    def step(done: Column, s: Column) -> Column:
        put = F.when((s["kind"] == 4) & gone(s), "").otherwise(F.element_at(labels, s["kind"] + 1))
        more = F.concat(done["out"], text.substr((done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), put)
        return F.when(s["start"] < done["at"], done).otherwise(F.struct(more.alias("out"), s["end"].alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, start, step, lambda d: F.concat(d["out"], text.substr((d["at"] + 1).cast("int"), F.length(text))))
