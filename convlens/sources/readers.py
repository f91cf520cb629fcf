"""Reading conversations from JSON, CSV and text, and writing results.

Each parser turns a column of file contents into rows (path, conv, turn, role, text), in the cluster; ``read`` picks
the format of each file. Lines of one file are handled inside its row or by windows over the file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.window import Window

from convlens.functions import text as T

MESSAGE = Ty.StructType([Ty.StructField("role", Ty.StringType()), Ty.StructField("content", Ty.StringType())])
LOOSE = Ty.StructType([
    Ty.StructField("messages", Ty.ArrayType(MESSAGE)), Ty.StructField("text", Ty.StringType()),
    Ty.StructField("content", Ty.StringType()), Ty.StructField("metadata", Ty.MapType(Ty.StringType(), Ty.StringType())),
])
WRAPPER = Ty.StructType([Ty.StructField("conversations", Ty.ArrayType(LOOSE))])
USER, ASSISTANT = ("user", "human", "question"), ("assistant", "ai", "answer", "bot")
HEADER = ("id", "conversation_id", "conv_id", "role", "content", "message", "text", "user", "speaker")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def detect_format(content: Column, name: Column) -> Column:
    low = F.lower(name)
    plain = T.strip(content)
    looks = (F.startswith(plain, F.lit("{")) | F.startswith(plain, F.lit("["))) & F.try_parse_json(plain).isNotNull()
    head = F.slice(F.split(plain, "\n"), 1, 5)
    commas = F.aggregate(F.transform(head, lambda x: F.regexp_count(x, F.lit(","))), F.lit(0), lambda a, b: a + b)
    return (
        F.when(low.endswith(".json"), "json").when(low.endswith(".csv"), "csv").when(low.endswith(".txt"), "text")
        .when(looks, "json").when(commas > F.size(head), "csv").otherwise("text")
    )


def parse_json(raw: DataFrame) -> DataFrame:
    """An array, a single object, or an object that wraps ``conversations``; rows without messages or text are dropped."""
    plain = T.strip(F.col("content"))
    wrapped = F.from_json(plain, WRAPPER)["conversations"]
    many = F.from_json(plain, Ty.ArrayType(LOOSE))
    one = F.array(F.from_json(plain, LOOSE))
    items = F.when(F.startswith(plain, F.lit("[")), many).otherwise(F.coalesce(wrapped, one))
    convs = raw.select("path", F.posexplode(items).alias("conv", "c"))
    given = F.filter("c.messages", lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    single = F.coalesce("c.text", "c.content")
    messages = F.when(F.col("c.messages").isNotNull(), given).when(single.isNotNull(), F.array(F.struct(F.lit("user").alias("role"), single.alias("content"))))
    return convs.select("path", "conv", F.posexplode(messages).alias("turn", "m")).select("path", "conv", "turn", "m.role", F.col("m.content").alias("text"))


def _lines(raw: DataFrame) -> DataFrame:
    return raw.select("path", F.posexplode(F.split(F.regexp_replace("content", "\r\n|\r", "\n"), "\n")).alias("line", "value"))


def _runs(rows: DataFrame) -> DataFrame:
    """A new conversation wherever the id differs from the line before: islands, not groups."""
    w = Window.partitionBy("path").orderBy("line")
    new = F.coalesce((F.lag("id").over(w) != F.col("id")).cast("int"), F.lit(0))
    marked = rows.withColumn("_new", new).withColumn("conv", F.sum("_new").over(w).cast("int"))
    turn = F.row_number().over(Window.partitionBy("path", "conv").orderBy("line")) - 1
    return marked.withColumn("turn", turn).select("path", "conv", "turn", "role", "text")


def parse_csv(raw: DataFrame, header: Sequence[str] = HEADER) -> DataFrame:
    """id, role, text (with its commas), quotes stripped; a first line of header words is skipped."""
    cells = F.split("value", ",")
    rows = _lines(raw).where(T.strip(F.col("value")) != "").withColumn("cells", cells)
    is_header = (F.col("line") == 0) & F.exists(F.slice("cells", 1, 3), lambda c: F.lower(F.regexp_replace(T.strip(c), '^"|"$', "")).isin(*header))
    kept = rows.where(~is_header & (F.size("cells") >= 3))
    clean = lambda c: F.regexp_replace(T.strip(c), r'^["\']+|["\']+$', "")
    role = F.when(F.lower(clean(F.col("cells")[1])).isin(*USER), "user").otherwise("assistant")
    return _runs(kept.select("path", "line", clean(F.col("cells")[0]).alias("id"), role.alias("role"), clean(F.array_join(F.slice("cells", F.lit(3), F.size("cells")), ",")).alias("text")))


def parse_csv_plain(raw: DataFrame) -> DataFrame:
    """The simple variant: the first line is always skipped and roles stay as they are."""
    rows = _lines(raw).where((F.col("line") > 0) & (T.strip(F.col("value")) != "")).withColumn("cells", F.split("value", ","))
    return _runs(rows.where(F.size("cells") >= 3).select("path", "line", T.strip(F.col("cells")[0]).alias("id"), T.strip(F.col("cells")[1]).alias("role"), T.strip(F.array_join(F.slice("cells", F.lit(3), F.size("cells")), ",")).alias("text")))


def parse_text(raw: DataFrame, join_lines: bool = False) -> DataFrame:
    """Lines such as ``User: ...``; a line without a mark is a message of the current role, or more of the last message."""
    words = "|".join((*USER, *ASSISTANT))
    mark = rf"(?i)^({words})\s*:\s*(.*)$" if not join_lines else r"^(User|Human|Assistant|AI)\s*:\s*(.*)$"
    lines = _lines(raw).withColumn("value", T.strip(F.col("value"))).where("value <> ''")
    named = F.lower(F.regexp_extract("value", mark, 1))
    role = F.when(named.isin(*USER), "user").when(named.isin(*ASSISTANT), "assistant")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("own", role).withColumn("role", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit("user")))
    rows = rows.withColumn("text", F.when(F.col("own").isNotNull(), F.regexp_extract("value", mark, 2)).otherwise(F.col("value")))
    if join_lines:
        rows = rows.withColumn("g", F.sum(F.col("own").isNotNull().cast("int")).over(w))
        rows = rows.groupBy("path", "g").agg(F.min("line").alias("line"), F.min_by("role", "line").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))
    rows = rows.where("text <> ''")
    turn = F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1
    return rows.select("path", F.lit(0).alias("conv"), turn.alias("turn"), "role", "text")


def read(raw: DataFrame) -> DataFrame:
    """Every file by its own format."""
    kind = raw.withColumn("_kind", detect_format(F.col("content"), F.col("path")))
    parts = [f(kind.where(F.col("_kind") == k).drop("_kind")) for k, f in (("json", parse_json), ("csv", parse_csv), ("text", parse_text))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def file_stats(raw: DataFrame, messages: DataFrame) -> DataFrame:
    """(path, size, format, conversations), with a warning where nothing was found."""
    n = messages.groupBy("path").agg(F.countDistinct("conv").alias("conversations"))
    sized = raw.select("path", F.octet_length("content").alias("size"), detect_format(F.col("content"), F.col("path")).alias("format"))
    joined = sized.join(n, "path", "left").withColumn("conversations", F.coalesce("conversations", F.lit(0)))
    return joined.withColumn("warning", F.when(F.col("conversations") == 0, F.concat(F.lit("No conversations found in "), "path")))


def with_ids(messages: DataFrame) -> DataFrame:
    """The engine's form (conv_id, turn, role, text): ids from the hash of path and place in the file."""
    return messages.select(F.xxhash64("path", "conv").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


def strict_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOOSE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def examples(spark: SparkSession, n: int, seed: int = 42, categories: Sequence[str] = ("Bug Report", "Support", "Feedback", "Sales")) -> DataFrame:
    """Example conversations: categories in equal parts, an even number of turns, all from a hash of id and seed."""
    openers = {"Bug Report": "I found an error in the report", "Support": "How do I change my settings?", "Feedback": "I love the new layout", "Sales": "What does a subscription cost?"}
    base = spark.range(n).withColumn("category", F.element_at(F.array(*map(F.lit, categories)), (F.col("id") % len(categories) + 1).cast("int")))
    turns = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4)) + 2) * 2
    rows = base.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)))
    role = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    said = F.create_map(*[F.lit(x) for c in categories for x in (c, openers.get(c, "Hello"))])[F.col("category")]
    text = F.when(F.col("turn") == 0, said).when(role == "user", F.concat(F.lit("And another question, number "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("Here is what I can tell you about "), F.lower("category")))
    return rows.select(F.col("id").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), "category")


def diverse_examples(spark: SparkSession, n: int, seed: int = 42, categories: Sequence[str] = ("Bug Report", "Support", "Feedback", "Sales")) -> DataFrame:
    """(conv_id, category): n div k of each of k categories, one more of the first n mod k, mixed by a hash and numbered anew."""
    from convlens.operators.conversations import numbered

    k = len(categories)
    ids = spark.range(n).withColumn("category", F.element_at(F.array(*map(F.lit, categories)), (F.col("id") % k + 1).cast("int")))
    mixed = numbered(ids.withColumn("_h", F.xxhash64("id", F.lit(seed))), "_h", "id")
    return mixed.select(F.col("position").cast("long").alias("conv_id"), "category")


def prefix_examples(templates: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(conv_id, turn, role, text): for each conversation a hashed template's first messages, two at least, and for three
    of ten a further question and answer. ``templates`` has (template, turn, role, text), as a parameter's size.
    """
    spark = templates.sparkSession
    sizes = templates.groupBy("template").agg(F.count(F.lit(1)).alias("_size"))
    known = sizes.count()
    draw = lambda salt: F.shiftrightunsigned(F.xxhash64("conv_id", F.lit(seed), F.lit(salt)), 1)
    drawn = spark.range(n).select(F.col("id").alias("conv_id")).withColumn("template", draw("template") % known).join(sizes, "template")
    keep = F.least(F.col("_size"), F.lit(2) + draw("length") % F.greatest(F.col("_size") - 1, F.lit(1)))
    drawn = drawn.withColumn("_keep", keep).withColumn("_more", draw("more") % 10 < 3)
    own = drawn.join(templates, "template").where(F.col("turn") < F.col("_keep")).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    pair = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("role"), F.lit(t).alias("text")) for i, r, t in ((0, "user", "Can you say more about that?"), (1, "assistant", "Of course, here is some more detail."))])
    more = drawn.where("_more").select("conv_id", "_keep", F.explode(pair).alias("p"))
    return own.unionByName(more.select("conv_id", (F.col("_keep") + F.col("p.i")).cast("long").alias("turn"), "p.role", "p.text"))
