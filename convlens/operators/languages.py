"""Languages by profiles of character trigrams, learnt from labelled texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from convlens.llm.common import bytes_of, pieces_of
from convlens.session import checkpointed

#: Log probabilities are whole thousandths, so sums are the same in any order.
STEPS = 1000
#: Characters that a task looks at at once; weights that go out to all tasks, more are joined by a shuffle.
STRETCH, WEIGHTS = 1_000_000, 4_000_000
#: Bits of a character in a trigram's number.
WIDE = 21


def grams_of(word: Column) -> Column:
    """Trigrams of a word with a blank on either side: as many as it has characters."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(padded, i, F.lit(3)))


def grams(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep, gram): one row for each trigram of each run of letters, in lower case."""
    words = rows.select(*keep, F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("_w")).where("_w <> ''")
    return words.select(*keep, F.explode(grams_of(F.col("_w"))).alias("gram"))


def letters_only(text: Column) -> Column:
    """In lower case, with one blank for each run of what is no letter."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")


def numbers(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the text, number of the trigram) for each letter of texts of ``letters_only``: the letter between its neighbours."""
    padded = pc.binary_join_element_wise(" ", texts, " ", "")
    signs = np.frombuffer(bytes_of(padded).tobytes().decode().encode("utf-32-le"), np.uint32)
    ends = np.cumsum(pc.utf8_length(padded).to_numpy())
    for start in range(1, len(signs) - 1, STRETCH):
        part = signs[start - 1 : start + STRETCH + 1].astype(np.int64)
        at = np.flatnonzero(part[1:-1] != ord(" "))
        yield np.searchsorted(ends, at + start, "right"), (part[at] << 2 * WIDE) | (part[at + 1] << WIDE) | part[at + 2]


def spelt(number: np.ndarray) -> list[str]:
    mask = (1 << WIDE) - 1
    signs = np.stack([number >> 2 * WIDE, number >> WIDE & mask, number & mask], 1).astype("<u4").tobytes().decode("utf-32-le")
    return [signs[i : i + 3] for i in range(0, len(signs), 3)]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, gram, n) of some texts at a time."""
    for whole in batches:
        for batch in pieces_of(whole, "text"):
            batch = batch.take(pc.sort_indices(batch.column("language")))
            names = batch.column("language").dictionary_encode()
            of = names.indices.to_numpy(zero_copy_only=False)
            for owner, number in numbers(batch.column("text")):
                edges = np.searchsorted(of[owner], np.arange(len(names.dictionary) + 1))
                for i, name in enumerate(names.dictionary):
                    found, n = np.unique(number[edges[i] : edges[i + 1]], return_counts=True)
                    if len(found):
                        yield pa.record_batch({"language": pa.array([name.as_py()] * len(found), pa.string()), "gram": pa.array(spelt(found), pa.string()), "n": pa.array(n, pa.int64())})


def profiles(labelled: DataFrame, text: str = "text", language: str = "language", most: int = 300) -> DataFrame:
    """(gram, language, weight): of the ``most`` commonest trigrams of any language, their log probability in each.

    Rows without a language or text are not learnt from. The table has at most ``most`` rows for each pair of languages.
    """
    told = labelled.where(F.col(language).isNotNull()).select(F.col(language).cast("string").alias("language"), letters_only(F.col(text)).alias("text"))
    counts = told.mapInArrow(counted, "language string, gram string, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)  # read three times
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram")))
    chosen = ranked.where(F.col("_r") <= most).select("gram").distinct()
    every = chosen.crossJoin(totals)  # languages and most bound both
    weight = F.round(F.log((F.coalesce("n", F.lit(0)) + 1.0) / (F.col("total") + float(STEPS))) * STEPS).cast("long")
    return every.join(counts, ["language", "gram"], "left").select("gram", "language", weight.alias("weight"))


def by_profile(rows: DataFrame, profile: DataFrame, key: str, text: str = "text", default: str = "unknown") -> DataFrame:
    """(key, language, grams, confidence) of each row: the language with the greatest sum of weights, of equals the first by name.

    ``confidence`` is its probability if one trigram counts as much as all of a text's: the mean weights through the logistic. Null and empty
    texts, and those without a known trigram, are ``default`` with confidence 0. ``key`` must be distinct. Weights of one trigram are one row.
    """
    if profile.limit(WEIGHTS + 1).count() > WEIGHTS:
        return _by_joins(rows, profile, key, text, default)
    known = profile.select("gram", "language", "weight").collect()
    languages = sorted({r["language"] for r in known})
    if not languages:
        return rows.select(key, F.lit(default).alias("language"), F.lit(0).cast("long").alias("grams"), F.lit(0.0).alias("confidence"))
    table = sorted({r["gram"] for r in known if len(r["gram"]) == 3}, key=lambda g: [*map(ord, g)])
    row, column = {g: i for i, g in enumerate(table)}, {x: i for i, x in enumerate(languages)}
    weights = np.zeros((len(table), len(languages)), np.int32)
    for r in known:
        if r["gram"] in row:
            weights[row[r["gram"]], column[r["language"]]] = r["weight"]
    codes = np.array([ord(g[0]) << 2 * WIDE | ord(g[1]) << WIDE | ord(g[2]) for g in table], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                count, sums = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(languages)), np.int64)
                for owner, number in numbers(batch.column("text")):
                    place = np.minimum(np.searchsorted(codes, number), len(codes) - 1)
                    hit = codes[place] == number
                    owner, place = owner[hit], place[hit]
                    count += np.bincount(owner, minlength=len(count))
                    for i in range(len(languages)):  # sums of whole numbers far below 2^53
                        sums[:, i] += np.bincount(owner, weights[place, i], len(count)).astype(np.int64)
                yield pa.record_batch({key: batch.column(key), "grams": pa.array(count), "s": pa.array(list(sums), pa.list_(pa.int64()))})

    given = rows.select(key, letters_only(F.col(text)).alias("text"))
    sums = given.mapInArrow(run, StructType([rows.schema[key], StructField("grams", LongType()), StructField("s", ArrayType(LongType()))]))
    language, share = _told(F.transform("s", lambda x, i: F.struct(x.alias("s"), (-i).alias("i"))), languages)
    some = F.col("grams") > 0
    return sums.select(key, F.when(some, language).otherwise(F.lit(default)).alias("language"), "grams", F.when(some, 1 / share).otherwise(F.lit(0.0)).alias("confidence"))


def _told(scores: Column, languages: list[str]) -> tuple[Column, Column]:
    """(language, reciprocal of its probability) by scores (s, i), i the place of the language below 0."""
    best = F.array_max(scores)
    share = F.aggregate(scores, F.lit(0.0), lambda t, x: t + F.exp((x["s"] - best["s"]) / F.col("grams") / float(STEPS)))
    return F.element_at(F.array(*map(F.lit, languages)), 1 - best["i"]), share


def _by_joins(rows: DataFrame, profile: DataFrame, key: str, text: str, default: str) -> DataFrame:
    """The same for a profile that is too large to go out whole: trigrams are joined with it."""
    lists = profile.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("language", "weight"))).alias("w"))
    languages = [r["language"] for r in profile.select("language").distinct().orderBy("language").limit(1001).collect()]
    if len(languages) > 1000:
        raise ValueError("more than 1000 languages")
    wide = lists.select("gram", *[F.col("w")[i]["weight"].alias(f"_{i}") for i in range(len(languages))])
    few = wide.limit(300_001).count() <= 300_000
    found = grams(rows.select(key, text), [key], text).join(F.broadcast(wide) if few else wide, "gram")
    sums = found.groupBy(key).agg(F.count(F.lit(1)).alias("grams"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(languages))])
    if not languages:
        return rows.select(key, F.lit(default).alias("language"), F.lit(0).cast("long").alias("grams"), F.lit(0.0).alias("confidence"))
    language, share = _told(F.array(*[F.struct(F.col(f"_{i}").alias("s"), F.lit(-i).alias("i")) for i in range(len(languages))]), languages)
    told = sums.select(key, language.alias("language"), "grams", (1 / share).alias("confidence"))
    return rows.select(key).join(told, key, "left").select(key, F.coalesce("language", F.lit(default)).alias("language"), F.coalesce("grams", F.lit(0)).alias("grams"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
