"""From raw documents to a token store: each stage works on all that the one before it kept.

Stages follow a number of every row (of its file and place, or written with it), never the id, so rows that repeat an id, or have none, are
each judged by their own text. Null and empty texts are kept by the first three stages (nothing in them is toxic,
alike or leaked) and left out by the mix, which takes words. Of rows that repeat a text, or are linked by similarity, one stays:
the one with the least id. Very long texts are read whole; ties between rows of one id are settled by their number.
An empty table goes through every stage and gives an empty result. Other columns of the documents, whatever their
names, are handed on by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.llm import decontamination, jaccard, mixing, tokens, toxicity
from convlens.llm.common import Scratch, crc_mod, free_name, numbered, owned, written
from convlens.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7.

    A null or empty text is scored as the share of such labels; without labels nothing is dropped.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, row, Scratch(spark, "pipeline-toxicity-rows"))

    def rejected() -> DataFrame:
        scored = toxicity.toxicity_scores(rows, table(spark, sf_dir, "labels"), learn_from=crc_mod("doc_id", 3) != 1, row_col=row)
        return scored.where("score >= 0.7").select(F.col("row").alias(row))

    return rows.join(written(rejected, Scratch(spark, "pipeline-toxicity")), row, "left_anti").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word Jaccard similarity of 0.8 or more, one: that with the least id, null ids last.

    Documents without words are all kept.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, row, Scratch(spark, "pipeline-jaccard-rows"))

    def others() -> DataFrame:
        found = jaccard.linked(rows, row_col=row).where("`group` is not null and n_links > 0").select("group", "doc_id", "row")
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
        first = found.groupBy("group").agg(F.min(order).alias("m")).select(F.col("m.row").alias("row"))
        return found.join(first, "row", "left_anti").select(F.col("row").alias(row))

    return rows.join(written(others, Scratch(spark, "pipeline-jaccard")), row, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row, Scratch(spark, "pipeline-leaks-rows"))
    hits = lambda: decontamination.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=row).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(written(hits, Scratch(spark, "pipeline-leaks")), row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of its slots; those without words are not taken."""
    return mixing.mixed_documents(docs, scratch=Scratch(spark, "pipeline-mix"))


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents as read back."""
    return tokens.read_store(tokens.write_store(docs, tokenizer_path(), Scratch(spark, "pipeline-tokens")))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("token_store", store_tokens),
]

#: MinHash, aligned edits and a tokenizer have no SQL; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself, and its input, go once its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with owned(spark):
            docs = scratch.put(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
