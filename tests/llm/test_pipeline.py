"""The pipeline stage by stage and as a whole, on odd tables."""

import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from .conftest import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, row long, _row string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(documents, folder): repeated ids, null ids and texts, copies, near copies, leaks, toxic texts, clashing columns."""
    folder = str(tmp_path_factory.mktemp("tables"))
    item = "which of the seven rivers crosses the old border twice before it meets the sea near the salt works"
    base, words = prose(1, 90), prose(1, 90).split()
    texts = [base, base, " ".join([*words[:88], "x"]), None, "", "  ", f"so {item} indeed", prose(77, 6000)]
    texts += [prose(200 + i, 30 + i) + (" nastyword grimslur vileterm nastyword" if i % 5 == 0 else "") for i in range(80)]
    rows = [(None if i in (3, 9) else 6 if i == 7 else i, t, "en", ["a", "b", None][i % 3], 1, 0.9, 5, "x") for i, t in enumerate(texts)]
    rows += rows[20:22]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 8 and (i - 8) % 5 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, folder


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_toxic_documents_go(spark, tables):
    docs, folder = tables
    out = pipeline.drop_toxic(spark, docs, folder)
    assert out.columns == docs.columns
    assert plain(out) == [r for r in plain(docs) if "nastyword" not in (r[1] or "")]


def test_one_of_each_group_stays(spark, tables):
    docs, folder = tables
    out = plain(pipeline.keep_one_of_each_group(spark, docs, folder))
    texts = [r[1] for r in out]
    everything = [r for r in plain(docs) if (r[1] or "").split()]
    near = {everything_text for everything_text in (r[1] for r in everything if r[0] in (0, 1, 2))}
    assert sum(t in near for t in texts) == 1 and [r[0] for r in out if r[1] in near] == [0]
    others = [r[1] for r in everything if r[1] not in near]
    assert sorted(t for t in texts if (t or "").split() and t not in near) == sorted(set(others))
    assert sum(not (t or "").split() for t in texts) == sum(not (r[1] or "").split() for r in plain(docs))


def test_leaks_go(spark, tables):
    docs, folder = tables
    assert plain(pipeline.drop_leaks(spark, docs, folder)) == [r for r in plain(docs) if "seven rivers" not in (r[1] or "")]


def test_mix_takes_rows_as_they_are(spark, tables):
    docs, folder = tables
    out = pipeline.mix_sources(spark, docs, folder)
    assert out.columns == docs.columns
    got = plain(out)
    assert set(got) <= set(plain(docs)) and all((r[1] or "").split() for r in got)
    assert any(r[0] is None for r in got) or all(r[0] is not None for r in plain(docs) if (r[1] or "").split() and r[3] == "a")


def test_whole_run_against_its_stages(spark, tables):
    """run() is its stages one after the other, and its last rows are the ids of the documents that the mix gave."""
    docs, folder = tables
    now = docs
    for _, stage in pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), SCHEMA)
    encoder = __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    want = sorted((str(r["doc_id"]), crc(r["text"])) for r in now.collect())
    got = pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == want and len(want) > 20
    kept = {r["text"] for r in now.collect()}
    assert not any("nastyword" in t or "seven rivers" in t for t in kept)


def test_empty_tables(spark, tables, tmp_path):
    docs, folder = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_numbers_of_rows_are_the_same_in_every_reading(spark, tables, tmp_path):
    from convlens.llm.common import Scratch, numbered

    docs, folder = tables
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = numbered(table, "_n", Scratch(spark, "test-numbers"))
    assert rows.columns == [*table.columns, "_n"] and rows.select("_n").distinct().count() == table.count()
    once = sorted(map(str, rows.select("doc_id", "text", "_n").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert sorted(map(str, rows.select("_n", "doc_id", "text").select("doc_id", "text", "_n").collect())) == once
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    clash = docs.withColumn("_metadata", docs["lang"])
    assert numbered(clash, "n", Scratch(spark, "test-numbers-2")).select("n").distinct().count() == docs.count()


def test_stages_on_files(spark, tables):
    """Stages give the same rows for a written table as for one in memory."""
    docs, folder = tables
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert plain(stage(spark, table, folder)) == plain(stage(spark, docs, folder))


def test_rows_made_from_rows_have_numbers_of_their_own(spark, tables):
    """Exploded, joined and united frames repeat places in files; no row is taken for another."""
    from convlens.llm.common import Scratch, numbered
    from pyspark.sql import functions as F

    docs, folder = tables
    table = spark.read.parquet(f"{folder}/documents.parquet")
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first()["text"]
    twice = F.explode(F.array(F.lit("first part"), F.lit("second part"), F.lit(item)))
    exploded = table.limit(2).select(*[twice.alias("text") if c == "text" else c for c in table.columns])
    from_files = table.where("doc_id < 2").select(*[twice.alias("text") if c == "text" else c for c in table.columns])
    joined = table.join(table.select(F.col("doc_id").alias("other")).where("other < 3"), F.col("doc_id") < F.col("other") + 5)
    for rows in (exploded, from_files, joined, table.union(table)):
        made = numbered(rows, "_n", Scratch(spark, "test-derived"))
        assert made.select("_n").distinct().count() == made.count() == rows.count()
    left = plain(pipeline.drop_leaks(spark, from_files, folder))
    assert [r[1] for r in left] == [r[1] for r in plain(from_files) if r[1] != item] and len(left) == 4


def test_two_callers_leave_each_other_alone(spark, tables):
    from concurrent.futures import ThreadPoolExecutor

    from convlens.llm.common import Scratch, owned

    docs, folder = tables
    mine = Scratch(spark, "test-mine").put(docs, "rows")
    with owned(spark):
        inner = Scratch(spark, "test-inner")
        inner.put(docs, "rows")
        with ThreadPoolExecutor(1) as other:
            theirs = other.submit(lambda: Scratch(spark, "test-theirs").put(docs, "rows")).result()
    assert mine.count() == theirs.count() == docs.count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(f"{inner.path}/rows").count()
    with ThreadPoolExecutor(2) as both:
        runs = [both.submit(lambda: plain(pipeline.drop_leaks(spark, docs, folder))) for _ in range(2)]
        assert runs[0].result() == runs[1].result() == [r for r in plain(docs) if "seven rivers" not in (r[1] or "")]


def test_broadcasts_go_with_their_owner(spark):
    from convlens.llm import common

    with common.owned(spark):
        sent = common.shared(spark, list(range(1000)))
        assert sent.value[-1] == 999
    with pytest.raises(Exception, match="destroyed"):
        spark.sparkContext.parallelize([1]).map(lambda x: sent.value[x]).collect()
    assert common._OPENED.get() is None
