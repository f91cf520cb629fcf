"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.llm import caps, decontamination, exact, jaccard, middle, mixing, phrases, quality, sanitise, secrets, tokens, toolcalls, toxicity
from convlens.llm.common import Scratch, crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tokens.write_store(table(spark, sf_dir, "documents"), tokenizer_path(), Scratch(spark, "op1"))
    return tokens.read_store(store)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 3) == 1
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op6_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = caps.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 0
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.from_turns(table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, toolcalls.TOOLS)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / wt, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(wt) OVER (ORDER BY cap / wt, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, sid, source_size, least(cap, wt * (SELECT min_by(lev, cap / wt) FROM l WHERE lev <= cap / wt)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.sid, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS want,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || d.doc_id), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT sid, CAST(round(target) AS BIGINT) AS want, CAST(ceil(round(target) / 1024) AS BIGINT) AS blocks FROM t WHERE round(target) > 0),
r AS (SELECT *, coalesce(sum(want) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (SELECT sum(want) FROM k)::DOUBLE AS lo,
             sum(want) OVER (ORDER BY sid)::DOUBLE / (SELECT sum(want) FROM k)::DOUBLE AS hi FROM k),
g AS (SELECT i AS slot, ((i::HUGEINT * 2850178567708297085::HUGEINT) % 4611686018427387904::HUGEINT)::DOUBLE / 4611686018427387904.0::DOUBLE AS u
      FROM range((SELECT CAST(sum(blocks) AS BIGINT) FROM k)) AS x(i)),
h AS (SELECT slot, sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block FROM g JOIN r ON u >= lo AND u < hi),
n AS (SELECT k.sid, blocks, coalesce(have, 0) AS have FROM k LEFT JOIN (SELECT sid, count(*) AS have FROM h GROUP BY sid) USING (sid)),
m AS (SELECT *, coalesce(sum(blocks - have) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n WHERE have < blocks),
s2 AS (SELECT slot, sid, block FROM h WHERE block < blocks
       UNION ALL SELECT (SELECT sum(blocks) FROM k) + before + b - have AS slot, sid, b AS block FROM (SELECT *, unnest(range(have, blocks)) AS b FROM m))
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(greatest(0, least(a + size, want) - least(a, want))
          + greatest(0, least(a + source_size + size, want) - least(a + source_size, want))
          + greatest(0, least(a + 2 * source_size + size, want) - least(a + 2 * source_size, want)) AS BIGINT) AS taken,
       CAST(s2.slot AS BIGINT) AS first_slot
FROM p LEFT JOIN s2 ON s2.sid = p.sid AND s2.block = p.a // 1024 AND p.size > 0 AND p.a < p.want
"""


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), dictionary=tokenizer_path())
    base = F.filter("found", lambda s: s["kind"] != "guess")
    counts = [secrets.counted(F.col("found"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"), secrets.costs(F.col("found")).alias("costs"))


def op9_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)
    counts = [sanitise.counted(F.col("spans"), k).alias(f"n_{name}") for k, name in enumerate(sanitise.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(sanitise.named(base), 256).alias("base_sha256"), sanitise.named(F.col("spans")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), Scratch(spark, "op11"))


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, generate_subscripts(s, 1) AS p, unnest(s) AS piece FROM (SELECT d, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS s FROM d)),
w AS (SELECT d, lang, p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, list_slice(w, i, i + k - 1) AS g, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS x(k) WHERE len(w) >= k)),
f AS (SELECT lang, g, k, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT a.lang, a.g, a.f AS a, a.k, cut, l.f AS l, r.f AS r, n, (1000 * a.f * n) // (l.f * r.f) AS score
      FROM f AS a JOIN range(1, 5) AS x(cut) ON cut < a.k
      JOIN f AS l ON l.lang = a.lang AND l.g = list_slice(a.g, 1, cut) JOIN f AS r ON r.lang = a.lang AND r.g = list_slice(a.g, cut + 1, a.k)
      JOIN t ON t.lang = a.lang WHERE a.k > 1),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
i AS (SELECT DISTINCT lang, list_slice(g, i, i + size - 1) AS g, f FROM (SELECT lang, g, f, size, unnest(range(1, k - size + 2)) AS i FROM f, range(2, 5) AS y(size) WHERE size < k)),
s AS (SELECT m.lang, array_to_string(m.g, ' ') AS phrase, a, l, r, n, score FROM m WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = m.lang AND i.g = m.g AND i.f >= m.a))
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s) WHERE rank <= 2000
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op12")).drop("row")


OP12_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(len(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                  WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
v AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, substring(t, 1, least(x, y)) AS p, substring(t, least(x, y) + 1, abs(x - y)) AS m, substring(t, greatest(x, y) + 1) AS s FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM v
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_store": op1_token_store, "op2_toxicity": op2_toxicity, "op3_ngram_jaccard": op3_ngram_jaccard, "op4_tool_calls": op4_tool_calls, "op5_source_mix": op5_source_mix, "op6_embedding_caps": op6_embedding_caps, "op7_quality": op7_quality, "op8_secrets": op8_secrets, "op9_private_terms": op9_private_terms, "op10_decontamination": op10_decontamination, "op11_phrases": op11_phrases, "op12_exact_dedup": op12_exact_dedup, "op13_fill_in_middle": op13_fill_in_middle}


def oracle_sql() -> dict[str, str]:
    return {"op5_source_mix": OP5_SQL, "op11_phrases": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
