"""Queries over ``documents``, ``labels`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens import lexicon as L
from convlens.functions import text as T
from convlens.operators import clusters as K
from convlens.operators import conversations as C
from convlens.operators import insight as I
from convlens.plans import sql as S
from convlens.plans.registry import query
from convlens.session import checkpointed


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def facets(spark, d):
    """Facets of labelled documents: clusters are sources."""
    rows = documents(spark, d).select("doc_id", "source", "lang").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(c).cast("string").alias("value")) for n, c in (("language", "lang"), ("quality", "quality"), ("toxic", "toxic"))])
    return rows.select(F.col("doc_id").alias("conv_id"), F.col("source").alias("cluster"), F.explode(pairs).alias("f")).select("conv_id", "cluster", "f.facet", "f.value")


def clusters(spark, d):
    """Sources as clusters of different sizes: their labelled documents of low quality."""
    rows = documents(spark, d).select("doc_id", "source").join(spark.read.parquet(f"{d}/labels.parquet").where("quality = 0"), "doc_id")
    sized = rows.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("size"))
    return sized.select(
        F.regexp_extract("name", "[0-9]+", 0).cast("int").alias("cluster"), F.concat(F.lit("Source "), F.col("name")).alias("name"), "size",
        F.concat(F.lit("Documents of "), F.col("name")).alias("summary"), F.array(F.lit("document"), F.col("name")).alias("keywords"),
    )


FACETS = "f AS (SELECT d.doc_id AS conv_id, source AS cluster, unnest(['language', 'quality', 'toxic']) AS facet, unnest([lang, CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR)]) AS value FROM documents d JOIN labels USING (doc_id))"
CLUSTERS = "c AS (SELECT CAST(regexp_extract(source, '[0-9]+') AS INT) AS cluster, 'Source ' || source AS name, count(*) AS size, 'Documents of ' || source AS summary, ['document', source] AS keywords FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY source)"
_f, _l = S.flags("text", L.PII), S.flags("text", L.PII_LOOSE)


@query("pii_flags", f"SELECT doc_id, {', '.join(f'{c} AS {k}' for k, c in _f.items())} FROM documents")
def pii_flags(spark, d):
    return documents(spark, d).select("doc_id", *[c.alias(k) for k, c in T.pii_flags(F.col("text")).items()])


@query("pii_flags_loose", f"SELECT doc_id, {', '.join(f'{c} AS {k}' for k, c in _l.items())} FROM documents")
def pii_flags_loose(spark, d):
    return documents(spark, d).select("doc_id", *[c.alias(k) for k, c in T.pii_flags(F.col("text"), L.PII_LOOSE).items()])


@query("pii_joined", f"SELECT doc_id, concat_ws(', ', {', '.join(f'''CASE WHEN {c} THEN '{k}' END''' for k, c in _l.items())}) AS kinds FROM documents WHERE {' OR '.join(_l.values())}")
def pii_joined(spark, d):
    kinds = F.concat_ws(", ", *[F.when(c, F.lit(k)) for k, c in T.pii_flags(F.col("text"), L.PII_LOOSE).items()])
    return documents(spark, d).select("doc_id", kinds.alias("kinds")).where("kinds <> ''")


def _redacted(x: str) -> str:
    for pattern, label in L.REDACT.values():
        x = f"regexp_replace({x}, {S.quoted(pattern)}, '{label}', 'g')"
    return x


@query("pii_redact", f"SELECT doc_id, md5({_redacted('text')}) AS redacted, CAST(len(regexp_extract_all(text, {S.quoted(L.EMAIL)})) AS INT) AS emails FROM documents")
def pii_redact(spark, d):
    text, counts = T.redact(F.col("text"))
    return documents(spark, d).select("doc_id", F.md5(text.cast("binary")).alias("redacted"), counts["email"].alias("emails"))


def _audit_sql() -> str:
    """Each kind is counted in what the kinds before it left."""
    sql, last = "a0 AS (SELECT text AS whole, text AS x FROM documents)", 0
    for i, (kind, (pattern, label)) in enumerate(L.REDACT.items(), 1):
        sql += f", a{i} AS (SELECT * EXCLUDE (x), len(regexp_extract_all(x, {S.quoted(pattern)})) AS {kind}, regexp_replace(x, {S.quoted(pattern)}, {S.quoted(label)}, 'g') AS x FROM a{i - 1})"
        last = i
    sums = ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in L.REDACT)
    return f"WITH {sql} SELECT {sums}, count(*) FILTER (x <> whole) AS redacted, round(avg((x <> whole)::INT), 6) AS rate FROM a{last}"


@query("pii_audit", _audit_sql())
def pii_audit(spark, d):
    return I.pii_audit(documents(spark, d))


@query("content_hashes", f"SELECT doc_id, md5(lower({S.strip('text')})) AS md5, sha256(text) AS sha256, 'group_' || left(md5(text), 8) AS anonymity_group, sha256(text || '|' || 'small-model') AS cache_key FROM documents")
def content_hashes(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", T.content_hash(t).alias("md5"), F.sha2(t, 256).alias("sha256"), T.anonymity_group(t).alias("anonymity_group"), F.sha2(F.concat(t, F.lit("|small-model")), 256).alias("cache_key"))


@query("anonymity_audit", "SELECT count(*) AS groups, min(n) AS least, count(*) FILTER (n >= 2) AS compliant, round(count(*) FILTER (n >= 2) / count(*), 6) AS rate FROM (SELECT count(*) AS n FROM documents GROUP BY left(md5(text), 8))")
def anonymity_audit(spark, d):
    return I.anonymity_audit(documents(spark, d), 2)


@query("dedup_first", f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(lower({S.strip('text')})) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first(spark, d):
    return C.first_by(documents(spark, d), T.content_hash(F.col("text")), "doc_id").select("doc_id", "source")


@query("duplicate_issues", "SELECT doc_id, original FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS original FROM documents) WHERE doc_id > original")
def duplicate_issues(spark, d):
    return C.duplicate_issues(documents(spark, d), F.sha2("text", 256), "doc_id")


@query("lang_heuristic", f"SELECT doc_id, 'en' AS language, CAST(CASE WHEN length({S.strip('text')}) < 10 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM documents")
def lang_heuristic(spark, d):
    code, confidence = T.script_language(F.col("text"))
    return documents(spark, d).select("doc_id", code.alias("language"), confidence.alias("confidence"))


@query("lang_indicators", f"SELECT doc_id, {S.language('text')[0]} AS language, round({S.language('text')[1]}, 6) AS confidence FROM documents")
def lang_indicators(spark, d):
    found = T.with_indicator_language(documents(spark, d).select("doc_id", "text"))
    return found.select("doc_id", "language", F.round("confidence", 6).alias("confidence"))


@query("language_names", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS name FROM documents")
def language_names(spark, d):
    return documents(spark, d).select("doc_id", T.language_name(F.col("lang")).alias("name"))


@query("filter_language", f"SELECT doc_id FROM documents WHERE {S.language('text')[0]} = 'fr' AND {S.language('text')[1]} >= 0.5")
def filter_language(spark, d):
    code, confidence = T.indicator_language(F.col("text"))
    return documents(spark, d).where((code == "fr") & (confidence >= 0.5)).select("doc_id")


@query("normalize_whitespace", f"SELECT doc_id, md5({S.strip('''regexp_replace(text, '\\s+', ' ', 'g')''')}) AS flat, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip('''regexp_replace(x, '\\s+', ' ', 'g')''')}), lambda x: x <> ''), chr(10))) AS lines FROM documents")
def normalize_whitespace(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", F.md5(T.normalize_whitespace(t).cast("binary")).alias("flat"), F.md5(T.normalize_whitespace(t, True).cast("binary")).alias("lines"))


@query("normalize_unicode", "SELECT doc_id, md5(nfc_normalize(text)) AS nfc FROM documents")
def normalize_unicode(spark, d):
    return documents(spark, d).select("doc_id", F.md5(T.normalize_unicode("NFC")(F.col("text")).cast("binary")).alias("nfc"))


def _fixed(x: str) -> str:
    for a, b in sorted(L.MOJIBAKE, key=lambda p: -len(p[0])):
        x = f"replace({x}, {S.quoted(a)}, {S.quoted(b)})"
    return f"regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"


@query("fix_encoding", f"SELECT doc_id, md5({_fixed('text')}) AS fixed FROM documents")
def fix_encoding(spark, d):
    return documents(spark, d).select("doc_id", F.md5(T.fix_encoding(F.col("text")).cast("binary")).alias("fixed"))


def _unescaped(x: str) -> str:
    for a, b in L.ENTITIES:
        x = f"replace({x}, {S.quoted(a)}, {S.quoted(b)})"
    return x


@query("html_clean", f"SELECT page_id, md5({_unescaped('''regexp_replace(html, '<[^>]+>', '', 'g')''')}) AS cleaned, md5(lower(regexp_replace(url, 'https?://\\S+|www\\.\\S+', '[URL]', 'g'))) AS url FROM pages")
def html_clean(spark, d):
    return pages(spark, d).select("page_id", F.md5(T.clean_text(F.col("html")).cast("binary")).alias("cleaned"), F.md5(T.clean_text(F.col("url"), urls=True, html=False, lower=True).cast("binary")).alias("url"))


@query("word_counts", f"SELECT doc_id, CAST({S.words('text')} AS INT) AS words, CAST(strlen(text) // 4 AS BIGINT) AS estimate FROM documents")
def word_counts(spark, d):
    return documents(spark, d).select("doc_id", T.word_tokens(F.col("text")).alias("words"), F.expr("cast(octet_length(text) div 4 as bigint)").alias("estimate"))


@query("display_strings", "SELECT doc_id, left(text, 50) AS t50, left(text, 200) AS t200 FROM documents")
def display_strings(spark, d):
    return documents(spark, d).select("doc_id", F.left("text", F.lit(50)).alias("t50"), F.left("text", F.lit(200)).alias("t200"))


@query("tfidf_top", f"""WITH v AS (SELECT source, doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN {S.listed(L.STOP_WORDS)}) AS l FROM documents),
w AS (SELECT source, doc_id, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM v),
f AS (SELECT source, doc_id, term, count(*) AS tf FROM w GROUP BY ALL), t AS (SELECT source, term, sum(tf) AS total, count(*) AS df FROM f GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY total DESC, term) AS r FROM t) WHERE r <= 10), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
g AS (SELECT f.source, doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w, n FROM f JOIN k USING (source, term) JOIN n USING (source)), l AS (SELECT source, doc_id, sqrt(sum(w * w)) AS l FROM g GROUP BY ALL),
m AS (SELECT source, term, sum(w / l) / min(n) AS score FROM g JOIN l USING (source, doc_id) GROUP BY ALL)
SELECT source, term, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, term) AS rank FROM m) WHERE rank <= 5""")
def tfidf_top(spark, d):
    return K.tfidf_terms(documents(spark, d), by="source").select("source", "term", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("top_words_by_source", f"""WITH w AS (SELECT source, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS word FROM documents),
c AS (SELECT source, word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]{{3,}}') AND word NOT IN {S.listed(L.STOP_WORDS)} GROUP BY ALL)
SELECT source, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 10""")
def top_words_by_source(spark, d):
    return K.top_words(documents(spark, d), ["source"], 10).withColumn("rank", F.col("rank").cast("long"))


@query("dominant_language", """WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL), b AS (SELECT source, sum(n) AS size, count(*) AS k, max(n) AS top FROM c GROUP BY source),
d AS (SELECT source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS r FROM c) WHERE r = 1)
SELECT source, CASE WHEN top / size < 0.6 AND k > 1 THEN 'Mixed - ' || lang ELSE lang END AS name, CAST(size AS BIGINT) AS size FROM b JOIN d USING (source)""")
def dominant_language(spark, d):
    return K.dominant(documents(spark, d), "source", "lang", "doc_id")


@query("most_common_language", "SELECT source, max({'n': n, 'v': lang}).v AS lang, max(n) AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def most_common_language(spark, d):
    return K.most_common(documents(spark, d), ["source"], "lang")


@query("samples_by_source", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def samples_by_source(spark, d):
    return K.top_rows(documents(spark, d).select("source", "doc_id"), ["source"], ["doc_id"], 5)


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '42') LIMIT 20")
def seeded_sample(spark, d):
    return K.sample(documents(spark, d).select("doc_id"), "doc_id", 20, "42")


@query("keyword_index", """WITH k AS (SELECT source AS cluster, unnest([lang, left(source, 4)]) AS keyword, size FROM (SELECT DISTINCT source, lang, count(*) OVER (PARTITION BY source) AS size FROM documents)), u AS (SELECT DISTINCT * FROM k)
SELECT keyword, list(DISTINCT cluster ORDER BY cluster) AS clusters, round(sum(size) / (SELECT count(*) FROM documents), 6) AS support FROM u GROUP BY keyword HAVING count(DISTINCT cluster) >= 2""")
def keyword_index(spark, d):
    docs = documents(spark, d)
    size = docs.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    rows = docs.select("source", "lang").distinct().join(size, "source").select(F.col("source").alias("cluster"), F.explode(F.array("lang", F.left("source", F.lit(4)))).alias("keyword"), "size").distinct()
    return K.keyword_index(rows)


@query("facet_distribution", f"WITH {FACETS} SELECT cluster, facet, value, n, round(n / sum(n) OVER (PARTITION BY cluster, facet), 6) AS share FROM (SELECT cluster, facet, value, count(*) AS n FROM f GROUP BY ALL)")
def facet_distribution(spark, d):
    return I.facet_distribution(facets(spark, d)).withColumn("share", F.round("share", 6))


@query("facet_pairs", f"""WITH {FACETS}, s AS (SELECT cluster, facet, value, n / sum(n) OVER (PARTITION BY cluster, facet) AS share FROM (SELECT cluster, facet, value, count(*) AS n FROM f GROUP BY ALL)), z AS (SELECT cluster, count(DISTINCT conv_id) AS size FROM f GROUP BY cluster),
p AS (SELECT facet || '=' || value AS pattern, sum(share * size) AS w FROM s JOIN z USING (cluster) GROUP BY ALL UNION ALL
SELECT a.facet || '=' || a.value || ' AND ' || b.facet || '=' || b.value, sum(a.share * b.share * size) FROM s a JOIN s b ON a.cluster = b.cluster AND a.facet < b.facet JOIN z ON z.cluster = a.cluster GROUP BY ALL)
SELECT pattern, round(w / (SELECT sum(size) FROM z), 6) AS support, round(least(1.0, w / (SELECT sum(size) FROM z) / 0.5), 6) AS interestingness FROM p WHERE w / (SELECT sum(size) FROM z) >= 0.1""")
def facet_pairs(spark, d):
    f = facets(spark, d)
    sizes = f.groupBy("cluster").agg(F.countDistinct("conv_id").alias("size"))
    return I.facet_patterns(I.facet_distribution(f), sizes).select("pattern", F.round("support", 6).alias("support"), F.round("interestingness", 6).alias("interestingness"))


@query("facet_co_occurrence", f"WITH {FACETS} SELECT a.facet AS facet_a, a.value AS value_a, b.facet AS facet_b, b.value AS value_b, count(*) AS n FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.facet < b.facet GROUP BY ALL")
def facet_co_occurrence(spark, d):
    return I.co_occurrence(facets(spark, d))


@query("common_pattern", f"WITH {FACETS}, t AS (SELECT count(DISTINCT conv_id) AS total FROM f), g AS (SELECT value, count(*) AS n FROM f WHERE facet = 'language' GROUP BY value ORDER BY n DESC, value LIMIT 1) SELECT value, n, n * 100 // total AS percent FROM g, t WHERE total >= 10 AND n > total // 3")
def common_pattern(spark, d):
    return I.common_value(facets(spark, d).where("facet = 'language'"))


@query("trend", """WITH f AS (SELECT doc_id AS conv_id, CAST(n_chars // 200 AS VARCHAR) AS value FROM documents), p AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS p, count(*) OVER () AS n FROM f),
g AS (SELECT value, count(*) FILTER (p < n // 2) AS first_half, count(*) FILTER (p >= n // 2) AS second_half FROM p GROUP BY value)
SELECT *, second_half / greatest(first_half, 1) AS increase FROM g WHERE second_half > first_half * 1 AND second_half > 5""")
def trend(spark, d):
    f = documents(spark, d).select(F.col("doc_id").alias("conv_id"), F.expr("cast(n_chars div 200 as string)").alias("value"))
    return I.trends(f, factor=1)


@query("overlay", f"WITH {FACETS} SELECT cluster, count(*) FILTER (value = 'en') AS count, round(avg((value = 'en')::INT), 6) AS prevalence FROM f WHERE facet = 'language' GROUP BY cluster")
def overlay(spark, d):
    return I.overlay(facets(spark, d).where("facet = 'language'"), "en").withColumn("prevalence", F.round("prevalence", 6))


@query("overlay_numeric", "SELECT source, count(n_chars) AS count, CAST(sum(n_chars) AS BIGINT) AS sum, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")
def overlay_numeric(spark, d):
    return I.numeric_overlay(documents(spark, d), "source", F.col("n_chars")).withColumn("mean", F.round("mean", 6))


@query("privacy_filter", f"WITH {CLUSTERS} SELECT name, size, CAST(1 AS BIGINT) AS parts FROM c WHERE size >= 3 UNION ALL SELECT 'merged_small_clusters', CAST(sum(size) AS BIGINT), count(*) FROM c WHERE size < 3 HAVING sum(size) >= 3")
def privacy_filter(spark, d):
    return I.privacy_filter(clusters(spark, d), 3)


@query("size_audit", f"WITH {CLUSTERS} SELECT count(*) AS clusters, count(*) FILTER (size < 3) AS small, CAST(coalesce(sum(size) FILTER (size < 3), 0) AS BIGINT) AS small_members, count(*) FILTER (size < 3) = 0 AS compliant FROM c")
def size_audit(spark, d):
    return I.size_audit(clusters(spark, d), 3)


@query("cluster_search", f"WITH {CLUSTERS}, r AS (SELECT cluster, name, round(contains(lower(name), 'src1')::INT + 0.5 * contains(lower(summary), 'src1')::INT + 0.3 * len(list_filter(keywords, lambda k: contains(k, 'src1'))), 6)::DOUBLE AS relevance FROM c) SELECT * FROM r WHERE relevance > 0 ORDER BY relevance DESC, cluster LIMIT 5")
def cluster_search(spark, d):
    return I.search(clusters(spark, d), "SRC1", 5)


@query("recommendations", f"""WITH {CLUSTERS}, o AS (SELECT cluster FROM c WHERE size < 3 ORDER BY cluster LIMIT 3), t AS (SELECT cluster FROM c ORDER BY size DESC, cluster LIMIT (6 - (SELECT count(*) FROM o)))
SELECT cluster, 'outlier' AS kind, 0.7::DOUBLE AS confidence FROM o UNION ALL SELECT cluster, 'trending', 0.8::DOUBLE FROM t""")
def recommendations(spark, d):
    return I.recommendations(clusters(spark, d), 6)


@query("cluster_similarity", f"""WITH {CLUSTERS}, p AS (SELECT a.cluster AS a, b.cluster AS b, round((least(a.size, b.size) / greatest(a.size, b.size) + CASE WHEN a.name = b.name THEN 1 ELSE len(list_filter(string_split(a.name, ' '), lambda w: contains(b.name, w))) / greatest(len(string_split(a.name, ' ')), len(string_split(b.name, ' '))) END) / 2, 6) AS similarity FROM c a, c b WHERE a.cluster <> b.cluster) SELECT * FROM p WHERE similarity > 0.3""")
def cluster_similarity(spark, d):
    return I.cluster_similarity(clusters(spark, d))


@query("name_correlation", f"WITH {CLUSTERS} SELECT a.cluster AS a, b.cluster AS b, round(least(length(a.name), length(b.name)) / greatest(length(a.name), length(b.name)), 6) AS ratio FROM c a, c b WHERE a.cluster <> b.cluster AND least(length(a.name), length(b.name)) / greatest(length(a.name), length(b.name)) > 0.3")
def name_correlation(spark, d):
    return I.name_correlation(clusters(spark, d))


@query("facet_conditions", f"WITH {FACETS} SELECT 'equals' AS op, conv_id FROM f WHERE facet = 'language' AND value = 'de' UNION ALL SELECT 'regex', conv_id FROM f WHERE facet = 'language' AND regexp_matches(value, '^e') UNION ALL SELECT 'greater_than', conv_id FROM f WHERE facet = 'quality' AND CAST(value AS DOUBLE) > 0.5")
def facet_conditions(spark, d):
    f = facets(spark, d)
    asked = (("language", "equals", "de"), ("language", "regex", "^e"), ("quality", "greater_than", 0.5))
    parts = [I.facet_condition(f, *a).select(F.lit(a[1]).alias("op"), "conv_id") for a in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("facet_prevalence", f"WITH {FACETS} SELECT cluster FROM f WHERE facet = 'language' GROUP BY cluster HAVING avg((value = 'en')::INT) >= 0.6")
def facet_prevalence(spark, d):
    return I.facet_condition(facets(spark, d), "language", "prevalence", "en>=0.6")


@query("investigate", f"WITH {CLUSTERS} SELECT cluster, name, size FROM c WHERE size BETWEEN 2 AND 4 AND (contains(lower(name || ' ' || summary), 'src1') OR contains(lower(name || ' ' || summary), 'src2'))")
def investigate(spark, d):
    return I.investigate(clusters(spark, d), terms=("src1", "src2"), conditions=(("size", "between", 2, 4),)).select("cluster", "name", "size")


@query("keyword_privacy", "SELECT source, round(greatest(0.1, 1 - (contains(lower(source), '1')::INT + contains(lower(lang), 'e')::INT) / 2), 6)::DOUBLE AS score FROM (SELECT DISTINCT source, lang FROM documents)")
def keyword_privacy(spark, d):
    rows = documents(spark, d).select("source", "lang").distinct()
    kw = F.array(F.when(F.contains("source", F.lit("1")), F.lit("my secret")).otherwise("plain"), F.when(F.contains("lang", F.lit("e")), F.lit("Password")).otherwise("plain"))
    return rows.select("source", F.round(T.pattern_privacy(kw), 6).alias("score"))


@query("cluster_privacy", "SELECT source, least(1.0, CASE WHEN n < 100 THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def cluster_privacy(spark, d):
    sized = documents(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sized.select("source", I.cluster_privacy(F.col("n"), [F.col("source")], 50).alias("score"))


@query("display_radius", f"WITH {CLUSTERS} SELECT cluster, round(greatest(20, least(80, 30 + 5 * ln(size + 1) * (1 - 0.1 * (cluster % 3)))), 6) AS radius FROM c")
def display_radius(spark, d):
    return clusters(spark, d).select("cluster", F.round(T.cluster_radius(F.col("size"), F.col("cluster") % 3), 6).alias("radius"))


@query("cube_source_language", "SELECT source, lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang)")
def cube_source_language(spark, d):
    return documents(spark, d).cube("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("passages_in_documents", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def passages_in_documents(spark, d):
    """Containment as an equi-join on a hash of inner words of each item, then a check of the whole item.

    Only words that stand between others in the item are sure to be whole words of the text: the second to the fifth, or
    as many as there are. Items of one or two words are compared with every text, so there may be no more than 1000.
    """
    words = lambda c: F.transform(F.split(c, r"\s+"), lambda w: F.xxhash64(w))
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.col("text").alias("item"))
    items = items.withColumn("w", words("item")).withColumn("n", F.least(F.size("w") - 2, F.lit(4)))
    keyed = items.where("n > 0").select("item_id", "item", F.xxhash64("n", F.slice("w", F.lit(2), F.col("n"))).alias("key"), "n")
    lengths = sorted(r["n"] for r in keyed.select("n").distinct().collect())  # 1 to 4
    docs = documents(spark, d).select("doc_id", "text")
    keys = keyed.select("key").distinct()
    parts = []
    for n in lengths:
        own = docs.withColumn("w", words("text"))
        at = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.lit(n), F.slice("w", i, F.lit(n))))  # noqa: B023
        grams = F.when(F.size("w") >= n, F.array_distinct(at))
        parts.append(own.select("doc_id", "text", F.explode(grams).alias("key")))
    found = None
    for p in parts:
        # Keys of items go out while there are few of them; beyond that the join is left to its plan.
        side = F.broadcast(keyed) if keys.count() <= 1_000_000 else keyed
        hits = p.join(side, "key").where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
        found = hits if found is None else found.unionByName(hits)
    short = items.where("n <= 0").select("item_id", "item")
    few = short.limit(1001).count()
    if few > 1000:
        raise ValueError("more than 1000 items of one or two words")
    if few:
        hits = docs.join(F.broadcast(short), F.contains("text", F.col("item"))).select("doc_id", "item_id")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct() if found is not None else docs.select("doc_id", F.lit(None).cast("long").alias("item_id")).where("false")


_GRAMS = """w AS (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+')) AS w FROM documents),
g AS (SELECT doc_id, lang, substring(' ' || w || ' ', CAST(i AS BIGINT), 3) AS gram FROM (SELECT doc_id, lang, w, unnest(range(1, length(w) + 1)) AS i FROM w WHERE w <> '')),
c AS (SELECT lang, gram, count(*) AS n FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
k AS (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM c) WHERE r <= 300),
p AS (SELECT k.gram, t.lang, CAST(round(ln((coalesce(n, 0) + 1.0::DOUBLE) / (total::DOUBLE + 1000)) * 1000) AS BIGINT) AS weight FROM k CROSS JOIN t LEFT JOIN c ON c.lang = t.lang AND c.gram = k.gram),
s AS (SELECT doc_id, p.lang, sum(weight) AS s, count(*) AS n FROM g JOIN p USING (gram) GROUP BY ALL),
b AS (SELECT doc_id, lang, n, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS r FROM s)"""


@query("language_profile", f"WITH {_GRAMS} SELECT d.doc_id, coalesce(b.lang, 'unknown') AS language, CAST(coalesce(n, 0) AS BIGINT) AS grams FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND r = 1")
def language_profile(spark, d):
    """Languages by trigrams learnt from four fifths of the labelled documents."""
    from convlens.operators import languages as N

    docs = documents(spark, d).select("doc_id", F.col("lang").alias("language"), "text")
    return N.by_profile(docs, checkpointed(N.profiles(docs.where("doc_id % 5 <> 0"))), "doc_id").drop("confidence")


@query("bpe_counts")
def bpe_counts(spark, d):
    """Tokens of each document by the merges of a vocabulary file."""
    import public_tokenizers

    from convlens.operators import bpe

    return bpe.counts(documents(spark, d), "doc_id", public_tokenizers.path("byte_bpe_50k.json"))
