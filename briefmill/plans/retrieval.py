"""Retrieval queries over documents, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.operators import lexical
from briefmill.operators import retrieval as r
from briefmill.sources.tables import table

PROBE = [((i * 37) % 64 - 32) / 64 for i in range(64)]
TERMS = ("license", "software", "the", "worthless")
_PROBE_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"
_PASSAGES = "p AS (SELECT doc_id, idx - 1 AS idx, doc_id || ':' || (idx - 1) AS id, l AS text, lang, source FROM (SELECT *, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents))"
_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def vector_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    return r.vector_top_k(table(spark, d, "embeddings"), PROBE, 20).select("vec_id", F.round("distance", 6).alias("distance"))


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return r.vector_top_k(table(spark, d, "embeddings"), PROBE, 10, where=F.col("label") == 3).select("vec_id", "label", F.round("distance", 6).alias("distance"))


def nn_label_classify(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    shelf = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    out = r.nearest_label(e, shelf, "vec_id", "embedding", "label", 0.45)
    return out.withColumn("confidence", F.round("confidence", 6))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return r.bm25(docs, TERMS).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(25)


def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over stems and positions, as a stored index holds them: every form of the words counts, stopwords do not."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    stop = F.size(F.filter(lexical.words(F.col("text")), lambda w: ~w.isin(lexical.STOPWORDS)))
    text = "The Licensing of Apache softwares"
    got = lexical.search(lexical.postings(docs, lexical.asked_stems(text)), docs.select("id", F.greatest(stop, F.lit(0)).alias("n")), text)
    return got.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(25)


def lexical_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the words 'licensed under' in whatever form, and how often."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return lexical.phrase(lexical.postings(docs, lexical.asked_stems("licenses under")), "licenses under")


def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    p = r.passages(table(spark, d, "documents"))
    return p.where(r.phrase(F.col("text"), ["under", "the"])).select("id", "doc_id")


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    vec = r.ranked(r.vector_top_k(table(spark, d, "embeddings"), PROBE, 50).select(F.col("vec_id").alias("id"), F.round("distance", 6).alias("distance")), [F.col("distance"), F.col("id")], 50)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    lex = r.ranked(r.bm25(docs, TERMS).withColumn("score", F.round("score", 6)), [F.desc("score"), F.col("id")], 50)
    return r.rrf([vec, lex]).select("id", F.round("score", 8).alias("score")).orderBy(F.desc("score"), "id").limit(20)


def like_fallback(spark: SparkSession, d: str) -> DataFrame:
    p = r.passages(table(spark, d, "documents"))
    return p.where(F.contains(F.lower("text"), F.lit("licensed under"))).select("id", F.lit(0.0).alias("score"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Sub-query hits: passages that have a term, scored by its frequency."""
    p = r.passages(table(spark, d, "documents"))
    arms = []
    for term in TERMS:
        n = r.term_count(r.tokens(F.col("text")), term)
        arms.append(p.select("doc_id", F.floor(F.col("idx") / 10).cast("int").alias("page"), "text", n.cast("double").alias("score"), F.lit(term).alias("sub_query")).where("score > 0"))
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return out


_HITS_SQL = f"{_PASSAGES}, h AS (" + " UNION ALL ".join(f"SELECT doc_id, (idx // 10)::INTEGER AS page, text, len(list_filter({_TOK}, lambda x: x = '{t}'))::DOUBLE AS score, '{t}' AS sub_query FROM p WHERE list_contains({_TOK}, '{t}')" for t in TERMS) + ")"
_MERGED_SQL = f"{_HITS_SQL}, m AS (SELECT doc_id, page, text, max(score) * (1 + 0.15 * (count(DISTINCT sub_query) - 1)) AS score, list_sort(list_distinct(list(sub_query))) AS sub_queries FROM h GROUP BY doc_id, page, text)"


def multi_query_dedup(spark: SparkSession, d: str) -> DataFrame:
    m = r.merge_hits(_hits(spark, d))
    return m.select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.round("score", 6).alias("score"), F.array_join("sub_queries", ",").alias("sub_queries"))


def diversity_cap(spark: SparkSession, d: str) -> DataFrame:
    m = r.merge_hits(_hits(spark, d)).withColumn("score", F.round("score", 6)).withColumn("k", F.md5(F.col("text").cast("binary")))
    return r.diversify(m, 60, [F.desc("score"), F.col("doc_id"), F.col("page"), F.col("k")], cap=3).select("doc_id", "page", "score", F.col("k").alias("text_md5"), F.col("nth").cast("long").alias("nth"))


def diversity_cap_adaptive(spark: SparkSession, d: str) -> DataFrame:
    m = r.merge_hits(_hits(spark, d)).withColumn("score", F.round("score", 6)).withColumn("k", F.md5(F.col("text").cast("binary")))
    return r.diversify(m, 60, [F.desc("score"), F.col("doc_id"), F.col("page"), F.col("k")]).select("doc_id", "page", "score", F.col("k").alias("text_md5"))


def entity_boost(spark: SparkSession, d: str) -> DataFrame:
    p = r.passages(table(spark, d, "documents"))
    n = F.size(r.tokens(F.col("text"))).cast("double")
    s = r.boost_if(n, r.has_all(F.col("text"), ["license", "version"]), 1.5)  # all entities
    s = r.boost_if(s, F.col("text").rlike("(?i)transcript|the"), 1.35)  # a pattern
    s = r.boost_if(s, F.col("source").isin("src1", "src2"), 1.2)  # a soft reference, once per row
    s = r.boost_if(s, F.contains("text", F.lit(" | ")), 2.0)  # tables
    return p.select("id", F.round(s, 6).alias("score"))


def pattern_backstop(spark: SparkSession, d: str) -> DataFrame:
    p = r.passages(table(spark, d, "documents"))
    return p.where(F.col("text").rlike(r"(?i)\blicense\b|\bsoftware\b")).select("id", F.lit(0.65).alias("score"))


def secondary_anti_dup(spark: SparkSession, d: str) -> DataFrame:
    p = r.passages(table(spark, d, "documents"))
    first = p.where(F.contains("text", F.lit("License"))).select("id", F.lit("main").alias("arm"))
    more = p.where("idx = 1").select("id", F.lit("page").alias("arm"))
    return first.unionByName(more.join(first, "id", "left_anti"))


def budget_pack_skip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return r.pack_budget(docs, "source", ["doc_id"], F.col("n_chars"), 20_000).select("source", "doc_id", "n_chars")


def budget_pack_break(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return r.pack_until_full(docs, "source", [F.col("doc_id")], F.col("n_chars"), 20_000)


def evidence_caps(spark: SparkSession, d: str) -> DataFrame:
    m = r.merge_hits(_hits(spark, d)).withColumn("k", F.md5(F.col("text").cast("binary")))
    top = m.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id", "page", "k").limit(40)
    return top.select("doc_id", "page", "score", "k", F.substring("text", 1, 1200).alias("excerpt"))


def outline_selection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    best = e.orderBy(F.desc("value"), "event_id").limit(12).select("event_id", "ts", "value")
    return r.ranked(best, [F.col("ts"), F.col("event_id")], 12).select("event_id", "value", F.col("rank").cast("long").alias("position"))


def score_validation(spark: SparkSession, d: str) -> DataFrame:
    return r.score_health(table(spark, d, "events").select(F.col("value").alias("score")))


def subquery_timing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("slowest"), F.min("value").alias("fastest"), F.round(F.sum("value"), 4).alias("total"), F.max_by("event_id", F.struct("value", "event_id")).alias("slowest_id"))


QUERIES = {f.__name__: f for f in (vector_topk_l2, vector_topk_filtered, nn_label_classify, bm25_topk, lexical_topk, lexical_phrase, phrase_match, rrf_hybrid, like_fallback, multi_query_dedup, diversity_cap, diversity_cap_adaptive, entity_boost, pattern_backstop, secondary_anti_dup, budget_pack_skip, budget_pack_break, evidence_caps, outline_selection, score_validation, subquery_timing)}

_DIST = f"sqrt(list_sum(list_transform(list_zip(embedding, {_PROBE_SQL}), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))))"
_BM = "WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), c AS (SELECT id, len(t) AS n, " + ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(sorted(TERMS))) + " FROM t), s AS (SELECT count(*) AS docs, avg(n) AS mean, " + ", ".join(f"count(*) FILTER (f{i} > 0) AS df{i}" for i in range(len(TERMS))) + " FROM c), b AS (SELECT id, round(" + " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(TERMS))) + ", 6) AS score FROM c, s WHERE " + " OR ".join(f"f{i} > 0" for i in range(len(TERMS))) + ")"

_STOP = "(" + ", ".join(f"'{w}'" for w in lexical.STOPWORDS) + ")"

ORACLE = {
    "vector_topk_l2": f"SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 20",
    "vector_topk_filtered": f"SELECT vec_id, label, round({_DIST}, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY {_DIST}, vec_id LIMIT 10",
    "nn_label_classify": """WITH s AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
        d AS (SELECT vec_id, s.label::VARCHAR AS label, sqrt(list_sum(list_transform(list_zip(embedding, v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS d FROM embeddings e, s),
        b AS (SELECT vec_id, arg_min(label, (d, label)) AS label, least(0.99, 1 / (1 + min(d))) AS c FROM d GROUP BY vec_id)
        SELECT vec_id, CASE WHEN c < 0.45 THEN 'Other' ELSE label END AS label, round(c, 6) AS confidence FROM b""",
    "bm25_topk": f"{_BM} SELECT id, score FROM b ORDER BY score DESC, id LIMIT 25",
    "lexical_topk": f"""WITH w AS (SELECT doc_id AS id, list_filter(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN {_STOP}) AS t FROM documents),
        f AS (SELECT id, len(t) AS n, unnest([len(list_filter(t, lambda x: x IN ('license', 'licenses', 'licensed', 'licensing'))), len(list_filter(t, lambda x: x = 'apache')), len(list_filter(t, lambda x: x IN ('software', 'softwares')))]) AS f, unnest([1, 2, 3]) AS q FROM w),
        s AS (SELECT *, count(*) FILTER (f > 0) OVER (PARTITION BY q) AS df, count(*) OVER (PARTITION BY q) AS docs, avg(n) OVER (PARTITION BY q) AS mean FROM f)
        SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM s WHERE f > 0 GROUP BY id ORDER BY score DESC, id LIMIT 25""",
    "lexical_phrase": """WITH w AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+') AS t FROM documents)
        SELECT id, len(list_filter(range(1, len(t)), lambda i: t[i] IN ('license', 'licenses', 'licensed', 'licensing') AND t[i + 1] = 'under'))::INTEGER AS n FROM w WHERE n > 0""",
    "phrase_match": f"WITH {_PASSAGES} SELECT id, doc_id FROM p WHERE contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' under the ')",
    "rrf_hybrid": f"""{_BM}, v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round({_DIST}, 6), vec_id) AS rank FROM embeddings), l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b)
        SELECT id, round(sum(1 / (60 + rank)), 8) AS score FROM (SELECT * FROM v WHERE rank <= 50 UNION ALL SELECT * FROM l WHERE rank <= 50) GROUP BY id ORDER BY score DESC, id LIMIT 20""",
    "like_fallback": f"WITH {_PASSAGES} SELECT id, 0.0::DOUBLE AS score FROM p WHERE contains(lower(text), 'licensed under')",
    "multi_query_dedup": f"WITH {_MERGED_SQL} SELECT doc_id, page, md5(text) AS text_md5, round(score, 6) AS score, array_to_string(sub_queries, ',') AS sub_queries FROM m",
    "diversity_cap": f"WITH {_MERGED_SQL}, n AS (SELECT doc_id, page, round(score, 6) AS score, md5(text) AS text_md5, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, page, md5(text)) AS nth FROM m) SELECT * FROM n ORDER BY nth > 3, score DESC, doc_id, page, text_md5 LIMIT 60",
    "diversity_cap_adaptive": f"WITH {_MERGED_SQL}, n AS (SELECT doc_id, page, round(score, 6) AS score, md5(text) AS text_md5, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, page, md5(text)) AS nth FROM m), c AS (SELECT greatest(2, ceil(72.0 / greatest(1, count(DISTINCT doc_id)))) AS cap FROM n) SELECT doc_id, page, score, text_md5 FROM n, c ORDER BY nth > cap, score DESC, doc_id, page, text_md5 LIMIT 60",
    "entity_boost": f"WITH {_PASSAGES} SELECT id, round(len({_TOK})::DOUBLE * CASE WHEN contains(lower(text), 'license') AND contains(lower(text), 'version') THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN regexp_matches(text, '(?i)transcript|the') THEN 1.35::DOUBLE ELSE 1 END * CASE WHEN source IN ('src1', 'src2') THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN contains(text, ' | ') THEN 2.0::DOUBLE ELSE 1 END, 6) AS score FROM p",
    "pattern_backstop": f"WITH {_PASSAGES} SELECT id, 0.65::DOUBLE AS score FROM p WHERE regexp_matches(text, '(?i)\\blicense\\b|\\bsoftware\\b')",
    "secondary_anti_dup": f"WITH {_PASSAGES}, f AS (SELECT id FROM p WHERE contains(text, 'License')) SELECT id, 'main' AS arm FROM f UNION ALL SELECT id, 'page' FROM p WHERE idx = 1 AND id NOT IN (SELECT id FROM f)",
    "budget_pack_skip": """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
        w AS (SELECT source, doc_id, n_chars, i, n_chars <= 20000 AS taken, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END AS used FROM o WHERE i = 1
              UNION ALL SELECT o.source, o.doc_id, o.n_chars, o.i, w.used + o.n_chars <= 20000, w.used + CASE WHEN w.used + o.n_chars <= 20000 THEN o.n_chars ELSE 0 END FROM w JOIN o ON o.source = w.source AND o.i = w.i + 1)
        SELECT source, doc_id, n_chars FROM w WHERE taken""",
    "budget_pack_break": "SELECT * FROM (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= 20000",
    "evidence_caps": f"WITH {_MERGED_SQL} SELECT doc_id, page, round(score, 6) AS score, md5(text) AS k, substr(text, 1, 1200) AS excerpt FROM m ORDER BY score DESC, doc_id, page, k LIMIT 40",
    "outline_selection": "WITH b AS (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 12) SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS position FROM b",
    "score_validation": "SELECT count(*) AS n, count(DISTINCT round(value, 6)) AS distinct, count(*) FILTER (isnan(value)) = 0 AND count(DISTINCT round(value, 6)) > 1 AND max(value) >= 0.001 AND stddev_pop(value) / abs(avg(value)) >= 0.001 AS trusted FROM events",
    "subquery_timing": "SELECT user_id, count(*) AS n, max(value) AS slowest, min(value) AS fastest, round(sum(value), 4) AS total, arg_max(event_id, (value, event_id)) AS slowest_id FROM events GROUP BY user_id",
}
