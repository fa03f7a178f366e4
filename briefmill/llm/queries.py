"""Queries of the numbered operators and of the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents")
    return dedup_lines(docs.select("doc_id", "text"), counts=("n_lines", "n_kept"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.mixing import probabilities

    return probabilities(table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 6))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.site_style import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm import ogg

    back = ogg.examine(ogg.store(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.fill_middle import fill_in_middle, restored

    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefmill.llm.byte_bpe import decode, encode

    back = decode(encode(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_topk": op6_topk,
    "op7_ogg": op7_ogg,
    "op8_toxicity": op8_toxicity,
    "op9_html": op9_html,
    "op10_near_dedup": op10_near_dedup,
    "op11_fill_middle": op11_fill_middle,
    "op12_divergence": op12_divergence,
    "op13_byte_bpe": op13_byte_bpe,
    "pipeline": pipeline,
}

_OP10_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS items FROM w),
n AS (SELECT doc_id, len(items) AS n, md5(array_to_string(list_sort(items), chr(1))) AS k FROM s),
c AS (SELECT k, n, min(doc_id) AS rep FROM n WHERE n > 0 GROUP BY k, n),
r AS (SELECT rep, n.n, unnest(items) AS item FROM c JOIN n ON n.doc_id = c.rep JOIN s ON s.doc_id = c.rep),
p AS (SELECT a.rep AS x, b.rep AS y FROM r a JOIN r b ON a.item = b.item AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
t AS (SELECT rep AS id, rep AS top FROM c UNION SELECT t.id, e.y FROM t JOIN e ON t.top = e.x),
m AS (SELECT id, min(top) AS top FROM t GROUP BY id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(m.top, n.doc_id) AS component_id, n.doc_id = coalesce(m.top, n.doc_id) AS kept
FROM n LEFT JOIN c ON n.k = c.k AND n.n = c.n LEFT JOIN m ON m.id = c.rep
"""



def _op3_sql() -> str:
    from briefmill.llm import mixing

    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in mixing.TOPICS) + f" ELSE '{mixing.OTHER_TOPIC}' END"
    parts = [
        f"d AS (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents)",
        "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        "w0 AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM c) AS w FROM c)",
    ]
    for dim, power in mixing.TEMPERATURES.items():
        parts.append(f"g_{dim} AS MATERIALIZED (SELECT {dim} AS k, p / sum(p) OVER () AS goal FROM (SELECT {dim}, pow(sum(w), {power}) AS p FROM w0 GROUP BY {dim}))")
    n = 0
    for _ in range(mixing.ITERATIONS):
        for dim in mixing.DIMENSIONS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, coalesce(w * goal / nullif(sum(w) OVER (PARTITION BY {dim}), 0), 0) AS w FROM w{n} JOIN g_{dim} ON {dim} IS NOT DISTINCT FROM k)")
            n += 1
    parts += [
        f"f AS (SELECT source, lang, topic, tokens, coalesce(w / nullif(tokens, 0), 0) AS f FROM w{n})",
        "o AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY f DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(tokens * f) OVER (ORDER BY f DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM f WHERE f > 0)",
        "s AS (SELECT arg_max(s, f) AS s FROM (SELECT f, (0.5 * (SELECT sum(tokens) FROM c) - full_) / rest AS s FROM o) WHERE s * f <= 1)",
        "p AS (SELECT source, lang, topic, least(1.0, f * coalesce((SELECT s FROM s), 1 / (SELECT min(f) FROM o))) AS p FROM f)",
    ]
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, d.source, d.lang, d.topic, d.tokens::BIGINT AS tokens, round(p, 6) AS probability,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 < p AS kept
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic"""


_OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

_OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, [('0x' || substr(h, i, 8))::BIGINT FOR i IN [1, 9, 17, 25]] AS g FROM d),
c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(pre || mid || suf) AS restored_sha256
FROM p
"""

_OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, sum(total) AS total FROM g GROUP BY lang),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v) AS p
      FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(l.total) + 5 * any_value(v.v)) AS q FROM p JOIN l USING (lang) JOIN v USING (lang) GROUP BY ALL),
o AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
t AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT 'pair' AS part, * FROM o UNION ALL SELECT 'term', * FROM t)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""

ORACLE = {
    "op11_fill_middle": _OP11_SQL,
    "op12_divergence": _OP12_SQL,
    "op6_topk": _OP6_SQL,
    "op3_mixing": _op3_sql(),
    "op10_near_dedup": _OP10_SQL,
}
