"""Aggregates, ordered analytics, graphs, text functions and scores over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefmill.functions import chunking, readiness
from briefmill.functions import text as t
from briefmill.operators import ordered as o
from briefmill.operators.retrieval import holds_quote, passages
from briefmill.plans.retrieval import _PASSAGES
from briefmill.sources.tables import table


def corpus_status(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders")
    return x.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.max("o_orderdate").alias("latest"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_key"))


def coverage_by_source(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    done = F.count("quality")
    return x.groupBy("source").agg(F.count("*").alias("total"), done.alias("labelled"), F.round(done / F.nullif(F.count("*"), F.lit(0)), 3).alias("coverage"))


def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return x.na.fill(0, ["F", "O", "P"])


def grand_total_rollup(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("long").alias("level"))


def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "label")
    return x.withColumns({"rank": F.row_number().over(w).cast("long"), "share": F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4)})


def page_report(spark: SparkSession, d: str) -> DataFrame:
    """Turns 0 to the last of each conversation, with or without text, and their state."""
    c = table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    every = last.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + 2)).alias("turn"))
    has = c.groupBy("conv_id", "turn").agg(F.max(F.length("text")).alias("chars"))
    x = every.join(has, ["conv_id", "turn"], "left")
    return x.groupBy("conv_id").agg(F.count("*").alias("pages"), F.count("chars").alias("found"), F.count_if(F.col("chars") < 50).alias("thin"), F.round(F.avg("chars"), 4).alias("mean"))


def gap_pages(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_quantity > 10").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("have"), F.max("l_linenumber").alias("n"))
    gaps = F.array_except(F.sequence(F.lit(1), F.col("n")), F.col("have"))
    return x.select("l_orderkey", F.array_join(F.transform(gaps, lambda g: g.cast("string")), ",").alias("gaps"), (F.size("have") * 10 < F.col("n") * 3).alias("low"))


def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    a, b = F.count_if(F.col("l_linestatus") == "F"), F.count_if(F.col("l_returnflag") == "R")
    return x.groupBy("l_suppkey").agg(a.alias("indexed"), b.alias("structured"), F.greatest(F.lit(0).cast("long"), a - b).alias("legacy"))


def execution_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("ok"), F.round(F.avg("value"), 2).alias("mean"), F.max("ts").alias("last"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))


def decayed_preferences(spark: SparkSession, d: str) -> DataFrame:
    """Weights that halve with age, capped at 10, the top three of each kind."""
    e = table(spark, d, "events")
    age = F.datediff(F.to_date(F.lit("2024-01-31")), F.to_date("ts"))
    x = e.groupBy("event_type", "user_id").agg(F.least(F.lit(10.0), F.round(F.sum(F.col("value") / 100 * F.exp(-age / 30)), 6)).alias("weight"))
    w = Window.partitionBy("event_type").orderBy(F.desc("weight"), "user_id")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3")


def wave_plan(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("waiting"), F.min("o_orderdate").alias("oldest"))
    w = Window.orderBy("waiting", "o_custkey")
    return x.orderBy("waiting", "o_custkey").limit(50).withColumn("wave", F.floor((F.row_number().over(w) - 1) / 10).cast("long"))


def progress_rate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.count("*") / 3600, 6).alias("per_second")).select(F.col("w.start").alias("hour"), "n", "per_second")


def rate_window_10s(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    w = F.window("ts", "10 seconds", "5 seconds")
    return e.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n", (F.col("n") / 10).alias("rate"))


def rate_limit_60s(spark: SparkSession, d: str) -> DataFrame:
    """Each minute of a type is one window, which also sees the minute before, so that a busy type is many tasks."""
    e = table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("own", F.expr("s div 60000000"))
    each = e.select("event_id", "event_type", "s", "own", F.explode(F.array("own", F.col("own") + 1)).alias("minute"))
    w = Window.partitionBy("event_type", "minute").orderBy("s").rangeBetween(-60_000_000, 0)
    told = each.withColumn("recent", F.count("*").over(w)).where("minute = own")
    return told.select("event_id", "recent", (F.col("recent") >= 3).alias("limited"))


def lag_percentile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("top"))


def folder_totals(spark: SparkSession, d: str) -> DataFrame:
    """Pages and characters under each prefix of the paths."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"), F.length("html").alias("n"))
    parts = F.split("path", "/")
    each = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"), "n")
    return each.groupBy("folder").agg(F.count("*").alias("pages"), F.sum("n").alias("chars"))


def chunk_neighbours(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("text", F.md5(F.col("text").cast("binary")))
    x = o.neighbours(c, ["conv_id"], ["turn", "role", "text"], "text", 2, 2)
    return x.select("conv_id", "turn", "role", "text", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"), "at_start", "at_end", "ambiguous")


def section_ranges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", (F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))).alias("page"))
    return o.until_next(e, "user_id", "page", F.lit(2_592_000).cast("long"))


def speaker_turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return o.turns(c, "conv_id", "turn", "role")


def carried_heading(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    head = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return e.select("event_id", "user_id", o.carried(e, "user_id", "event_id", head).alias("heading"))


def runner_up_margin(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    y = x.withColumns({"rn": F.row_number().over(w), "margin": F.round(F.col("o_totalprice") - F.lead("o_totalprice").over(w), 2)})
    return y.where("rn = 1").select("o_custkey", "o_orderkey", "margin")


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders")
    return x.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return x.select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst")).where("dst is not null")


def graph_lineage(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return o.lineage(_edges(spark, d), seeds).groupBy("seed", "node").agg(F.min("depth").cast("long").alias("depth"))


def lineage_by_revision(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lineage of up to 50 nodes, as far as it has the same status, by a revision that some lack."""
    k = F.col("o_orderkey")
    nodes = table(spark, d, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("scope"), F.when(k % 4 != 0, k % 9).alias("revision"))
    return o.lineage_in_scope(_edges(spark, d), nodes).withColumn("depth", F.col("depth").cast("long"))


def related_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each order's classes of related orders: those that share a supplier (1) or a part (2), with how many others. Members of
    one class are the related ones, so all pairs follow from a join by class; none is made here."""
    x = table(spark, d, "lineitem")
    arm = lambda key, why: x.select("l_orderkey", F.lit(why).alias("why"), F.col(key).alias("class")).distinct()
    members = arm("l_suppkey", 1).unionByName(arm("l_partkey", 2))
    size = members.groupBy("why", "class").agg((F.count("*") - 1).alias("others"))
    return members.join(size, ["why", "class"]).select("l_orderkey", "why", "class", "others")


def unconnected(spark: SparkSession, d: str) -> DataFrame:
    x = _edges(spark, d)
    ids = table(spark, d, "orders").select("o_orderkey")
    touched = x.select(F.col("src").alias("o_orderkey")).union(x.select("dst")).distinct()
    return ids.join(touched, "o_orderkey", "left_anti")


def selection_state(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("chosen"))
    return x.select("l_orderkey", F.when(F.col("chosen") == 0, "none").when(F.col("chosen") == F.col("n"), "all").otherwise("some").alias("state"))


def citation_format(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as pages of records, with volumes, lines, supplements and case numbers that some lack."""
    x = table(spark, d, "lineitem")
    k, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "N", "Clerk's Record").when(F.col("l_returnflag") == "R", "rr").when(p % 2 == 0, "Exhibit")
    made = t.citation(kind, F.when(n < 6, n), k % 3, F.col("l_quantity").cast("int"), F.when(p % 4 != 0, p % 25 + 1), F.when(p % 3 != 0, F.col("l_suppkey") % 25 + 1), F.when(k % 14 != 0, k % 14), F.when(p % 5 != 0, F.concat(F.lit("D-1-"), k.cast("string"))))
    return x.select("l_orderkey", "l_linenumber", made.alias("c")).select("l_orderkey", "l_linenumber", "c.full", "c.short", "c.type")


def truncate_and_snippet(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.select("doc_id", t.truncate_middle(F.col("text"), 105).alias("short"), t.snippet(F.col("text"), "license").alias("snippet"))


def line_tests(spark: SparkSession, d: str) -> DataFrame:
    p = passages(table(spark, d, "documents"))
    return p.select("id", t.heading(F.col("text")).alias("heading"), F.length("text").alias("n"))


def draft_detection(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.select("doc_id", t.draft_score(F.col("text"), F.col("source")).alias("draft"))


def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", t.name_key(F.concat(F.lit("Hon. "), "c_name", F.lit(" Jr."))).alias("key"))


def hash_and_distance(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part")
    return x.select("p_partkey", F.sha2(F.col("p_name"), 256).alias("sha256"), F.levenshtein("p_name", "p_type").cast("long").alias("distance"), F.lower("p_name").contains("a").alias("has_a"))


def quote_verification(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold a benchmark passage, by ``operators.retrieval.holds_quote``."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return holds_quote(table(spark, d, "documents").select("doc_id", "text"), b)


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    p = passages(table(spark, d, "documents")).where(F.trim("text") != "")
    n = p.groupBy(F.md5(F.col("text").cast("binary")).alias("line")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))
    return n.where("docs >= 3")


def token_bloat(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return x.select("doc_id", words.alias("words"), F.round(F.length("text") / F.greatest(words, F.lit(1)), 4).alias("per_word"), (words > 4000).alias("bloat"))


def glyph_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    entropy = readiness.bigram_entropies(x, "doc_id", "text")
    replaced = x.select("doc_id", F.round(readiness.replacement_ratio(F.col("text")), 6).alias("replaced"))
    return replaced.join(entropy, "doc_id", "left").select("doc_id", "replaced", F.round(F.coalesce("entropy", F.lit(0.0)), 6).alias("entropy"))


def readiness_score(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records of pages: their lines' classes, mean score, penalties and band."""
    p = passages(table(spark, d, "documents"))
    ocr = F.col("idx") % 3 == 1
    conf = F.when(ocr & (F.col("idx") % 9 != 4), (F.length("text") % 100) / F.when(F.col("idx") % 2 == 0, 100.0).otherwise(1.0))
    cls = readiness.page_class(F.col("text"), conf, F.contains("text", F.lit("%%%")), ocr)
    x = p.withColumn("class", cls).withColumn("page_score", readiness.ladder(F.col("class")))
    y = x.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("page_score") == 0).alias("missing"), F.avg("page_score").alias("mean"), (F.count("*") - F.count_distinct("text") >= 3).alias("repeat"), (F.sum(F.length("text")) > 20000).alias("bloat"))
    score = readiness.document_score(F.col("mean"), F.col("pages"), F.col("missing"), F.col("repeat"), F.col("bloat"), F.col("pages") > 8, F.lit(False), F.col("missing") > 2)
    return y.select("doc_id", score.alias("score"), readiness.band(score).alias("band"))


def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(table(spark, d, "documents"), chunking.recursive)


def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(table(spark, d, "documents"), chunking.by_tokens)


def head_and_tail(spark: SparkSession, d: str) -> DataFrame:
    p = passages(table(spark, d, "documents")).select("doc_id", "idx")
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return p.withColumn("n", n).where("idx < 3 or idx >= n - 5").select("doc_id", "idx")


def excerpt_picker(spark: SparkSession, d: str) -> DataFrame:
    """The lines with most keywords, first lines preferred, up to 12 and 6000 characters of a document."""
    p = passages(table(spark, d, "documents")).withColumn("size", F.length("text"))
    hits = sum((F.regexp_like("text", F.lit(k)).cast("int") for k in (r"(?i)\blicense", r"(?i)\bthe\b", r"(?i)\bof\b", r" \| ")), F.lit(0)) + (F.col("idx") < 2).cast("int")
    w = Window.partitionBy("doc_id").orderBy(F.desc("hits"), "idx")
    x = p.withColumn("hits", hits).where("hits > 0").withColumns({"rn": F.row_number().over(w), "used": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return x.where("rn <= 12 and used <= 6000").select("doc_id", "idx", "hits", "used")


def kind_lookup(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.createDataFrame([("1-URGENT", "motion"), ("2-HIGH", "response"), ("3-MEDIUM", "order")], "o_orderpriority string, kind string")
    x = table(spark, d, "orders").join(F.broadcast(kinds), "o_orderpriority", "left")
    return x.groupBy(F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))


def distinct_tags(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.explode(F.json_object_keys("props")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def answer_target(spark: SparkSession, d: str) -> DataFrame:
    """The part type that has at least half of a name's words, with a lead of .2 over the next type, else none."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    p = table(spark, d, "part").select("p_partkey", words("p_name").alias("w"))
    k = table(spark, d, "part").select("p_type").distinct().select("p_type", F.explode(words("p_type")).alias("t"))
    met = p.select("p_partkey", F.size("w").alias("n"), F.explode("w").alias("t")).join(k, "t").groupBy("p_partkey", "n", "p_type").agg(F.count("*").alias("c"))
    v = Window.partitionBy("p_partkey").orderBy(F.desc("o"), F.desc("p_type"))
    best = met.withColumn("o", F.col("c") / F.col("n")).withColumns({"rn": F.row_number().over(v), "next": F.coalesce(F.lead("o").over(v), F.lit(0.0))}).where("rn = 1 and o >= 0.5 and o - next >= 0.2")
    return p.select("p_partkey").join(best.select("p_partkey", F.col("p_type").alias("target")), "p_partkey", "left")


QUERIES = {f.__name__: f for f in (corpus_status, coverage_by_source, status_pivot, grand_total_rollup, vector_stats, page_report, gap_pages, conditional_counts, execution_stats, decayed_preferences, wave_plan, progress_rate, rate_window_10s, rate_limit_60s, lag_percentile, folder_totals, chunk_neighbours, section_ranges, speaker_turns, carried_heading, runner_up_margin, latest_version, graph_lineage, lineage_by_revision, related_entities, unconnected, selection_state, citation_format, truncate_and_snippet, line_tests, draft_detection, name_keys, hash_and_distance, quote_verification, repeated_lines, token_bloat, glyph_metrics, readiness_score, chunk_recursive, chunk_tokens, head_and_tail, excerpt_picker, kind_lookup, distinct_tags, answer_target)}

_EDGES = "e AS (SELECT * FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"
_W = r"'[^\x20\x09-\x0D]+'"
ORACLE = {
    "corpus_status": "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS large, max(o_orderdate) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_key FROM orders GROUP BY 1",
    "coverage_by_source": "SELECT source, count(*) AS total, count(quality) AS labelled, round(count(quality) / count(*), 3) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "status_pivot": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "grand_total_rollup": "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(lang, source)::BIGINT AS level FROM documents GROUP BY ROLLUP (lang, source)",
    "vector_stats": "SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS rank, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM embeddings GROUP BY label",
    "page_report": "WITH h AS (SELECT conv_id, turn, max(length(text)) AS c FROM conversations GROUP BY ALL), e AS (SELECT conv_id, unnest(range(0, max(turn) + 3)) AS turn FROM conversations GROUP BY conv_id) SELECT conv_id, count(*) AS pages, count(c) AS found, count(*) FILTER (c < 50) AS thin, round(avg(c), 4) AS mean FROM e LEFT JOIN h USING (conv_id, turn) GROUP BY conv_id",
    "gap_pages": "WITH h AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS have, max(l_linenumber) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1) SELECT l_orderkey, array_to_string(list_filter(range(1, n + 1), lambda x: NOT list_contains(have, x)), ',') AS gaps, len(have) * 10 < n * 3 AS low FROM h",
    "conditional_counts": "SELECT l_suppkey, count(*) FILTER (l_linestatus = 'F') AS indexed, count(*) FILTER (l_returnflag = 'R') AS structured, greatest(0, count(*) FILTER (l_linestatus = 'F') - count(*) FILTER (l_returnflag = 'R')) AS legacy FROM lineitem GROUP BY 1",
    "execution_stats": "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS ok, round(avg(value), 2) AS mean, max(ts) AS last, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY 1",
    "decayed_preferences": "WITH x AS (SELECT event_type, user_id, least(10.0::DOUBLE, round(sum(value / 100 * exp(-date_diff('day', ts::DATE, DATE '2024-01-31') / 30.0::DOUBLE)), 6)) AS weight FROM events GROUP BY ALL) SELECT event_type, user_id, weight, row_number() OVER (PARTITION BY event_type ORDER BY weight DESC, user_id) AS rank FROM x QUALIFY rank <= 3",
    "wave_plan": "WITH x AS (SELECT o_custkey, count(*) AS waiting, min(o_orderdate) AS oldest FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT *, (row_number() OVER (ORDER BY waiting, o_custkey) - 1) // 10 AS wave FROM x ORDER BY waiting, o_custkey LIMIT 50",
    "progress_rate": "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(count(*) / 3600, 6) AS per_second FROM events GROUP BY 1",
    "rate_window_10s": "WITH w AS (SELECT time_bucket(INTERVAL 5 SECONDS, ts) - to_seconds(5 * k) AS start FROM events, range(2) t(k)) SELECT start, count(*) AS n, count(*) / 10 AS rate FROM w GROUP BY 1",
    "rate_limit_60s": "SELECT event_id, count(*) OVER w AS recent, count(*) OVER w >= 3 AS limited FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)",
    "lag_percentile": "SELECT event_type, quantile_disc(value, 0.95) AS p95, max(value) AS top FROM events GROUP BY 1",
    "folder_totals": "WITH p AS (SELECT string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/') AS s, length(html) AS n FROM pages) SELECT array_to_string(s[1:k], '/') AS folder, count(*) AS pages, sum(n)::BIGINT AS chars FROM (SELECT s, n, unnest(range(1, len(s) + 1)) AS k FROM p) GROUP BY 1",
    "chunk_neighbours": "WITH c AS (SELECT conv_id, turn, role, md5(text) AS text FROM conversations) SELECT conv_id, turn, role, text, coalesce(string_agg(text, ',') OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(text, ',') OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after, row_number() OVER w = 1 AS at_start, lead(1) OVER w IS NULL AS at_end, count(*) OVER (PARTITION BY conv_id, turn) > 1 AS ambiguous FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)",
    "section_ranges": "WITH s AS (SELECT DISTINCT user_id, (epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01'))::BIGINT AS page FROM events WHERE event_type = 'purchase') SELECT user_id, page, coalesce(lead(page) OVER (PARTITION BY user_id ORDER BY page) - 1, 2592000) AS \"end\" FROM s",
    "speaker_turns": "WITH c AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL), m AS (SELECT *, (lag(role) OVER w IS DISTINCT FROM role OR lag(turn) OVER w IS NULL)::INTEGER AS new FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM m) SELECT conv_id, island, role, min(turn) AS first, max(turn) AS last, count(*) AS rows FROM i GROUP BY ALL",
    "carried_heading": "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events",
    "runner_up_margin": "SELECT o_custkey, o_orderkey, margin FROM (SELECT *, row_number() OVER w AS rn, round(o_totalprice - lead(o_totalprice) OVER w, 2) AS margin FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE rn = 1",
    "latest_version": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
    "graph_lineage": f"WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT o_orderkey AS seed, o_orderkey AS node, 0 AS depth FROM orders UNION SELECT seed, dst, depth + 1 FROM r JOIN b ON node = src WHERE depth < 4) SELECT seed, node, min(depth)::BIGINT AS depth FROM r GROUP BY ALL",
    "lineage_by_revision": f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT o_orderkey AS seed, o_orderkey AS node, 0 AS depth FROM orders UNION SELECT seed, dst, depth + 1 FROM r JOIN b ON node = src WHERE depth < 4),
        m AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY ALL), t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, node) <= 50)
        SELECT seed, node, depth::BIGINT AS depth, row_number() OVER (PARTITION BY seed ORDER BY CASE WHEN y.o_orderkey % 4 <> 0 THEN y.o_orderkey % 9 ELSE 0 END, node)::INTEGER AS place
        FROM t JOIN orders x ON x.o_orderkey = seed JOIN orders y ON y.o_orderkey = node WHERE depth > 0 AND x.o_orderstatus = y.o_orderstatus""",
    "related_entities": "WITH m AS (SELECT DISTINCT l_orderkey, 1 AS why, l_suppkey AS class FROM lineitem UNION SELECT DISTINCT l_orderkey, 2, l_partkey FROM lineitem) SELECT l_orderkey, why, class, count(*) OVER (PARTITION BY why, class) - 1 AS others FROM m",
    "unconnected": f"WITH {_EDGES} SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e)",
    "selection_state": "SELECT l_orderkey, CASE count(*) FILTER (l_returnflag = 'N') WHEN 0 THEN 'none' WHEN count(*) THEN 'all' ELSE 'some' END AS state FROM lineitem GROUP BY 1",
    "citation_format": """WITH x AS (SELECT *, floor(l_quantity)::INTEGER AS page, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS vol, l_orderkey % 3 > 1 AS many, CASE l_orderkey % 14 WHEN 0 THEN '' WHEN 1 THEN 'Supp. ' WHEN 2 THEN '2nd Supp. ' WHEN 3 THEN '3rd Supp. ' ELSE (l_orderkey % 14) || 'th Supp. ' END AS supp FROM lineitem),
        y AS (SELECT *, CASE l_returnflag WHEN 'N' THEN CASE WHEN many THEN coalesce(vol, 1) || ' ' ELSE '' END || supp || 'CR ' || page
            WHEN 'R' THEN CASE WHEN many THEN coalesce(vol, 1) || ' ' ELSE '' END || supp || 'RR ' || page || CASE WHEN l_partkey % 4 = 0 THEN '' WHEN l_partkey % 3 = 0 OR l_partkey % 25 = l_suppkey % 25 THEN ':' || (l_partkey % 25 + 1) ELSE ':' || (l_partkey % 25 + 1) || '-' || (l_suppkey % 25 + 1) END
            ELSE CASE WHEN l_partkey % 2 = 0 THEN 'Exhibit' ELSE 'Doc' END || CASE WHEN many AND vol IS NOT NULL THEN ' Vol. ' || vol || ',' ELSE '' END || ' p. ' || page END AS short FROM x)
        SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 <> 0 THEN 'D-1-' || l_orderkey || ' ' ELSE '' END || short AS "full", short, CASE WHEN l_returnflag = 'A' THEN 'generic' ELSE CASE WHEN supp <> '' THEN 'Supp. ' ELSE '' END || CASE l_returnflag WHEN 'N' THEN 'CR' ELSE 'RR' END END AS type FROM y""",
    "truncate_and_snippet": "WITH x AS (SELECT doc_id, text, instr(lower(text), 'license') AS pos FROM documents) SELECT doc_id, CASE WHEN length(text) <= 105 THEN text ELSE substr(text, 1, 50) || ' ... ' || right(text, 50) END AS short, CASE WHEN pos > 0 THEN substr(text, greatest(1, pos - 60), pos - greatest(1, pos - 60) + 140) END AS snippet FROM x",
    "line_tests": f"WITH {_PASSAGES} SELECT id, length(text) <= 120 AND (regexp_matches(text, '^[A-Z][A-Z0-9 ,.''&-]{{3,}}$') OR regexp_matches(text, '^(?:[IVXLC]+|[A-Z]|\\d{{1,3}})\\.\\s+\\S')) AS heading, length(text)::INTEGER AS n FROM p",
    "draft_detection": "SELECT doc_id, round(greatest(0.0, least(1.0, CASE WHEN regexp_matches(text, '(?i)\\bdraft\\b') THEN 0.5 ELSE 0 END + least(0.3, 0.1 * len(regexp_extract_all(text, '_{4,}|\\[[^\\]]{0,40}\\]|(?i:\\btbd\\b)'))) + CASE WHEN regexp_matches(text, '(?i)\\b(?:filed|received|e-filed)\\b') THEN -0.4 ELSE 0.1 END + CASE WHEN regexp_matches(source, '(?i)final|filed') THEN -0.2 ELSE 0 END)), 6)::DOUBLE AS draft FROM documents",
    "name_keys": "SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('Hon. ' || c_name || ' Jr.'), '[^a-z ]', ' ', 'g'), '\\b(?:mr|mrs|ms|dr|hon|jr|sr|esq|judge|justice|[a-z])\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM customer",
    "hash_and_distance": "SELECT p_partkey, sha256(p_name) AS sha256, levenshtein(p_name, p_type) AS distance, contains(lower(p_name), 'a') AS has_a FROM part",
    "quote_verification": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "repeated_lines": f"WITH {_PASSAGES} SELECT md5(text) AS line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM p WHERE trim(text) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3",
    "token_bloat": f"SELECT doc_id, len(regexp_extract_all(text, {_W}))::INTEGER AS words, round(length(text) / greatest(len(regexp_extract_all(text, {_W})), 1), 4) AS per_word, len(regexp_extract_all(text, {_W})) > 4000 AS bloat FROM documents",
    "glyph_metrics": "WITH c AS (SELECT doc_id, text, unnest(range(1, length(text))) AS i FROM documents), g AS (SELECT doc_id, lower(substr(text, i, 2)) AS g FROM c), n AS (SELECT doc_id, g, count(*)::DOUBLE AS k FROM g WHERE regexp_full_match(g, '[a-z][a-z]') GROUP BY ALL), e AS (SELECT doc_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS e FROM n GROUP BY 1) SELECT d.doc_id, round((length(text) - length(replace(text, chr(65533), ''))) / greatest(length(text), 1), 6) AS replaced, round(coalesce(e, 0), 6) AS entropy FROM documents d LEFT JOIN e USING (doc_id)",
    "readiness_score": f"""WITH {_PASSAGES}, c AS (SELECT doc_id, idx, text, length(text) AS n, CASE WHEN idx % 3 = 1 AND idx % 9 <> 4 THEN (length(text) % 100) / CASE WHEN idx % 2 = 0 THEN 100.0::DOUBLE ELSE 1 END END AS f FROM p),
        k AS (SELECT *, CASE WHEN f <= 1 THEN f * 100 ELSE f END AS q FROM c),
        s AS (SELECT doc_id, text, n, CASE WHEN NOT regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]') THEN 0 WHEN contains(text, '%%%') THEN 0 WHEN idx % 3 = 1 THEN CASE WHEN q IS NULL OR q >= 90 THEN 80 WHEN q >= 75 THEN 70 ELSE 50 END WHEN n < 150 THEN 70 ELSE 95 END AS s FROM k),
        y AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (s = 0) AS missing, avg(s) AS mean, count(*) - count(DISTINCT text) >= 3 AS rep, sum(n) > 20000 AS bloat FROM s GROUP BY 1),
        z AS (SELECT doc_id, missing, greatest(0, least(100, mean - CASE WHEN missing > 0 THEN least(40, 10 + round(45 * sqrt(missing / pages))) ELSE 0 END - CASE WHEN rep THEN 8 ELSE 0 END - CASE WHEN bloat THEN 8 ELSE 0 END - CASE WHEN pages > 8 THEN 6 ELSE 0 END)) AS v FROM y),
        f AS (SELECT doc_id, round(CASE WHEN missing > 2 THEN least(v, 84) ELSE v END)::DOUBLE AS score FROM z)
        SELECT doc_id, score, CASE WHEN score >= 85 THEN 'HIGH' WHEN score >= 70 THEN 'OK' WHEN score >= 50 THEN 'RISKY' ELSE 'POOR' END AS band FROM f""",
    "head_and_tail": f"WITH {_PASSAGES} SELECT doc_id, idx::INTEGER AS idx FROM (SELECT doc_id, idx, count(*) OVER (PARTITION BY doc_id) AS n FROM p) WHERE idx < 3 OR idx >= n - 5",
    "excerpt_picker": f"""WITH {_PASSAGES}, h AS (SELECT doc_id, idx, length(text) AS size, regexp_matches(text, '(?i)\\blicense')::INTEGER + regexp_matches(text, '(?i)\\bthe\\b')::INTEGER + regexp_matches(text, '(?i)\\bof\\b')::INTEGER + contains(text, ' | ')::INTEGER + (idx < 2)::INTEGER AS hits FROM p),
        w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, idx) AS rn, sum(size) OVER (PARTITION BY doc_id ORDER BY hits DESC, idx ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM h WHERE hits > 0)
        SELECT doc_id, idx::INTEGER AS idx, hits, used FROM w WHERE rn <= 12 AND used <= 6000""",
    "kind_lookup": "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'motion' WHEN '2-HIGH' THEN 'response' WHEN '3-MEDIUM' THEN 'order' ELSE 'other' END AS kind, count(*) AS n FROM orders GROUP BY 1",
    "distinct_tags": "SELECT tag, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS tag FROM events) GROUP BY 1",
    "answer_target": """WITH p AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part), k AS (SELECT DISTINCT p_type AS t, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS v FROM part),
        o AS (SELECT p_partkey, t, len(list_intersect(w, v)) / len(w) AS o FROM p, k), r AS (SELECT *, row_number() OVER x AS rn, lead(o) OVER x AS nxt FROM o WINDOW x AS (PARTITION BY p_partkey ORDER BY o DESC, t DESC))
        SELECT p_partkey, CASE WHEN o >= 0.5 AND o - coalesce(nxt, 0) >= 0.2 THEN t END AS target FROM r WHERE rn = 1""",
}
