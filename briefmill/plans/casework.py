"""Casework queries: changes of stored rows, sections and volumes, worklists, scope graphs and counts from the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefmill.functions import text
from briefmill.operators import relations as j
from briefmill.operators.retrieval import passages
from briefmill.plans.retrieval import _PASSAGES
from briefmill.sources import stored
from briefmill.sources.tables import table


def document_scan(spark: SparkSession, d: str) -> DataFrame:
    p = passages(table(spark, d, "documents").where("doc_id = 7"))
    return p.orderBy("idx").limit(60).select("doc_id", "idx", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def append_evolving(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers in one table of people, each with the columns of either."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    return stored.appended(c, s).select("id", "name", "c_mktsegment", "s_acctbal")


def delete_pages(spark: SparkSession, d: str) -> DataFrame:
    """The lines left of each document once the returned ones are deleted."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return stored.without(li, gone, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def stamp_status(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the status that their shipped lines imply, where they imply one, and the newest ship date."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.count_if(F.col("l_linestatus") == "O") == 0, "F").alias("o_orderstatus"), F.max("l_shipdate").alias("shipped"))
    return stored.stamped(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), li, "o_orderkey")


def page_section(spark: SparkSession, d: str) -> DataFrame:
    """For each order's day, the first section of its customer's list (by key) that holds it; a fifth of the sections is open."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("scope"), day.alias("day"))
    sections = o.select("scope", F.col("day").alias("start"), F.when(F.col("o_orderkey") % 5 != 0, F.col("day") + F.col("o_orderkey") % 400).alias("stop"), (F.col("o_orderkey") % 1000).alias("place"), F.col("o_orderkey").alias("label"))
    found = j.first_range(o.select(F.col("o_orderkey").alias("key"), "scope", F.col("day").alias("at")), sections)
    return found.select(F.col("key").alias("o_orderkey"), F.col("label").alias("section"))


def line_in_chunk(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of a turn, each whole, stand in the next turn of the conversation or in the same, and the first and
    last of them: equal conversation and place, then the text decides."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    lines = c.select("conv_id", "turn", F.posexplode(F.split("text", "\\n")).alias("line_no", "line")).where("trim(line) <> ''")
    near = lines.withColumn("at", F.explode(F.array("turn", F.col("turn") + 1)))
    held = near.join(c.select("conv_id", F.col("turn").alias("at"), F.col("text").alias("chunk")), ["conv_id", "at"]).where(F.contains("chunk", F.col("line")))
    return held.groupBy("conv_id", "turn", "at").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def chunk_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Who speaks in each span of an order's lines: turns of parts by flag over spans of line numbers, a fifth of both open."""
    li = table(spark, d, "lineitem")
    stop = lambda key, n: F.when(F.col(key) % 5 != 0, F.col("l_linenumber") + F.col(key) % n)
    spans = li.select(F.col("l_orderkey").alias("scope"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_linenumber").alias("start"), stop("l_partkey", 3).alias("stop"))
    turns = li.select(F.col("l_orderkey").alias("scope"), F.concat("l_returnflag", "l_linestatus").alias("label"), F.col("l_linenumber").alias("start"), stop("l_suppkey", 2).alias("stop"))
    return j.overlapping_labels(spans, turns).select("id", F.array_join("labels", ",").alias("speakers"))


def transcript_functions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages of a transcript: first and last printed line, the speaker of a line, and a date in one of four forms."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    pages = li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, " "), F.lit("  Q. "), "l_returnflag"))), "\n").alias("page"))
    k = F.col("o_orderkey")
    line = F.element_at(F.array(F.lit("   THE COURT: sustained"), F.lit("Q. And then?"), F.lit("A   No."), F.lit("MR. O'HARA: objection"), F.lit("plain text: here")), (k % 5 + 1).cast("int"))
    day = F.to_date("o_orderdate")
    told = F.element_at(F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "M/d/yyyy"), F.date_format(day, "MMMM d, yyyy"), F.lit("2024-02-30"), F.lit("no date")), (k % 5 + 1).cast("int"))
    got = o.join(pages, F.col("l_orderkey") == k, "left").select(k, text.printed_line_numbers(F.col("page")).alias("n"), text.speaker(line).alias("speaker"), text.any_date(told).alias("day"))
    return got.select("o_orderkey", F.col("n.first").alias("first_line"), F.col("n.last").alias("last_line"), "speaker", "day")


def references(spark: SparkSession, d: str) -> DataFrame:
    """What short texts mean: words and brands of parts, nations, and the numbers of suppliers, among customers, suppliers and parts."""
    c, s, p = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "part")

    def field(df: DataFrame, kind: str, key: str, name: str, priority: int, *sure: float) -> DataFrame:
        told = [F.lit(x).alias(n) for n, x in zip(("exact", "prefix", "substring"), sure)]
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.lit(name).alias("field"), F.lit(priority).alias("priority"), F.col(name).alias("value"), *told)

    fields = [
        field(c, "customer", "c_custkey", "c_name", 1, 0.95, 0.8, 0.7),
        field(s, "supplier", "s_suppkey", "s_name", 1, 0.95, 0.7, 0.6),
        field(p, "part", "p_partkey", "p_brand", 1, 0.5, 0.45, 0.4),
        field(p, "part", "p_partkey", "p_name", 2, 0.9, 0.7, 0.6),
    ]
    words = p.select(F.explode(F.split("p_name", " ")).alias("text"))
    numbers = s.select(F.regexp_extract("s_name", "([1-9][0-9]*)$", 1).alias("text"))
    asked = words.unionByName(numbers).unionByName(p.select(F.upper("p_name").alias("text"))).unionByName(table(spark, d, "nation").select(F.col("n_name").alias("text"))).unionByName(p.select(F.col("p_brand").alias("text")))
    return j.resolve(asked, fields[0].unionByName(fields[1]).unionByName(fields[2]).unionByName(fields[3]))


def volume_counts(spark: SparkSession, d: str) -> DataFrame:
    """Volumes of each customer and kind, named by an order or by one of its lines."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    own = o.select("o_custkey", F.regexp_extract("o_orderpriority", r"^(\d+)-", 1).alias("kind"), (F.col("o_orderkey") % 7).alias("volume"))
    lines = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.regexp_extract("o_orderpriority", r"^(\d+)-", 1).alias("kind"), F.col("l_linenumber").cast("long").alias("volume"))
    return own.unionByName(lines).groupBy("o_custkey", "kind").agg(F.count_distinct("volume").alias("volumes"))


def worklist_totals(spark: SparkSession, d: str) -> DataFrame:
    """Open work by kind, by slot and in all."""
    x = table(spark, d, "lineitem").where("l_linestatus = 'O'")
    return x.groupingSets([["l_returnflag"], ["l_linenumber"], []], "l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))


def chunk_renumbering(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", F.md5(F.col("text").cast("binary")))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", (F.row_number().over(w) - 1).cast("long").alias("chunk_index"))


def title_hits_first(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where(F.contains("p_name", F.lit("ring")) | F.contains(F.lower("p_type"), F.lit("small")))
    return p.orderBy(F.when(F.contains("p_name", F.lit("ring")), 0).otherwise(1), "p_name", "p_partkey").limit(30).select("p_partkey", "p_name")


def motions_by_person(spark: SparkSession, d: str) -> DataFrame:
    """Up to 50 orders in which person 5 has any of the roles, newest first."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_suppkey = 5").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(5).alias("supplier")).distinct()
    rows = o.join(li, "o_orderkey", "left").where(stored.any_of(["o_custkey", "supplier"], 5))
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey")


def scope_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of customers to their orders and of orders to the order after them; none to itself or to what is not shown."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    shown = o.select(F.col("o_orderkey").alias("dst"))
    every = table(spark, d, "orders")
    ref = every.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("dst"), F.lit("ref").alias("kind"))
    ref = ref.where("src <> dst").join(shown, "dst", "left_semi").join(shown.withColumnRenamed("dst", "src"), "src", "left_semi")
    contains = o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("contains").alias("kind"))
    return contains.unionByName(ref.select("src", "dst", "kind"))


def slot_worklist(spark: SparkSession, d: str) -> DataFrame:
    """Orders without a line of their defining kind, the order before them that has one, and why they are listed."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    has = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("filled"), F.count("*").alias("lines"))
    x = o.join(has, "o_orderkey", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("suggestion", F.last(F.when(F.col("filled") > 0, F.col("o_orderkey")), ignorenulls=True).over(w))
    reason = F.when(F.col("lines").isNull(), "no documents").when(F.col("suggestion").isNull(), "no candidate").otherwise("slot empty")
    return x.where("filled = 0").select("o_orderkey", "suggestion", reason.alias("reason"))


def primary_kind(spark: SparkSession, d: str) -> DataFrame:
    """A document's kind by precedence: table, licensed, shouting, else prose."""
    t = F.col("text")
    kind = F.when(F.contains(t, F.lit(" | ")), "table").when(F.contains(t, F.lit("icensed under")), "licensed").when(F.contains(t, F.lit("!!")), "shout").otherwise("prose")
    return table(spark, d, "documents").groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"))


def rerank_pool(spark: SparkSession, d: str) -> DataFrame:
    limit = 9
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(min(150, max(limit * 8, 40))).select("event_id", "value")


def both_stores(spark: SparkSession, d: str) -> DataFrame:
    """Documents and turns of conversations as one store, each with its origin."""
    a = table(spark, d, "documents").select(F.lit("case").alias("origin"), F.col("doc_id").cast("string").alias("id"), F.length("text").alias("n"))
    b = table(spark, d, "conversations").select(F.lit("chat").alias("origin"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.length("text").alias("n"))
    return a.unionByName(b)


def citation_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each 'under the ...' phrase is cited, and in how many documents."""
    each = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"under the ([A-Za-z]+)"), F.lit(1))).alias("cited"))
    return each.groupBy("cited").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    """E-mail domains that texts name, by document."""
    each = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._]+@([A-Za-z0-9.]+[A-Za-z0-9])"), F.lit(1))).alias("domain"))
    return each.groupBy("doc_id", F.lower("domain").alias("domain")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (document_scan, append_evolving, delete_pages, stamp_status, page_section, line_in_chunk, chunk_speakers, transcript_functions, references, volume_counts, worklist_totals, chunk_renumbering, title_hits_first, motions_by_person, scope_graph, slot_worklist, primary_kind, rerank_pool, both_stores, citation_counts, entity_mentions)}

ORACLE = {
    "document_scan": f"WITH {_PASSAGES} SELECT doc_id, idx::INTEGER AS idx, md5(text) AS text_md5 FROM p WHERE doc_id = 7 ORDER BY idx LIMIT 60",
    "append_evolving": "SELECT c_custkey AS id, c_name AS name, c_mktsegment, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier",
    "delete_pages": "SELECT l_orderkey, count(*) AS n FROM lineitem x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber AND y.l_returnflag = 'R') GROUP BY 1",
    "stamp_status": "WITH u AS (SELECT l_orderkey, CASE WHEN count(*) FILTER (l_linestatus = 'O') = 0 THEN 'F' END AS s, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(s, o_orderstatus) AS o_orderstatus, shipped FROM orders LEFT JOIN u ON l_orderkey = o_orderkey",
    "page_section": """WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS day FROM orders)
        SELECT a.o_orderkey, arg_min(b.o_orderkey, (b.o_orderkey % 1000, b.o_orderkey)) AS section FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.day >= b.day AND (b.o_orderkey % 5 = 0 OR a.day <= b.day + b.o_orderkey % 400) GROUP BY 1""",
    "line_in_chunk": """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM conversations)
        SELECT l.conv_id, l.turn, c.turn AS at, count(*) AS n, min(n)::INTEGER AS first_line, max(n)::INTEGER AS last_line FROM l JOIN conversations c ON c.conv_id = l.conv_id AND c.turn IN (l.turn, l.turn + 1) AND contains(c.text, line) WHERE trim(line) <> '' GROUP BY 1, 2, 3""",
    "chunk_speakers": """WITH l AS (SELECT *, CASE WHEN l_partkey % 5 <> 0 THEN l_linenumber + l_partkey % 3 ELSE 999 END AS a, CASE WHEN l_suppkey % 5 <> 0 THEN l_linenumber + l_suppkey % 2 ELSE 999 END AS b FROM lineitem)
        SELECT concat_ws('-', x.l_orderkey, x.l_linenumber, x.l_partkey, x.l_suppkey) AS id, array_to_string(list_sort(list(DISTINCT y.l_returnflag || y.l_linestatus)), ',') AS speakers
        FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber <= y.b AND y.l_linenumber <= x.a GROUP BY 1""",
    "transcript_functions": """WITH p AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY 1)
        SELECT o_orderkey, CASE WHEN n >= 2 THEN a END::INTEGER AS first_line, CASE WHEN n >= 2 THEN b END::INTEGER AS last_line, ['THE COURT', 'Q', 'A', 'MR. O''HARA', NULL][(o_orderkey % 5 + 1)::INTEGER] AS speaker,
               CASE WHEN o_orderkey % 5 < 3 THEN o_orderdate::DATE END AS day FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""",
    "references": """WITH f AS (SELECT 'customer' AS kind, c_custkey AS id, 'c_name' AS field, 1 AS p, c_name AS v, 0.95::DOUBLE AS e, 0.8::DOUBLE AS x, 0.7::DOUBLE AS s FROM customer
        UNION ALL SELECT 'supplier', s_suppkey, 's_name', 1, s_name, 0.95, 0.7, 0.6 FROM supplier UNION ALL SELECT 'part', p_partkey, 'p_brand', 1, p_brand, 0.5, 0.45, 0.4 FROM part UNION ALL SELECT 'part', p_partkey, 'p_name', 2, p_name, 0.9, 0.7, 0.6 FROM part),
        a AS (SELECT unnest(string_split(p_name, ' ')) AS text FROM part UNION SELECT regexp_extract(s_name, '([1-9][0-9]*)$', 1) FROM supplier UNION SELECT upper(p_name) FROM part UNION SELECT n_name FROM nation UNION SELECT p_brand FROM part),
        m AS (SELECT text, kind, id, field, p, CASE WHEN lower(v) = lower(text) THEN e WHEN starts_with(lower(v), lower(text)) THEN x ELSE s END AS c FROM a JOIN f ON contains(lower(v), lower(text)) WHERE trim(text) <> ''),
        b AS (SELECT text, kind, id, max(c) AS confidence, arg_min(field, (-c, p)) AS matched_on FROM m GROUP BY ALL),
        r AS (SELECT *, row_number() OVER w AS rank, first_value(confidence) OVER w AS top, nth_value(confidence, 2) OVER (PARTITION BY text ORDER BY confidence DESC, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS next FROM b WINDOW w AS (PARTITION BY text ORDER BY confidence DESC, kind, id))
        SELECT text, rank::INTEGER AS rank, kind, id, matched_on, confidence, coalesce(round(top - next, 9) <= 0.15, false) AS ambiguous FROM r WHERE rank <= 5""",
    "volume_counts": "WITH v AS (SELECT o_custkey, regexp_extract(o_orderpriority, '^(\\d+)-', 1) AS kind, o_orderkey % 7 AS volume FROM orders UNION ALL SELECT o_custkey, regexp_extract(o_orderpriority, '^(\\d+)-', 1), l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT o_custkey, kind, count(DISTINCT volume) AS volumes FROM v GROUP BY ALL",
    "worklist_totals": "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())",
    "chunk_renumbering": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) - 1 AS chunk_index FROM conversations",
    "title_hits_first": "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(lower(p_type), 'small') ORDER BY NOT contains(p_name, 'ring'), p_name, p_partkey LIMIT 30",
    "motions_by_person": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 5 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 5) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "scope_graph": "WITH s AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), r AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) SELECT o_custkey AS src, o_orderkey AS dst, 'contains' AS kind FROM s UNION ALL SELECT src, dst, 'ref' FROM r WHERE src <> dst AND src IN (SELECT o_orderkey FROM s) AND dst IN (SELECT o_orderkey FROM s)",
    "slot_worklist": "WITH h AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS filled FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey, l_orderkey, coalesce(filled, 0) AS filled, last_value(CASE WHEN filled > 0 THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS suggestion FROM orders LEFT JOIN h ON l_orderkey = o_orderkey) SELECT o_orderkey, suggestion, CASE WHEN l_orderkey IS NULL THEN 'no documents' WHEN suggestion IS NULL THEN 'no candidate' ELSE 'slot empty' END AS reason FROM x WHERE filled = 0",
    "primary_kind": "SELECT source, CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'icensed under') THEN 'licensed' WHEN contains(text, '!!') THEN 'shout' ELSE 'prose' END AS kind, count(*) AS n FROM documents GROUP BY ALL",
    "rerank_pool": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 72",
    "both_stores": "SELECT 'case' AS origin, doc_id::VARCHAR AS id, length(text)::INTEGER AS n FROM documents UNION ALL SELECT 'chat', conv_id || ':' || turn, length(text)::INTEGER FROM conversations",
    "citation_counts": "WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, 'under the ([A-Za-z]+)', 1)) AS cited FROM documents) SELECT cited, count(*) AS n, count(DISTINCT doc_id) AS docs FROM e GROUP BY 1",
    "entity_mentions": "WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@([A-Za-z0-9.]+[A-Za-z0-9])', 1)) AS domain FROM documents) SELECT doc_id, lower(domain) AS domain, count(*) AS n FROM e GROUP BY ALL",
}
