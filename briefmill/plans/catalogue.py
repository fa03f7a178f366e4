"""Catalogue queries: filters, pages with totals, patches, tags, origins, repeated content, printed lines and fallbacks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefmill.operators import catalogue as c
from briefmill.operators import ocr_gate as gate
from briefmill.sources import files
from briefmill.sources.tables import table


def metadata_filters(spark: SparkSession, d: str) -> DataFrame:
    """Orders of some kinds that are no drafts, of a scope of two customers and of one order."""
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "filed").when(F.col("o_orderstatus") == "O", "draft").otherwise(""))
    by = {"case": "o_custkey", "type": "o_orderpriority", "status": "status", "document": "o_orderkey"}
    wide = c.metadata_filter({"type": ["1-URGENT", "2-HIGH"], "status": "not-draft", "document": None, "cases": []}, by)
    return o.where(wide | c.scope_filter([5, 7], [3], "o_custkey", "o_orderkey")).select("o_orderkey", "status")


def unfiled_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of documents that no label files, with how many there are."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti")
    return c.page_of(docs.select("doc_id", "source"), [F.lower("source"), F.col("doc_id")], 20, 40)


def source_documents(spark: SparkSession, d: str) -> DataFrame:
    """Of each source, what is shown (filed) and what is hidden, and its length: unknown, not 0, where nothing is filed."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    filed = F.col("quality") == 1
    n = F.count_if(filed)
    return x.groupBy("source", "lang").agg(n.alias("filed"), (F.count("*") - n).alias("hidden"), F.when(n > 0, F.sum(F.when(filed, F.col("n_chars")))).alias("chars"))


def committed_patches(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as patches: columns, a reference, tags that come and go, and fields that are derived."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.create_map(F.lit("note"), F.lit("old"), F.lit("flag"), F.lit("M")).alias("tags"))
    li = table(spark, d, "lineitem")
    s = lambda x: x.cast("string")
    patch = F.create_map(
        F.lit("o_orderstatus"), F.col("l_linestatus"), F.lit("o_orderpriority"), F.when(F.col("l_linenumber") % 3 == 0, "  ").otherwise("9-NEW"), F.lit("custRef"), F.concat(F.lit("@"), s(F.col("l_suppkey"))),
        F.lit("note"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")), F.lit("noteLabel"), F.lit("x"), F.lit("dis"), F.lit("y"),
    )
    patches = li.select(F.col("l_orderkey").alias("o_orderkey"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("seq"), patch.alias("patch"))
    got = c.committed(o, patches, "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"], {"custRef": "o_custkey"}, ["dis", "origin"])
    return got.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("tags")["note"].alias("note"), F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("tag_names"))


def tag_check(spark: SparkSession, d: str) -> DataFrame:
    """Parts' tags against rules: a kind of each type, one that is missing and one that no rule knows."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    size = F.when(k % 4 == 0, F.lit("big")).otherwise(F.col("p_size").cast("string"))
    since = F.when(k % 5 == 0, F.lit("2024-02-30")).otherwise(F.lit("2024-02-29"))
    base = F.create_map(F.lit("size"), size, F.lit("since"), since, F.lit("brand"), F.when(k % 3 == 0, F.concat(F.lit("@"), "p_brand")).otherwise(F.col("p_brand")))
    tags = F.when(k % 2 == 0, F.map_concat(base, F.create_map(F.lit("active"), F.lit("M")))).when(k % 7 == 0, F.map_concat(base, F.create_map(F.lit("odd"), F.lit("x")))).otherwise(base)
    rules = spark.createDataFrame([("size", "number", False), ("since", "date", False), ("brand", "ref", True), ("active", "marker", True)], "tag string, type string, required boolean")
    return c.tag_errors(p.select("p_partkey", tags.alias("tags")), "p_partkey", "tags", rules).select("p_partkey", F.array_join("errors", " ").alias("errors"))


def origins(spark: SparkSession, d: str) -> DataFrame:
    """Whom each order comes from: by marker, author, the author's role and the sides in its scope."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k.alias("key"), F.when(k % 50 == 0, "selfFiled").alias("marker"), F.when(F.col("o_orderpriority") == "1-URGENT", "signed").alias("kind"),
        F.when(k % 7 != 0, k % 13 - 1).alias("author"), (F.col("o_custkey") % 25).alias("scope"),
    )
    s, n = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("person"), "s_nationkey", "s_acctbal"), table(spark, d, "nation")
    people = s.select("person", F.when(F.col("person") % 10 == 1, "judge").when(F.col("person") % 10 == 2, "courtClerk").otherwise("").alias("role")).unionByName(spark.createDataFrame([(-1, "self")], "person long, role string"))
    side = lambda x: F.when(x, "plaintiff").otherwise("defendant")
    roles = s.select(F.col("s_nationkey").cast("long").alias("scope"), "person", side(F.col("s_acctbal") > 2000).alias("side"))
    mine = n.select(F.col("n_nationkey").cast("long").alias("scope"), F.lit(-1).cast("long").alias("person"), side(F.col("n_nationkey") % 2 == 0).alias("side"))
    return c.origin(rows, people, roles.unionByName(mine), -1)


def repeated_pages(spark: SparkSession, d: str) -> DataFrame:
    """Sources as documents, their texts as pages: pages that repeat and the share of repeated lines."""
    x = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return c.repeated_content(x).withColumn("duplicates", F.round("duplicates", 6))


def printed_page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages of placed texts, two or three to a line, of which some have printed numbers."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("k"))
    y = 700 - F.col("l_linenumber") * 20 + (F.col("l_partkey") % 3) * 0.5
    glyph = lambda x, text, seq: li.select(F.col("l_orderkey").alias("page"), (F.col("k") * 3 + seq).alias("seq"), x.cast("double").alias("x"), y.cast("double").alias("y"), text.cast("string").alias("text"))
    number = glyph(F.lit(40) + F.col("l_suppkey") % 5, F.col("l_linenumber"), 0).where("page % 3 <> 0")
    word = glyph(F.lit(90) + F.col("l_partkey"), F.concat("l_returnflag", F.lit("-"), F.col("l_partkey")), 1)
    blank = glyph(F.lit(10), F.lit("  "), 2)
    return c.printed_lines(number.unionByName(word).unionByName(blank))


def rerank_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders by a score, or as they were where the score tells nothing."""
    o = table(spark, d, "orders").withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    k = F.col("o_custkey")
    score = F.when(k % 6 == 0, 0.5).when(k % 6 == 1, -F.col("o_totalprice")).when(k % 6 == 2, F.col("o_totalprice") / 1e9).when(k % 6 == 3, 5 + F.col("o_totalprice") / 1e9).otherwise(F.col("o_totalprice") / 1e6)
    return c.reranked(o.select(k.alias("query"), F.col("o_orderkey").alias("id"), "place", score.alias("score")))


def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k, F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")))).alias("name"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("bar"), F.when(k % 3 == 0, F.col("p_type")).alias("email"))
    return c.merged_people(p, "p_partkey", ["bar", "email"])


def annotation_markers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("strikeout", "highlight", "underline", "squiggly", "comment"))), (k % 5 + 1).cast("int"))
    text = c.annotation_marker(kind, F.when(k % 2 == 0, F.col("p_brand")), F.when(k % 3 == 0, F.col("p_name")), F.repeat(F.col("p_type"), (k % 12).cast("int")))
    return table(spark, d, "part").select("p_partkey", text.alias("marker"))


def tag_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Orders by their tags, one column a predicate: a flag, a number, a date, a reference, a text, and one of another type."""
    k = F.col("o_orderkey")
    flag = F.when(k % 4 == 0, F.lit("true")).when(k % 4 == 1, F.lit("false")).when(k % 4 == 2, F.lit('"M"'))
    whole = F.concat(F.lit('{"a": {"flag": '), F.coalesce(flag, F.lit("null")), F.lit(', "price": '), F.col("o_totalprice").cast("string"), F.lit(', "day": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"}, "by": "@'), F.col("o_custkey").cast("string"), F.lit('", "kind": "'), "o_orderpriority", F.lit('"}'))
    o = table(spark, d, "orders").select(k, F.when(k % 17 != 0, whole).otherwise("{broken").alias("tags"))
    t = F.col("tags")
    asked = {
        "flagged": c.tag_is(t, "a.flag", "==", True), "unflagged": c.tag_is(t, "a.flag", "!=", True), "dear": c.tag_is(t, "a.price", ">", 250_000), "late": c.tag_is(t, "a.day", ">=", dt.date(1996, 2, 29)),
        "own": c.tag_is(t, "by", "==", "@7"), "urgent": c.tag_is(t, "kind", "==", "1-URGENT"), "odd": c.tag_is(t, "kind", "<", 5), "none": c.tag_is(t, "absent", "!=", "x"),
    }
    return o.select("o_orderkey", *[x.alias(n) for n, x in asked.items()])


def slots_missing(spark: SparkSession, d: str) -> DataFrame:
    """Orders that lack slots, with a label that falls back: a line, a label of the customer, a flag."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("part"), F.max(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).alias("flag"))
    x = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("mark", F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise("m"))
    lacks = c.missing_slots({"part": F.col("part"), "flag": F.col("flag"), "mark": F.col("mark")})
    label = F.coalesce(F.nullif(F.trim("mark"), F.lit("")), "flag", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    return x.select("o_orderkey", F.array_join(lacks, ",").alias("missing"), label.alias("label")).where("missing <> ''")


def rulings_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rulings on the order they name, or else on their customer's number; none on itself."""
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, F.floor(k / 5)).alias("resolves"), F.when(k % 4 != 0, F.col("o_custkey")).alias("motion"))
    return c.gathered(x, "resolves", "motion", "id").select("parent", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


def known_words(spark: SparkSession, d: str) -> DataFrame:
    """The share of each document's words that thirty documents or more have."""
    docs = table(spark, d, "documents")
    got = c.dictionary_ratio(docs, gate.common_words(docs, 30))
    return got.withColumn("ratio", F.round("ratio", 6))


def enriched_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as they are read: the customer's label and nation, the first line, how many suppliers, tags without references to itself."""
    o, cu, n, li = (table(spark, d, t) for t in ("orders", "customer", "nation", "lineitem"))
    lines = li.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"), F.count_distinct("l_suppkey").alias("suppliers"))
    own = F.col("o_orderkey") % 11 == 0
    x = o.join(cu, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    ref = F.when(~own, F.concat(F.lit("@"), F.floor(F.col("o_orderkey") / 2).cast("string")))
    label = F.coalesce("c_name", F.concat(F.lit("customer "), F.col("o_custkey").cast("string")))
    return x.select("o_orderkey", label.alias("label"), F.col("n_name").alias("nation"), "first_part", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), ref.alias("ref"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def ensured_nations(spark: SparkSession, d: str) -> DataFrame:
    """Nations by name, with those that customers' segments would need and that are not there yet."""
    n = table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("key"))
    wanted = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("NATION_"), (F.col("c_custkey") % 40).cast("string"))).otherwise(F.col("c_mktsegment")).alias("n_name"), F.col("c_custkey").cast("long").alias("key"))
    return files.ensured(n, wanted, "n_name")


def orphan_errors(spark: SparkSession, d: str) -> DataFrame:
    """Users' errors without any purchase: how many, and the first."""
    e = table(spark, d, "events")
    bad = e.where("event_type = 'error'").join(e.where("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_anti")
    return bad.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("sample"))


def repair_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Pages (order, line) after a round of repairs, with which of the missing ones may be tried again."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    state = li.where("p % 3 = 0").select("doc", "page", (F.col("p") % 4).cast("int").alias("attempts"), F.lit("ocr-empty").alias("code"), (F.col("p") % 4 == 3).alias("terminal"))
    tried = li.where("s % 4 <> 0").select("doc", "page", (F.col("s") % 5 != 0).alias("still"), F.when(F.col("s") % 7 == 0, "bad Dimension").when(F.col("s") % 7 == 1, "timeout").otherwise("").alias("error"), (F.col("s") % 7 == 2).alias("rejected"), (F.col("s") % 7 == 3).alias("inked"), (F.col("s") % 7 < 6).alias("empty"))
    after = c.repaired(state, tried)
    return c.to_repair(after.select("doc", "page"), after).join(after, ["doc", "page"])


QUERIES = {f.__name__: f for f in (metadata_filters, unfiled_page, source_documents, committed_patches, tag_check, origins, repeated_pages, printed_page_lines, rerank_fallback, merged_candidates, annotation_markers, tag_predicates, slots_missing, rulings_of_orders, known_words, enriched_orders, ensured_nations, orphan_errors, repair_rounds)}

_PLAIN = r"lower(trim(regexp_replace(regexp_replace({}, '[0-9]+', '#', 'g'), '\s+', ' ', 'g')))"

ORACLE = {
    "metadata_filters": """WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'filed' WHEN 'O' THEN 'draft' ELSE '' END AS status FROM orders)
        SELECT o_orderkey, status FROM o WHERE (o_orderpriority IN ('1-URGENT', '2-HIGH') AND status <> 'draft') OR o_custkey IN (5, 7) OR o_orderkey = 3""",
    "unfiled_page": "WITH x AS (SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)) SELECT *, (SELECT count(*) FROM x) AS total FROM x ORDER BY lower(source), doc_id LIMIT 20 OFFSET 40",
    "source_documents": "SELECT source, lang, count(*) FILTER (quality = 1) AS filed, count(*) - count(*) FILTER (quality = 1) AS hidden, sum(n_chars) FILTER (quality = 1)::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "committed_patches": """WITH p AS (SELECT l_orderkey, round(l_extendedprice * 100)::BIGINT AS seq, '@' || l_suppkey AS ref, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS note, CASE WHEN l_linenumber % 3 = 0 THEN '  ' ELSE '9-NEW' END AS pri, l_linestatus AS st FROM lineitem),
        l AS (SELECT l_orderkey, max((seq, ref, note, pri, st)) AS m FROM p GROUP BY 1)
        SELECT o_orderkey, coalesce(substr(m[2], 2)::BIGINT, o_custkey) AS o_custkey, coalesce(m[5], o_orderstatus) AS o_orderstatus, CASE WHEN m IS NULL THEN o_orderpriority ELSE nullif(trim(m[4]), '') END AS o_orderpriority,
               CASE WHEN m IS NULL THEN 'old' ELSE nullif(m[3], '') END AS note, CASE WHEN m[3] = '' THEN 'flag' ELSE 'flag,note' END AS tag_names FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "tag_check": """SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN p_partkey % 2 = 1 THEN 'active:missing' END, CASE WHEN p_partkey % 3 <> 0 THEN 'brand:ref' END, CASE WHEN p_partkey % 5 = 0 THEN 'since:date' END, CASE WHEN p_partkey % 4 = 0 THEN 'size:number' END,
        CASE WHEN p_partkey % 2 = 1 AND p_partkey % 7 = 0 THEN 'odd:unknown' END], lambda x: x IS NOT NULL)), ' ') AS errors FROM part""",
    "origins": """WITH s AS (SELECT s_suppkey AS p, s_nationkey AS scope, CASE WHEN s_acctbal > 2000 THEN 1 ELSE 0 END AS side FROM supplier UNION ALL SELECT -1, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END FROM nation),
        r AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 13 - 1 END AS a, o_custkey % 25 AS sc FROM orders)
        SELECT o_orderkey AS key, CASE WHEN o_orderkey % 50 = 0 THEN 'selfFiled' WHEN a IS NULL THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'courtIssued' END WHEN a <> -1 AND a NOT IN (SELECT s_suppkey FROM supplier) THEN NULL WHEN a = -1 THEN 'selfFiled'
               WHEN a % 10 IN (1, 2) THEN 'courtIssued' WHEN m.side <> t.side THEN 'opposingFiled' WHEN m.side = t.side THEN 'selfFiled' ELSE 'thirdParty' END AS origin
        FROM r LEFT JOIN s m ON m.p = -1 AND m.scope = sc LEFT JOIN s t ON t.p = a AND t.scope = sc""",
    "repeated_pages": f"""WITH d AS (SELECT concat_ws('/', lang, source) AS doc, doc_id AS page, text FROM documents),
        w AS (SELECT doc, {_PLAIN.format("replace(text, chr(10), ' ')")} AS t FROM d), z AS (SELECT doc, count(*) AS pages FROM d GROUP BY 1),
        e AS (SELECT doc, count(*) AS same FROM (SELECT doc, t FROM w WHERE t <> '' GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1),
        l AS (SELECT doc, page, {_PLAIN.format("line")} AS line FROM (SELECT doc, page, unnest(string_split(text, chr(10))) AS line FROM d)),
        n AS (SELECT doc, line, count(*) AS n, count(DISTINCT page) AS on_ FROM l WHERE length(line) >= 4 GROUP BY ALL),
        u AS (SELECT doc, sum(n - 1) / sum(n) AS dup FROM n JOIN z USING (doc) WHERE on_ <= 0.8 * pages GROUP BY 1)
        SELECT doc, CASE WHEN pages > 1 THEN coalesce(same, 0) ELSE 0 END AS same_pages, round(CASE WHEN pages > 1 THEN coalesce(dup, 0) ELSE 0 END, 6)::DOUBLE AS duplicates, pages > 1 AND (coalesce(same, 0) > 0 OR coalesce(dup, 0) > 0.3) AS fired FROM z LEFT JOIN e USING (doc) LEFT JOIN u USING (doc)""",
    "printed_page_lines": """WITH i AS (SELECT l_orderkey AS page, (l_partkey * 1000 + l_suppkey) * 3 AS s, 700 - l_linenumber * 20 + (l_partkey % 3) * 0.5::DOUBLE AS y, * FROM lineitem),
        g AS (SELECT page, s AS seq, 40 + l_suppkey % 5 AS x, y, l_linenumber::VARCHAR AS text FROM i WHERE page % 3 <> 0 UNION ALL SELECT page, s + 1, 90 + l_partkey, y, l_returnflag || '-' || l_partkey FROM i),
        n AS (SELECT *, (coalesce(lag(y) OVER (PARTITION BY page ORDER BY y DESC, x, seq) - y, 3) > 2)::INTEGER AS new FROM g),
        m AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y DESC, x, seq ROWS UNBOUNDED PRECEDING) AS line FROM n),
        l AS (SELECT page, line, list(text ORDER BY x, seq, text) AS t, min(x) AS x0 FROM m GROUP BY ALL),
        k AS (SELECT *, CASE WHEN regexp_full_match(t[1], '[1-9]|1[0-9]|2[0-5]') THEN t[1]::INTEGER END AS num FROM l),
        a AS (SELECT page, x0, row_number() OVER (PARTITION BY page ORDER BY x0) AS rn, count(*) OVER (PARTITION BY page) AS n FROM k WHERE num IS NOT NULL AND len(t) > 1),
        c AS (SELECT a.page, m.x0 AS median FROM a JOIN (SELECT page, x0 FROM a WHERE rn = n // 2 + 1) m USING (page) WHERE abs(a.x0 - m.x0) < 30 GROUP BY ALL HAVING count(*) >= 3),
        f AS (SELECT k.*, CASE WHEN x0 < median + 30 THEN num END AS number FROM k LEFT JOIN c USING (page))
        SELECT page, line::INTEGER AS line, number, trim(array_to_string(CASE WHEN number IS NULL THEN t ELSE t[2:] END, ' ')) AS text FROM f""",
    "rerank_fallback": """WITH o AS (SELECT o_custkey AS query, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place,
        CASE o_custkey % 6 WHEN 0 THEN 0.5 WHEN 1 THEN -o_totalprice WHEN 2 THEN o_totalprice / 1e9 WHEN 3 THEN 5 + o_totalprice / 1e9 ELSE o_totalprice / 1e6 END::DOUBLE AS score FROM orders),
        f AS (SELECT query, CASE WHEN min(round(score, 6)) = max(round(score, 6)) THEN 'identical' WHEN max(score) < 0 THEN 'negative' WHEN max(score) < 0.001 THEN 'low' WHEN stddev_pop(score) / abs(avg(score)) < 0.001 AND count(*) >= 3 THEN 'even' END AS fault FROM o GROUP BY 1)
        SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN fault IS NULL THEN -score END, place, id)::INTEGER AS rank, fault FROM o JOIN f USING (query)""",
    "merged_candidates": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || replace(p_name, ' ', '  ') END AS name, lower(p_name) AS key, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS bar, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS email FROM part)
        SELECT key, arg_min(name, k) AS name, count(*) AS n, arg_min(bar, k) FILTER (bar <> '') AS bar, arg_min(email, k) FILTER (email <> '') AS email FROM p GROUP BY key""",
    "tag_predicates": """SELECT o_orderkey, ok AND o_orderkey % 4 IN (0, 2) AS flagged, NOT (ok AND o_orderkey % 4 IN (0, 2)) AS unflagged, ok AND o_totalprice > 250000 AS dear, ok AND o_orderdate::DATE >= DATE '1996-02-29' AS late,
        ok AND o_custkey = 7 AS own, ok AND o_orderpriority = '1-URGENT' AS urgent, false AS odd, true AS none FROM (SELECT *, o_orderkey % 17 <> 0 AS ok FROM orders)""",
    "slots_missing": """WITH l AS (SELECT l_orderkey, min(l_partkey) AS part, max(l_returnflag) FILTER (l_returnflag <> 'N') AS flag FROM lineitem GROUP BY 1),
        x AS (SELECT o_orderkey, concat_ws(',', CASE WHEN part IS NULL THEN 'part' END, CASE WHEN flag IS NULL THEN 'flag' END, CASE WHEN o_orderkey % 3 = 0 THEN 'mark' END) AS missing, CASE WHEN o_orderkey % 3 <> 0 THEN 'm' ELSE coalesce(flag, 'order ' || o_orderkey) END AS label FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
        SELECT * FROM x WHERE missing <> ''""",
    "rulings_of_orders": """WITH x AS (SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 5 END, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END) AS parent FROM orders)
        SELECT parent, array_to_string(list(id ORDER BY id), ',') AS children FROM x WHERE parent <> id GROUP BY 1""",
    "known_words": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w, regexp_split_to_array(text, '\\s+') AS tok FROM documents),
        d AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(list_transform(list_filter(tok, lambda x: regexp_full_match(x, '[A-Za-z]+')), lambda x: lower(x)))) AS word FROM t) GROUP BY 1 HAVING count(*) >= 30),
        e AS (SELECT doc_id, unnest(w) AS word FROM t), r AS (SELECT doc_id, count(*) AS n, count(d.word) / count(*) AS ratio FROM e LEFT JOIN d USING (word) GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n, round(ratio, 6) AS ratio FROM t LEFT JOIN r USING (doc_id)""",
    "enriched_orders": """WITH l AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1)
        SELECT o_orderkey, coalesce(c_name, 'customer ' || o_custkey) AS label, n_name AS nation, first_part, coalesce(suppliers, 0) AS suppliers, CASE WHEN o_orderkey % 11 <> 0 THEN '@' || (o_orderkey // 2) END AS ref, strftime(o_orderdate, '%Y-%m-%d') AS day
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN l ON l_orderkey = o_orderkey""",
    "ensured_nations": """WITH w AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'NATION_' || (c_custkey % 40) ELSE c_mktsegment END AS n_name, c_custkey AS key FROM customer)
        SELECT n_name, n_nationkey::BIGINT AS key FROM nation UNION ALL SELECT n_name, min(key) FROM w WHERE n_name NOT IN (SELECT n_name FROM nation) GROUP BY 1""",
    "orphan_errors": "SELECT user_id, count(*) AS n, min(event_id) AS sample FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase') GROUP BY 1",
    "repair_rounds": """WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS page, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
        x AS (SELECT doc, page, CASE WHEN p % 3 = 0 THEN p % 4 END AS had, s % 4 <> 0 AS tried, s % 5 <> 0 AS still, s % 7 AS k FROM l WHERE p % 3 = 0 OR s % 4 <> 0),
        y AS (SELECT *, CASE WHEN NOT tried THEN 'ocr-empty' ELSE ['dimension-mismatch', 'reindex-request-failed', 'ocr-quality-rejected', 'image-only', 'ocr-empty', 'ocr-empty', 'unknown'][(k + 1)::INTEGER] END AS code,
              (coalesce(had, 0) + CASE WHEN tried AND k NOT IN (1, 2) THEN 1 ELSE 0 END)::INTEGER AS attempts FROM x WHERE NOT tried OR still),
        z AS (SELECT *, CASE WHEN NOT tried THEN had = 3 ELSE k IN (0, 3) OR (k NOT IN (1, 2) AND attempts >= 3) END AS terminal FROM y)
        SELECT doc, page, NOT terminal AS eligible, attempts, code, terminal FROM z""",
    "annotation_markers": """WITH x AS (SELECT p_partkey, p_partkey % 5 AS kind, CASE WHEN p_partkey % 2 = 0 THEN ' by ' || p_brand ELSE '' END AS who, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS said, repeat(p_type, p_partkey % 12) AS t FROM part)
        SELECT p_partkey, CASE WHEN kind = 4 THEN '[COMMENT' || who || '] ' || coalesce(said, '') ELSE '[' || ['STRUCK THROUGH', 'HIGHLIGHTED', 'UNDERLINED', 'SQUIGGLY UNDERLINED'][kind + 1] || who || CASE WHEN said IS NULL THEN '' ELSE ': "' || said || '"' END || '] '
        || CASE WHEN t = '' THEN '' ELSE '"' || substr(t, 1, 100) || CASE WHEN length(t) > 100 THEN '...' ELSE '' END || '"' END END AS marker FROM x""",
}
