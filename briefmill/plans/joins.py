"""Scans, filters, joins and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefmill.operators import links
from briefmill.operators import relations as j
from briefmill.operators import scan as x
from briefmill.operators.retrieval import passages, phrase
from briefmill.plans.retrieval import _PASSAGES
from briefmill.sources.tables import table


def bool_filter_scan(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    hits = docs.where((F.col("lang") == "en") & phrase(F.col("text"), ["the"]) & ~phrase(F.col("text"), ["license"]))
    return hits.join(labels, "doc_id", "left").select("doc_id", "lang", "n_chars", "quality").orderBy(F.desc("n_chars"), "doc_id").limit(20)


def in_collapse_or(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where(F.col("o_orderstatus").isin("F", "P") | F.col("o_orderpriority").isin("1-URGENT")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def scan_paged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(40).limit(20)


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return x.page_after(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"], (100, 2), 50)


def pattern_scan(spark: SparkSession, d: str) -> DataFrame:
    p = passages(table(spark, d, "documents"))
    return x.scan(p, r"licensed? under the [A-Z]\w+").select("id", "match", "at")


def line_tolerant_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return x.crossing_lines(docs, "the of").select("doc_id", "crosses")


def crossing_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orders as numbered pages: which hold a pattern in one line, and which only across a printed line's end."""
    li = table(spark, d, "lineitem")
    line = F.struct("l_linenumber", F.concat(F.col("l_linenumber").cast("string"), F.lit("  "), "l_returnflag", F.lit(" "), "l_linestatus").alias("line"))
    pages = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda y: y["line"]), "\n").alias("text"))
    return x.crossing_lines(pages, "O N|R F").select("l_orderkey", "crosses")


def proven_absence(spark: SparkSession, d: str) -> DataFrame:
    return x.absence(table(spark, d, "documents"), r"software", ["source"])


def semi_join_relationship(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return j.related(c, "c_nationkey", n, "n_nationkey", F.col("n_regionkey") == 2).select("c_custkey", "c_nationkey")


def anti_join_relationship(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return j.related(c, "c_custkey", o, "c_custkey", F.col("o_totalprice") > 100000, negate=True).select("c_custkey")


def three_hop_predicate(spark: SparkSession, d: str) -> DataFrame:
    li, s, n = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "nation")
    asia = s.join(n.where("n_regionkey = 1"), s["s_nationkey"] == n["n_nationkey"], "left_semi")
    orders = li.join(asia, li["l_suppkey"] == asia["s_suppkey"], "left_semi").select("l_orderkey").distinct()
    o = table(spark, d, "orders")
    return o.join(orders, o["o_orderkey"] == orders["l_orderkey"], "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def json_marker_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.parse_json("props"))
    k = F.expr("try_variant_get(v, '$.k', 'bigint')")
    return e.where(k.isNotNull() & (k >= 50)).select("event_id", k.alias("k"))


def json_missing_marker(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where(F.get_json_object("props", "$.absent").isNull() & F.get_json_object("props", "$.k").isNotNull()).groupBy("event_type").agg(F.count("*").alias("n"))


def null_keeping_inequality(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    q = docs.join(labels, "doc_id", "left")
    return q.where(F.coalesce(F.col("toxic"), F.lit(0)) != 1).groupBy("lang").agg(F.count("*").alias("n"))


def polymorphic_roles(spark: SparkSession, d: str) -> DataFrame:
    li, s, c, o = (table(spark, d, t) for t in ("lineitem", "supplier", "customer", "orders"))
    a = li.select(F.col("l_suppkey").alias("person"), F.lit("supplier").alias("role"), F.col("l_orderkey").alias("scope"))
    b = o.select(F.col("o_custkey").alias("person"), F.lit("customer").alias("role"), F.col("o_orderkey").alias("scope"))
    return a.unionByName(b).distinct().groupBy("person").agg(F.count("*").alias("roles"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("kinds"))


def hydrate(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = li.where("l_quantity >= 50").join(o, li["l_orderkey"] == o["o_orderkey"], "left").join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return rows.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name", "n_name")


def _ranges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1990-01-01"))).cast("long").alias("day"))
    end = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("long")).otherwise(F.col("day") + F.col("o_orderkey") % 400)
    return o, o.select("o_custkey", F.col("o_orderkey").alias("range_id"), F.col("day").alias("start"), end.alias("end"))


def range_join_narrowest(spark: SparkSession, d: str) -> DataFrame:
    points, ranges = _ranges(spark, d)
    return j.narrowest_range(points, ranges, "o_custkey", "day", "o_orderkey", 100).select("o_orderkey", "range_id")


def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    _, ranges = _ranges(spark, d)
    r = ranges.where(F.col("end").isNotNull())
    left = r.select("o_custkey", F.col("range_id").alias("l_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = r.select("o_custkey", F.col("range_id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return j.overlapping(left, right, ["o_custkey"], 100).where("l_id < r_id").select("l_id", "r_id")


def folder_survey(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("hash"))
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    files = docs.where("doc_id % 10 <> 3").select(F.when(F.col("doc_id") % 7 == 0, F.concat(path, F.lit(".moved"))).otherwise(path).alias("path"), "hash")
    known = docs.where("doc_id % 4 <> 1").select(path.alias("doc_path"), F.col("hash").alias("doc_hash"), F.col("doc_id").alias("id"))
    ignored = docs.where("doc_id % 11 = 5").select(path.alias("path"), "hash")
    return j.survey(files, known, ignored)


def prefix_containment(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"))
    parts = F.split("path", "/")
    roots = p.select(F.concat_ws("/", F.slice(parts, 1, 2)).alias("root")).distinct()
    each = p.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    return each.join(roots, "root").groupBy("root").agg(F.count("*").alias("pages"))


def exists_child(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li.where("l_discount > 0.09"), o["o_orderkey"] == li["l_orderkey"], "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def sole_document(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem")
    one = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.count("*") == 1, F.min("l_linenumber")).alias("sole"))
    return o.join(one, "o_orderkey", "left").select("o_orderkey", "sole")


def courts_of_people(spark: SparkSession, d: str) -> DataFrame:
    n, s, r = (table(spark, d, t) for t in ("nation", "supplier", "region"))
    return r.join(n, r["r_regionkey"] == n["n_regionkey"]).join(s, n["n_nationkey"] == s["s_nationkey"]).groupBy("r_name").agg(F.count_distinct("s_suppkey").alias("people"), F.count_distinct("n_nationkey").alias("courts"))


def oldest_per_parent(spark: SparkSession, d: str) -> DataFrame:
    return j.first_per(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


def grouped_children(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("orders"))
    return c.join(o, "c_custkey", "left")


def coalesce_merge(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", (F.col("n_chars") > 500).cast("int")).alias("quality"))


def similar_people(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return j.similar_names(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat("s_nationkey", F.lit("@"), F.floor("s_acctbal").cast("string")).alias("email"))).withColumn("score", F.round("score", 6))


def duplicate_people(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by bar number first, which some share and some lack, then by e-mail and name."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    people = s.select(k.alias("id"), F.concat("s_name", F.lit(" "), (k % 9).cast("string")).alias("name"), F.when(k % 3 != 0, F.concat("s_nationkey", F.lit("@"), (k % 4).cast("string"))).otherwise("").alias("email"), F.when(k % 2 == 0, F.concat(F.lit("B"), (k % 30).cast("string"))).alias("bar"))
    return j.similar_names(people).withColumn("score", F.round("score", 6))


def _order_records(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("scope"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("kind"), "o_orderpriority", "o_orderstatus")


def _slot_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("P", "answers", "O"), ("P", "answers", "F"), ("O", "amends", "O"), ("F", "resolves", "O"), ("F", "resolves", "P")], "kind string, slot string, target_kind string")


def link_suggestion(spark: SparkSession, d: str) -> DataFrame:
    """Each order's best earlier order of its customer, by gap and equal attributes; unsure if the margin is below .75."""
    got = links.suggest(_order_records(spark, d), ["o_orderpriority", "o_orderstatus"])
    return got.select(F.col("key").alias("o_orderkey"), "target", "score")


def slot_suggestion(spark: SparkSession, d: str) -> DataFrame:
    """The same by slot: which kinds of order a slot may point at is a table of rules; a tenth of the orders is undated."""
    rows = _order_records(spark, d).withColumn("day", F.when(F.col("key") % 10 != 0, F.col("day")))
    return links.suggest(rows, ["o_orderpriority"], _slot_rules(spark)).select(F.col("key").alias("o_orderkey"), "slot", "target", "score")


def slot_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rules = _slot_rules(spark)
    slots = rules.select("kind", "slot").unionByName(spark.createDataFrame([("F", "replaces")], "kind string, slot string")).distinct()
    return links.verdicts(_order_records(spark, d), rules, slots).select(F.col("key").alias("o_orderkey"), "slot", "allowed", "refused")


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    b = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    tag = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("op"), "n")
    return tag(a.union(b), "union all").unionByName(tag(a.union(b).distinct(), "union")).unionByName(tag(a.intersect(b), "intersect")).unionByName(tag(a.subtract(b), "except"))


def path_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_brand").startswith("Brand#1")).select("p_brand").distinct().orderBy("p_brand").limit(25)


def nocase_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy(F.lower("p_name"), "p_partkey").limit(30)


QUERIES = {f.__name__: f for f in (bool_filter_scan, in_collapse_or, scan_paged, keyset_page, pattern_scan, line_tolerant_scan, crossing_scan, proven_absence, semi_join_relationship, anti_join_relationship, three_hop_predicate, json_marker_filter, json_missing_marker, null_keeping_inequality, polymorphic_roles, hydrate, range_join_narrowest, interval_overlap, folder_survey, prefix_containment, exists_child, sole_document, courts_of_people, oldest_per_parent, grouped_children, coalesce_merge, similar_people, duplicate_people, link_suggestion, slot_suggestion, slot_verdicts, set_operations, path_values, nocase_order)}

_TOK = "' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' '"
_RANGES = "o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS day FROM orders), r AS (SELECT o_custkey, o_orderkey AS range_id, day AS start, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE day + o_orderkey % 400 END AS stop FROM o)"

_SLOTS = "rules AS (SELECT * FROM (VALUES ('P', 'answers', 'O'), ('P', 'answers', 'F'), ('O', 'amends', 'O'), ('F', 'resolves', 'O'), ('F', 'resolves', 'P')) t(kind, slot, target_kind))"

ORACLE = {
    "bool_filter_scan": f"SELECT doc_id, lang, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en' AND contains({_TOK}, ' the ') AND NOT contains({_TOK}, ' license ') ORDER BY n_chars DESC, doc_id LIMIT 20",
    "in_collapse_or": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') OR o_orderpriority = '1-URGENT'",
    "scan_paged": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40",
    "keyset_page": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) ORDER BY l_orderkey, l_linenumber LIMIT 50",
    "pattern_scan": f"WITH {_PASSAGES}, m AS (SELECT id, text, regexp_extract(text, '(?i)licensed? under the [A-Z]\\w+') AS match FROM p WHERE regexp_matches(text, '(?i)licensed? under the [A-Z]\\w+')) SELECT id, match, instr(text, match)::INTEGER AS at FROM m",
    "crossing_scan": r"""WITH p AS (SELECT l_orderkey, string_agg(l_linenumber || '  ' || l_returnflag || ' ' || l_linestatus, chr(10) ORDER BY l_linenumber, l_returnflag, l_linestatus) AS text FROM lineitem GROUP BY 1)
        SELECT l_orderkey, NOT regexp_matches(text, '(?i)O N|R F') AS crosses FROM p WHERE regexp_matches(text, '(?i)O\s+(?:\d{1,3}\s+)?N|R\s+(?:\d{1,3}\s+)?F')""",
    "line_tolerant_scan": r"SELECT doc_id, NOT regexp_matches(text, '(?i)the of') AS crosses FROM documents WHERE regexp_matches(text, '(?i)the\s+(?:\d{1,3}\s+)?of')",
    "proven_absence": "SELECT source, count(*) AS searched, count(*) FILTER (regexp_matches(text, '(?i)software')) AS matched, count(*) FILTER (regexp_matches(text, '(?i)software')) = 0 AS absent FROM documents GROUP BY source",
    "semi_join_relationship": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "anti_join_relationship": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "three_hop_predicate": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1) GROUP BY 1",
    "json_marker_filter": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT >= 50",
    "json_missing_marker": "SELECT event_type, count(*) AS n FROM events WHERE props->>'$.absent' IS NULL AND props->>'$.k' IS NOT NULL GROUP BY 1",
    "null_keeping_inequality": "SELECT lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1 GROUP BY 1",
    "polymorphic_roles": "WITH r AS (SELECT l_suppkey AS person, 'supplier' AS role, l_orderkey AS scope FROM lineitem UNION SELECT o_custkey, 'customer', o_orderkey FROM orders) SELECT person, count(*) AS roles, string_agg(DISTINCT role, ',' ORDER BY role) AS kinds FROM r GROUP BY person",
    "hydrate": "SELECT l_orderkey, l_linenumber, o_orderstatus, c_name, n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity >= 50",
    "range_join_narrowest": f"WITH {_RANGES} SELECT o_orderkey, (SELECT range_id FROM r WHERE r.o_custkey = o.o_custkey AND start <= day AND (stop IS NULL OR day <= stop) ORDER BY stop IS NULL, coalesce(stop - start, 0), range_id LIMIT 1) AS range_id FROM o",
    "interval_overlap": f"WITH {_RANGES} SELECT a.range_id AS l_id, b.range_id AS r_id FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.range_id < b.range_id AND a.start <= b.stop AND b.start <= a.stop",
    "folder_survey": """WITH d AS (SELECT doc_id, source || '/' || doc_id AS path, md5(text) AS hash FROM documents), f AS (SELECT CASE WHEN doc_id % 7 = 0 THEN path || '.moved' ELSE path END AS path, hash FROM d WHERE doc_id % 10 <> 3),
        k AS (SELECT path, hash, doc_id AS id FROM d WHERE doc_id % 4 <> 1), i AS (SELECT path, hash FROM d WHERE doc_id % 11 = 5),
        m AS (SELECT f.path, f.hash, (SELECT min(id) FROM k WHERE k.path = f.path) AS p, (SELECT min(id) FROM k WHERE k.hash = f.hash) AS h, f.path IN (SELECT path FROM i) OR f.hash IN (SELECT hash FROM i) AS g FROM f)
        SELECT path, hash, CASE WHEN p IS NOT NULL THEN 'known' WHEN g THEN 'ignored' WHEN h IS NOT NULL THEN 'moved' ELSE 'new' END AS state, coalesce(p, h) AS id FROM m
        UNION ALL SELECT path, hash, 'orphaned', id FROM k WHERE path NOT IN (SELECT path FROM f) AND hash NOT IN (SELECT hash FROM f)""",
    "prefix_containment": "WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages), r AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS root FROM p) SELECT root, count(*) AS pages FROM r JOIN p ON path = root OR starts_with(path, root || '/') GROUP BY root",
    "exists_child": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09) GROUP BY 1",
    "sole_document": "SELECT o_orderkey, CASE WHEN count(l_orderkey) = 1 THEN min(l_linenumber) END AS sole FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "courts_of_people": "SELECT r_name, count(DISTINCT s_suppkey) AS people, count(DISTINCT n_nationkey) AS courts FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1",
    "oldest_per_parent": "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
    "grouped_children": "SELECT c_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey GROUP BY 1",
    "coalesce_merge": "SELECT doc_id, coalesce(quality, (n_chars > 500)::INTEGER) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "similar_people": """WITH p AS (SELECT s_suppkey AS id, lower(trim(s_name)) AS name, s_nationkey || '@' || floor(s_acctbal)::BIGINT AS email FROM supplier), q AS (SELECT id, name, email, list_distinct(regexp_split_to_array(name, '\\s+')) AS t FROM p),
        s AS (SELECT a.id, b.id AS other, greatest(CASE WHEN a.email = b.email THEN 0.95 END, CASE WHEN levenshtein(a.name, b.name) <= 2 THEN 0.9 - levenshtein(a.name, b.name) * 0.1 END, CASE WHEN len(list_intersect(a.t, b.t)) * 100.0 / len(list_distinct(a.t || b.t)) >= 50 THEN 0.8 * len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) END)::DOUBLE AS score FROM q a JOIN q b ON a.id <> b.id)
        SELECT id, other, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other)::INTEGER AS rank FROM s WHERE score IS NOT NULL QUALIFY rank <= 3""",
    "duplicate_people": """WITH p AS (SELECT s_suppkey AS id, lower(s_name || ' ' || (s_suppkey % 9)) AS name, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey || '@' || (s_suppkey % 4) END AS email, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 30 END AS bar FROM supplier), q AS (SELECT *, list_distinct(regexp_split_to_array(name, '\\s+')) AS t FROM p),
        s AS (SELECT a.id, b.id AS other, greatest(CASE WHEN a.bar = b.bar THEN 1 END, CASE WHEN a.email = b.email THEN 0.95 END, CASE WHEN levenshtein(a.name, b.name) <= 2 THEN 0.9 - levenshtein(a.name, b.name) * 0.1 END, CASE WHEN len(list_intersect(a.t, b.t)) * 100.0 / len(list_distinct(a.t || b.t)) >= 50 THEN 0.8 * len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) END)::DOUBLE AS score FROM q a JOIN q b ON a.id <> b.id)
        SELECT id, other, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other)::INTEGER AS rank FROM s WHERE score IS NOT NULL QUALIFY rank <= 3""",
    "slot_suggestion": f"""WITH {_SLOTS}, r AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS kind, o_orderpriority AS p, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE END AS day FROM orders),
        s AS (SELECT a.k, u.slot, b.k AS target, round(1 + coalesce(1 / (1 + date_diff('day', b.day, a.day) / 30.0::DOUBLE), 0) + 0.6::DOUBLE * (a.p = b.p)::INTEGER, 6) AS score
              FROM r a JOIN rules u ON u.kind = a.kind JOIN r b ON b.c = a.c AND b.k <> a.k AND b.kind = u.target_kind AND coalesce(b.day <= a.day, true)),
        w AS (SELECT *, row_number() OVER (PARTITION BY k, slot ORDER BY score DESC, target) AS rn, lead(score) OVER (PARTITION BY k, slot ORDER BY score DESC, target) AS next FROM s)
        SELECT k AS o_orderkey, slot, CASE WHEN coalesce(score - next, 9) >= 0.75 THEN target END AS target, score FROM w WHERE rn = 1""",
    "slot_verdicts": f"""WITH {_SLOTS}, s AS (SELECT DISTINCT kind, slot FROM rules UNION SELECT 'F', 'replaces')
        SELECT a.o_orderkey, s.slot, count(*) FILTER (b.o_orderkey <> a.o_orderkey AND EXISTS (SELECT 1 FROM rules u WHERE u.kind = s.kind AND u.slot = s.slot AND u.target_kind = b.o_orderstatus)) AS allowed,
               count(*) FILTER (b.o_orderkey <> a.o_orderkey AND NOT EXISTS (SELECT 1 FROM rules u WHERE u.kind = s.kind AND u.slot = s.slot AND u.target_kind = b.o_orderstatus)) AS refused
        FROM orders a JOIN s ON s.kind = a.o_orderstatus JOIN orders b ON b.o_custkey = a.o_custkey GROUP BY ALL""",
    "link_suggestion": """WITH s AS (SELECT a.o_orderkey, b.o_orderkey AS target, round(1 + 1 / (1 + date_diff('day', b.o_orderdate::DATE, a.o_orderdate::DATE) / 30.0::DOUBLE) + 0.6::DOUBLE * least(3, (a.o_orderpriority = b.o_orderpriority)::INTEGER + (a.o_orderstatus = b.o_orderstatus)::INTEGER), 6) AS score
        FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND b.o_orderdate::DATE <= a.o_orderdate::DATE),
        w AS (SELECT *, row_number() OVER v AS rn, lead(score) OVER v AS nxt FROM s WINDOW v AS (PARTITION BY o_orderkey ORDER BY score DESC, target))
        SELECT o_orderkey, CASE WHEN coalesce(score - nxt, 9.0) >= 0.75 THEN target END AS target, score FROM w WHERE rn = 1""",
    "set_operations": """WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
        SELECT 'union all' AS op, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "path_values": "SELECT DISTINCT p_brand FROM part WHERE starts_with(p_brand, 'Brand#1') ORDER BY p_brand LIMIT 25",
    "nocase_order": "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 30",
}
