"""Queries over texts as they come in: the recognition gate, tables, filing types and dates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefmill.functions import chunking
from briefmill.operators import blocks, dates, filings, tables
from briefmill.operators import ocr_gate as gate
from briefmill.sources.tables import spread, table
from briefmill.streaming import folders, moves


def ocr_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each document's faults and what can be saved of it; the dictionary is the words of twenty documents or more."""
    docs = table(spark, d, "documents")
    return gate.assess(docs, gate.common_words(docs, 20)).withColumn("reasons", F.array_join("reasons", "+"))


def pipe_tables(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the documents' tables, each as the rectangle it spans."""
    got = tables.cells(table(spark, d, "documents"))
    return got.select("doc_id", "table_no", "row_no", "col_no", F.md5(F.col("cell").cast("binary")).alias("cell_md5"))


def _order_html(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as an HTML table: a heading over two rows, and the flag over the rows of lines that share it."""
    lines = spread(table(spark, d, "lineitem"), "l_orderkey").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_returnflag", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")))
    flag = Window.partitionBy("l_orderkey", "l_returnflag")
    lines = lines.withColumns({"tall": F.count("*").over(flag), "first": F.col("rn") == F.min("rn").over(flag)})
    own = F.when(F.col("first"), F.concat(F.lit('<td rowspan="'), F.col("tall"), F.lit('">'), "l_returnflag")).otherwise("")
    row = F.concat(F.lit("<tr>"), own, F.lit("<td>"), "l_partkey", F.lit("<td>"), F.col("l_linenumber"), F.lit("</tr>"))
    head = "<p>Lines &amp; parts</p><table><tr><th rowspan=2>Flag<th colspan=2>Of this order</tr><tr><th>Part<th>Line</tr>"
    rows = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    return rows.select("l_orderkey", F.concat(F.lit(head), "rows", F.lit("</table>")).alias("html"))


def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """The cells of each order's table, read back from its HTML."""
    return tables.cells(_order_html(spark, d), "l_orderkey", "html").select("l_orderkey", "row_no", "col_no", "cell", "header", "own")


def _order_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each order's story, with dates written in five ways."""
    day = F.to_date("o_orderdate")
    text = F.concat(
        F.lit("Filed "), F.date_format(day, "yyyy-MM-dd"), F.lit(", served on "), F.date_format(F.date_add(day, 20), "MMMM d, yyyy"),
        F.lit(" and answered between "), F.date_format(F.date_add(day, 30), "M/d/yyyy"), F.lit(" and "), F.date_format(F.date_add(day, 40), "MMM d yyyy"),
        F.lit(". Heard since "), F.date_format(F.date_add(day, 50), "M/d/yy"), F.lit(". Order no. "), F.col("o_orderkey").cast("string"), F.lit(" of 31/31/1999 was read last week."),
    )
    return spread(table(spark, d, "orders")).select("o_orderkey", text.alias("text"))


def date_mentions(spark: SparkSession, d: str) -> DataFrame:
    return dates.mentions(_order_texts(spark, d), "1998-03-11", "o_orderkey").select("o_orderkey", "start", "stop", "rule", "first_day", "last_day")


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Days that texts name, with how many texts name them and the first of these; ranges that are open do not count."""
    found = dates.mentions(_order_texts(spark, d).withColumnRenamed("o_orderkey", "doc_id"), "1998-03-11").where("rule not in ('after', 'before')")
    return found.groupBy(F.col("first_day").alias("day")).agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first_doc"))


_NAMES = ["{} to Strike", "Supplemental {} in Support of Petition for Bill of Review", "2nd Amended {}", "{}", "Petitioner {} V2"]
_KINDS = ["MOTION", "Affidavit", "Order", "BRIEF", "Notice", "Reply", "Subpoena"]


def _filings(spark: SparkSession, d: str) -> DataFrame:
    """A file name, a folder and a header for each order: the kinds by key, number prefixes for all, some without a kind."""
    o = spread(table(spark, d, "orders"))
    k = F.col("o_orderkey")
    kind, other = (F.element_at(F.array(*map(F.lit, _KINDS)), (x % len(_KINDS) + 1).cast("int")) for x in (k, F.floor(k / 7)))
    form = F.element_at(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES) + 1).cast("int"))
    name = F.concat(F.lit("D-1-FM-25-"), F.lpad(k.cast("string"), 6, "0"), F.lit(" - "), F.when(k % 11 != 0, F.replace(form, F.lit("{}"), kind)).otherwise(k.cast("string")), F.lit(".pdf"))
    header = F.when(k % 3 == 0, F.concat(F.lit("CAUSE NO. D-1-FM-25\nIN THE DISTRICT COURT OF TRAVIS COUNTY, TEXAS\n"), F.upper(other), F.lit(" OF THE PARTY")))
    return o.select("o_orderkey", name.alias("file_name"), F.when(k % 2 == 0, F.concat(other, F.lit("s"))).alias("folder"), header.alias("header"))


def filing_types(spark: SparkSession, d: str) -> DataFrame:
    """Each filing's type by name, folder and header, the header's own, and the title."""
    x = _filings(spark, d)
    name, folder, header = F.col("file_name"), F.col("folder"), F.col("header")
    got = x.select("o_orderkey", filings.filing_type(name, folder, header).alias("t"), filings.header_type(header).alias("h"), filings.filing_title(name, header, folder).alias("title"))
    return got.select("o_orderkey", F.col("t.type").alias("type"), F.col("t.confidence").alias("confidence"), F.col("h.type").alias("header_type"), F.col("h.matched").alias("matched"), "title")


def _file_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as those of files: a user's content, at one of three paths, that comes, goes, fails or is filed."""
    kinds = F.create_map(*[F.lit(x) for kv in {"view": "add", "click": "add", "error": "gone", "purchase": "error", "signup": "filed"}.items() for x in kv])
    path = F.concat(F.lit("/"), (F.floor("value") % 3).cast("string"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("hash"), path.alias("path"), kinds[F.col("event_type")].alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def file_moves(spark: SparkSession, d: str) -> DataFrame:
    """Records of contents as their files come, go and turn up elsewhere; SQL has no such state, a walk in the tests has."""
    return moves.tracked(_file_events(spark, d))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Customers' work as claimed by the kinds of events: queued, or running with a lease that may have ended."""
    c = table(spark, d, "customer")
    queued = F.col("c_acctbal") >= 0
    known = c.select(F.col("c_custkey").alias("id"), F.when(queued, "QUEUED").otherwise("RUNNING").alias("status"), F.when(~queued, "none").alias("owner"), F.when(~queued, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).alias("until"))
    asks = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("worker"), F.col("ts").cast("timestamp_ntz").alias("at"))
    return moves.claim(asks, known)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """The documents' lines as blocks of pages: every ninth a heading, lines with pipes tables, and some notes and footers."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("place", "text"))
    kind = F.when(F.contains("text", F.lit(" | ")), "table").when(F.col("place") % 9 == 3, "heading").when(F.col("place") % 13 == 7, "footnote").when(F.col("place") % 17 == 11, "page_footer").otherwise("paragraph")
    return lines.withColumn("kind", kind)


def structured_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The documents as laid-out pages, in chunks under their headings; a slow chunker in the tests tells the same."""
    return blocks.page_chunks(_blocks(spark, d), "[Filing]\n\n")


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents in chunks of at most 1,000 characters under their sections' headings, cut before legal separators."""
    return chunking.chunk(table(spark, d, "documents"), chunking.by_sections)


def _folder_changes(spark: SparkSession, d: str) -> DataFrame:
    """Events as changes of folders: a user group's puts at /a/b/c, and drops of a file or of a folder by errors."""
    u, v = F.col("user_id"), F.floor("value").cast("long")
    parts = [F.concat(F.lit("/"), ((v / n).cast("long") % 4).cast("string")) for n in (1, 4, 16)]
    drop = F.col("event_type") == "error"
    path = F.when(drop & (v % 3 == 0), parts[0]).when(drop & (v % 3 == 1), F.concat(*parts[:2])).otherwise(F.concat(*parts))
    return table(spark, d, "events").select((u % 7).cast("string").alias("link"), F.col("event_id").alias("seq"), F.when(drop, "drop").otherwise("put").alias("op"), path.alias("path"), F.col("event_type").alias("payload"))


def folder_state(spark: SparkSession, d: str) -> DataFrame:
    """What folders hold once all changes are in, by ancestors that were dropped."""
    return folders.current(_folder_changes(spark, d))


QUERIES = {f.__name__: f for f in (ocr_gate, pipe_tables, html_tables, date_mentions, timeline, filing_types, file_moves, claims, structured_chunks, section_chunks, folder_state)}

_TRIM = r"'^\s+|\s+$', '', 'g'"
_WIN = "regexp_extract_all({}, '(?s).{{24}}')"
_FEW = "(len({0}) >= {1} AND len(list_distinct({0})) < {2} * len({0}))"

_OCR_GATE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), {_TRIM}) AS raw FROM documents),
dict AS (SELECT word FROM (SELECT r, unnest(list_distinct(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: regexp_full_match(t, '[A-Za-z]+')), lambda t: lower(t)))) AS word
         FROM (SELECT row_number() OVER () AS r, text FROM documents)) GROUP BY word HAVING count(*) >= 20),
l AS (SELECT r, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM d WHERE contains(raw, chr(10))),
k AS (SELECT r, i, line, regexp_replace(regexp_replace(lower(regexp_replace(line, {_TRIM})), '[0-9]+', '#', 'g'), '\s+', ' ', 'g') AS key FROM l),
f AS (SELECT *, (key <> '' AND row_number() OVER (PARTITION BY r, key ORDER BY i) = 1)::INT AS new, count(*) OVER (PARTITION BY r, key) AS times,
      sum(length(line) + 1) OVER (PARTITION BY r ORDER BY i) - 1 AS stop, count(*) OVER (PARTITION BY r) AS n FROM k),
s AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead, max(CASE WHEN new = 1 THEN i END) OVER (PARTITION BY r) AS last_new FROM f),
thin AS (SELECT r, min(i) AS i FROM s WHERE n - i + 1 >= 8 AND ahead < 0.1 * (n - i + 1) GROUP BY r),
stay AS (SELECT r, max(i) AS i FROM s WHERE i <= last_new AND (key = '' OR times < 3) GROUP BY r),
v AS (SELECT r, unnest({_WIN.format('raw')}) AS w, generate_subscripts({_WIN.format('raw')}, 1) AS i, length(raw) // 24 AS total FROM d WHERE length(raw) >= 384),
fresh AS (SELECT r, min(i) AS i, any_value(total) AS total FROM v GROUP BY r, w),
dead AS (SELECT r, min(i) AS i FROM (SELECT r, i, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), total + 1) - i - 1 AS gap FROM fresh) WHERE gap >= 8 GROUP BY r),
wcut AS (SELECT r, raw, i * 24 AS stop, i * 24 - length(regexp_extract(substr(raw, 1, (i * 24 + 1)::BIGINT), '[^ \n]*$')) AS space FROM dead JOIN d USING (r)),
cuts AS (SELECT r, CASE WHEN space > greatest(0, stop - 96) THEN space ELSE stop END AS cut FROM wcut
         UNION SELECT thin.r, s.stop FROM thin JOIN s ON s.r = thin.r AND s.i = thin.i - 1
         UNION SELECT stay.r, s.stop FROM stay JOIN s ON s.r = stay.r AND s.i = stay.i),
texts AS (SELECT r, NULL AS cut, raw AS t FROM d UNION ALL SELECT r, length(p) AS cut, p AS t FROM (SELECT DISTINCT r, regexp_replace(substr(raw, 1, cut::BIGINT), '\s+$', '') AS p FROM cuts JOIN d USING (r)) WHERE length(p) >= 400),
a AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\n+'), lambda x: regexp_replace(x, {_TRIM})), lambda x: x <> '') AS lines, {_WIN.format('t')} AS win,
      {_WIN.format("regexp_replace(t, '[0-9]+', '#', 'g')")} AS win2, len(list_distinct(list_filter(regexp_split_to_array(lower(t), '[^a-z]+'), lambda x: x <> ''))) AS vocab,
      list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS tokens, len(regexp_extract_all(t, '[\x{{2E80}}-\x{{2EFF}}\x{{3000}}-\x{{303F}}\x{{3040}}-\x{{30FF}}\x{{3130}}-\x{{318F}}\x{{31C0}}-\x{{9FFF}}\x{{A960}}-\x{{A97F}}\x{{AC00}}-\x{{D7FF}}\x{{F900}}-\x{{FAFF}}]')) AS cjk FROM texts),
b AS (SELECT *, list_filter(tokens, lambda x: regexp_full_match(x, '[A-Za-z]+')) AS alpha,
      coalesce(list_sum(list_transform(list_filter(tokens, lambda x: length(x) >= 30 AND regexp_matches(x, '[A-Za-z]') AND NOT regexp_matches(x, '(?i)^(?:https?://|www\.)|@[a-z0-9.-]+\.[a-z]{{2,}}$|^[a-z]:?[\\/][\w\\/.\-]+$|\.(?:pdf|docx?|xlsx?|html?|txt|jpe?g|png)$')), lambda x: length(x))), 0) AS run FROM a),
c AS (SELECT *, length(t) >= 60 AND len(alpha) >= 8 AND len(list_filter(alpha, lambda x: regexp_matches(x, '(?i)[aeiouy]') AND NOT regexp_matches(x, '(?i)[bcdfghjklmnpqrstvwxz]{{5,}}'))) < 0.5 * len(alpha) AS odd FROM b),
soup AS (SELECT r, cut FROM (SELECT r, coalesce(cut, -1) AS cut, unnest(alpha) AS w FROM c WHERE odd) LEFT JOIN dict ON word = lower(w) GROUP BY r, cut HAVING count(word) < 0.08 * count(*)),
g AS (SELECT c.r, c.cut, length(t) AS n, array_to_string(list_filter([
      CASE WHEN length(t) >= 240 AND ({_FEW.format('lines', 8, 0.2)} OR {_FEW.format('win', 8, 0.25)} OR (NOT regexp_matches(t, '[|$\t]') AND vocab <= 4 AND {_FEW.format('win2', 8, 0.25)})) THEN 'repetition-loop' END,
      CASE WHEN cjk >= 2 AND cjk >= len(regexp_extract_all(t, '[A-Za-z]')) THEN 'unexpected-script' END,
      CASE WHEN len(regexp_extract_all(t, '\\(?:frac|sin|cos|tan|theta|sqrt|sum|int|alpha|beta|gamma|pi|cdot|times|left|right)\b|\\\(|\\\[')) >= 2 THEN 'latex-hallucination' END,
      CASE WHEN length(t) >= 60 AND run > 0.3 * length(t) THEN 'run-together-text' END,
      CASE WHEN soup.r IS NOT NULL THEN 'letter-soup' END], lambda x: x IS NOT NULL), '+') AS reasons
      FROM c LEFT JOIN soup ON soup.r = c.r AND soup.cut = coalesce(c.cut, -1)),
best AS (SELECT r, min(cut) AS cut FROM g WHERE cut IS NOT NULL AND reasons = '' GROUP BY r)
SELECT doc_id, n::INTEGER AS n_chars, reasons, CASE WHEN reasons = 'repetition-loop' THEN best.cut::INTEGER END AS salvaged_chars
FROM g JOIN d USING (r) LEFT JOIN best USING (r) WHERE g.cut IS NULL
"""

_PIPE_TABLES = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2) AS lines FROM documents),
r AS (SELECT doc_id, list_filter(lines, lambda x: NOT regexp_full_match(x, '\s*\|?[\s\-|:]+\|?\s*')) AS lines FROM d WHERE len(lines) >= 2),
c AS (SELECT doc_id, list_transform(lines, lambda x: regexp_split_to_array(regexp_replace(x, '^\s*\|\s*|\s*\|\s*$', '', 'g'), '\s*\|\s*')) AS cells FROM r),
w AS (SELECT doc_id, cells, list_max(list_transform(cells, lambda x: len(x))) AS width FROM c),
y AS (SELECT doc_id, width, unnest(cells) AS line, generate_subscripts(cells, 1) AS y FROM w),
x AS (SELECT doc_id, y, line, unnest(range(1, width + 1)) AS x FROM y)
SELECT doc_id, 0 AS table_no, (y - 1)::INTEGER AS row_no, (x - 1)::INTEGER AS col_no, md5(coalesce(line[x], '')) AS cell_md5 FROM x
"""

_HTML_TABLES = """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn FROM lineitem),
f AS (SELECT *, rn = min(rn) OVER (PARTITION BY l_orderkey, l_returnflag) AS first FROM l),
o AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT l_orderkey, y AS row_no, x AS col_no, c AS cell, true AS header, own FROM o, (VALUES (0, 0, 'Flag', true), (0, 1, 'Of this order', true), (0, 2, 'Of this order', false), (1, 0, 'Flag', false), (1, 1, 'Part', true), (1, 2, 'Line', true)) h(y, x, c, own)
UNION ALL SELECT l_orderkey, (rn + 1)::INTEGER, 0, l_returnflag, false, first FROM f
UNION ALL SELECT l_orderkey, (rn + 1)::INTEGER, 1, l_partkey::VARCHAR, false, true FROM f
UNION ALL SELECT l_orderkey, (rn + 1)::INTEGER, 2, l_linenumber::VARCHAR, false, true FROM f
"""

_DATES = """
m AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders),
p AS (SELECT o_orderkey, d, strftime(d, '%Y-%m-%d') AS a, strftime(d + 20, '%B %-d, %Y') AS b, strftime(d + 30, '%-m/%-d/%Y') || ' and ' || strftime(d + 40, '%b %-d %Y') AS c, strftime(d + 50, '%-m/%-d/%y') AS e FROM m),
q AS (SELECT *, 6 + length(a) + 12 AS at_b, 6 + length(a) + 12 + length(b) + 14 AS at_c FROM p),
u AS (SELECT *, at_c + 8 + length(c) + 8 AS at_e FROM q),
v AS (SELECT *, at_e + 6 + length(e) + 12 + length(o_orderkey::VARCHAR) + 24 AS at_w FROM u),
named AS (SELECT o_orderkey, 6 AS start, 6 + length(a) AS stop, 'iso' AS rule, d AS first_day, d AS last_day FROM v
 UNION ALL SELECT o_orderkey, at_b, at_b + length(b), 'words', d + 20, d + 20 FROM v
 UNION ALL SELECT o_orderkey, at_c, at_c + 8 + length(c), 'between', d + 30, d + 40 FROM v
 UNION ALL SELECT o_orderkey, at_e, at_e + 6 + length(e), 'after', d + 50, DATE '9999-12-31' FROM v
 UNION ALL SELECT o_orderkey, at_w, at_w + 9, 'week', DATE '1998-03-02', DATE '1998-03-08' FROM v)
"""

_LIST = lambda x: "[" + ", ".join(f"'{y}'" for y in x) + "]"
_FILING_TYPES = f"""
WITH x AS (SELECT o_orderkey AS k, {_LIST(_KINDS)}[(o_orderkey % 7 + 1)::INTEGER] AS kind, {_LIST(_KINDS)}[((o_orderkey // 7) % 7 + 1)::INTEGER] AS other, o_orderkey % 5 AS form FROM orders),
y AS (SELECT *, CASE lower(kind) WHEN 'motion' THEN 'Motion' WHEN 'brief' THEN 'Brief' ELSE kind END AS own, CASE lower(other) WHEN 'motion' THEN 'Motion' WHEN 'brief' THEN 'Brief' ELSE other END AS second, k % 11 <> 0 AS named FROM x),
z AS (SELECT *, CASE WHEN named THEN own END AS by_name, CASE WHEN k % 2 = 0 AND second <> 'Order' THEN second END AS by_folder, CASE WHEN k % 3 = 0 THEN second END AS by_header FROM y),
t AS (SELECT *, coalesce(by_name, by_folder, by_header) AS type FROM z),
a AS (SELECT *, coalesce((by_name = type)::INTEGER, 0) + coalesce((by_folder = type)::INTEGER, 0) + coalesce((by_header = type)::INTEGER, 0) AS agree, CASE WHEN by_name IS NOT NULL THEN 0.85 WHEN by_folder IS NOT NULL THEN 0.75 ELSE 0.6 END AS base,
      CASE WHEN NOT named AND k % 2 = 0 THEN other || 's'
           WHEN NOT named AND by_header IS NOT NULL THEN second || ' of the Party'
           WHEN NOT named AND k < 100 THEN 'D 1 Fm 25 ' || lpad(k::VARCHAR, 6, '0') || ' ' || k
           WHEN NOT named THEN k::VARCHAR
           WHEN form = 0 THEN kind || ' to Strike' WHEN form = 1 THEN 'Supplemental ' || kind || ' in Support of Petition for Bill of Review' WHEN form = 2 THEN '2nd Amended ' || kind WHEN form = 3 THEN own ELSE 'Petitioner ' || kind END AS name FROM t)
SELECT k AS o_orderkey, coalesce(type, 'Other') AS type,
       (CASE WHEN type IS NULL THEN 0.2 WHEN agree = 3 THEN least(base + 0.12, 0.99) WHEN agree = 2 THEN least(base + 0.08, 0.97) ELSE base END)::DOUBLE AS confidence,
       CASE WHEN k % 3 = 0 AND second IN ('Affidavit', 'Brief', 'Notice', 'Subpoena') THEN second WHEN k % 3 = 0 AND second = 'Order' THEN 'Order' END AS header_type,
       CASE WHEN k % 3 = 0 THEN CASE second WHEN 'Affidavit' THEN 'AFFIDAVIT OF' WHEN 'Brief' THEN 'BRIEF OF' WHEN 'Notice' THEN 'NOTICE OF THE' WHEN 'Subpoena' THEN 'SUBPOENA' WHEN 'Order' THEN 'ORDER' END END AS matched,
       CASE WHEN k % 3 = 0 AND length(second || ' of the Party') > 1.5 * length(name) THEN second || ' of the Party' ELSE name END AS title
FROM a
"""

ORACLE = {
    "ocr_gate": _OCR_GATE,
    "pipe_tables": _PIPE_TABLES,
    "html_tables": _HTML_TABLES,
    "date_mentions": f"WITH {_DATES} SELECT o_orderkey, start::INTEGER AS start, stop::INTEGER AS stop, rule, first_day, last_day FROM named",
    "timeline": f"WITH {_DATES} SELECT first_day AS day, count(DISTINCT o_orderkey) AS n, min(o_orderkey) AS first_doc FROM named WHERE rule <> 'after' GROUP BY 1",
    "filing_types": _FILING_TYPES,
    "folder_state": """WITH e AS (SELECT (user_id % 7)::VARCHAR AS link, event_id AS seq, event_type AS payload, event_type = 'error' AS dropping, floor(value)::BIGINT AS v FROM events),
        p AS (SELECT *, '/' || (v % 4) AS a, '/' || (v // 4 % 4) AS b, '/' || (v // 16 % 4) AS c FROM e),
        f AS (SELECT link, seq, payload, dropping, CASE WHEN dropping AND v % 3 = 0 THEN a WHEN dropping AND v % 3 = 1 THEN a || b ELSE a || b || c END AS path FROM p),
        l AS (SELECT * FROM f WHERE NOT dropping QUALIFY row_number() OVER (PARTITION BY link, path ORDER BY seq DESC) = 1)
        SELECT path, payload, link, seq FROM l WHERE NOT EXISTS (SELECT 1 FROM f d WHERE d.dropping AND d.link = l.link AND d.seq > l.seq AND (l.path = d.path OR starts_with(l.path, d.path || '/')))""",
    "claims": """WITH k AS (SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN 'QUEUED' ELSE 'RUNNING' END AS status, CASE WHEN c_acctbal < 0 THEN 'none' END AS owner, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-02' END AS until FROM customer),
        f AS (SELECT id, min((ts, event_type)) AS w FROM events JOIN k ON id = user_id WHERE status = 'QUEUED' OR until <= ts GROUP BY id)
        SELECT k.id, CASE WHEN w IS NULL THEN status ELSE 'RUNNING' END AS status, coalesce(w[2], owner) AS owner, coalesce(w[1] + INTERVAL 10 MINUTE, until) AS until FROM k LEFT JOIN f USING (id)""",
}
