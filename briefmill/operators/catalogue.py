"""Operations on catalogue rows: filters as one column, pages with totals, patches, origins, and what pages' lines tell."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metadata_filter(wanted: Mapping, columns: Mapping[str, str]) -> Column:
    """All of ``wanted`` (field to value, or to a list of values) by the ``columns`` of the fields; null values ask nothing.

    ``cases`` goes before ``case`` and never beside it. ``status`` is filed, draft, not-draft, or any. An empty list asks
    nothing, too; a field without a column is an error, not a filter that is left out.
    """
    asked = {k: v for k, v in wanted.items() if v is not None and v != [] and not (k == "status" and v == "any")}
    if "cases" in asked:
        asked.pop("case", None)
    out = []
    for field, value in asked.items():
        c = F.col(columns["case" if field == "cases" else field])
        if field == "status":
            out.append({"filed": c == "filed", "draft": c == "draft", "not-draft": c != "draft"}[value])
        else:
            out.append(c.isin(list(value)) if isinstance(value, list | tuple) else c == value)
    return reduce(Column.__and__, out, F.lit(True))


def scope_filter(cases: Sequence | None, filings: Sequence | None, case_col: str, filing_col: str) -> Column:
    """Rows of any of the cases or of the filings; with neither, all rows."""
    arms = [F.col(c).isin(list(ids)) for c, ids in ((case_col, cases), (filing_col, filings)) if ids]
    return reduce(Column.__or__, arms) if arms else F.lit(True)


def in_cases(rows: DataFrame, known: DataFrame, key: str, one=None, many: Sequence | None = None) -> DataFrame:
    """``rows`` of one case or of several, which must be in ``known``; asking for both, or for unknown ones, is an error."""
    if one is not None and many:
        raise ValueError("ask for one case or for several, not for both")
    ids = [one] if one is not None else sorted(set(many or ()))
    if not ids:
        return rows
    missing = set(ids) - {r[0] for r in known.where(F.col(key).isin(ids)).select(key).distinct().collect()}  # as many as are asked
    if missing:
        raise ValueError(f"unknown cases: {sorted(missing)}")
    return rows.where(F.col(key).isin(ids))


def page_of(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of ``rows`` in an order that leaves no ties, with ``total``, the number of all rows, in each of its rows."""
    total = rows.agg(F.count("*").alias("total")).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def committed(rows: DataFrame, patches: DataFrame, key: str, columns: Sequence[str], refs: Mapping[str, str], derived: Sequence[str]) -> DataFrame:
    """``rows`` with the latest patch of each key: ``patches`` has key, ``seq`` and ``patch`` (map of strings).

    A patch sets the ``columns`` it names and, by ``refs``, those that a reference stands for ('@x' sets 'x'); its other
    fields are merged into ``tags``. Blank values become null in columns and take tags away. ``derived`` fields and
    those that end in Label are never written. Of equal ``seq`` the patch with the greater entries wins.
    """
    entries = F.array_sort(F.map_entries("patch"))
    last = patches.groupBy(key).agg(F.max(F.struct("seq", entries.alias("e"))).alias("p")).select(key, F.map_from_entries("p.e").alias("_patch"))
    keep = F.map_filter("_patch", lambda k, v: ~k.isin(list(derived)) & ~F.endswith(k, F.lit("Label")))
    told = rows.join(last.withColumn("_patch", keep), key, "left")
    value = lambda name: F.nullif(F.trim(F.col("_patch")[name]), F.lit(""))
    out = {}
    for c in columns:
        named = [c, *[r for r, target in refs.items() if target == c]]
        new = F.coalesce(*[F.when(F.map_contains_key("_patch", F.lit(n)), F.struct(F.ltrim(value(n), F.lit("@")).alias("v"))) for n in named])
        out[c] = F.when(new.isNotNull(), new["v"].cast(rows.schema[c].dataType)).otherwise(F.col(c))
    tagged = F.map_filter("_patch", lambda k, v: ~k.isin([*columns, *refs]))
    blank = F.map_keys(F.map_filter(tagged, lambda k, v: F.coalesce(F.trim(v), F.lit("")) == ""))
    old = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(tagged), k))
    new = F.map_filter(tagged, lambda k, v: ~F.array_contains(blank, k))
    out["tags"] = F.when(F.col("_patch").isNull(), F.col("tags")).otherwise(F.map_concat(old, new))
    return told.withColumns(out).drop("_patch")


def tag_errors(rows: DataFrame, key: str, tags_col: str, rules: DataFrame) -> DataFrame:
    """(key, errors) of each row: its tags against ``rules`` (tag, type, required), where type is marker, number, date, ref or str.

    A tag without a rule is 'unknown'; a value that does not fit is the type's name; a required one that is missing is
    'missing'. Errors read tag:fault, in order; rows without any have an empty list.
    """
    fits = {
        "marker": F.col("value").isin("M", "true", "1"),
        "number": F.regexp_like(F.coalesce("value", F.lit("")), F.lit(r"^-?\d+(\.\d+)?$")),
        "date": F.try_to_date(F.col("value"), "yyyy-MM-dd").isNotNull(),
        "ref": F.startswith(F.coalesce("value", F.lit("")), F.lit("@")),
        "str": F.col("value").isNotNull(),
    }
    each = rows.select(key, F.explode(tags_col).alias("tag", "value")).join(rules, "tag", "left")
    good = reduce(lambda e, kv: e.when(F.col("type") == kv[0], kv[1]), fits.items(), F.when(F.lit(False), F.lit(True))).otherwise(False)
    bad = each.withColumn("fault", F.when(F.col("type").isNull(), "unknown").when(~F.coalesce(good, F.lit(False)), F.col("type"))).where("fault is not null").select(key, "tag", "fault")
    need = rules.where("required").agg(F.collect_list("tag").alias("need")).scalar()  # as many as there are rules
    gone = rows.withColumn("_need", need).select(key, F.explode(F.array_except("_need", F.coalesce(F.map_keys(tags_col), F.array().cast("array<string>")))).alias("tag"), F.lit("missing").alias("fault"))
    listed = bad.unionByName(gone).groupBy(key).agg(F.array_sort(F.collect_list(F.concat_ws(":", "tag", "fault"))).alias("errors"))
    return rows.select(key).join(listed, key, "left").select(key, F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def origin(rows: DataFrame, people: DataFrame, roles: DataFrame, me) -> DataFrame:
    """(key, origin): who a row comes from. ``rows`` has key, marker, kind, author and scope; ``people`` person and role (self,
    judge, ...); ``roles`` scope, person and side (plaintiff or defendant); ``me`` is the own person.

    A marker decides; else a row without author is courtIssued if it is signed, else unknown (null); an author who is
    oneself is selfFiled, one of the court courtIssued; else the sides in the scope tell selfFiled from opposingFiled;
    else it is thirdParty. Authors whom no one knows are unknown. ``people`` has a row a person, ``roles`` one a scope and person.
    """
    own = roles.where(F.col("person") == F.lit(me)).select("scope", F.col("side").alias("_mine"))
    told = rows.join(people.select(F.col("person").alias("author"), F.col("role").alias("_role"), F.lit(True).alias("_known")), "author", "left")
    told = told.join(own, "scope", "left").join(roles.select("scope", F.col("person").alias("author"), F.col("side").alias("_theirs")), ["scope", "author"], "left")
    got = (
        F.when(F.col("marker").isNotNull(), F.col("marker"))
        .when(F.col("author").isNull(), F.when(F.col("kind") == "signed", "courtIssued"))
        .when(F.col("_known").isNull(), F.lit(None).cast("string"))
        .when(F.col("_role") == "self", "selfFiled")
        .when(F.col("_role").isin("judge", "courtClerk", "courtReporter"), "courtIssued")
        .when(F.col("_mine") != F.col("_theirs"), "opposingFiled")
        .when(F.col("_mine") == F.col("_theirs"), "selfFiled")
        .otherwise("thirdParty")
    )
    return told.select("key", got.alias("origin"))


def repeated_content(pages: DataFrame) -> DataFrame:
    """Of each document in ``pages`` (doc, page, text): ``same_pages``, ``duplicates`` and ``fired``.

    Lines count without case, numbers and white space, of four characters or more; those on over 80 % of a document's
    pages are boilerplate. ``same_pages`` is the number of texts that three pages or more have, ``duplicates`` the share
    of the other lines that stood there before; 30 % of them, or such pages, fire. Documents of one page do not.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"\d+", "#"), r"\s+", " ")))
    whole = pages.select("doc", plain(F.col("text")).alias("t"))
    size = whole.groupBy("doc").agg(F.count("*").alias("pages"))
    same = whole.where("t <> ''").groupBy("doc", "t").count().where("count >= 3").groupBy("doc").agg(F.count("*").alias("same_pages"))
    lines = pages.select("doc", "page", F.explode(F.split("text", "\n")).alias("line")).select("doc", "page", plain(F.col("line")).alias("line")).where("length(line) >= 4")
    on_page = lines.groupBy("doc", "line", "page").agg(F.count("*").alias("n"))  # a line that all pages hold is one row a page
    counted = on_page.groupBy("doc", "line").agg(F.sum("n").alias("n"), F.count("*").alias("on")).join(size, "doc").where("on <= 0.8 * pages")
    share = counted.groupBy("doc").agg((F.sum(F.col("n") - 1) / F.sum("n")).alias("duplicates"))
    told = size.join(same, "doc", "left").join(share, "doc", "left").select("doc", "pages", F.coalesce("same_pages", F.lit(0)).alias("same_pages"), F.coalesce("duplicates", F.lit(0.0)).alias("duplicates"))
    many = F.col("pages") > 1
    return told.select("doc", F.when(many, F.col("same_pages")).otherwise(0).alias("same_pages"), F.when(many, F.col("duplicates")).otherwise(0.0).alias("duplicates"), (many & ((F.col("same_pages") > 0) | (F.col("duplicates") > 0.3))).alias("fired"))


def printed_lines(glyphs: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Lines of pages from placed texts (page, seq, x, y, text): ``page``, ``line``, ``number``, ``text``, from top to bottom.

    A line is a run of items, by height, of which each is within ``tolerance`` of the one above. Where three lines
    or more begin with a number from 1 to 25 and text behind it, within 30 of the median of their places, such numbers left of the
    median + 30 are the lines' numbers. Blank items do not count; ties go by ``seq``. A page's lines are windows over
    its items.
    """
    top = Window.partitionBy("page").orderBy(F.desc("y"), "x", "seq")
    items = glyphs.where("trim(text) <> ''").withColumn("new", (F.coalesce(F.lag("y").over(top) - F.col("y"), F.lit(tolerance + 1)) > tolerance).cast("int"))
    items = items.withColumn("line", F.sum("new").over(top.rowsBetween(Window.unboundedPreceding, 0)))
    lines = items.groupBy("page", "line").agg(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))).alias("items"))
    first = F.col("items")[0]
    number = F.when(F.regexp_like(F.trim(first["text"]), F.lit("^([1-9]|1[0-9]|2[0-5])$")), F.trim(first["text"]).cast("int"))
    lines = lines.select("page", "line", "items", number.alias("number"), first["x"].alias("x0"))
    able = lines.where("number is not null and size(items) > 1").select("page", F.col("x0").alias("x"))
    spot = Window.partitionBy("page").orderBy("x")
    middle = able.withColumns({"rn": F.row_number().over(spot), "of": F.count("*").over(Window.partitionBy("page"))}).where("rn = floor(of / 2) + 1").select("page", F.col("x").alias("median"))
    column = able.join(middle, "page").groupBy("page", "median").agg(F.count_if(F.abs(F.col("x") - F.col("median")) < 30).alias("near")).where("near >= 3").select("page", "median")
    told = lines.join(column, "page", "left").withColumn("number", F.when(F.col("x0") < F.col("median") + 30, F.col("number")))
    body = F.when(F.col("number").isNull(), F.col("items")).otherwise(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))))
    return told.select("page", F.col("line").cast("int").alias("line"), "number", F.trim(F.array_join(F.transform(body, lambda i: i["text"]), " ")).alias("text"))


def reranked(rows: DataFrame) -> DataFrame:
    """``rows`` (query, id, place, score) with ``rank`` and ``fault``: by score, or by ``place`` where a query's scores are of no use.

    They are not if all are equal to six places, the highest is below 0.001, one is NaN or null, all are negative, or
    three or more hardly differ (deviation below 0.001 of the mean). Equal scores keep their places.
    """
    w = Window.partitionBy("query")
    s = F.col("score")
    stats = {
        "_odd": F.max((s.isNull() | F.isnan(s)).cast("int")).over(w), "_low": F.min(F.round(s, 6)).over(w), "_high": F.max(F.round(s, 6)).over(w), "_top": F.max(s).over(w),
        "_n": F.count("*").over(w), "_spread": F.stddev_pop(s).over(w), "_mean": F.avg(s).over(w),
    }
    even = F.col("_spread") / F.when(F.col("_mean") == 0, 1.0).otherwise(F.abs("_mean")) < 0.001
    fault = F.when(F.col("_odd") == 1, "nan").when(F.col("_low") == F.col("_high"), "identical").when(F.col("_top") < 0, "negative").when(F.col("_top") < 0.001, "low").when(even & (F.col("_n") >= 3), "even")
    told = rows.withColumns(stats).withColumn("fault", fault)
    order = Window.partitionBy("query").orderBy(F.when(F.col("fault").isNull(), -s), "place", "id")
    return told.withColumn("rank", F.row_number().over(order)).select("query", "id", "rank", "fault")


def merged_people(rows: DataFrame, order: str, values: Sequence[str]) -> DataFrame:
    """Candidates of the same name, whatever its case and spaces: ``key``, the first ``name``, and of each of ``values`` the first that is filled."""
    key = F.trim(F.regexp_replace(F.lower("name"), r"\s+", " "))
    first = [F.min_by(v, F.when(F.coalesce(F.col(v).cast("string"), F.lit("")) != "", F.col(order))).alias(v) for v in values]
    return rows.groupBy(key.alias("key")).agg(F.min_by("name", order).alias("name"), F.count("*").alias("n"), *first)


def annotation_marker(kind: Column, author: Column, comment: Column, covered: Column) -> Column:
    """The marker of a note on a page: what was done, by whom, the remark and the first 100 characters it covers."""
    by = F.when(author != "", F.concat(F.lit(" by "), author)).otherwise("")
    said = F.when(comment != "", F.concat(F.lit(': "'), comment, F.lit('"'))).otherwise("")
    cut = F.when(covered != "", F.concat(F.lit('"'), F.substring(covered, 1, 100), F.when(F.length(covered) > 100, "...").otherwise(""), F.lit('"'))).otherwise("")
    names = {"strikeout": "STRUCK THROUGH", "highlight": "HIGHLIGHTED", "underline": "UNDERLINED", "squiggly": "SQUIGGLY UNDERLINED"}
    done = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[kind]
    return F.when(kind == "comment", F.concat(F.lit("[COMMENT"), by, F.lit("] "), F.coalesce(comment, F.lit("")))).otherwise(F.concat(F.lit("["), done, by, said, F.lit("] "), cut))


_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def tag_is(tags: Column, path: str, op: str, value) -> Column:
    """A JSON document's tag at ``path`` (a.b) against a literal, by the literal's type: flag, number, date, reference ('@id') or text.

    Tags of another type, missing tags and JSON that is none fit nothing, but ``!=``, which holds where the tag is not
    that value. A flag is also 1 or 0, or a marker ('M'), as older rows write it.
    """
    doc = F.try_parse_json(tags)
    got = lambda kind: F.try_variant_get(doc, f"$.{path}", kind)
    if isinstance(value, bool):
        flag = F.lower(got("string"))
        known = F.when(flag.isin("true", "1", "m"), True).when(flag.isin("false", "0"), False)
        fits = _COMPARE[op](known, F.lit(value))
    elif isinstance(value, int | float):
        fits = _COMPARE[op](got("double"), F.lit(float(value)))
    elif isinstance(value, dt.date):
        fits = _COMPARE[op](F.try_to_date(got("string"), "yyyy-MM-dd"), F.lit(value))
    else:
        fits = _COMPARE[op](got("string"), F.lit(value))
    return F.coalesce(fits, F.lit(op == "!="))


def missing_slots(slots: Mapping[str, Column]) -> Column:
    """The names of the slots that are null or blank, in their order."""
    return F.array_compact(F.array(*[F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) == "", F.lit(name)) for name, c in slots.items()]))


def gathered(children: DataFrame, explicit: str, other: str, key: str) -> DataFrame:
    """(parent, children): each parent's children in order, by the ``explicit`` parent or else by the ``other``; none is its own."""
    parent = F.coalesce(explicit, other)
    rows = children.where(parent.isNotNull() & ~parent.eqNullSafe(F.col(key)))
    return rows.groupBy(parent.alias("parent")).agg(F.array_sort(F.collect_list(key)).alias("children"))


def dictionary_ratio(texts: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, ratio): the words of letters in each text, and the share of them in ``dictionary`` (word); null without words.

    Each text's words are counted before they are joined; ids are unique.
    """
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]+"), F.lit(0))
    each = texts.select(F.col(id_col).alias("id"), F.explode(words).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    told = each.join(dictionary.select("word", F.lit(1).alias("known")).distinct(), "word", "left").groupBy("id").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("ratio"))
    return texts.select(F.col(id_col).alias("id")).join(told, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n"), "ratio")


def cursor(pattern: str, scope: Mapping, last: Sequence) -> str:
    """An opaque mark of where a page of a scan ended, good for the same pattern and scope only."""
    told = {"print": _print(pattern, scope), "last": list(last)}
    return base64.urlsafe_b64encode(json.dumps(told).encode()).decode()


def _print(pattern: str, scope: Mapping) -> str:
    return hashlib.sha256(json.dumps([pattern, sorted((k, v) for k, v in scope.items())]).encode()).hexdigest()[:16]


def after_cursor(rows: DataFrame, mark: str | None, pattern: str, scope: Mapping, keys: Sequence[str], limit: int) -> DataFrame:
    """The next page of ``rows`` by ``keys``, at most 200 rows; a mark of another pattern or scope, or none at all, is an error."""
    if mark is not None:
        try:
            told = json.loads(base64.urlsafe_b64decode(mark.encode()))
            same, last = told["print"] == _print(pattern, scope), told["last"]
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("not a cursor of this scan") from e
        if not same or len(last) != len(keys):
            raise ValueError("the cursor belongs to another pattern or scope")
        later = F.lit(False)
        for k, v in reversed(list(zip(keys, last))):
            later = (F.col(k) > F.lit(v)) | ((F.col(k) == F.lit(v)) & later)
        rows = rows.where(later)
    return rows.orderBy(*keys).limit(min(limit, 200))


#: attempts after which a page is given up
MOST_ATTEMPTS = 3


def repair_code() -> Column:
    """Why a page that was tried is still not there, from the columns error, rejected, inked and empty; the first that tells."""
    return (
        F.when(F.lower("error").contains("dimension"), "dimension-mismatch").when(F.col("error") != "", "reindex-request-failed").when(F.col("rejected"), "ocr-quality-rejected")
        .when(F.col("inked"), "image-only").when(F.col("empty"), "ocr-empty").otherwise("unknown")
    )


def repaired(state: DataFrame, tried: DataFrame) -> DataFrame:
    """The state (doc, page, attempts, code, terminal) of pages after a round of repairs.

    ``tried`` has doc, page, still (missing), error, rejected, inked and empty, one row a page. Pages that are there now
    leave the state; those still missing count an attempt, unless the request or the recognition failed, which is not the page's
    fault. Wrong dimensions and image-only pages are terminal at once, others at the third attempt. Other pages stay.
    """
    now = tried.select("doc", "page", "still", repair_code().alias("_code"))
    both = state.withColumn("_had", F.lit(True)).join(now, ["doc", "page"], "full")
    infra = F.col("_code").isin("reindex-request-failed", "ocr-quality-rejected")
    attempts = F.coalesce("attempts", F.lit(0)) + F.when(infra, 0).otherwise(1)
    terminal = ~infra & (F.col("_code").isin("dimension-mismatch", "image-only") | (attempts >= MOST_ATTEMPTS))
    kept = both.where(F.col("still").isNull() | F.col("still"))
    new = lambda value, old: F.when(F.col("still").isNull(), F.col(old)).otherwise(value).alias(old)
    return kept.select("doc", "page", new(attempts, "attempts"), new(F.col("_code"), "code"), new(terminal, "terminal"))


def to_repair(missing: DataFrame, state: DataFrame) -> DataFrame:
    """(doc, page, eligible) of ``missing`` pages (doc, page): all but those that the state gives up."""
    gone = state.where("terminal").select("doc", "page", F.lit(True).alias("_t")).distinct()
    return missing.join(gone, ["doc", "page"], "left").select("doc", "page", F.col("_t").isNull().alias("eligible"))
