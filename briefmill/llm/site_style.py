"""HTML extraction by site style trees (operator 9).

The DOMs of a host's pages are merged by the paths of their elements (tag and class). For each path, the presentations
(sequences of child elements) and the contents (texts anywhere in its branch) of all its pages are counted; their
entropies make the branch's importance: contents that differ from page to page are important, contents that repeat on
every page are not. From each page the branches of low importance go, unless they hold over three quarters of its text: then it
is the article that repeats, in near copies of the page. Before that, fixed lists of tags, roles and class names decide what a
tree cannot tell: adverts and reader comments differ from page to page as the article does. Where a page has articles,
and at least a quarter of its text is in them, only what is in them counts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.llm.scratch import broadcast_if_small, settle

#: weight of the contents against the presentation in a path's importance, and what counts as low
CONTENT_WEIGHT, LOW = 0.9, 0.3
#: a host with fewer pages on a path tells nothing about it
LEAST_PAGES = 4

#: a quote counts only where a value begins, so that an odd one elsewhere does not swallow the tag's end
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: an opening tag closes open elements of these names, up to the nearest of the second
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend"}
_NEVER = frozenset("script style noscript template textarea title iframe head nav footer aside form button select dialog menu svg canvas object audio video input label xmp noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|breadcrumbs?|masthead|topbar|banner|footer|foot|sidebar\w*|side|aside|ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter"
    r"|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|repl(?:y|ies)|search|form|widgets?|pagination|pager|toolbar|skip|copyright|disclaimer)(?=$|[\s_\d-])",
    re.I,
)
#: within an article a class counts only if it is made of such names and of these words: 'comment-list', but not 'related-work'
_PLAIN = re.compile(r"list|items?|box|block|section|area|container|wrap(?:per)?|inner|outer|main|links?|bar|buttons?|posts?|content|slot|unit|top|bottom|left|right|form|[a-z]?\d*", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_\d-])", re.I)


class Page:
    """Elements (parent, path, dropped, in_article) and text blocks (element, text) of a page, in page order."""

    def __init__(self, source: str) -> None:
        self.parent, self.path, self.tag, self.dropped, self.in_article = [-1], [""], [""], [False], [False]
        self.children: list[list[str]] = [[]]
        self.blocks: list[tuple[int, str]] = []
        self._text: list[str] = []
        self._block = 0
        stack, at, raw = [0], 0, source
        while True:
            m = _TOKEN.search(raw, at)
            self._text.append(raw[at : m.start() if m else len(raw)])
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._close(stack, name)
            else:
                self._open(stack, name, m[3])
                if name in _RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(raw, at)
                    at = end.end() if end else len(raw)
                    self._flush(stack.pop())
                    self._block = stack[-1]
        self._flush(stack[-1])

    def _flush(self, after: int) -> None:
        text = " ".join(html.unescape("".join(self._text)).split())
        self._text = []
        if text:
            self.blocks.append((self._block, text))
        self._block = after

    def _close(self, stack: list[int], name: str) -> None:
        if not any(self.tag[n] == name for n in stack):
            return
        while True:
            n = stack.pop()
            if self.tag[n] in _BLOCK or self.dropped[n] != self.dropped[stack[-1]]:
                self._flush(stack[-1])
            if self.tag[n] == name:
                break
        if self._text == [] or self.tag[n] in _BLOCK:
            self._block = stack[-1]

    def _open(self, stack: list[int], name: str, rest: str) -> None:
        if name == "br" or name == "wbr":
            self._text.append("\n" if name == "br" else "")
            return
        if name in _ENDS_P and any(self.tag[n] == "p" for n in stack):
            self._close(stack, "p")
        if name in _CLOSES:
            names, stop = _CLOSES[name]
            for n in reversed(stack):
                if self.tag[n] in stop:
                    break
                if self.tag[n] in names:
                    self._close(stack, self.tag[n])
        words = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest else {}
        up = stack[-1]
        kind = f"{name}.{'.'.join(sorted(words.get('class', '').split()))}"
        n = len(self.parent)
        self.parent.append(up)
        self.tag.append(name)
        self.path.append(f"{self.path[up]}/{kind}")
        self.children.append([])
        self.children[up].append(kind)
        named = f"{words.get('class', '')} {words.get('id', '')}"
        inside = self.in_article[up]
        by_name = bool(named.strip()) and bool(_NAMES.search(named)) and (not inside or any(_wholly_named(w) for w in named.split()))
        gone = (
            self.dropped[up]
            or name in _NEVER
            or words.get("role", "").lower() in _ROLES
            or "hidden" in words
            or words.get("aria-hidden") == "true"
            or "display:none" in words.get("style", "").replace(" ", "").lower()
            or (name not in ("html", "body", "main") and by_name)
            or (not inside and (name == "header" or (name not in ("html", "body", "main") and bool(_HEADER.search(named)))))
        )
        self.dropped.append(gone)
        self.in_article.append(inside or (name in ("article", "main") and not gone))
        if name in _BLOCK or gone != self.dropped[up]:
            self._flush(n)
        if name not in _VOID:
            stack.append(n)

    def keys(self) -> list[int]:
        """The hash of each element's path."""
        known: dict[str, int] = {}
        for path in self.path:
            if path not in known:
                known[path] = path_key(path)
        return [known[p] for p in self.path]

    def text(self, low: frozenset[int] = frozenset()) -> str:
        """The blocks that are in no dropped branch and in none of ``low`` importance, one a line."""
        kept = [(n, t) for n, t in self.blocks if not self.dropped[n]]
        if low:
            gone, keys = [False], self.keys()
            for n in range(1, len(self.parent)):
                gone.append(gone[self.parent[n]] or keys[n] in low)
            left = [(n, t) for n, t in kept if not gone[n]]
            if 4 * _size(left) >= _size(kept):
                kept = left
        inside = [(n, t) for n, t in kept if self.in_article[n]]
        return "\n".join(t for _, t in (inside if 4 * _size(inside) >= _size(kept) else kept))


def _size(blocks: list[tuple[int, str]]) -> int:
    return sum(len(t) for _, t in blocks)


def _wholly_named(word: str) -> bool:
    parts = [p for p in re.split(r"[_-]+", word) if p]
    return any(_NAMES.fullmatch(p) for p in parts) and all(_NAMES.fullmatch(p) or _PLAIN.fullmatch(p) for p in parts)


def path_key(path: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(path) - (1 << 63)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


_SEEN = "host string, path long, kind int, feature long, pages long"


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's counts of pages by (host, path, kind, feature): kind 0 presence, 1 presentations, 2 contents."""
    from collections import Counter

    count: Counter = Counter()

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*((*k, v) for k, v in count.items()), strict=True)) or [()] * 5
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["host", "path", "kind", "feature", "pages"])

    for batch in batches:
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page, host, seen = Page(source or ""), host_of(url), set()
            keys = page.keys()
            for n in range(1, len(keys)):
                seen.add((host, keys[n], 0, 0))
                # runs of equal children are one: lists of any length look alike
                seen.add((host, keys[n], 1, path_key(" ".join(c for i, c in enumerate(page.children[n]) if i == 0 or page.children[n][i - 1] != c))))
            for n, text in page.blocks:
                of = path_key(text)
                while n > 0:  # a branch is as important as what is in it
                    seen.add((host, keys[n], 2, of))
                    n = page.parent[n]
            count.update(seen)
            if len(count) > 200_000:
                yield batch_of()
                count.clear()
    yield batch_of()


def path_importance(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, m, importance) of the merged trees: m distinct pages have the path; importance from 0 to 1, 1 where m is 1.

    A presentation's part is the entropy, to base m, of the presentations; a content's importance falls with the share
    of the pages that hold it: one less the mean of log(its pages) / log(m) over the contents of all the branch's pages.
    """
    rows = pages.select(F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    # copies of a page on its host are one page, else the article of a page that is often repeated looks like a menu
    keyed = rows.withColumns({"h1": F.xxhash64(_host("url"), "html"), "h2": F.xxhash64(F.lit(1), _host("url"), "html")})
    copied = broadcast_if_small(settle(keyed.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")))
    # only pages that have copies are shuffled
    once = keyed.join(copied, ["h1", "h2"], "left_anti")
    one = once.unionByName(keyed.join(copied, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]))
    seen = one.select("url", "html").mapInArrow(_observe, _SEEN)
    each = seen.groupBy("host", "path", "kind", "feature").agg(F.sum("pages").alias("k"))
    m = F.max(F.when(F.col("kind") == 0, F.col("k")))
    total = F.sum(F.when(F.col("kind") == 1, F.col("k")))
    shown = F.sum(F.when(F.col("kind") == 1, F.col("k") * F.log("k")))
    repeat = F.sum(F.when(F.col("kind") == 2, F.col("k") * F.log("k"))) / F.sum(F.when(F.col("kind") == 2, F.col("k")))
    by = each.groupBy("host", "path").agg(m.alias("m"), total.alias("n"), shown.alias("s"), repeat.alias("r"))
    presentation = F.when(F.col("m") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("m")).otherwise(1.0)
    content = F.when(F.col("m") > 1, 1 - F.coalesce(F.col("r"), F.lit(0.0)) / F.log("m")).otherwise(1.0)
    return by.select("host", "path", "m", ((1 - CONTENT_WEIGHT) * presentation + CONTENT_WEIGHT * content).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text`` (blocks joined by line ends, empty if none) and ``n_chars``.

    A null html counts as empty; pages without a host in their url form one host. Repeated rows are extracted each, and
    count as one page of their host. Of a host with fewer than ``LEAST_PAGES`` distinct pages on a path nothing is known
    there, and only the lists decide. Other columns are ignored, whatever their names.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    low = path_importance(rows).where((F.col("m") >= LEAST_PAGES) & (F.col("importance") < LOW))
    low = settle(low.groupBy("host").agg(F.collect_list("path").alias("low")))
    size = low.agg(F.sum(F.size("low")), F.count("*")).first()
    small = (size[0] or 0) + size[1] <= 500_000
    joined = rows.withColumn("h", _host("url")).join(F.broadcast(low) if small else low, F.col("h") == F.col("host"), "left").select("id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source or "").text(frozenset(paths or ())) for source, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
