"""The merged tree against a slow one, and what it may and may not remove."""

import math
import random
from collections import Counter, defaultdict

from briefmill.llm.site_style import CONTENT_WEIGHT, Page, extract, host_of, path_importance, path_key


def slow_tree(pages):
    """{(host, path): (m, importance)} by sets of pages, for pages whose html differs."""
    has, shown, told = defaultdict(set), defaultdict(Counter), defaultdict(lambda: defaultdict(set))
    for i, (url, source) in enumerate(pages):
        page, host = Page(source), host_of(url)
        looks = defaultdict(set)
        for n in range(1, len(page.path)):
            has[host, page.path[n]].add(i)
            runs = [c for k, c in enumerate(page.children[n]) if not k or page.children[n][k - 1] != c]
            looks[page.path[n]].add(" ".join(runs))
        for path, kinds in looks.items():
            shown[host, path].update(kinds)
        for n, text in page.blocks:
            while n > 0:
                told[host, page.path[n]][text].add(i)
                n = page.parent[n]
    out = {}
    for key, of in has.items():
        m = len(of)
        if m == 1:
            out[key] = (1, 1.0)
            continue
        total = sum(shown[key].values())
        entropy = -sum(k / total * math.log(k / total) for k in shown[key].values()) / math.log(m)
        shares = [math.log(len(x)) / math.log(m) for x in told[key].values() for _ in x]
        out[key] = (m, (1 - CONTENT_WEIGHT) * entropy + CONTENT_WEIGHT * (1 - (sum(shares) / len(shares) if shares else 0)))
    return out


def test_importance_is_that_of_a_slow_tree(spark):
    rng = random.Random(2)
    pages = []
    for i in range(40):
        extra = "".join(f"<li>{rng.randrange(5)}</li>" for _ in range(rng.randrange(4)))
        pages.append((f"http://h{i % 3}.example/{i}", f"<body><nav>same</nav><div class='b a'><p>text {rng.randrange(30)}</p><p>{i}</p><ul>{extra}</ul></div><footer><p>end</p></footer></body>"))
    got = {(r["host"], r["path"]): (r["m"], r["importance"]) for r in path_importance(spark.createDataFrame(pages, "url string, html string")).collect()}
    want = {(h, path_key(p)): x for (h, p), x in slow_tree(pages).items()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_the_tree_changes_pages_that_no_list_knows(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=x1><span>Edition of today</span><div class=y>{'seen once' if i == 3 else 'Our rates'}</div></div><div class=x2><p>Event number {i} took place and was long talked about</p></div></body>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    with_tree = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    for i, _, source in rows:
        story = f"Event number {i} took place and was long talked about"
        assert Page(source).text() != story and with_tree[i].endswith(story)
        assert with_tree[i] == story
    # the whole branch went, also what page 3 alone has in it


def test_near_copies_of_an_article_keep_it(spark):
    story = "".join(f"<p>Paragraph {k} of the only story that this host has.</p>" for k in range(9))
    rows = [(i, f"http://copy.example/{i}", f"<body><div class=x1>Edition</div><article>{story}<p>Copy {i}</p></article></body>") for i in range(30)]
    for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r["text"].count("\n") == 9 and "Edition" not in r["text"]


def test_names_within_an_article_and_odd_quotes():
    for name in ("search-results", "related-work", "reply-brief", "form-10k"):
        assert Page(f"<article><p>a</p><div class={name}>b</div></article>").text() == "a\nb"
    for name in ("comments", "comment-list", "ad-box", "share-buttons", "newsletter"):
        assert Page(f"<article><p>a</p><div class={name}>b</div></article>").text() == "a"
    assert Page('<p class=x">one</p>').text() == "one" and Page('<p title="a" b">hello</p>').text() == "hello"
    assert Page("<p title='a > b'>hello</p><p a = \"c>d\" e>x</p>").text() == "hello\nx"
    assert Page("<article><p>teaser</p></article><div><p>" + "The story beside it. " * 9 + "</p></div>").text().startswith("teaser\nThe story")
    assert Page("<a " + "x='" * 5000 + "<p>y").text() in ("", "y")
