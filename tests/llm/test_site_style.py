from briefmill.llm.site_style import Page, extract, path_importance
from tests.conftest import SF

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body class="page">
<nav><ul><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>not this</p> -->
<header><h1>Site</h1></header><article><header><h1>A  title &amp; more</h1></header><p><b>First&nbsp;line<br>of text<p>Second &lt;b&gt; <i>one</i>,
two.</p><ul><li>item 1<li>item 2</ul><div class="ad">Buy</div><form>Your mail <input></form><table><tr><td>a<td>b</table>
<div id="comments"><p>nice post</p></div></article><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_article_of_a_page():
    assert Page(PAGE).text().split("\n") == ["A title & more", "First line of text", "Second <b> one, two.", "item 1", "item 2", "a", "b"]


def test_odd_markup():
    assert Page("").text() == "" and Page("plain  text").text() == "plain text"
    assert Page("<p>a<p>b</div></p>c").text() == "a\nb\nc"
    assert Page("<div>x<span>y</span>z</div><p>cut &am").text() == "xyz\ncut &am"
    assert Page("<p>one <em>two</em> three").text() == "one two three"
    assert Page("<article><p>in</p></article><p>out</p>").text() == "in"
    assert Page("<b>" * 3000 + "deep" + "<script>" + "x" * 100000).text() == "deep"
    assert Page("<p>a <span class='share'>tweet</span> b</p>").text() == "a\nb"


def test_branches_that_repeat_on_a_host_go(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=top>Welcome to our site</div><div class=story><p>Story {i} is new</p></div><div class=end>All rights</div></body>", "x") for i in range(20)]
    rows += [(100, "http://other.example/", rows[0][2], "x"), (101, None, None, "x"), (102, "", "", "x"), (103, "http://h.example/9", "<p>" + "long text " * 60000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extract(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["text"] == f"Story {i} is new" for i in range(20))
    assert got[100]["text"] == "Welcome to our site\nStory 0 is new\nAll rights"
    assert got[101]["text"] == got[102]["text"] == "" and got[101]["url"] is None
    assert got[103]["n_chars"] == len(("long text " * 60000).strip())
    low = {r["importance"] < 0.3 for r in path_importance(pages.where("page_id < 20")).collect()}
    assert low == {True, False}
    assert extract(pages.limit(0)).count() == 0


def test_query_keeps_the_articles_of_the_table(spark):
    from briefmill.llm.queries import op9_html

    out = op9_html(spark, SF)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in out.collect():
        body = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        assert r["text"] == Page(f"<article>{body}</article>").text() and r["text"]
