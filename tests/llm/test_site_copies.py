"""Pages that repeat on a host."""

from briefmill.llm.site_style import extract


def page(story):
    return f"<body><div class=top>Welcome to our site</div><div class=story><p>{story}</p></div></body>"


def test_articles_of_repeated_pages_stay(spark):
    rows = [(i, f"http://one.example/{i % 3}", page("The only story")) for i in range(30)]
    rows += [(100 + i, f"http://four.example/{i}", page(f"Story {i % 4}")) for i in range(100)]
    rows += [(300 + i, f"http://many.example/{i % 12}", page(f"Story {i % 12}")) for i in range(300)]
    got = {r["page_id"]: r["text"].split("\n") for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i][-1] == "The only story" for i in range(30))
    assert all(got[100 + i][-1] == f"Story {i % 4}" for i in range(100))
    # twelve distinct pages tell that the head repeats
    assert all(got[300 + i] == [f"Story {i % 12}"] for i in range(300))
