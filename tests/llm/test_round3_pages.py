"""Pages with a marked article take part in the comparison."""

from sylvan.llm import html_text


def test_marked_pages_are_compared_too(spark):
    frame = ["Welcome to our site, enjoy", "All about this site and more"]
    body = lambda *own: f"<body><div>{frame[0]}</div>{''.join(own)}<div>{frame[1]}</div></body>"
    pages = [(1, "http://h.org/a", body("<p>Only page without an article</p>")), (2, "http://h.org/b", body("<article><p>First</p><p>Said twice</p></article>")),
             (3, "http://h.org/c", body("<article><p>Second</p><p>Said twice</p></article>")), (4, "http://z.org/", body("<article><p>Alone</p></article>"))]
    got = {r["page_id"]: (r["text"], r["n_repeated"]) for r in html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    # page 1 kept the frame before: the marked pages beside it were no partners
    assert got[1] == ("Only page without an article", 2)
    assert got[2][0] == "First\nSaid twice" and got[2][1] >= 2 and got[3] == ("Second\nSaid twice", 3)
    assert got[4] == ("Alone", 0)
