from pyspark.sql import functions as F

from postsignal.operators import pages

META = '<span class="article-meta-value">{}</span>'
PUSH = (
    '<div class="push"><span class="hl push-tag">{} </span><span class="push-userid">{}</span>'
    '<span class="push-content">{}</span></div>'
)


def page(metas, pushes, footer="※ 發信站: 批踢踢實業坊(ptt.cc)", title="[新聞] t"):
    head = f'<meta property="og:title" content="{title}">' if title else ""
    return (
        f"<html><head>{head}</head><body><div>{''.join(META.format(m) for m in metas)}</div>"
        f"first line\n<b>bold</b> a &lt; b<span class=\"f2\">{footer}</span>tail{''.join(pushes)}</body></html>"
    )


WHEN = "Wed Apr  5 12:34:56 2017"
PUSHES = [PUSH.format("推", "u1", ": yes"), PUSH.format("噓", "u2", ": no"), PUSH.format("→", "u3", ": so")]


def posts(spark, *htmls):
    rows = [(i, f"https://b/{i}", h) for i, h in enumerate(htmls)]
    return pages.posts_from_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()


def test_a_whole_page(spark):
    (got,) = posts(spark, page(["ann (A)", "Board", "t", WHEN], PUSHES))
    assert got["title"] == "[新聞] t" and got["author"] == "ann (A)"
    assert str(got["posted_at"]) == "2017-04-05 12:34:56"
    assert got["content"] == "first line\nbold a < b"
    assert [(c["user"], c["content"], c["score"]) for c in got["comments"]] == [
        ("u1", ": yes", 1),
        ("u2", ": no", -1),
        ("u3", ": so", 0),
    ]
    assert got["score"] == 0


def test_pages_that_lack_a_part_are_dropped(spark):
    full = ["ann", "Board", "t", WHEN]
    bad = [
        '<div class="over18-notice">18?</div>' + page(full, PUSHES),
        page(full[1:], PUSHES),
        page(["ann", "Board", "t", "no date"], PUSHES),
        page(full, PUSHES, footer="another site"),
        page(full, PUSHES, title=None),
        page(full, [*PUSHES, '<div class="push"><span class="push-tag">推</span></div>']),
    ]
    assert posts(spark, *bad) == []


def test_a_page_without_comments_has_score_zero(spark):
    (got,) = posts(spark, page(["ann", "Board", "t", WHEN], []))
    assert got["comments"] == [] and got["score"] == 0


def test_index_addresses(spark):
    sites = spark.createDataFrame([("https://b/", 25_007), ("https://c/", 1)], "base_url string, pages long")
    got = pages.index_frontier(sites, chunk=100).groupBy("base_url").agg(
        F.count("*").alias("n"), F.count_distinct("url").alias("d"), F.min("page_no"), F.max("page_no")
    )
    assert {tuple(r) for r in got.collect()} == {
        ("https://b/", 25_006, 25_006, 2, 25_006),
        ("https://c/", 1, 1, None, None),
    }


def test_links_of_a_list_page(spark):
    entry = '<div class="r-ent"><div class="nrec">1</div><div class="title">\n\t{}</div></div>'
    body = entry.format('<a href="/bbs/b/M.1.html">one</a>') + entry.format("(deleted)") + '<a href="/other">x</a>'
    df = spark.createDataFrame([(1, "https://www.b.example/bbs/b/index2.html", body)], "page_id long, url string, html string")
    got = [tuple(r) for r in pages.page_links(df, ["b.example"], pages.BOARD_LINKS).collect()]
    assert got == [(1, 0, "/bbs/b/M.1.html", "https://www.b.example/bbs/b/M.1.html", "www.b.example", True)]


def test_the_gates_name_in_a_text_is_no_gate(spark):
    rows = [
        (1, '<p>over18-notice</p><a title="over18-notice">x</a>'), (2, '<div class="a over18-notice b">x</div>'),
        (3, "<div id='z' class=\"over18-notice\">x</div>"), (4, '<div class="not-over18-notice">x</div>'),
    ]
    left = pages.without_gates(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert sorted(r["page_id"] for r in left) == [1, 4]


def test_a_document_without_comments_has_a_page(spark):
    from conftest import DATA

    from postsignal.plans import catalog, tables

    made = tables.board_pages(spark, DATA)
    assert made.count() == tables.table(spark, DATA, "documents").count() == 200
    bare = catalog.CATALOG["board_page_posts_all"](spark, DATA).filter("n_comments = 0").collect()
    talked = {r[0] for r in tables.comments(spark, DATA).select("post_id").distinct().collect()}
    ids = {r["doc_id"] for r in tables.table(spark, DATA, "documents").collect()} - talked
    assert {r["post_id"] for r in bare} == {i for i in ids if i % 50 < 48} and len(ids) == 100
    assert all(r["posted_at"].startswith("2024-01-") and r["score"] == 0 and r["users"] == "" for r in bare)
