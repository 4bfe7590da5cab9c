"""Page HTML to post records, links and index addresses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar, html, urls, votes


@dataclass(frozen=True)
class Layout:
    """Where a site keeps the parts of a post. Patterns give the value in group 1."""

    title: str
    body_start: str
    footer: str
    gate_word: str = "over18-notice"
    gate: str = r'<[^>]*\bclass="(?:[^"]*\s)?over18-notice[\s"]'
    meta: str = r'class="article-meta-value"[^>]*>([^<]*)<'
    author_at: int = 0
    date_at: int = 3
    comment_open: str = '<div class="push">'
    comment_tag: str = r'class="[^"]*push-tag[^"]*"[^>]*>([^<]+)<'
    comment_user: str = r'class="[^"]*push-userid[^"]*"[^>]*>([^<]+)<'
    comment_text: str = r'class="[^"]*push-content[^"]*"[^>]*>([^<]+)<'


# Class names and footer text of the board pages.
BOARD = Layout(
    title=r'<meta[^>]*property="og:title"[^>]*content="([^"]*)"',
    body_start="article-meta-value",
    footer=r"批踢踢實業坊\(ptt.cc\)",
)
# Links of the board's list pages; any link at all is ``ANY_LINKS``.
BOARD_LINKS = r'<div class="r-ent">\s*(?:<div class="nrec">.*?</div>\s*)?<div class="title">\s*<a[^>]*href="([^"]*)"'
ANY_LINKS = r'href="([^"]*)"'

# Plain article pages: no author, date or comments.
ARTICLE = Layout(title=r"<title>([^<]*)</title>", body_start="<article", footer="&copy;")


def without_gates(pages: DataFrame, layout: Layout = BOARD) -> DataFrame:
    """Pages without an element of the age question's class; the word in a text is no such element.

    The pattern is tried only on pages that have the class's name at all.
    """
    page = F.col("html")
    return pages.filter(~(page.contains(layout.gate_word) & page.rlike(layout.gate)))


def _kept_records(pages: DataFrame, record: Column, whole, shown=None) -> DataFrame:
    """One row per page whose ``record`` struct passes ``whole``, with its fields as columns.

    A filter on computed columns would be pushed below their projection and compute all of them a
    second time. Here the record is one array element, computed once per page.
    """
    records = F.filter(F.array(record), whole)
    return pages.select(F.inline(records if shown is None else F.transform(records, shown)))


def page_titles(pages: DataFrame, layout: Layout) -> DataFrame:
    """``(page_id, url, title, html)``; a page without a title is dropped."""
    title = html.decoded(html.first(F.col("html"), layout.title)).alias("title")
    record = F.struct("page_id", "url", title, "html")
    return _kept_records(without_gates(pages, layout), record, lambda r: r["title"].isNotNull())


def page_bodies(pages: DataFrame, layout: Layout) -> DataFrame:
    """``(page_id, url, content)``; a page without both markers is dropped."""
    body = html.body_text(F.col("html"), layout.body_start, layout.footer).alias("content")
    record = F.struct("page_id", "url", body)
    return _kept_records(without_gates(pages, layout), record, lambda r: r["content"].isNotNull())


def posts_from_pages(pages: DataFrame, layout: Layout = BOARD) -> DataFrame:
    """Post records: title, author, posted_at, content, url, comments, score.

    One scan without a shuffle. A page that lacks a part, or has a comment that lacks one, is
    dropped as a whole.
    """
    source = F.col("html")
    pieces = F.split(source, layout.comment_open)

    def found(block: Column) -> Column:
        return F.struct(
            html.decoded(html.first(block, layout.comment_user)).alias("user"),
            html.decoded(html.first(block, layout.comment_text)).alias("content"),
            html.first(block, layout.comment_tag).alias("tag"),
        )

    record = F.struct(
        "page_id",
        "url",
        html.decoded(html.first(source, layout.title)).alias("title"),
        F.transform(html.every(source, layout.meta), html.decoded).alias("meta"),
        html.body_text(source, layout.body_start, layout.footer).alias("content"),
        F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), found).alias("comments"),
    )

    def whole(r: Column) -> Column:
        broken = F.exists(
            r["comments"], lambda c: c["user"].isNull() | c["content"].isNull() | c["tag"].isNull()
        )
        return (
            r["title"].isNotNull()
            & F.get(r["meta"], F.lit(layout.author_at)).isNotNull()
            & calendar.board_time(F.get(r["meta"], F.lit(layout.date_at))).isNotNull()
            & r["content"].isNotNull()
            & ~broken
        )

    def shown(r: Column) -> Column:
        comments = F.transform(
            r["comments"],
            lambda c: F.struct(
                c["user"].alias("user"),
                c["content"].alias("content"),
                votes.vote_code(c["tag"]).alias("score"),
            ),
        )
        return F.struct(
            r["page_id"].alias("page_id"),
            r["url"].alias("url"),
            r["title"].alias("title"),
            F.get(r["meta"], F.lit(layout.author_at)).alias("author"),
            calendar.board_time(F.get(r["meta"], F.lit(layout.date_at))).alias("posted_at"),
            r["content"].alias("content"),
            comments.alias("comments"),
        )

    kept = _kept_records(without_gates(pages, layout), record, whole, shown)
    return kept.withColumn("score", votes.total_score(F.col("comments")))


def page_links(pages: DataFrame, domains: list[str], pattern: str = ANY_LINKS) -> DataFrame:
    """One row per link of a page, in page order, made absolute and checked against the domains."""
    links = pages.select(
        "page_id",
        F.col("url").alias("page_url"),
        F.posexplode(html.every(F.col("html"), pattern)).alias("position", "href"),
    )
    target = links.withColumn("url", urls.absolute(html.decoded(F.col("href")), F.col("page_url")))
    return target.select(
        "page_id",
        "position",
        "href",
        "url",
        urls.host(F.col("url")).alias("host"),
        urls.on_domains(F.col("url"), domains).alias("allowed"),
    )


def followed_links(pages: DataFrame, domains: list[str], pattern: str = BOARD_LINKS) -> DataFrame:
    """``(page_id, position, url)`` of the links a crawl goes on with: those on the domains."""
    return page_links(pages, domains, pattern).filter("allowed").select("page_id", "position", "url")


def index_frontier(sites: DataFrame, stop: int = 0, chunk: int = 10_000) -> DataFrame:
    """Addresses of a site's list pages: ``index.html``, then downwards to ``index{stop+2}.html``.

    ``sites`` has ``base_url`` and ``pages``; counting starts one below ``pages``. A site with
    very many pages is first cut into ranges that are spread over the cluster, so no row holds
    more than ``chunk`` numbers.
    """
    top, low = F.col("pages") - 1, F.lit(stop + 2)
    ranges = (
        sites.filter(top >= low)
        .select(
            "base_url",
            top.alias("_top"),
            F.explode(F.sequence(low.cast("long"), top, F.lit(chunk).cast("long"))).alias("_from"),
        )
        .repartition("base_url", "_from")
    )
    numbered = ranges.select(
        "base_url",
        F.explode(
            F.sequence("_from", F.least(F.col("_from") + (chunk - 1), F.col("_top")))
        ).alias("page_no"),
    )
    first = sites.select("base_url", F.lit(None).cast("long").alias("page_no"))
    number = F.coalesce(F.col("page_no").cast("string"), F.lit(""))
    return first.unionByName(numbered).withColumn(
        "url", F.concat("base_url", F.lit("index"), number, F.lit(".html"))
    )
