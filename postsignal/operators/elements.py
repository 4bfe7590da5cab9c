"""Elements of HTML pages as intervals of their tokens, and page bodies found by them.

A page is a row of tokens, tags and texts in turn; a token's place is its number. An element is the
interval from its opening tag to the closing tag of the same name and level, where a level is a running
sum of opening and closing tags of that name. Containment and parents are then comparisons of places.
Only names and places of tags are spread into rows; texts stay in their pages.

Closing tags that close nothing count for nothing. An element that is never closed reaches to the end
of the page; one that has no content by its name, or is closed in its own tag, holds nothing. Comments are
tags without a name. Null and empty pages have no elements. Page ids must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html
from ..session import written
from .pages import BOARD, Layout

#: Characters of pages that are dealt to one task, more only if a page is longer.
PART = 4_000_000
TOKEN = r"(?s)<!--.*?-->|<[a-zA-Z/!][^>]*>|[^<]+|<"
OPENING, CLOSING = r"^<([a-zA-Z][a-zA-Z0-9]*)", r"^</([a-zA-Z][a-zA-Z0-9]*)"
# Elements that have no content.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


def tokens(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(TOKEN), F.lit(0))


def _spread(pages: DataFrame) -> DataFrame:
    """``(page_id, place, size, token)`` of all tokens that are tags."""

    def tags(every: Column) -> Column:
        shown = F.transform(every, lambda t, i: F.struct(i.alias("place"), F.size(every).alias("size"), t.alias("token")))
        return F.filter(shown, lambda x: x["token"].startswith("<"))

    # The page is taken apart once, and only its tags leave it.
    return pages.select("page_id", F.inline(F.get(F.transform(F.array(tokens(F.col("html"))), tags), F.lit(0))))


def _parts(pages: DataFrame) -> int:
    """Number of parts that ``pages`` and what is made of them are dealt into, so that a part does not grow with the table."""
    length = pages.agg(F.sum(F.length("html"))).first()[0] or 0
    return max(pages.sparkSession.sparkContext.defaultParallelism, length // PART + 1)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "page_id")


def elements(pages: DataFrame) -> DataFrame:
    """``(page_id, start, stop, name, tag)`` of all elements; ``stop`` is the place of the closing tag.

    ``pages`` is read twice and should be a stored table.
    """
    token = F.lower("token")
    opened, closed = F.regexp_extract(token, OPENING, 1), F.regexp_extract(token, CLOSING, 1)
    name = F.when(opened != "", opened).otherwise(closed)
    alone = name.isin(VOID) | F.col("token").endswith("/>")
    step = F.when(opened != "", F.when(alone, 0).otherwise(1)).otherwise(F.when(alone, 0).otherwise(-1))
    # All windows are within a page, so tags are dealt by page once.
    tags = _dealt(_spread(pages), _parts(pages)).withColumns({"name": name, "step": step}).filter("name <> '' and (step <> 0 or not startswith(token, '</'))")
    in_name = Window.partitionBy("page_id", "name").orderBy("place")
    running = F.sum("step").over(in_name)
    placed = tags.withColumn("running", running).withColumn("low", F.least(F.min("running").over(in_name), F.lit(0)))
    before = F.coalesce(F.lag("low").over(in_name), F.lit(0))
    # A closing tag that takes the sum to a new low has nothing to close.
    stray = (F.col("step") == -1) & (F.col("low") < before)
    level = F.col("running") - F.col("low") + F.when(F.col("step") == -1, 1).otherwise(0)
    kept = placed.withColumn("stray", stray).withColumn("level", level).filter("not stray")
    at_level = Window.partitionBy("page_id", "name", "level", F.col("step") == 0).orderBy("place")
    until = F.when(F.col("step") == 0, F.col("place")).otherwise(F.coalesce(F.lead("place").over(at_level), F.col("size")))
    return kept.withColumn("stop", until).filter("step >= 0").select("page_id", F.col("place").alias("start"), "stop", "name", F.col("token").alias("tag"))


def has_class(tag: Column, name: str) -> Column:
    return tag.rlike(rf"""\bclass\s*=\s*["']?(?:[^"'>]*[\s"'])?{name}(?:[\s"'>]|$)""")


def bodies(pages: DataFrame, layout: Layout = BOARD) -> DataFrame:
    """``(page_id, content)``: texts after the last start element's first text, up to the footer's parent.

    The footer is the first text that its pattern matches, and its parent the innermost element that
    holds it. Null where there is no start, no footer, or the parent begins before the start. ``pages``
    is read several times and should be a stored table.
    """
    # All joins are by page: their sides are dealt alike, and so sorted in small parts.
    parts = _parts(pages)
    every, pages = _dealt(written(elements(pages)), parts), _dealt(pages, parts)
    last = every.filter(has_class(F.col("tag"), layout.body_start)).groupBy("page_id").agg(F.max("start").alias("begin"))
    texts = F.transform(tokens(F.col("html")), lambda t, i: F.struct(i.alias("place"), t.alias("text")))
    footers = F.filter(texts, lambda x: (~x["text"].startswith("<")) & x["text"].rlike(layout.footer))
    found = pages.select("page_id", F.get(footers, F.lit(0))["place"].alias("footer"))
    around = (F.col("start") < F.col("footer")) & (F.col("footer") < F.col("stop"))
    parent = every.join(found, "page_id").filter(around).groupBy("page_id").agg(F.max("start").alias("end"))
    bounds = last.join(parent, "page_id").filter("begin < end")

    def between(page: Column) -> Column:
        return F.transform(F.array(page), lambda p: F.slice(p, F.col("begin") + 2, F.col("end") - F.col("begin") - 1))[0]

    inner = between(tokens(F.col("html")))
    # The element's own first text is not the body's.
    own = F.transform(inner, lambda t, i: F.when(t.startswith("<") | (i == 0), "").otherwise(t))
    return pages.join(bounds, "page_id", "left").select(
        "page_id", F.when(F.col("begin").isNotNull(), html.decoded(F.array_join(own, ""))).alias("content")
    )
