"""Intervals of elements on pages written by hand, and bodies between them."""

from html.parser import HTMLParser
from random import Random

import pytest

from postsignal.operators import elements, pages
from postsignal.operators.elements import VOID


def found(spark, page):
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    return sorted((r["start"], r["stop"], r["name"]) for r in elements.elements(df).collect())


def test_nested_void_and_own_closed(spark):
    page = "<div><p>a<br>b</p><div class='x'>c</div><img src='y'/></div>"
    assert found(spark, page) == [(0, 10, "div"), (1, 5, "p"), (3, 3, "br"), (6, 8, "div"), (9, 9, "img")]


def test_unbalanced_pages(spark):
    assert found(spark, "</p><p>a<b>x</p></b></p>") == [(1, 5, "p"), (3, 6, "b")]
    assert found(spark, "<div><p>a<p>b</div> < 3") == [(0, 5, "div"), (1, 9, "p"), (3, 9, "p")]
    assert found(spark, "<!-- <p> --><P>x</p >") == [(1, 3, "p")]
    assert found(spark, "") == found(spark, None) == found(spark, "no tags") == []


class Intervals(HTMLParser):
    """Opening and closing tags of balanced pages by a stack."""

    def __init__(self):
        super().__init__()
        self.at, self.open, self.found = 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.found.append((self.at, self.at, tag))
        else:
            self.open.append((self.at, tag))
        self.at += 1

    def handle_endtag(self, tag):
        start, name = self.open.pop()
        assert name == tag
        self.found.append((start, self.at, tag))
        self.at += 1

    def handle_data(self, data):
        self.at += 1


def test_random_balanced_pages_equal_a_stack(spark):
    draw = Random(4)

    def element(depth):
        name = draw.choice(["div", "p", "span", "br", "hr"])
        if name in VOID:
            return f"<{name}>"
        inner = "".join(draw.choice([lambda: element(depth + 1), lambda: "<i></i>"])() + draw.choice(["", "text "]) for _ in range(draw.randint(0, 3))) if depth < 5 else "t"
        return f"<{name} class=\"c{depth}\">{inner}</{name}>"

    made = {i: "".join(element(0) for _ in range(3)) for i in range(40)}
    df = spark.createDataFrame(list(made.items()), "page_id long, html string")
    got = {}
    for r in elements.elements(df).collect():
        got.setdefault(r["page_id"], []).append((r["start"], r["stop"], r["name"]))
    for i, page in made.items():
        parser = Intervals()
        parser.feed(page)
        assert sorted(got[i]) == sorted(parser.found), page


FOOT = "※ 發信站: 批踢踢實業坊(ptt.cc)"


@pytest.mark.parametrize(
    "page, body",
    [
        (f'<div><span class="article-meta-value">a</span>x &lt;<b>y</b>\n<span class="f2">{FOOT}</span></div>', "x <y\n"),
        (f'<span class="b article-meta-value">a</span>one<span class="article-meta-value">b</span>two<p><i>q</i>{FOOT}</p>', "two"),
        (f'<span class="article-meta-value">a</span>x<div>y<span>z</span>w {FOOT}</div>', "x"),
        (f'<span class="not-article-meta-value">a</span>x<p>{FOOT}</p>', None),
        ('<span class="article-meta-value">a</span>x', None),
        (f'<p>{FOOT}</p><span class="article-meta-value">a</span>x', None),
        (f'<p><span class="article-meta-value">a</span>x {FOOT}</p>', None),
        (None, None),
    ],
)
def test_bodies(spark, page, body):
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [r["content"] for r in elements.bodies(df).collect()] == [body]


def test_bodies_of_rendered_pages_equal_the_pattern(spark):
    from conftest import DATA

    from postsignal.plans import tables

    shown = pages.without_gates(tables.board_pages(spark, DATA))
    by_pattern = {r["page_id"]: r["content"] for r in pages.page_bodies(shown, pages.BOARD).collect()}
    by_interval = {r["page_id"]: r["content"] for r in elements.bodies(shown).collect()}
    assert by_interval == by_pattern and len(by_interval) > 190


def test_a_task_sorts_no_more_as_pages_get_more(spark, monkeypatch):
    """Parts are as many as the pages' characters ask for; the elements are the same."""
    page = "<div><p>a<b>x</b></p></div>" * 20
    df = spark.createDataFrame([(i, page) for i in range(40)], "page_id long, html string")
    few = {tuple(r) for r in elements.elements(df).collect()}
    monkeypatch.setattr(elements, "PART", len(page))
    many = elements.elements(df)
    assert many.rdd.getNumPartitions() == 41 and {tuple(r) for r in many.collect()} == few and len(few) == 40 * 60
