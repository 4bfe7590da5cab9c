"""Columns cut out of HTML text with native string functions; there is no DOM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entities that are decoded. The ampersand comes last.
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]


def decoded(text: Column) -> Column:
    """Text with its entities replaced."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain(html: Column) -> Column:
    """Text nodes of a piece of HTML, joined without anything between them."""
    return decoded(F.regexp_replace(html, r"<[^>]*>", ""))


def first(html: Column, pattern: str) -> Column:
    """Group 1 of the first match; null when nothing matches (also for a dropped row's filter)."""
    return F.get(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.lit(0))


def every(html: Column, pattern: str) -> Column:
    """Group 1 of every match, in order."""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def body_text(html: Column, start: str, footer: str) -> Column:
    """Text between two markers, null when either is missing.

    It starts after the element that holds the *last* ``start`` literal and stops before the tag
    whose text holds the first match of the ``footer`` pattern.
    """
    after = F.when(html.contains(start), F.substring_index(html, start, -1))
    inner = F.regexp_replace(after, r"^[^>]*>[^<]*", "")
    return plain(first(inner, rf"(?s)^(.*?)<[^<>]*>[^<>]*(?:{footer})"))
