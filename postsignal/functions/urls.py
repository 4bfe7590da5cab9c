"""URL columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Host of an absolute URL, lower-case; ``''`` when there is none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def on_domains(url: Column, domains: Iterable[str]) -> Column:
    """True for URLs on one of the domains or on a sub-domain of one."""
    name = host(url)
    allowed = F.lit(False)
    for domain in domains:
        allowed = allowed | (name == domain) | name.endswith("." + domain)
    return allowed


def _without_dots(path: Column) -> Column:
    """Path with its ``.`` and ``..`` steps carried out."""
    steps = F.split(path, "/")
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, step: F.when(step == ".", done)
        .when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(step))),
    )
    tail = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.concat(F.array_join(kept, "/"), tail)


def absolute(href: Column, base: Column) -> Column:
    """``href`` seen from the page at ``base``."""
    origin = F.regexp_extract(base, _ORIGIN, 1)
    base_path = F.regexp_extract(base, _PATH, 1)
    folder = F.when(base_path == "", "/").otherwise(F.regexp_replace(base_path, r"[^/]*$", ""))
    href_path = F.regexp_extract(href, r"^[^?#]*", 0)
    href_rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    full_path = F.when(href.startswith("/"), href_path).otherwise(F.concat(folder, href_path))
    tidy = F.when(full_path.rlike(r"/\.{1,2}(/|$)"), _without_dots(full_path)).otherwise(full_path)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:]*:", 0), href))
        .when(href == "", F.regexp_replace(base, r"#.*$", ""))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, base_path, href))
        .otherwise(F.concat(origin, tidy, href_rest))
    )
