"""Hosts, paths and rules against string operations, model arithmetic, and odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from postsignal.llm import url_filter
from postsignal.llm.url_filter import CAPITALS, RULES, SMALL

DATA = "/root/testdata/sf0.01"


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end].translate(str.maketrans(CAPITALS, SMALL)), rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None,))[0]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{DATA}/pages.parquet")


def test_whole_table(pages):
    urls = {r["page_id"]: r["url"] for r in pages.select("page_id", "url").collect()}
    got = url_filter.judge(pages).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got} == {i: plain(u) for i, u in urls.items()}
    verdicts = {h + p: v for v, h, p in RULES}
    assert all(r["verdict"] == verdicts[r["rule"]] for r in got if r["rule"])
    assert {r["verdict"] for r in got if not r["rule"]} == {"allow", "block"}


ODD = [
    None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net/", "http://net", "http://xnet/", "a://b.example.NET/en/?q#f", "x://example.net/en",
    "http://é.org/fr/ü#/x", "http://org?x/fr/", "http://a\nb.net/c", "://m.net//", "http://u:p@h.net:80/a?b", "http://example.com/de/" + "y" * 30_000,
]


def test_odd_rows(spark):
    rows = [(i, u, "lang") for i, u in enumerate(ODD)] + [(None, "http://a.net/", "x"), (1, ODD[1], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got}
    assert {i: by_id[i] for i in range(len(ODD))} == {i: plain(u) for i, u in enumerate(ODD)}
    assert {r["verdict"] for r in got if r["page_id"] in (0, 1, 2)} == {"allow"}
    assert url_filter.judge(pages.limit(0)).collect() == []


def model_by_hand(lines, order):
    """Probability of a character after a context, from counts of all sequences."""
    counts = {}
    for line in lines:
        padded = "\x02" * order + line + "\x03"
        for at in range(order, len(padded)):
            for size in range(1, order + 2):
                seq = padded[at - size + 1 : at + 1]
                counts[seq] = counts.get(seq, 0) + 1
    after = {}
    for seq, n in counts.items():
        after.setdefault(seq[:-1], []).append(n)

    def probability(seq):
        lower = 1 / url_filter.SYMBOLS if len(seq) == 1 else probability(seq[1:])
        follow = after.get(seq[:-1])
        if not follow:
            return lower
        return max(counts.get(seq, 0) - 0.5, 0) / sum(follow) + 0.5 * len(follow) / sum(follow) * lower

    return probability


def test_differences_and_verdicts_equal_a_model_over_all_sequences(pages):
    order = url_filter.ORDER
    got = url_filter.judge(pages).collect()
    held = url_filter.parsed(pages).select("page_id", "ruled", (F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0).alias("out")).collect()
    out, ruled = {r["page_id"]: r["out"] for r in held}, {r["page_id"]: r["ruled"] for r in held}
    line = {r["page_id"]: r["host"] + r["path"] for r in got}
    models = {c: model_by_hand([line[i] for i in line if ruled[i] == c and not out[i]], order) for c in ("allow", "block")}

    def difference(text):
        padded = "\x02" * order + text + "\x03"
        seqs = [padded[i - order : i + 1] for i in range(order, len(padded))]
        return sum(math.log(models["block"](s)) - math.log(models["allow"](s)) for s in seqs) / len(seqs)

    for r in got:
        text = line[r["page_id"]]
        assert r["difference"] == (None if not text else pytest.approx(difference(text), abs=1e-9))
    free = [r for r in got if r["rule"] is None and r["difference"] is not None]
    blocked = [r["difference"] for r in free if r["verdict"] == "block"]
    assert max((r["difference"] for r in free if r["verdict"] == "allow"), default=-9) <= min(blocked, default=9)


def test_probabilities_add_up(spark):
    pages = spark.createDataFrame([(i, f"http://a.net/{i % 7}/abab") for i in range(50)], "page_id long, url string")
    counts = url_filter.sequences(url_filter.parsed(pages), order=2)
    letters = sorted({c for i in range(7) for c in f"a.net/{i}/abab\x03"})
    asked = [context + c for context in ("\x02\x02", "ab", "/0", "zz") for c in [*letters, "\x7f"]]
    table = spark.createDataFrame([(s,) for s in asked], "seq string")
    found = {r["seq"]: r["block"] for r in url_filter.probabilities(counts, table, order=2).collect()}
    by_hand = model_by_hand([f"a.net/{i % 7}/abab" for i in range(50)], 2)
    assert all(math.isclose(found[s], by_hand(s), rel_tol=1e-12) for s in asked)
    for context in ("\x02\x02", "ab", "/0", "zz"):
        unseen = found[context + "\x7f"] * (url_filter.SYMBOLS - len(letters))
        assert math.isclose(sum(found[context + c] for c in letters) + unseen, 1, abs_tol=1e-9), context


def test_urls_of_another_kind_do_not_change_a_difference(spark):
    rows = [(i, f"http://h{i % 9}.{'example.com/de' if i % 2 else 'org/fr'}/{i}") for i in range(200)]
    other = [(1000 + i, f"http://free{i}.invalid/{'x' * (i % 50)}") for i in range(500)]
    made = [
        {r["page_id"]: (r["difference"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(x, "page_id long, url string")).collect()}
        for x in (rows, rows + other)
    ]
    assert all(made[1][i] == made[0][i] for i, _ in rows)


def test_models_tell_unseen_urls_apart(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'evil'}{i % 13}.example.{'org/fr' if i % 2 else 'com/de'}/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://{'good' if i % 2 else 'evil'}{i}.example.{'org/en' if i % 2 else 'com/en'}/{i}") for i in range(40)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).filter("rule is null").collect()
    right = sum((r["verdict"] == "allow") == bool(r["page_id"] % 2) for r in got)
    assert len(got) == 40 and right >= 38
