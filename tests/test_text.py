import random
from collections import Counter

from pyspark.sql import functions as F

from postsignal.functions import calendar, html, text, urls, votes


def column(spark, values, expression, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_cleaning(spark):
    given = ["don't (x) $5 50% xxHello\n", "Xx", "XX", "  a\t\n b  ", "it's they've we'd you'll"]
    assert column(spark, given, text.clean_text) == [
        "do n't ( x ) $ 5 50 % xxx",
        "xx",
        "xxx",
        "a b",
        "it 's they 've we 'd you 'll",
    ]


def test_cleaning_a_long_piece_without_blanks(spark):
    assert column(spark, ["ab" * 50_000], lambda c: F.length(text.clean_text(c))) == [100_000]


def test_han_pairs(spark):
    assert column(spark, ["台北市ab政府", "我,x", ""], text.segmented) == ["台北 北市 ab 政府", "我 , x", ""]


def test_words_are_two_or_more_characters(spark):
    assert column(spark, ["A bc D_e É1 éa, x-yz 新聞"], text.words) == [["bc", "d_e", "é1", "éa", "yz", "新聞"]]


def test_paired_words_in_one_pass_are_the_words_of_the_pairs(spark):
    rng = random.Random(6)
    drawn = ["".join(rng.choice("台北市々〇⺀㐀𠀀aBé1_ ,'ΣβİX\n") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    given = ["ΑΣ々Β台", "a台北b cd市", "台", "𠀀𠀁𠀂x", "", None, "plain Words_1 x"] + drawn
    assert column(spark, given, text.paired_words) == column(spark, given, lambda c: text.words(text.paired(c)))


def test_default_tokens_look_at_a_text_once(spark):
    from postsignal.operators import keywords

    plan = spark.range(1).select(F.lit("台北市").alias("content")).select(keywords.default_tokens())
    assert plan.first()[0] == ["台北", "北市"]
    shown = spark.createDataFrame([("x",)], "content string").select(keywords.default_tokens())._jdf.queryExecution().analyzed().toString()
    assert "$1$2" not in shown  # pairs are not written into the text first


def test_term_frequencies_and_places_against_counting(spark):
    rng = random.Random(5)
    docs = [[rng.choice("abcde") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))] for _ in range(40)]
    counted = column(spark, docs, text.term_frequencies, "array<string>")
    assert [{r["term"]: r["tf"] for r in d} for d in counted] == [dict(Counter(d)) for d in docs]
    placed = column(spark, docs, text.term_places, "array<string>")
    for doc, runs in zip(docs, placed):
        assert {r["term"]: r["positions"] for r in runs} == {
            t: [i for i, u in enumerate(doc) if u == t] for t in doc
        }


def test_vote_codes_and_scores(spark):
    assert column(spark, ["推 ", "噓 ", "→ ", "噓推"], votes.vote_code) == [1, -1, 0, 1]
    df = spark.sql(
        "select array(named_struct('user','a','content','b','score',1), named_struct('user','a','content','b','score',-1),"
        " named_struct('user','a','content','b','score',-1)) c union all select null union all select array()"
    )
    assert sorted(r[0] for r in df.select(votes.total_score(F.col("c"))).collect()) == [-1, 0, 0]


def test_hour_tags(spark):
    tags = column(spark, [3, 4, 8, 9, 17, 18], calendar.hour_tag, "int")
    assert tags == ["OutOfWork", "WakeUp", "WakeUp", "Work", "Work", "OutOfWork"]


def test_times(spark):
    shown = lambda c: calendar.board_time(c).cast("string")
    given = ["Wed Apr  5 12:34:56 2017", "Sat Dec 31 01:02:03 2016", "yesterday", None]
    assert column(spark, given, shown) == ["2017-04-05 12:34:56", "2016-12-31 01:02:03", None, None]
    shown = lambda c: calendar.iso_time(c).cast("string")
    assert column(spark, ["2017-04-05 00:00:01", "x"], shown) == ["2017-04-05 00:00:01", None]


def test_entities_are_decoded_once(spark):
    assert column(spark, ["a &amp;lt; &lt;b&gt; &quot;"], html.decoded) == ['a &lt; <b> "']


def test_absolute_urls(spark):
    base = F.lit("https://a.example.com/x/y?q=1#top")
    hrefs = ["/r", "z", "../z", "./z?k=/../v", "//o.example/p", "http://h/p", "?n", "#f", "mailto:a@b", "a/../../b/"]
    assert column(spark, hrefs, lambda c: urls.absolute(c, base)) == [
        "https://a.example.com/r",
        "https://a.example.com/x/z",
        "https://a.example.com/z",
        "https://a.example.com/x/z?k=/../v",
        "https://o.example/p",
        "http://h/p",
        "https://a.example.com/x/y?n",
        "https://a.example.com/x/y?q=1#f",
        "mailto:a@b",
        "https://a.example.com/b/",
    ]


def test_domains(spark):
    given = ["http://ex.com/a", "http://m.ex.com", "http://notex.com", "http://u:p@EX.com:80/", "/x"]
    assert column(spark, given, lambda c: urls.on_domains(c, ["ex.com"])) == [True, True, False, True, False]
