"""Posts, comments and pages made from the test tables, shaped like the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.votes import vote_counts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def comments_of(events: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as comments, ten per post, with a vote code by event type."""
    kind = F.col("event_type")
    return events.select(
        F.expr("event_id div 10").alias("post_id"),
        "event_id",
        "ts",
        "user_id",
        F.when(kind.isin("purchase", "signup"), 1)
        .when(kind == "error", -1)
        .otherwise(0)
        .alias("score"),
    )


def comments(spark: SparkSession, folder: str) -> DataFrame:
    return comments_of(table(spark, folder, "events"))


def arriving_comments(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of files, with instants for times: the wall clock is read as that of UTC."""
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/event[s].parquet")
    micros = F.expr("timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return comments_of(stream).withColumn("ts", F.timestamp_micros(micros))


def _title(post_id: Column, source: Column) -> Column:
    last = post_id % 10
    prefix = (
        F.when(last == 7, "Re: [新聞] ")
        .when(last == 8, "Fw: [新聞] ")
        .when(last == 9, "[問卦] ")
        .otherwise("[新聞] ")
    )
    return F.concat(prefix, source)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as posts without votes or date: a scan and a projection, nothing else."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("post_id"),
        _title(F.col("doc_id"), F.col("source")).alias("title"),
        F.col("source").alias("author"),
        F.concat(F.lit("https://board.example/post/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("content"),
    )


def dated_votes(spark: SparkSession, folder: str, hourly: bool = False) -> DataFrame:
    """``(post_id, posted_at, n_push, n_hate, n_neutral)`` of every document, without its text.

    The date is that of the first comment, cut to the hour if ``hourly``, which puts many posts
    exactly on window borders. A document without comments has no date and no votes.
    """
    votes = (
        comments(spark, folder)
        .groupBy("post_id")
        .agg(F.min("ts").alias("posted_at"), *vote_counts(F.col("score")))
    )
    if hourly:
        day = F.col("posted_at").cast("date").cast("timestamp_ntz")
        votes = votes.withColumn("posted_at", day + F.make_dt_interval(hours=F.hour("posted_at")))
    ids = table(spark, folder, "documents").select(F.col("doc_id").alias("post_id"))
    return ids.join(votes, "post_id", "left").na.fill(0, ["n_push", "n_hate", "n_neutral"])


def posts(spark: SparkSession, folder: str, hourly: bool = False) -> DataFrame:
    """``texts`` with their dates and votes. The join decides for itself whether to shuffle."""
    return texts(spark, folder).join(dated_votes(spark, folder, hourly), "post_id")


def keyword_topics(kept: DataFrame, n_topics: int = 20) -> DataFrame:
    """A fixed assignment ``(post_id, topic, p)``: each keyword votes for a topic by its MD5."""
    topic = (F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("long") % n_topics).alias("topic")
    per_topic = kept.groupBy("post_id", topic).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("post_id"))
    return per_topic.select("post_id", "topic", (F.col("n") / total).alias("p"))


# Letters shown as Han characters; vowels and blanks, which have none, are left out.
CONSONANTS, HAN_SHOWN, LEFT_OUT = "bcdfghjklmnpqrstvwxyz", "台北市政府今天宣布例人口大小中國山水火木金", "aeiou "


def han_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``texts`` whose words are strings of Han characters without blanks between them."""
    shown = F.translate(F.lower("content"), CONSONANTS + LEFT_OUT, HAN_SHOWN)
    return texts(spark, folder).withColumn("content", shown)


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def list_pages(spark: SparkSession, folder: str) -> DataFrame:
    """List pages of twenty posts each in the board's HTML.

    Of each ten posts one is deleted, one lies on another site, and one is linked outside its entry.
    """
    n, i = F.col("post_id") % 10, F.col("post_id").cast("string")
    site = F.when(n == 8, F.lit("https://other.example/post/")).otherwise(F.lit("/post/"))
    link = F.concat(F.lit('<div class="title">\n<a href="'), site, i, F.lit('">'), F.col("title"), F.lit("</a></div>"))
    entry = F.concat(
        F.lit('<div class="r-ent"><div class="nrec"><span>3</span></div>'),
        F.when(n == 7, F.lit('<div class="title">(deleted)</div></div>')).otherwise(F.concat(link, F.lit("</div>"))),
    )
    shown = F.when(n == 9, link).otherwise(entry)
    page = F.expr("post_id div 20").alias("page_id")
    return (
        texts(spark, folder)
        .select(page, F.struct("post_id", shown.alias("html")).alias("entry"))
        .groupBy("page_id")
        .agg(F.array_join(F.array_sort(F.collect_list("entry"))["html"], "\n").alias("html"))
        .withColumn("url", F.lit("https://board.example/board/index.html"))
    )


def board_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its comments, if any, as a page in the board's HTML.

    Of each fifty posts one comes as an age question, one without an author and one with a comment
    that lacks its text. A document without comments shows a date made from its id.
    """
    tag = F.when(F.col("score") == 1, "推 ").when(F.col("score") == -1, "噓 ").otherwise("→ ")
    n = F.col("post_id") % 50
    text_span = F.concat(
        F.lit('<span class="f3 push-content">: no '), F.col("event_id").cast("string"), F.lit("</span>")
    )
    block = F.concat(
        F.lit('<div class="push"><span class="hl push-tag">'),
        tag,
        F.lit('</span><span class="f3 hl push-userid">u'),
        F.col("user_id").cast("string"),
        F.lit("</span>"),
        F.when((n == 47) & (F.col("event_id") % 10 == 3), "").otherwise(text_span),
        F.lit('<span class="push-ipdatetime">04/05 12:34</span></div>\n'),
    )
    # Ten comments per post by construction of the comments table.
    pushes = (
        comments(spark, folder)
        .groupBy("post_id")
        .agg(
            F.min("ts").alias("posted_at"),
            F.array_sort(F.collect_list(F.struct("event_id", block.alias("block")))).alias("blocks"),
        )
    )
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "post_id")
    # 7,919 seconds apart by id, within thirty days.
    second = F.col("post_id") * 7919 % (30 * 86_400)
    own = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=second)
    at = F.coalesce(F.col("posted_at"), own)
    shown_time = F.concat(
        F.date_format(at, "EEE MMM "),
        F.lpad(F.day(at).cast("string"), 2, " "),
        F.date_format(at, " HH:mm:ss yyyy"),
    )

    def meta(value: Column) -> Column:
        return F.concat(F.lit('<span class="article-meta-value">'), value, F.lit("</span>"))

    html = F.concat(
        F.lit('<html><head><meta property="og:title" content="'),
        _title(F.col("post_id"), F.col("source")),
        F.lit('"></head><body><div id="main-content">'),
        F.when(n == 48, "").otherwise(meta(F.col("source"))),
        meta(F.lit("Board")),
        meta(F.lit("Title")),
        meta(shown_time),
        F.lit('</div><div class="text">'),
        _escaped(F.col("text")),
        F.lit('</div><span class="f2">※ 發信站: 批踢踢實業坊(ptt.cc)</span>\n'),
        F.coalesce(F.array_join(F.col("blocks")["block"], ""), F.lit("")),
        F.lit("</body></html>"),
    )
    gate = F.lit('<html><body><div class="over18-notice">18?</div></body></html>')
    return docs.join(pushes, "post_id", "left").select(
        F.col("post_id").alias("page_id"),
        F.concat(F.lit("https://board.example/post/"), F.col("post_id").cast("string")).alias("url"),
        F.when(n == 49, gate).otherwise(html).alias("html"),
    )
