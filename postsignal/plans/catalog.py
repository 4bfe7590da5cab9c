"""One query per operator over the test tables. Arrays and times are shown as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, html, text, urls, votes
from ..operators import (
    convnet,
    elements,
    encode,
    evaluate,
    filters,
    keywords,
    lexicon,
    pages,
    permute,
    regress,
    rolling,
    selection,
    split,
    stats,
    tally,
    topics,
    trend,
)
from ..session import shared_folder, written
from ..sources import posts as files
from ..streaming import rescore
from . import tables

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

SITE_DOMAINS = ["example.com", "m.ththth.example.net"]


def query(build: Query) -> Query:
    CATALOG[build.__name__] = build
    return build


def _shown(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _kept(posts: DataFrame) -> DataFrame:
    return keywords.keywords(keywords.tfidf_weights(posts))


def _cleaned(posts: DataFrame) -> DataFrame:
    return posts.select("post_id", text.clean_text(text.segmented(F.col("content"))).alias("cleaned"))


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    return written(tables.dated_votes(spark, folder, hourly=True))


def _with_calendar(posts: DataFrame) -> DataFrame:
    return posts.withColumns(
        {"hour": F.hour("posted_at").cast("long"), "weekday": calendar.weekday(F.col("posted_at"))}
    ).withColumn("hour_tag", calendar.hour_tag(F.col("hour")))


def _model_rows(spark: SparkSession, folder: str) -> DataFrame:
    posts = tables.posts(spark, folder, hourly=True)
    scores = trend_score_table(spark, folder).select("post_id", *trend.SCORES.values())
    tagged = _with_calendar(posts).select("post_id", "content", "hour_tag", "n_hate")
    return tagged.na.drop(subset=["content", "n_hate"]).join(scores, "post_id")


# Sources and sinks


def _with_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Posts in the form of a crawl: score and comments in page order, at most ten here."""
    posts = tables.posts(spark, folder)
    said = F.struct(
        "event_id",
        F.col("user_id").cast("string").alias("user"),
        F.col("event_id").cast("string").alias("content"),
        "score",
    )
    comments = (
        tables.comments(spark, folder)
        .groupBy("post_id")
        .agg(F.array_sort(F.collect_list(said)).alias("said"))
        .select("post_id", F.transform("said", lambda c: c.dropFields("event_id")).alias("comments"))
    )
    scores = tally.post_score(posts, tables.comments(spark, folder))
    return posts.join(scores, "post_id").join(comments, "post_id", "left").select(
        F.expr("post_id div 100").alias("part"),
        "title",
        "author",
        F.col("posted_at").alias("date"),
        "content",
        "url",
        F.col("score").cast("int").alias("score"),
        F.coalesce("comments", F.array().cast("array<struct<user:string,content:string,score:int>>")).alias("comments"),
    )


@query
def posts_from_json(spark: SparkSession, folder: str) -> DataFrame:
    """Posts written as files of JSON arrays, a hundred posts each at most, and read back."""
    path = shared_folder(spark)
    files.write_json_arrays(_with_comments(spark, folder), path, "part")
    return _shown_posts(files.read_json(spark, path))


@query
def posts_from_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same files read in parts that are cut by bytes."""
    path = shared_folder(spark)
    files.write_json_arrays(_with_comments(spark, folder), path, "part")
    kept, _ = files.read_json_by_lines(spark, path)
    return _shown_posts(kept)


def _shown_posts(read: DataFrame) -> DataFrame:
    return read.select(
        "url",
        "title",
        "author",
        _shown("date"),
        F.md5("content").alias("content_md5"),
        F.col("score").cast("long").alias("score"),
        F.size("comments").cast("long").alias("n_comments"),
        F.array_join(F.col("comments")["user"], ",").alias("users"),
        F.array_join(F.col("comments")["content"], ",").alias("comment_texts"),
        votes.total_score(F.col("comments")).alias("comment_score"),
    )


@query
def json_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted posts and rejected files where every seventh file of a crawl is cut off."""
    rows = _with_comments(spark, folder)
    path = shared_folder(spark)
    files.write_json_arrays(rows, f"{path}/whole", "part")
    broken = rows.filter("part % 7 = 0").groupBy("part").agg(F.max("title").alias("title"))
    cut_off = F.concat(F.lit('[{"title": "t"},\n{"title": "'), "title", F.lit('", "content": "cut'))
    broken.select(cut_off.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/broken")
    kept, rejected = files.read_json_or_reject(spark, [f"{path}/whole", f"{path}/broken"])
    # Rejects are per file, posts per row: both are only counted.
    counts = kept.select(F.lit(1).alias("k"), F.lit(0).alias("r")).union(rejected.select(F.lit(0), F.lit(1)))
    return counts.agg(F.sum("k").cast("long").alias("accepted"), F.sum("r").cast("long").alias("rejected_files"))


@query
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Posts written as CSV; only the named columns are read back."""
    path = shared_folder(spark)
    rows = tables.posts(spark, folder)
    files.write_csv(rows, path)
    read = files.read_csv(spark, path, rows.schema)
    return read.select(
        "post_id", "title", _shown("posted_at"), F.md5("content").alias("content_md5"), "n_hate"
    )


@query
def index_frontier(spark: SparkSession, folder: str) -> DataFrame:
    """List-page addresses of every host, for as many list pages as it has pages in the table."""
    sites = (
        tables.table(spark, folder, "pages")
        .groupBy(urls.host(F.col("url")).alias("host"))
        .agg(F.count("*").alias("pages"))
        .select(F.concat(F.lit("https://"), "host", F.lit("/board/")).alias("base_url"), "pages")
    )
    return pages.index_frontier(sites)


# Pages


@query
def page_posts(spark: SparkSession, folder: str) -> DataFrame:
    read = pages.page_titles(tables.table(spark, folder, "pages"), pages.ARTICLE)
    paragraphs = html.every(F.col("html"), r"<p>([^<]*)")
    return read.select(
        "page_id",
        "url",
        urls.host(F.col("url")).alias("host"),
        "title",
        F.get(paragraphs, F.lit(0)).alias("first_paragraph"),
        F.element_at(paragraphs, -1).alias("last_paragraph"),
    )


@query
def page_text(spark: SparkSession, folder: str) -> DataFrame:
    read = pages.page_bodies(tables.table(spark, folder, "pages"), pages.ARTICLE)
    return read.select(
        "page_id",
        F.length("content").cast("long").alias("n_chars"),
        F.md5("content").alias("content_md5"),
    )


@query
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    links = pages.page_links(tables.table(spark, folder, "pages"), SITE_DOMAINS)
    return links.withColumn("position", F.col("position").cast("long"))


@query
def list_page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Posts a crawl would go on with, found in list pages rendered from the tables."""
    found = pages.followed_links(tables.list_pages(spark, folder), ["board.example"])
    return found.withColumn("position", F.col("position").cast("long"))


@query
def board_page_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies of all board pages, found by the intervals of their elements."""
    found = elements.bodies(written(pages.without_gates(tables.board_pages(spark, folder))))
    return found.select("page_id", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5"))


@query
def board_page_posts_all(spark: SparkSession, folder: str) -> DataFrame:
    """Board pages of all documents, with comments or without, rendered and taken apart again."""
    found = pages.posts_from_pages(tables.board_pages(spark, folder))
    return found.select(
        F.col("page_id").alias("post_id"),
        "title",
        "author",
        _shown("posted_at"),
        F.md5("content").alias("content_md5"),
        F.size("comments").cast("long").alias("n_comments"),
        F.array_join(F.col("comments")["user"], ",").alias("users"),
        F.array_join(F.col("comments")["content"], ",").alias("comment_texts"),
        "score",
    )


@query
def board_page_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Those of ``board_page_posts_all`` that have comments: its SQL joins posts with their comments."""
    return board_page_posts_all(spark, folder).filter("n_comments > 0")


# Posts and votes


@query
def news_posts(spark: SparkSession, folder: str) -> DataFrame:
    kept = filters.news_posts(tables.texts(spark, folder))
    return kept.select(
        "post_id",
        "title",
        "url",
        F.md5(text.segmented(F.col("content"))).alias("content_split_md5"),
    )


@query
def segment_text(spark: SparkSession, folder: str) -> DataFrame:
    parts = text.segments(F.concat_ws(" ", "title", "content"))
    return tables.texts(spark, folder).select(
        "post_id",
        F.size(parts).cast("long").alias("n_segments"),
        F.md5(F.array_join(parts, " ")).alias("segments_md5"),
    )


@query
def dedup_posts(spark: SparkSession, folder: str) -> DataFrame:
    kept = filters.keep_last(tables.texts(spark, folder), ["content"])
    return kept.select("post_id", "title", F.md5("content").alias("content_md5"))


@query
def dedup_recrawled(spark: SparkSession, folder: str) -> DataFrame:
    """A third of all posts crawled twice, under the same key; each counts once with its votes."""
    crawled = tables.texts(spark, folder)
    once = filters.keep_last(crawled.unionByName(crawled.filter("post_id % 3 = 0")))
    return once.join(tables.dated_votes(spark, folder), "post_id").select(
        "post_id", "url", F.md5("content").alias("content_md5"), *trend.VOTES
    )


@query
def vote_tally(spark: SparkSession, folder: str) -> DataFrame:
    return tally.vote_tally(tables.comments(spark, folder))


@query
def post_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("post_id"))
    return tally.post_score(docs, tables.comments(spark, folder))


@query
def stream_tallies(spark: SparkSession, folder: str) -> DataFrame:
    """Votes per six hours, added up by a stream over the comments as they arrive."""
    out = shared_folder(spark)
    rescore.kept_tallies(tables.arriving_comments(spark, folder), out, shared_folder(spark)).awaitTermination()
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    wall = {c: epoch + F.make_dt_interval(secs=F.unix_seconds(c).cast("decimal(18,6)")) for c in ("low", "up")}
    return rescore.newest(spark, out).withColumns(wall).select(_shown("low"), _shown("up"), "n_push", "n_hate", "n_neutral")


@query
def calendar_tags(spark: SparkSession, folder: str) -> DataFrame:
    posts = _with_calendar(tables.posts(spark, folder).select("post_id", "posted_at"))
    return posts.select("post_id", "hour", "weekday", "hour_tag")


# Keywords


@query
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    found = text.words(F.col("content"))
    return tables.texts(spark, folder).select(
        "post_id",
        F.size(found).cast("long").alias("n_tokens"),
        F.md5(F.array_join(found, " ")).alias("tokens_md5"),
    )


@query
def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.term_counts(tables.texts(spark, folder))


@query
def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.term_stats(keywords.term_counts(tables.texts(spark, folder)))


@query
def corpus_shape(spark: SparkSession, folder: str) -> DataFrame:
    """Posts, vocabulary size and filled cells of the post-by-term matrix."""
    posts = tables.texts(spark, folder)
    per_term = keywords.term_stats(keywords.term_counts(posts))
    return per_term.agg(
        F.count("*").alias("n_terms"), F.sum("df").alias("n_cells")
    ).select(posts.agg(F.count("*")).scalar().alias("n_posts"), "n_terms", "n_cells")


@query
def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(keywords.tfidf_weights(tables.texts(spark, folder)), "weight")


@query
def keyword_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_kept(tables.texts(spark, folder)), "weight")


CATALOG["keywords"] = CATALOG.pop("keyword_rows")


@query
def keyword_strings(spark: SparkSession, folder: str) -> DataFrame:
    posts = tables.texts(spark, folder)
    joined = keywords.keyword_lists(posts, _kept(posts)).select(
        "post_id", keywords.to_string(F.col("words")).alias("words_filtered")
    )
    return joined.withColumn(
        "n_words", F.size(keywords.from_string(F.col("words_filtered"))).cast("long")
    )


# Rolling windows and topics


@query
def windows(spark: SparkSession, folder: str) -> DataFrame:
    at = rolling.grid(_dated(spark, folder))
    return rolling.windows(spark, at).select("window_id", _shown("low"), _shown("up"))


@query
def window_docs(spark: SparkSession, folder: str) -> DataFrame:
    posts = _dated(spark, folder)
    return rolling.window_docs(posts, rolling.grid(posts))


@query
def score_window(spark: SparkSession, folder: str) -> DataFrame:
    posts = _dated(spark, folder)
    return rolling.score_window(posts, rolling.grid(posts))


@query
def window_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Number of dictionary terms of every window."""
    dated = _dated(spark, folder)
    found = topics.dictionary(_kept(tables.texts(spark, folder)), dated, rolling.grid(dated))
    return rolling.exploded(found).groupBy("window_id").agg(F.count("*").alias("n_terms"))


@query
def bag_of_words(spark: SparkSession, folder: str) -> DataFrame:
    kept = written(_kept(tables.texts(spark, folder)))
    dated = _dated(spark, folder)
    return topics.bag_of_words(kept, dated, rolling.grid(dated))


@query
def topic_index(spark: SparkSession, folder: str) -> DataFrame:
    dated = _dated(spark, folder)
    assigned = tables.keyword_topics(_kept(tables.texts(spark, folder))).join(dated, "post_id")
    index = trend.rolling_index(assigned, rolling.grid(dated))
    return _rounded(index, *[c for c in index.columns if c not in ("window_id", "topic")])


def trend_score_table(spark: SparkSession, folder: str) -> DataFrame:
    dated = _dated(spark, folder)
    topics_of = written(tables.keyword_topics(_kept(tables.texts(spark, folder))))
    return trend.trend_scores(dated, topics_of, rolling.grid(dated))


@query
def trend_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = _rounded(trend_score_table(spark, folder), *trend.SCORES.values())
    return scored.select("post_id", _shown("posted_at"), *trend.SCORES.values(), "scored")


@query
def trend_scores_lda(spark: SparkSession, folder: str) -> DataFrame:
    """Which posts a topic model, refitted for every window, scores, and whether scores are possible.

    A score is a sum of averages times shares that add up to at most one, so it lies between 0 and
    the largest vote of the window's posts.
    """
    texts, dated = tables.texts(spark, folder), _dated(spark, folder)
    at = rolling.grid(dated)
    lists = keywords.keyword_lists(texts, _kept(texts))
    scored = written(topics.rolling_topic_scores(dated, lists, at, topics.TopicSettings(seed=7)))
    largest = (
        rolling.exploded(rolling.with_training_range(dated, at).groupBy("k_first", "k_last").agg(F.max("n_hate").alias("m")))
        .groupBy("window_id")
        .agg(F.max("m").alias("largest"))
    )
    by = rolling.score_window(dated, at).join(largest, "window_id", "left").select("post_id", "largest")
    possible = F.when(F.col("scored"), F.col("score_hate").between(F.lit(0.0), F.col("largest") + 1e-6)).otherwise(
        F.col("score_hate") == 0
    )
    return scored.join(by, "post_id").select("post_id", "scored", possible.alias("possible"))


# Model input


@query
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(tables.texts(spark, folder)).select(
        "post_id",
        F.length("cleaned").cast("long").alias("n_chars"),
        F.md5("cleaned").alias("cleaned_md5"),
    )


@query
def doc_lengths(spark: SparkSession, folder: str) -> DataFrame:
    docs = _cleaned(tables.texts(spark, folder))
    counted = written(docs.select("post_id", text.blank_count(F.col("cleaned")).cast("long").alias("n_words")))
    return counted.select("post_id", "n_words", counted.agg(F.max("n_words")).scalar().alias("longest"))


@query
def vocab_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return encode.vocabulary(_cleaned(tables.texts(spark, folder)))


@query
def encoded_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Word ids as long as their text; padding waits until batches are made."""
    docs = encode.tokenized(_cleaned(tables.texts(spark, folder)))
    ids = encode.encoded_docs(docs, encode.vocabulary(docs))
    return ids.select(
        "post_id",
        F.size("word_ids").cast("long").alias("n_ids"),
        F.md5(F.array_join(F.col("word_ids").cast("array<string>"), " ")).alias("ids_md5"),
    )


@query
def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of 64 posts with ids, padded to the longest of their batch, and label."""
    texts = tables.texts(spark, folder)
    docs = encode.tokenized(_cleaned(texts))
    rows = split.split_rows(texts.select("post_id")).filter("split = 'train'").select("post_id")
    dealt = split.epoch_batches(rows, epochs=1).select("batch", "post_id")
    labels = tables.dated_votes(spark, folder).select("post_id", "n_hate")
    ids = encode.encoded_docs(docs, encode.vocabulary(docs))
    filled = encode.padded_by(written(dealt.join(ids, "post_id").join(labels, "post_id")), "batch")
    return filled.select(
        "batch",
        "post_id",
        F.size("word_ids").cast("long").alias("n_ids"),
        F.md5(F.array_join(F.col("word_ids").cast("array<string>"), " ")).alias("ids_md5"),
        "n_hate",
    )


@query
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    posts = _with_calendar(tables.posts(spark, folder).select("post_id", "posted_at"))
    hot = encode.one_hot(F.col("hour_tag"), calendar.HOUR_TAGS)
    return posts.select(
        "post_id", "hour_tag", *[hot[i].alias(f"hot_{i + 1}") for i in range(len(calendar.HOUR_TAGS))]
    )


@query
def model_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rounded(_model_rows(spark, folder), *trend.SCORES.values())
    return rows.withColumn("content", F.md5("content")).withColumnRenamed("content", "content_md5")


@query
def feature_array(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(_model_rows(spark, folder))
    docs = encode.tokenized(_cleaned(rows))
    ids = encode.encoded_docs(docs, encode.vocabulary(docs))
    features = encode.feature_array(
        F.col("word_ids"),
        [F.col(s) for s in trend.SCORES.values()],
        encode.one_hot(F.col("hour_tag"), calendar.HOUR_TAGS),
    )
    joined = rows.join(ids, "post_id").select("post_id", features.alias("f"))
    word_ids = F.slice("f", F.lit(1), F.size("f") - 6).cast("array<bigint>").cast("array<string>")
    return joined.select(
        "post_id",
        F.size("f").cast("long").alias("n_features"),
        F.md5(F.array_join(word_ids, " ")).alias("ids_md5"),
        *[F.round(F.element_at("f", i - 6), 6).alias(f"meta_{i + 1}") for i in range(6)],
    )


@query
def split_rows(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_rows(tables.texts(spark, folder).select("post_id"))


@query
def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = split.split_rows(tables.posts(spark, folder).select("post_id", "n_hate"))
    return rows.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.sum("n_hate").alias("total_hate")
    )


@query
def epoch_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = split.split_rows(tables.texts(spark, folder).select("post_id"))
    train = rows.filter(F.col("split") == "train").select("post_id")
    return split.epoch_batches(train).select(
        F.col("epoch").cast("long").alias("epoch"), "batch", "post_id"
    )


@query
def epoch_permutation(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of four epochs whose orders are permutations of one numbering; training ranks are dense already."""
    rows = written(split.split_rows(tables.texts(spark, folder).select("post_id")))
    train = rows.filter(F.col("split") == "train")
    n, first = train.agg(F.count("*"), F.min("rank")).first()
    numbered = train.select("post_id", (F.col("rank") - (first or 0)).alias("number"))
    return permute.epoch_batches(numbered, n).select(
        F.col("epoch").cast("long").alias("epoch"), "batch", "place", "post_id"
    )


# Statistics


@query
def vote_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = stats.six_numbers(tables.posts(spark, folder), trend.VOTES)
    return _rounded(summary, "q1", "median", "mean", "q3")


@query
def value_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Six numbers of a continuous measure per kind of event, exact by selection."""
    values = tables.table(spark, folder, "events").select(F.col("event_type").alias("measure"), "value")
    return _rounded(selection.six_numbers(values), "q1", "median", "mean", "q3")


@query
def hate_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    posts = _with_calendar(tables.posts(spark, folder))
    return _rounded(stats.mean_sd(posts, "hour", "n_hate"), "mean", "sd")


@query
def hate_by_weekday(spark: SparkSession, folder: str) -> DataFrame:
    posts = _with_calendar(tables.posts(spark, folder))
    return _rounded(stats.mean_sd(posts, "weekday", "n_hate"), "mean", "sd")


@query
def weekday_hour_matrix(spark: SparkSession, folder: str) -> DataFrame:
    cells = stats.weekday_hour_means(_with_calendar(tables.posts(spark, folder)), "n_hate")
    return _rounded(stats.weekday_matrix(cells), *calendar.WEEKDAYS)


@query
def heat_zscores(spark: SparkSession, folder: str) -> DataFrame:
    cells = stats.weekday_hour_means(_with_calendar(tables.posts(spark, folder)), "n_hate")
    return _rounded(stats.weekday_matrix(stats.column_zscores(cells)), *calendar.WEEKDAYS)


@query
def welch_weekday(spark: SparkSession, folder: str) -> DataFrame:
    posts = _with_calendar(tables.posts(spark, folder))
    tested = stats.welch(posts, "weekday", "Wednesday", "Friday", "n_hate")
    return _rounded(tested, "mean1", "mean2", "t", "df", "p_value")


@query
def baseline_mean(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.baseline_mean(tables.posts(spark, folder)), "mean", "rmse")


@query
def baseline_prev_day(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluate.baseline_previous_day(tables.posts(spark, folder)), "rmse")


@query
def rmse_by_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Batch errors of the global mean as the prediction."""
    posts = tables.posts(spark, folder).select("post_id", "n_hate")
    mean = posts.agg(F.avg("n_hate")).scalar()
    rows = posts.withColumn("prediction", mean)
    return _rounded(evaluate.rmse_by_batch(rows, "n_hate", "prediction"), "rmse_batches", "rmse")


# Regression


def _split_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Label, scores, tag and split of every model row, without its text."""
    meta = written(_model_rows(spark, folder).drop("content"))
    return written(split.split_rows(meta))


def _dealt_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Model rows with their texts, dealt evenly: taking texts apart and every pass of a fit use all cores.

    A file of documents may have as few parts as row groups, and what is stored from it as few files.
    """
    texts = tables.texts(spark, folder).select("post_id", "content").na.drop()
    parts = 4 * spark.sparkContext.defaultParallelism
    return texts.join(_split_meta(spark, folder), "post_id").repartition(parts, "post_id")


def _regression_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Model rows with their hashed word sequences; texts and tokens are stored nowhere."""
    return regress.stored(regress.hashed(regress.model_input(_dealt_rows(spark, folder))))


@query
def ngram_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, mean label and two checks of the fit per split, of the model with all features.

    Errors are in ``regression_errors``: they depend on trained weights and have no SQL. A least-squares fit with an intercept has the mean label as its mean prediction and no larger
    error than that mean on the rows it was fitted to; ``train_gap`` and ``train_fits`` say so.
    """
    rows = _regression_rows(spark, folder)
    predicted = written(regress.predictions(rows, ["text+scores+tag"]))
    return _checked(predicted.groupBy("split"))


def _checked(grouped) -> DataFrame:
    gap = F.round(F.avg("prediction") - F.avg("label"), 4)
    error = F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), F.lit(2.0))))
    checked = grouped.agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg("label"), 6).alias("mean_label"),
        F.abs(gap).alias("train_gap"),
        (error <= F.stddev_pop("label") + 1e-6).alias("train_fits"),
    )
    trained = F.col("split") == "train"
    return checked.withColumns(
        {"train_gap": F.when(trained, F.col("train_gap")), "train_fits": F.when(trained, F.col("train_fits"))}
    )


@query
def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Word sequences of each width per post, as the regression sees them."""
    found = F.coalesce(regress.tokens(F.col("content")), F.array().cast("array<string>"))
    made = regress.with_ngrams(tables.texts(spark, folder).select("post_id", found.alias("tokens")))
    sizes = [
        F.struct(F.lit(w).cast("long").alias("width"), F.size(f"ngrams_{w}").cast("long").alias("n_ngrams"))
        for w in regress.WIDTHS
    ]
    return made.select("post_id", F.inline(F.array(*sizes)))


@query
def ablation_rmse(spark: SparkSession, folder: str) -> DataFrame:
    """The same checks for each of the three feature sets."""
    rows = _regression_rows(spark, folder)
    return _checked(regress.predictions(rows).groupBy("features", "split"))


@query
def regression_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the fitted models' predictions, whole and by batch, per feature set and split."""
    predicted = written(regress.predictions(_regression_rows(spark, folder)))
    return _rounded(regress.errors(predicted), "rmse_batches", "rmse", "rmse_mean")


@query
def convnet_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the convolutional network on words, scores and tag, whole and by batch, per split."""
    meta = regress.FEATURE_SETS["text+scores+tag"]
    to = convnet.Settings()
    given = regress.model_input(_dealt_rows(spark, folder))
    words = convnet.word_places(F.col("tokens"), to.places).alias("words")
    rows = written(given.select("post_id", "split", "rank", "label", *meta, words))
    model = convnet.fit(rows.filter("split = 'train'"), meta, to)
    found = written(convnet.predicted(rows, model, meta, to).withColumn("features", F.lit("text+scores+tag")))
    return _rounded(regress.errors(found), "rmse_batches", "rmse", "rmse_mean")


@query
def batch_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Batch and whole errors of stored predictions: each post gets its previous rank's label."""
    posts = written(tables.dated_votes(spark, folder).select("post_id", "n_hate"))
    rows = written(split.split_rows(posts))
    before = rows.select((F.col("rank") + 1).alias("rank"), F.col("n_hate").cast("double").alias("prediction"))
    given = written(rows.join(before, "rank").select("post_id", "n_hate", "prediction"))
    return _rounded(evaluate.rmse_by_batch(given, "n_hate", "prediction"), "rmse_batches", "rmse")


@query
def han_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Term counts of all texts with ten of their letters shown as Han characters."""
    shown = F.translate("content", "aeiounrstl", "台北市政府今天宣布例")
    return keywords.term_counts(tables.texts(spark, folder).withColumn("content", shown))


@query
def han_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all strings of up to five neighbouring Han characters."""
    return lexicon.gram_counts(tables.han_texts(spark, folder))


@query
def han_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Words that stand together and stand free, found by those counts."""
    words = lexicon.dictionary(written(lexicon.gram_counts(tables.han_texts(spark, folder))))
    return _rounded(words, "cohesion", "left_entropy", "right_entropy")


@query
def han_words(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct run of Han characters as its most probable row of words."""
    docs = tables.han_texts(spark, folder)
    counts = written(lexicon.gram_counts(docs))
    weights = written(lexicon.word_weights(counts, written(lexicon.dictionary(counts))))
    distinct = docs.select(F.explode(lexicon.runs(F.col("content"))).alias("run")).distinct()
    cut = lexicon.cut_runs(distinct, weights)
    return cut.select("run", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


@query
def han_keyword_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Term counts of texts whose Han runs are cut by the learnt dictionary."""
    docs = tables.han_texts(spark, folder)
    counts = written(lexicon.gram_counts(docs))
    weights = written(lexicon.word_weights(counts, written(lexicon.dictionary(counts))))
    return keywords.term_counts(lexicon.segmented(docs, weights), text.words(F.col("content")))


@query
def news_trend(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain: news, one row per text, keywords of segmented text, scores from their votes."""
    news = written(filters.keep_last(filters.news_posts(tables.texts(spark, folder)), ["content"]))
    dated = written(_dated(spark, folder).join(news.select("post_id"), "post_id", "left_semi"))
    topics_of = written(tables.keyword_topics(_kept(news)))
    scored = _rounded(trend.trend_scores(dated, topics_of, rolling.grid(dated)), *trend.SCORES.values())
    return scored.select("post_id", *trend.SCORES.values(), "scored")
