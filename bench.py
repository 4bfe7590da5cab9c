"""Times the headline queries once warm-up is done and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from postsignal.plans import catalog
from postsignal.session import session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "news_posts",
    "dedup_posts",
    "vote_tally",
    "board_page_posts",
    "page_links",
    "clean_text",
    "term_stats",
    "tfidf_weights",
    "keywords",
    "bag_of_words",
    "topic_index",
    "trend_scores",
    "vocab_first_seen",
    "encoded_docs",
    "split_rows",
    "epoch_batches",
    "feature_array",
    "trend_scores_lda",
    "ngram_regression",
    "ablation_rmse",
    "vote_summary",
    "weekday_hour_matrix",
    "welch_weekday",
    "baseline_prev_day",
]


def main() -> None:
    shared = os.environ.get("BENCH_SHARED") or tempfile.mkdtemp(prefix="bench-")
    spark = session(
        "bench",
        **{
            "spark.checkpoint.dir": shared,
            "spark.master": f"local[{CPUS}]",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.vote_tally(spark, FOLDER).count()
    seconds, build = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        made = catalog.CATALOG[name](spark, FOLDER)
        build[name] = round(time.perf_counter() - start, 3)
        made.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "of_that_jobs_while_building": build,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()
    if "BENCH_SHARED" not in os.environ:
        shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
