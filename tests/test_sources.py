import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postsignal.session import shared_folder, written
from postsignal.sources import posts as files


def test_json_arrays_of_several_files(spark, tmp_path):
    post = {"title": "t1", "author": "a", "date": "2017-04-05 12:34:56", "content": "c\n\"q\"", "url": "u", "score": 1,
            "comments": [{"user": "x", "content": "y", "score": 1}]}
    (tmp_path / "a.json").write_text(json.dumps([post, {"title": "t2"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"title": "t3", "comments": []}]))
    (tmp_path / "c.json").write_text("[{broken")
    (tmp_path / "d.json").write_text(json.dumps([{"author": "no title"}]))
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json(spark, str(tmp_path / "*.json")).collect()
    kept, rejects = files.read_json_or_reject(spark, str(tmp_path / "*.json"))
    rows = {r["title"]: r for r in kept.collect()}
    assert set(rows) == {"t1", "t2", "t3", None}
    assert [(r["file"].rsplit("/")[-1], r["text"]) for r in rejects.collect()] == [("c.json", "[{broken")]
    assert rows["t1"]["date"] == datetime(2017, 4, 5, 12, 34, 56) and rows["t1"]["comments"][0]["score"] == 1
    assert rows["t2"]["content"] is None


@pytest.mark.parametrize("ends", [("[", ",\n", "]"), ("[\n", ",\n", "\n]\n"), ("[", "\r\n, ", " ]"), ("[", ", ", "]")])
def test_one_large_array_is_read_by_several_tasks(spark, tmp_path, ends):
    texts = ['a},{"b', "]\n[", 'q" \\" \\\\', "},", "[{", "新聞 é", "", ",", "x" * 3000]
    rows = [
        {"title": f"t{i} {texts[i % 9]}", "content": texts[i * 7 % 9], "date": "2017-04-05 12:34:56", "score": i,
         "comments": [{"user": texts[i * 5 % 9], "content": "c", "score": 1}] * (i % 3)}
        for i in range(300)
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(ends[0] + ends[1].join(json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(rows)) + ends[2])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 4
        kept, rejects = files.read_json_by_lines(spark, str(tmp_path / "in"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = files.read_json(spark, str(tmp_path / "in"))
    assert sorted(kept.collect(), key=repr) == sorted(whole.collect(), key=repr) and rejects.isEmpty()
    assert kept.count() == 300


def test_lines_that_are_no_records_are_handed_over(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title": "a"},\n{"title": "b", "content": "cut\n{"title": "c"}, {"title": "d"},\n17,\n{"title": "e"}]')
    kept, rejects = files.read_json_by_lines(spark, str(tmp_path / "a.json"))
    assert sorted(r["title"] for r in kept.collect()) == ["a", "c", "d", "e"]
    assert sorted((r["file"].rsplit("/")[-1], r["text"]) for r in rejects.collect()) == [("a.json", "17,"), ("a.json", '{"title": "b", "content": "cut')]


def test_csv_keeps_quotes_breaks_and_columns(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'a "b", c\nd', datetime(2024, 1, 1, 2, 3, 4)), (2, "back\\slash \\n \\b 新聞\r\n", None), (3, None, None)],
        "post_id long, content string, posted_at timestamp_ntz",
    )
    files.write_csv(df, str(tmp_path / "out"))
    read = files.read_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(read.collect()) == sorted(df.collect())
    plan = read.select("post_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<post_id:bigint>" in plan


def test_written_tables_lie_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark).startswith(root)
    df = written(spark.range(5).withColumn("x", F.lit("a")))
    assert df.count() == 5 and all(root in f for f in df.inputFiles())
