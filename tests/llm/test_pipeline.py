"""Every stage on its own input: columns, and what it keeps and drops."""

import hashlib
import re

import pytest

import corpus_pipeline
from postsignal.llm import mixing, ngram_join, pieces, toxicity
from postsignal.session import written

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA))
        out.append(docs)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "sentencepiece"]
    assert all(df.columns == COLUMNS for df in steps[:-1])


def test_toxic_documents_go(spark, steps):
    scored = toxicity.score(steps[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids(steps[1]) == ids(scored.filter("predicted = 0"))


def test_one_of_equal_documents_stays(steps):
    bare = lambda t: hashlib.sha256(re.sub(r"\s", "", t).encode()).hexdigest()
    before = {bare(r["text"]) for r in steps[1].collect()}
    after = [bare(r["text"]) for r in steps[2].collect()]
    assert len(after) == len(set(after)) and set(after) == before


def test_one_of_linked_documents_stays(steps):
    found = ngram_join.components(steps[2], ngram_join.Rule(5, 80))
    assert ids(steps[3]) == ids(found.filter("doc_id = component_id"))


def test_documents_come_as_often_as_mixed(steps):
    plan = {r["doc_id"]: r for r in mixing.mix(steps[3]).collect()}
    taken = {}
    for r in steps[4].collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(re.findall(mixing.WORD, r["text"]))
    assert taken == {i: r["taken"] for i, r in plan.items() if r["taken"]}


def test_ids_decode_to_the_texts(steps):
    model = pieces.compiled()
    texts = sorted((r["doc_id"], r["text"]) for r in steps[4].collect())
    assert sorted((r["doc_id"], model.decode(r["ids"])) for r in steps[5].collect()) == texts


def test_run_gives_the_last_stage(spark, steps):
    assert ids(corpus_pipeline.run(spark, DATA)) == ids(steps[5])


def test_odd_documents_pass_all_stages(spark, steps, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "a b c", "en", "a", 5), (5, "a b c d e f", "en", None, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = written(stage(spark, table, str(tmp_path)))
        assert "ids" in table.columns
