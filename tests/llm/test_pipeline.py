"""The pipeline's stages against what the operators say of the same rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pagelattice.llm import mixing, ngram_join, pieces, secrets, shared, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    out = [shared.table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(shared.cut(stage(spark, out[-1], SF), name))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_toxic_documents_go(spark, steps):
    assert ids(steps[1]) == ids(toxicity.query(spark, SF).where("predicted = 0"))


def test_one_of_each_group_stays(steps):
    groups = ngram_join.join(steps[1].select("doc_id", "text"))
    assert ids(steps[2]) == sorted(set(ids(steps[1])) - set(ids(groups.where("doc_id <> component_id"))))
    assert ngram_join.join(steps[2].select("doc_id", "text")).where("doc_id <> component_id").count() == 0


def test_secrets_are_masked_and_nothing_else(steps):
    before = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    after = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    assert before.keys() == after.keys()
    assert all(not secrets.base_spans(t) for t in after.values())
    assert all(after[k] == before[k] for k in before if not secrets.base_spans(before[k]) and not secrets.candidates(before[k], []))


def test_documents_are_taken_as_the_mix_says(steps):
    times = {r["doc_id"]: round(r["taken"] / r["size"] + 1e-9) for r in mixing.mix(steps[3]).where("size > 0").collect()}
    got = {r["doc_id"]: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in times.items() if v}


def test_ids_decode_to_the_texts(steps):
    codec = pieces.codec(pieces.default_model())
    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows[:200]:
        assert r["ids"] == codec.lib.encode(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(codec.lib.decode(r["ids"]).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "some words are here today", "en", "s", 25), (2, "", "en", "s", 0), (3, "password=abcdef " * 3, "en", None, 48)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= 8
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_registered():
    q = __spark_entry__.queries()
    assert "pipeline" in q and sorted(int(k[2:].split("_")[0]) for k in q if k.startswith("op") and k[2].isdigit()) == list(range(1, 14))
    assert F is not None
