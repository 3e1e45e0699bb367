"""The pipeline's stages: each on what the one before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronicle.llm import decontaminate, language_id, line_dedup
from chronicle.llm.shared import documents

from test_near_stage import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    docs, out = documents(spark, SF).withColumn("odd name", F.lit(1)), []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF).cache()
        out.append((name, docs, kept))
        docs = kept
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(parts):
    for name, docs, kept in parts[:-1]:
        assert kept.columns == docs.columns, name


def test_language_stage_keeps_clean_documents(parts):
    _, docs, kept = parts[0]
    said = language_id.predict(docs, language_id.train(docs)).where("lang_pred <> 'und' AND score >= 0.05")
    assert ids(kept) == ids(said) and len(ids(kept)) >= 0.97 * docs.count()


def test_lines_stage(parts):
    _, docs, kept = parts[1]
    want = {r.doc_id: r.kept_text for r in line_dedup.with_line_dedup(docs).collect()}
    got = {r.doc_id: r for r in kept.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values()) and set(got) == ids(docs)


def test_one_of_each_group_stays(parts):
    _, docs, kept = parts[2]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert ids(kept) == brute(rows) and len(ids(kept)) < len(rows)


def test_no_leak_is_left(spark, parts):
    _, docs, kept = parts[3]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    gone = ids(decontaminate.leaks(docs, bench))
    assert ids(kept) == ids(docs) - gone and decontaminate.leaks(kept, bench).count() == 0


def test_run_gives_what_the_stages_give(spark, parts):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, parts[-1][2].collect()))
