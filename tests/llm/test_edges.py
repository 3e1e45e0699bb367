"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronicle.llm import decontaminate, fingerprints, html_text, language_id, line_dedup, piece_codec, sharding, simhash_dedup, substring_dedup, suffix_dedup

LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
LINE = "A line of more than forty characters that repeats"
PASSAGE = " ".join(f"p{k}" for k in range(70))
ROWS = [
    (None, PASSAGE, "en"), (None, PASSAGE, "en"), (None, None, None), (None, "", "en"),
    (3, PASSAGE, "en"), (3, PASSAGE, "en"), (3, "another text of the same id", "de"), (4, None, "en"), (5, "", None), (6, " \n\t", "en"),
    (7, LONG, "en"), (8, "before " + PASSAGE, "de"), (9, "\n".join([LINE] * 3), "en"),
    *[(k, f"{LINE}\nthe {k}", "en") for k in range(20, 26)], (-5, "negative id", "de"), (2**62, "large id", "de"),
]
#: Names that the operators use inside, or might.
NAMES = "row key words found h g pos slot cell bucket r guest tile a b dropped line_dropped line_doc lettered text_to_tell score lang_pred ambiguous n n_lines n_dropped kept_text fp near_key near_row text_hash _level item_id size shard _row edited".split()
ITEMS = [(1, " ".join(f"p{k}" for k in range(30))), (1, " ".join(f"p{k}" for k in range(31))), (2, None), (None, "p1 p2 p3 p4 p5 p6"), (3, "")]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


OPERATORS = {
    "language_id": lambda d: language_id.predict(d, language_id.train(d)),
    "sentencepiece": piece_codec.encode_digests,
    "suffix_dedup": suffix_dedup.shared_passages,
    "fingerprints": fingerprints.fingerprints,
    "line_dedup": lambda d: line_dedup.with_line_dedup(d).select("doc_id", "kept_text", "n_lines", "n_dropped"),
    "sharding": lambda d: sharding.shard_by_bytes(d).groupBy("shard").agg(F.sum("size").alias("size"), F.max("slot").alias("slot"), F.count(F.lit(1)).alias("n")),
    "simhash_dedup": simhash_dedup.near_duplicates,
    "substring_dedup": substring_dedup.remove_repeats,
    "decontaminate": lambda d: decontaminate.leaks(d, items(d.sparkSession)),
    "without_leaks": lambda d: decontaminate.without_leaks(d, items(d.sparkSession)).select("doc_id", "text", "lang"),
    "near_copies": lambda d: simhash_dedup.one_of_near_copies(d).select("doc_id", "text", "lang"),
}


def shown(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_clashing_names(spark, name):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    plain = shown(OPERATORS[name](docs))
    clash = docs.withColumns({c: F.lit(7) for c in NAMES}).repartition(3)
    assert shown(OPERATORS[name](clash)) == plain and plain
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_defined_results(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    gone = {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert (8, 70) in gone and (3, 0) in gone and (None, 0) in gone and not any(i is None and n for i, n in gone)
    spans = [(r.doc_id, r.start_word, r.end_word, r.source_doc_ids) for r in suffix_dedup.shared_passages(docs).collect()]
    assert spans == [(8, 1, 71, [3])]
    hits = sorted((r.doc_id is None, r.doc_id or 0, r.item_id, r.similarity, r.end_word - r.start_word) for r in decontaminate.leaks(docs, items(spark)).collect())
    assert hits == [(False, 3, 1, 1.0, 30)] * 2 + [(False, 8, 1, 1.0, 30)] + [(True, 0, 1, 1.0, 30)] * 2
    lost = {r.doc_id: r.n_dropped for r in line_dedup.with_line_dedup(docs).collect() if r.n_dropped}
    assert lost == {9: 3, **dict.fromkeys(range(20, 25), 1)}
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.train(docs)).collect() if r.doc_id in (4, 5, 6)} == dict.fromkeys((4, 5, 6), "und")


def test_pages(spark):
    body = "<article><p>" + "word " * 50 + "</p><p>" + "more " * 50 + "</p></article>"
    rows = [(1, "u", body), (1, "u", body), (None, None, body), (2, "u", None), (3, "u", ""), (4, "u", "<article>" + "<p>" + "long " * 30 + "</p>" * 1 + ("<p>" + "text " * 40) * 3000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = shown(html_text.extract(pages))
    assert shown(html_text.extract(pages.withColumns({c: F.lit(1) for c in ("blocks", "text", "words", "links", "tag", "name")}))) == plain
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[1] == got[None] == ("word " * 50).strip() + "\n" + ("more " * 50).strip() and got[2] == got[3] == "" and got[4].count("\n") == 3000


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, tmp_path, stage):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    name, act = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    plain = act(spark, docs, str(tmp_path))
    clash = act(spark, docs.withColumns({c: F.lit(7) for c in NAMES if c != "text"}), str(tmp_path))
    if stage < 4:
        assert plain.columns == docs.columns and clash.columns == [*docs.columns, *NAMES] and clash.where(" OR ".join(f"`{c}` <> 7" for c in NAMES)).count() == 0, name
        clash = clash.select(*docs.columns)
    assert shown(plain) == shown(clash) and plain.count()
    assert act(spark, docs.limit(0), str(tmp_path)).count() == 0
