"""A corpus pipeline: five stages, each an operator of ``chronicle.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.  All but the last return the
columns of ``docs``, whatever they are, besides changed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.llm.decontaminate import without_leaks
from chronicle.llm.language_id import UNKNOWN, predict, train
from chronicle.llm.line_dedup import with_line_dedup
from chronicle.llm.piece_codec import encode_digests
from chronicle.llm.shared import documents, materialize, unused
from chronicle.llm.simhash_dedup import one_of_near_copies

#: A text whose two nearest languages are closer than this is in none of them.
LEAST_SCORE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text has no letter or speaks for no language more than for another.

    Null and empty texts have no letter.  Repeated rows share their fate.
    """
    names = tuple(unused(docs, c) for c in ("language", "language_score", "language_ambiguous"))
    told = predict(docs, train(docs), keep=docs.columns, names=names)
    return told.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in the largest doc_id; n_chars follows the text, and no document goes.

    A null text stays null.  Repeated rows are documents of their own; those of the largest
    doc_id keep the line in each row, and a null doc_id keeps it only among null ones.
    """
    names = tuple(unused(docs, c) for c in ("line_kept_text", "line_total", "line_gone"))
    out = with_line_dedup(docs, names=names)
    text = F.when(F.col("text").isNotNull(), F.col(names[0]))
    changed = {"text": text} | ({"n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.withColumns(changed).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are alike at 0.8 or more one row stays, that of the smallest doc_id.

    Candidates are pairs of near fingerprints; their whole texts decide.  Repeated rows leave one
    of them, a null doc_id stays only where its group has no other, and null and empty texts are
    one group.
    """
    return one_of_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.  Null and empty texts hold none; repeated rows share their fate."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of ids and the digests of each document left; a null text is coded as an empty one."""
    return encode_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", decontaminate),
    ("sentencepiece", encode),
]

#: Language models and Hamming links have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
