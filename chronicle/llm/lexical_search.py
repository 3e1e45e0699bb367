"""Ranked lexical search in 64-bit integers over a DataFrame of postings.

Terms are the longest runs of ASCII letters and digits and of all beyond ASCII, with A-Z in
lower case.  ``postings`` is the index: a row is the bucket of one term in one block of
documents, with the documents that have it, how often, and how long they are.  A term that
a third of all documents have has a row in every block, so no row and no task holds it
whole.  ``search`` joins the buckets with the terms of the items, scores each match, sums
by item and document and ranks.  A block's rows lie together and sums begin where they
lie, so one row leaves a block for each item and document, however many terms they share.

With N documents of at least one term, L terms in all, n in a document, df documents of a
term and tf of its occurrences in one, its weight is w = floor(1000 ln((2 N + 2) / (2 df + 1))),
a document's m is 10 + (90 n N) div L, and a match scores w ((10^9 tf) div (1000 tf + 8 m)).

A null or empty text has no terms and is not found; an item without terms finds nothing.
Each row of the documents is one of its own, also where ids repeat; equal scores go by
ascending doc_id, null first.  Items of one item_id, null too, are one item with the terms
of all.  No rows give no rows.  Other columns than ids and texts are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronicle.llm.runs import LOWER, counted, runs, table
from chronicle.llm.shared import documents, materialize, small_batches
from chronicle.llm.words import slices

TOP = 10
#: Distinct terms of the items that are sent to all executors; with more, the index holds every term and joins shuffle.
MOST_TERMS = 500_000
_TERM = table(b"0123456789abcdefghijklmnopqrstuvwxyz")
_POSTING = "array<struct<row: long, doc_id: long, tf: long, n: long>>"


@dataclass
class Index:
    """Buckets of postings, and (documents, terms): N and L over all documents, whatever terms are indexed."""

    buckets: DataFrame
    documents: int
    terms: int


def terms_of(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches):
            found = runs(LOWER[data], bounds, _TERM)
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(found.text_of())), found.strings], names=["item_id", "term"])

    return small_batches(items).select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term string").distinct()


def postings(docs: DataFrame, terms: DataFrame | None = None) -> Index:
    """The index of ``docs``, of all terms or only of ``terms`` (term), which go to all executors."""
    held = None if terms is None else docs.sparkSession.sparkContext.broadcast(terms.select("term").toArrow().column("term").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches):
            found = runs(LOWER[data], bounds, _TERM)
            words, number = found.numbered()
            size, text = np.diff(found.offsets), found.text_of()
            if held is not None:
                asked = pc.is_in(words, value_set=held.value).to_numpy(zero_copy_only=False)
                text, number = text[asked[number]], number[asked[number]]
            number, text, tf = counted(number, text, len(size))
            first = np.flatnonzero(np.diff(number, prepend=-1))
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(first, len(number)).astype(np.int32)),
                pa.StructArray.from_arrays([part.column("row").take(pa.array(text)), part.column("doc_id").take(pa.array(text)), pa.array(tf), pa.array(size[text])], names=["row", "doc_id", "tf", "n"]),
            )
            # One more row, without a term, says how many documents have terms, and how many these are.
            none = pa.array([[{"row": None, "doc_id": None, "tf": int((size > 0).sum()), "n": int(size.sum())}]], lists.type)
            term = pa.concat_arrays([words.take(pa.array(number[first])), pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays([term, pa.concat_arrays([lists, none])], names=["term", "postings"])

    numbered = small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = materialize(numbered.mapInArrow(run, f"term string, postings {_POSTING}"), "postings")
    total = buckets.where("term IS NULL").agg(F.sum(F.col("postings")[0]["tf"]), F.sum(F.col("postings")[0]["n"])).first()
    return Index(buckets.where("term IS NOT NULL"), total[0] or 0, total[1] or 0)


def search(index: Index, asked: DataFrame, k: int = TOP, few: bool = True) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents for the items of ``asked`` (item_id, term); ``few`` terms are sent to all executors."""
    n, length = F.lit(index.documents), F.lit(max(1, index.terms))
    df = index.buckets.groupBy("term").agg(F.sum(F.size("postings")).alias("df"))
    weight = F.floor(1000 * F.ln((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = asked.join(df, "term").select("item_id", "term", weight.alias("w")).where("w > 0")  # without weight there is no score
    weighted = materialize(weighted, "asked-terms")
    each = index.buckets.select("term", F.explode("postings").alias("p")).select("term", "p.*")
    m = 10 + F.call_function("div", 90 * F.col("n") * n, length)
    tf = F.call_function("div", F.lit(1_000_000_000) * F.col("tf"), 1000 * F.col("tf") + 8 * m)
    scored = each.select("term", "row", "doc_id", tf.alias("x")).join(F.broadcast(weighted) if few else weighted, "term")
    summed = scored.groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("w") * F.col("x")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "row"))
    return summed.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best of ``docs`` for each of ``items`` (item_id, text)."""
    asked = materialize(terms_of(items), "item-terms")
    distinct = asked.select("term").distinct()
    few = distinct.count() <= MOST_TERMS and asked.count() <= 4 * MOST_TERMS
    return search(postings(docs, distinct if few else None), asked, k, few)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS nn, sum(len(words))::BIGINT AS ll FROM d WHERE len(words) > 0),
p AS (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, term, floor(1000 * ln((2.0 * nn + 2)::DOUBLE / (2.0 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN f USING (term), s),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll)))))::BIGINT AS score FROM t JOIN w USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
