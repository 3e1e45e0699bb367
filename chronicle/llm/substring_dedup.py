"""Substring dedup by relative Lempel-Ziv factors.

The reference of a document is the text of all documents with smaller ids.  It is
indexed by its windows of ``WINDOW`` words; the index is cut into blocks by hash, one to
a task, and each document asks every block that one of its windows lies in.  A document
is then parsed greedily from its beginning: where a window occurs in the reference, a
factor begins at the reference document that has it first, and goes on as long as the
next windows have that document for their first too; at a factor's end the next window
is looked up again, also if it overlaps the factor, so no window that crosses two
factors is missed.  Words that no factor covers stay as literals.

So a factor is the longest run in the first holder of its windows, not in any document:
a passage may be several factors where the first holders change in it, and together they
cover what longer ones would.  Asking each whole block for each whole document would
make the work grow with the square of the corpus.

A null or empty text has no words.  Rows without doc_id keep their text.  Repeated
rows of one doc_id are no reference for each other.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.llm.repeats import by_document, in_filter, key_filter, repeated_windows, starts
from chronicle.llm.shared import documents, materialize

WINDOW, WIDTH = 13, 8


def factors(found: list[dict], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first word, end, reference document) of the greedy parse; factors may overlap by less than a window."""
    out: list[tuple[int, int, int]] = []
    for at, source in starts(found):
        if out and out[-1][2] == source and at == out[-1][1] - window + 1:
            out[-1] = (out[-1][0], at + window, source)
        else:
            out.append((at, at + window, source))
    return out


def parse(docs: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_id): the factors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, found in zip(batch.column("doc_id").to_pylist(), batch.column("found").to_pylist(), strict=True) for f in factors(found, window)]
            a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(d, pa.int64())], names=["doc_id", "start_word", "end_word", "source_doc_id"]
            )

    return by_document(repeated_windows(docs, window, width)).mapInArrow(run, "doc_id long, start_word int, end_word int, source_doc_id long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words of its factors.

    Only documents that have factors move: a table of bits of their ids, of fixed size,
    tells the others where they lie.  An id whose bit is set by chance moves too and finds
    no factors.
    """
    found = materialize(by_document(repeated_windows(docs, window, width)), "factors")
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(found.select(F.col("doc_id").cast("long").alias("key"))))

    def with_factors(yes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                hit = in_filter(sent.value, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).view(np.uint64)) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == yes))

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, own in zip(batch.column("text"), batch.column("found"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.split()  # bytes split at [\x20\x09-\x0D]
                total.append(len(words))
                if own.is_valid:
                    stay, end = [], 0
                    for a, b, _ in factors(own.as_py(), window):
                        if a > end:
                            stay += words[end:a]
                        end = max(end, b)
                    words = stay + words[end:]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    moved = with_factors(True).join(found, "doc_id", "left")
    rest = with_factors(False).withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    return moved.unionByName(rest).mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i FROM k JOIN f USING (win) WHERE first < doc_id), range(0, 13) AS r(j)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d WHERE len(w) > 0),
y AS (SELECT x.doc_id, count(*) AS n, count(c.i) AS gone, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)
"""
