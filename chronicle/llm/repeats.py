"""Word windows that an earlier document has too: the index of substring dedup.

Four steps, of which only the last two see more than one in five words:

1. every document gives the keys of its windows' minimisers, about two for each
   ``width`` words, and a key is kept if documents of two ids have it;
2. the kept keys set bits in a table of fixed size (``FILTER_BITS``), which goes
   to all executors; a bit set by chance, or a table that a huge corpus fills, costs
   moved windows, never a result;
3. windows with a kept key are the entries of the index, spread over the cluster by
   their own hash, each with the least doc_id that has it;
4. every document asks the blocks of the index that its windows lie in; windows return
   to their documents where that id is smaller than their own, and lie there as bits of
   64-word blocks.

Counts are aggregated before they move and joins are plain equi-joins on window
hashes, so a passage that a third of all documents hold is no large group anywhere.
A null doc_id neither lends nor loses.  Windows are told apart by hashes of 64 bits: two
different ones meet with a chance of 2**-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicle.llm.shared import materialize, small_batches
from chronicle.llm.words import mix, shared_windows, slices, split_words

#: Bits of the table of keys that documents share, as a power of two: 16 MB.
FILTER_BITS = 27


def _slot(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - FILTER_BITS)


def shared_keys(docs: DataFrame, size: int, width: int) -> DataFrame:
    """(slot): table places of the keys that at least two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches):
            words = split_words(data, bounds)
            _, keys, place = shared_windows(words, size, width)
            owner = words.text_of()[place]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[owner[new]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(ids.astype(np.int64))], names=["key", "doc_id"])

    keyed = small_batches(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "key long, doc_id long")
    return keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")


def key_filter(keys: DataFrame) -> np.ndarray:
    """The table of bits; 64 bits a row at most come to the driver, 16 MB in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column("key").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    table = keys.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def in_filter(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set; true for every key that the table was made of."""
    slot = _slot(keys)
    return (filled[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def candidate_windows(docs: DataFrame, filled: np.ndarray, size: int, width: int) -> DataFrame:
    """(h, doc_id, pos) of every window with a shared key; h is a hash of its words."""
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for part, data, bounds in slices(batches):
            words = split_words(data, bounds)
            full, keys, place = shared_windows(words, size, width)
            near = in_filter(table, keys)
            full, place = full[near], place[near]
            owner = words.text_of()[place]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[owner]
            pos = place - words.offsets[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.view(np.int64)), pa.array(ids.astype(np.int64)), pa.array(pos.astype(np.int32))], names=["h", "doc_id", "pos"]
            )

    return small_batches(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "h long, doc_id long, pos int")


def repeated_windows(docs: DataFrame, size: int, width: int) -> DataFrame:
    """(doc_id, source, block, bits): windows that the smaller doc_id ``source`` has first.

    Bit b of block k stands for the window that begins at word 64 k + b.
    """
    windows = candidate_windows(docs, key_filter(shared_keys(docs, size, width)), size, width)
    first = windows.groupBy("h").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").select("h", "source")
    # Written out, so that Spark knows its size: it is sent to all if small, and else joined with splits of the common hashes.
    first = materialize(first, "first-windows")
    found = windows.join(first, "h").where("source < doc_id")
    bit = F.expr("shiftleft(1L, pos & 63)")
    return found.groupBy("doc_id", "source", F.expr("shiftright(pos, 6)").alias("block")).agg(F.bit_or(bit).alias("bits"))


def by_document(repeated: DataFrame) -> DataFrame:
    """(doc_id, found): each document's blocks as an array."""
    return repeated.groupBy("doc_id").agg(F.collect_list(F.struct("source", "block", "bits")).alias("found"))


def starts(found: list[dict]) -> list[tuple[int, int]]:
    """(place, source) of each repeated window of a document, in order."""
    out = []
    for f in found:
        bits, base = f["bits"] & ((1 << 64) - 1), f["block"] * 64
        while bits:
            low = bits & -bits
            out.append((base + low.bit_length() - 1, f["source"]))
            bits ^= low
    out.sort()
    return out
