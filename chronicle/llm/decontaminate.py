"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

Words are compared with A-Z in lower case.  A text is a bag of shingles of
``SHINGLE`` words (a shorter text: its whole sequence).  A window of a document, as
many words long as an item, matches it if the weighted Jaccard similarity of their
bags is at least ``SIMILARITY``.

A window without any shingle of an item has similarity 0, so windows are made only
where a shingle occurs that some item has.  Each gets a SimHash fingerprint of 64 bits.
Multi-index tables find the items near it: of ``RADIUS`` = 19 differing bits at most, one
of the four blocks of 16 bits has 4 or fewer, so a table for each block, with the items
under every value within 4 bits of theirs, gives all items within the radius.  The
exact similarity then decides.  Windows at 0.8 differ in 8 to 10 bits on average with a
standard deviation of 2.9, so the radius leaves them more than 3; of unrelated items the
tables let one in seven through, and the radius one in a thousand.

Benchmark items come in blocks of ``ITEMS`` at most, chosen by hash of item_id, so what
is sent to the executors is bounded; a benchmark of more items costs a pass over the
documents for each block.  Items without words or without item_id and null texts match
nothing.  Of rows of one item_id the best counts.  Repeated documents are judged alike,
each by itself, and a null doc_id is reported like any other.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.llm.shared import documents, small_batches
from chronicle.llm.words import Words, mix, slices, split_words

SHINGLE, SIMILARITY, RADIUS, ITEMS = 5, 0.8, 19, 4000
#: Blocks of a fingerprint, and all values that a block of it may be changed by.
BLOCKS = 4
_PLACE = np.uint64(16) * np.arange(BLOCKS, dtype=np.uint64)
_CHANGES = np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)) <= RADIUS // BLOCKS).astype(np.uint16)
_FILTER = np.uint64(64 - 22)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 for the 64 bits of each hash."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _blocks(prints: np.ndarray) -> np.ndarray:
    return ((prints[:, None] >> _PLACE) & np.uint64(0xFFFF)).astype(np.uint16)


def _near_items(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items in the order of the values near their own ``part``, and where each value begins."""
    value = (part[:, None] ^ _CHANGES).ravel()
    order = np.argsort(value, kind="stable")
    return np.searchsorted(value[order], np.arange((1 << 16) + 1)), np.repeat(np.arange(len(part), dtype=np.int32), len(_CHANGES))[order]


def weighted_jaccard(a: dict[int, int], b: dict[int, int]) -> float:
    shared = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def _bag(hashes) -> dict[int, int]:
    out: dict[int, int] = {}
    for h in hashes:
        out[h] = out.get(h, 0) + 1
    return out


@dataclass
class Benchmark:
    """Items of one length in words, or rather of every length: ``lengths`` tells."""

    ids: np.ndarray
    lengths: np.ndarray
    bags: list[dict[int, int]]
    prints: np.ndarray
    shingles: np.ndarray  # sorted hashes of shingles
    owners: list[np.ndarray]  # for each, the items that have it
    filled: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]  # for each block, where each value begins in the list of the items near it

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Benchmark:
        raw = [(t or "").encode() for _, t in rows]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        words = split_words(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds, lower=True)
        lengths = np.diff(words.offsets)
        bags, prints, owned = [], [], {}
        for k, n in enumerate(lengths.tolist()):
            size = min(SHINGLE, n)
            own = words.windows(size)[words.offsets[k] : words.offsets[k] + n - size + 1] if n else np.zeros(0, dtype=np.uint64)
            bags.append(_bag(own.tolist()))
            prints.append(packed(bits_of(own).sum(axis=0)[None])[0] if n else np.uint64(0))
            for h in bags[-1]:
                owned.setdefault((size, h), []).append(k)
        table = {h: np.array(owned[s, h]) for s, h in sorted(owned, key=lambda x: x[1])}
        shingles = np.array(list(table), dtype=np.uint64)
        filled = np.zeros(1 << 22, dtype=bool)
        filled[(mix(shingles) >> _FILTER).astype(np.int64)] = True
        prints = np.array(prints, dtype=np.uint64)
        tables = [_near_items(part) for part in _blocks(prints).T]
        return Benchmark(np.array([i for i, _ in rows]), lengths, bags, prints, shingles, list(table.values()), filled, tables)

    def matches(self, words: Words) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, end) of each item that a text holds: its best window, the first of equals."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for size in sorted({min(SHINGLE, n) for n in self.lengths.tolist() if n}):
            hashes = words.windows(size)
            at = np.flatnonzero(self.filled[(mix(hashes) >> _FILTER).astype(np.int64)] & words.inside(size))
            if not len(at):
                continue
            where = np.minimum(np.searchsorted(self.shingles, hashes[at]), len(self.shingles) - 1)
            real = self.shingles[where] == hashes[at]
            at, where = at[real], where[real]
            text = np.searchsorted(words.offsets, at, side="right") - 1
            for lo, hi in _runs(text):
                self._search(int(text[lo]), words, size, hashes, at[lo:hi], where[lo:hi], best)
        found: dict[tuple[int, int], tuple[int, int, float, int, int]] = {}
        for (t, i), (s, at) in sorted(best.items(), key=lambda x: (x[0][0], -x[1][0], x[1][1], x[0][1])):
            first = at - int(words.offsets[t])
            found.setdefault((t, int(self.ids[i])), (t, i, s, first, first + int(self.lengths[i])))
        return list(found.values())

    def _search(self, text: int, words: Words, size: int, hashes: np.ndarray, at: np.ndarray, shingle: np.ndarray, best: dict) -> None:
        """Windows of one text that hold any of its shingles ``at``, for the lengths of the items that own them."""
        begin, end = int(words.offsets[text]), int(words.offsets[text + 1])
        owners = [self.owners[s] for s in shingle.tolist()]
        items = np.concatenate(owners)
        spots = np.repeat(at, [len(o) for o in owners])
        length = self.lengths[items]
        fits = (length <= end - begin) & (np.minimum(SHINGLE, length) == size)
        for n in np.unique(length[fits]).tolist():
            own = np.unique(spots[fits & (length == n)])
            first, last = np.maximum(begin, own - (n - size)), np.minimum(own, end - n)
            # Windows from `first` to `last` of each spot; overlapping ranges become one.
            good = first <= last
            first, last = first[good], last[good]
            if not len(first):
                continue
            cut = np.flatnonzero(first[1:] > np.maximum.accumulate(last)[:-1] + 1) + 1
            for a, b in zip(first[np.concatenate([[0], cut])].tolist(), np.maximum.reduceat(last, np.concatenate([[0], cut])).tolist(), strict=True):
                for c in range(a, b + 1, 4096):
                    self._compare(text, n, size, hashes, c, min(c + 4095, b), best)

    def _compare(self, text: int, n: int, size: int, hashes: np.ndarray, a: int, b: int, best: dict) -> None:
        count = n - size + 1
        sums = np.zeros((b - a + count + 1, 64), dtype=np.int32)
        np.cumsum(bits_of(hashes[a : b + count]), axis=0, out=sums[1:])
        prints = packed(sums[count:] - sums[:-count])
        near = set()
        for (begin, items), part in zip(self.tables, _blocks(prints).T, strict=True):
            for value in np.unique(part).tolist():
                near.update(items[begin[value] : begin[value + 1]].tolist())
        for item in sorted(i for i in near if self.lengths[i] == n):
            close = np.flatnonzero(np.bitwise_count(prints ^ self.prints[item]) <= RADIUS)
            bag = self.bags[item]
            own = np.isin(hashes[a : b + count], np.fromiter(bag, dtype=np.uint64))
            held = np.concatenate([[0], np.cumsum(own)])
            held = held[count:] - held[:-count]  # shingles of the item in each window: no less than the bags share
            for k in close[held[close] >= SIMILARITY * count].tolist():
                similarity = weighted_jaccard(bag, _bag(hashes[a + k : a + k + count].tolist()))
                if similarity >= SIMILARITY and similarity > best.get((text, item), (0.0, 0))[0]:
                    best[text, item] = (similarity, a + k)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(x)], strict=True))


def benchmark_blocks(benchmark: DataFrame, items: int = ITEMS) -> Iterator[Benchmark]:
    """The benchmark in blocks of about ``items`` items at most."""
    held = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    blocks = -(-held.count() // items)
    for k in range(blocks):
        rows = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # one block
        yield Benchmark.of([(r.item_id, r.text) for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, end_word): the best window of each item that a document holds."""
    out = None
    for block in benchmark_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for part, data, bounds in slices(batches):
                found = items.matches(split_words(data, bounds, lower=True))
                t, i, s, a, b = (np.array(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(t, pa.int64())), pa.array(items.ids[t * 0 + i], pa.int64()), pa.array(s, pa.float64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                    names=["doc_id", "item_id", "similarity", "start_word", "end_word"],
                )

        part = small_batches(docs).where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, similarity double, start_word int, end_word int")
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start_word int, end_word int")
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    for block in benchmark_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part, data, bounds in slices(batches):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[m[0] for m in sent.value.matches(split_words(data, bounds, lower=True))]] = False
                yield part.filter(pa.array(keep))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
a AS (SELECT item_id, n, k, sh, count(*) AS c FROM (SELECT item_id, n, k, array_to_string(w[p:p + k - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM i)) GROUP BY ALL),
b AS (SELECT doc_id, total, k, p, array_to_string(w[p:p + k - 1], ' ') AS sh FROM (SELECT doc_id, w, len(w) AS total, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
h AS (SELECT doc_id, total, p, sh, item_id, n, k, c FROM b JOIN a USING (k, sh)),
s AS (SELECT DISTINCT doc_id, total, item_id, n, k, unnest(range(greatest(1, p - (n - k)), p + 1)) AS s FROM h),
x AS (SELECT s.doc_id, s.item_id, s.n, s.k, s.s, h.sh, least(count(*), min(h.c)) AS shared FROM s JOIN h ON s.doc_id = h.doc_id AND s.item_id = h.item_id AND h.p BETWEEN s.s AND s.s + s.n - s.k WHERE s.s + s.n - 1 <= s.total GROUP BY ALL),
y AS (SELECT doc_id, item_id, n, s, CAST(sum(shared) AS DOUBLE) / CAST(2 * (n - k + 1) - sum(shared) AS DOUBLE) AS similarity FROM x GROUP BY doc_id, item_id, n, k, s)
SELECT doc_id, item_id, similarity, CAST(s - 1 AS INTEGER) AS start_word, CAST(s - 1 + n AS INTEGER) AS end_word FROM y WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1
"""
