"""Passages that documents share, by a sparse suffix array that is sorted by Spark.

Of all suffixes of all documents only those that begin at a minimiser are retained: of
the ``WINDOW - GRAM + 1`` word grams of ``GRAM`` words in a window of ``WINDOW`` words
the one of the least hash, a choice that the words alone make.  So every window holds
the beginning of a retained suffix, its anchor, and equal windows hold it at the same place.

1. Suffixes whose gram only one document has are dropped: they have no neighbour.
2. The others get their context, the ``WINDOW`` words from the anchor on and the
   ``WINDOW - GRAM`` words before it, and are sorted by it over the whole cluster (a
   range partitioning, so equal beginnings may fill any number of tasks).
3. Each suffix is compared with its neighbours in that order: the nearest one before it
   and the nearest one after it that a smaller doc_id has.  Where their words agree for
   ``WINDOW`` words or more, to the left and to the right of the anchor, the words that
   agree are a match.
4. No smaller doc_id agrees with a suffix further to the right than those two do, but one
   that agrees less to the right may agree more to the left.  The windows which that leaves
   open are looked up among those of all suffixes of the same gram, where they lie.
5. A gram whose suffixes lie at an edge of a task may have more of them in other tasks.  Windows that
   are open there are looked up in the task; those that no smaller doc_id of the task has move as
   digests of 128 bits, a row for each task with all places there, and are grouped over the cluster.
6. The matches of all anchors of a document are laid together, which extends them over
   passages of any length.

So every window of ``WINDOW`` words that a smaller doc_id has too is found.  A task holds the suffixes
of one gram that its range has, no more than the range, and nothing meets in one task.
Of the documents that hold a passage all but the first give a row.  Null or short texts,
and rows without doc_id, give none.  Repeats inside one document, and repeated rows of one
doc_id, do not count as shared.  Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.llm.shared import documents, materialize, small_batches
from chronicle.llm.words import Words, sliding_min, slices, split_words

WINDOW, GRAM = 50, 20
#: Bytes of sorted suffixes in a task.
TASK_BYTES = 32 << 20

#: These sort before the blank between words, so suffixes of one gram may lie on both sides of one that has them.
_CONTROL = re.compile(r"[\x00-\x1F]")

_MATCH = "doc_id long, start_word int, end_word int, source_doc_id long, window binary, starts array<int>"
_SUFFIX = "right string, left string, doc_id long, pos int, windows long"


def minimisers(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, windows) of each gram that has the least hash of a window of one text.

    Bit d of ``windows`` stands for the window that begins d words before the gram and has it for its least one.
    """
    grams, width = words.windows(gram), window - gram + 1
    if width > 63:
        raise ValueError("a window has at most 62 words more than a gram")
    least = sliding_min(grams, width)
    if not len(least):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    least = np.where(words.inside(window)[: len(least)], least, np.uint64(0))
    wings = np.zeros(width - 1, dtype=np.uint64)
    least = np.concatenate([wings, least, wings])
    # A gram is a minimiser if the greatest of the least hashes around it is its own.
    around = ~sliding_min(~least, width)
    place = np.flatnonzero((around == grams) & (grams > 0))
    key = grams[place]
    windows = np.zeros(len(place), dtype=np.int64)
    for d in range(width):
        windows |= (least[place + (width - 1 - d)] == key).astype(np.int64) << np.int64(d)
    return place, key, windows


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, doc_id, row, pos, windows) of each retained suffix; ``row`` names the row by its doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches):
            words = split_words(data, bounds)
            place, key, windows = minimisers(words, window, gram)
            text = np.searchsorted(words.offsets, place, side="right") - 1
            take = pa.array(text)
            pos = pa.array((place - words.offsets[text]).astype(np.int32))
            columns = [pa.array(key.view(np.int64)), part.column("doc_id").take(take), part.column("row").take(take), pos, pa.array(windows)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "row", "pos", "windows"])

    return small_batches(docs).mapInArrow(run, "key long, doc_id long, row long, pos int, windows long")


def suffixes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(right, left, doc_id, pos) of the suffixes whose first gram at least two doc_ids have."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"))
    found = materialize(anchors(rows, window, gram), "anchors")
    shared = found.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    # Written out, so that a key which many documents have can be split among tasks.
    kept = found.join(materialize(shared, "shared-keys"), "key").groupBy("row").agg(F.collect_set(F.struct("pos", "windows")).alias("places"))
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, left, ids, at, own = [], [], [], [], []
            for doc_id, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("places").to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()  # bytes split at [\x20\x09-\x0D]
                for place in places:
                    p = place["pos"]
                    right.append(b" ".join(words[p : p + window]))
                    left.append(b" ".join(words[max(0, p - reach) : p][::-1]))
                    at.append(p)
                    own.append(place["windows"])
                ids += [doc_id] * len(places)
                if len(right) > 20_000:
                    yield _suffixes(right, left, ids, at, own)
                    right, left, ids, at, own = [], [], [], [], []
            yield _suffixes(right, left, ids, at, own)

    return small_batches(rows.join(kept, "row")).select("doc_id", "text", "places").mapInArrow(run, _SUFFIX)


def _suffixes(right: list, left: list, ids: list, at: list, own: list) -> pa.RecordBatch:
    texts = [pa.array(x, pa.binary()).cast(pa.string()) for x in (right, left)]
    return pa.RecordBatch.from_arrays([*texts, pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(own, pa.int64())], names=["right", "left", "doc_id", "pos", "windows"])


def common_words(a: str, b: str) -> int:
    """How many words two lines of words, one space between them, have in common at their beginnings."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    whole = (low == len(a) or a[low] == " ") and (low == len(b) or b[low] == " ")
    return a.count(" ", 0, low) + (1 if whole and low else 0)


class Run:
    """The sorted suffixes of one gram: rows of (right, left, doc_id, pos, windows).

    ``open_`` has the windows of each suffix that no match covers yet, ``most`` how many words to the
    right a smaller doc_id has in common with it.
    """

    def __init__(self, rows: list[tuple], window: int):
        self.rows, self.window = rows, window
        self.open_ = [row[4] for row in rows]
        self.most = [0] * len(rows)
        self.matches: list[tuple[int, int, int, int]] = []

    def compare(self, i: int, j: int) -> None:
        own, other = self.rows[i], self.rows[j]
        right, left = common_words(own[0], other[0]), common_words(own[1], other[1])
        self.most[i] = max(self.most[i], right + bool(_CONTROL.search(other[0])))
        if left + right >= self.window:
            self.matches.append((own[2], own[3] - left, own[3] + right, other[2]))
            first = self.window - right  # windows that begin so many words before the anchor, up to `left`
            self.open_[i] &= ~((1 << left + 1) - (1 << first))

    def neighbours(self) -> None:
        """Compare each suffix with the nearest ones of smaller doc_ids before and after it."""
        stack: list[int] = []  # suffixes that still may find one after them, doc_ids never falling
        before, same = [-1] * len(self.rows), 0
        for i, (right, left, doc_id, *_) in enumerate(self.rows):
            first = self.rows[same]
            if first[0] != right or first[1] != left:
                same = i
            elif first[2] < doc_id:  # the same context as the first one that has it
                self.compare(i, same)
                continue
            while stack and self.rows[stack[-1]][2] > doc_id:
                self.compare(stack.pop(), i)
            if stack:
                before[i] = stack[-1] if self.rows[stack[-1]][2] < doc_id else before[stack[-1]]
            if before[i] >= 0:
                self.compare(i, before[i])
            stack.append(i)

    def third(self) -> None:
        """Look up the windows that a smaller doc_id further off may have; a dictionary for each place of the anchor."""
        asked = [o >> self.window - m << self.window - m if m else 0 for o, m in zip(self.open_, self.most, strict=True)]
        places, d = 0, 0
        for a in asked:
            places |= a
        while places >> d:
            if places >> d & 1:
                keys = [(i, self._words(i, d)) for i, o in enumerate(self.open_) if o >> d & 1]
                least: dict[tuple[str, str], int] = {}
                for i, key in keys:
                    least[key] = min(least.get(key, self.rows[i][2]), self.rows[i][2])
                for i, key in keys:
                    doc_id, start = self.rows[i][2], self.rows[i][3] - d
                    if asked[i] >> d & 1 and least[key] < doc_id:
                        self.matches.append((doc_id, start, start + self.window, least[key]))
            d += 1

    def edge(self) -> list[tuple[int, list[int], bytes]]:
        """(doc_id, first words, digest) of the open windows that no smaller doc_id here has; the others become matches.

        A document that repeats a window has one row for it, with all places.  Of all that have a window here the least doc_id is among the open ones, as a match would have led to a smaller one.
        """
        held = list(self.windows())
        least: dict[bytes, int] = {}
        for doc_id, _, digest in held:
            least[digest] = min(least.get(digest, doc_id), doc_id)
        end = None
        for doc_id, start, digest in held:  # windows of one suffix follow each other from right to left
            source = least[digest]
            if source < doc_id:
                if end is not None and end == (doc_id, start + 1) and self.matches[-1][3] == source:
                    self.matches[-1] = (doc_id, start, self.matches[-1][2], source)
                else:
                    self.matches.append((doc_id, start, start + self.window, source))
                end = doc_id, start
        first: dict[bytes, list[int]] = {}
        for doc_id, start, digest in held:
            if least[digest] == doc_id:
                first.setdefault(digest, []).append(start)
        return [(least[digest], sorted(set(starts)), digest) for digest, starts in first.items()]

    def _words(self, i: int, d: int) -> tuple[str, str]:
        """The words of a window from its anchor on, and those before it."""
        right, left = self.rows[i][:2]
        return _first_words(right, self.window - d), _first_words(left, d)

    def windows(self) -> Iterator[tuple[int, int, bytes]]:
        """(doc_id, first word, digest) of each open window."""
        for i, (_, _, doc_id, pos, _) in enumerate(self.rows):
            left, d = self.open_[i], 0
            while left >> d:
                if left >> d & 1:
                    yield doc_id, pos - d, xxhash.xxh3_128_digest("\n".join(self._words(i, d)))
                d += 1


def _first_words(line: str, n: int) -> str:
    return " ".join(line.split(" ", n)[:n])


def matches(sorted_: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Matches in partitions that are ranges of the order; rows with ``window`` are windows open at an edge, without a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, inner in _runs(batches, gram):
            own = Run(rows, window)
            own.neighbours()
            if inner:
                own.third()
            left = [] if inner else own.edge()
            yield from _found(own.matches, left, window)

    return small_batches(sorted_).mapInArrow(_joined(run), _MATCH)


def _runs(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[tuple[list[tuple], bool]]:
    """The suffixes of each gram, and whether the partition has all of them, as others are before and after it."""
    rows: list[tuple] = []
    inner = False
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("right", "left", "doc_id", "pos", "windows")], strict=True):
            if rows and common_words(rows[-1][0], row[0]) < gram:
                plain = not (_CONTROL.search(rows[-1][0]) or _CONTROL.search(row[0]))
                yield rows, inner and plain
                rows, inner = [], plain
            rows.append(row)
    if rows:
        yield rows, False


def _found(found: list[tuple[int, int, int, int]], windows, window: int) -> Iterator[tuple]:
    yield from ((*match, None, None) for match in found)
    yield from ((doc_id, starts[0], starts[0] + window, None, digest, starts) for doc_id, starts, digest in windows)


def _joined(rows_of):
    """A function on Arrow batches from one that yields rows of _MATCH."""
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batched(rows_of(batches), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "start_word", "end_word", "source_doc_id", "window", "starts"])

    return run


def passages(spans: list[tuple[int, int, int]], window: int = WINDOW) -> list[tuple[int, int, list[int]]]:
    """(first word, end, sources) of each maximal run of matched windows, from matches (first word, end, source)."""
    out: list[tuple[int, int, set[int]]] = []
    for a, b, source in sorted(spans):
        if out and a <= out[-1][1] - window + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] | {source})
        else:
            out.append((a, b, {source}))
    return [(a, b, sorted(s)) for a, b, s in out]


def _places(spans: list[dict]) -> list[tuple[int, int, int]]:
    """(first word, end, source) of each match of a document, from rows of ``_spans``."""
    out = []
    for span in spans:
        length = span["end_word"] - span["start_word"]
        out += [(a, a + length, span["source_doc_id"]) for a in span["starts"] or [span["start_word"]]]
    return out


def _spans(held: DataFrame, parts: int, window: int, gram: int) -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_id, starts): all matches; with ``starts`` a row stands for a match at each."""
    order = ["right", "left", "doc_id", "pos"]
    found = materialize(matches(held.repartitionByRange(parts, *order).sortWithinPartitions(*order), window, gram), "matches")
    edge = found.where("window IS NOT NULL").drop("source_doc_id")
    first = edge.groupBy("window").agg(F.min("doc_id").alias("source_doc_id"), F.max("doc_id").alias("last")).where("source_doc_id < last")
    # Written out, so that windows which many tasks have can be split.
    met = edge.join(materialize(first.drop("last"), "edge-windows"), "window").where("source_doc_id < doc_id")
    columns = ["doc_id", "start_word", "end_word", "source_doc_id", "starts"]
    return found.where("window IS NULL").select(columns).unionByName(met.select(columns))


def shared_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_ids) of each passage of ``window`` words or more that earlier documents hold."""
    held = materialize(suffixes(docs, window, gram), "suffixes")
    size = held.agg(F.sum(F.octet_length("right") + F.octet_length("left") + 20)).first()[0] or 0
    parts = max(1, size // TASK_BYTES, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spans = _spans(held, parts, window, gram)
    gathered = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word", "source_doc_id", "starts")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_places(spans) for spans in batch.column("spans").to_pylist()]
            rows = [(i, a, b, s) for i, spans in zip(batch.column("doc_id").to_pylist(), own, strict=True) for a, b, s in passages(spans, window)]
            i, a, b, s = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(s, pa.list_(pa.int64()))],
                names=["doc_id", "start_word", "end_word", "source_doc_ids"],
            )

    return gathered.mapInArrow(run, "doc_id long, start_word int, end_word int, source_doc_ids array<long>")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(documents(spark, sf_dir))
