"""Language identification with error-correcting output codes.

Each language has a codeword.  For each of its bits a binary classifier over
hashed character n-grams says how far a text's n-grams speak for a one: the mean
of their log-odds between the languages whose codeword has a one there and those
that have a zero.  Decoding takes the codeword of least loss, where a bit counts
for a language as much as its classifier was right about that language's training
texts.  A text whose two nearest codewords are about as near is flagged ambiguous.

The classifiers are counts of n-grams by language, gathered by Spark from at most
``SAMPLE`` training rows a language, chosen by a hash of doc_id; one in ``HELD`` of them
teaches nothing and judges the bits.  Prediction reads whole texts of all rows, and
every label is learned, however rare.

Rows without doc_id, text or language teach nothing.  A text that is null or has
no letter is ``und`` with score 0, and so is every text if nothing was learned.
With one learned language every text with a letter is in it.  Repeated rows are
predicted alike; columns other than text play no part in a prediction.  Very long
texts cost memory of some times their own size in one task, as they are one row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronicle.llm.shared import documents, small_batches, unused
from chronicle.llm.words import mix, slices

UNKNOWN = "und"
#: Training rows for each language at most; where a language has so many, one in HELD of them is kept to judge the bits.
SAMPLE, JUDGED, HELD = 2000, 20, 5
#: Character n-grams and the table they are hashed into.
ORDERS, BUCKETS = (1, 2, 3), 1 << 15
#: Scores below this, of 0 to 1, are ambiguous.
AMBIGUOUS = 0.5
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def codewords(n: int) -> np.ndarray:
    """A code of n words: all splits of up to six languages, else the best of random ones."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        columns = [(1, *x) for x in itertools.product((1, -1), repeat=n - 1) if -1 in x]
        return np.array(columns, dtype=float).T
    rng = np.random.default_rng(7)
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, int(10 * np.log2(n))))
        distance = (code[:, None] != code[None]).sum(axis=2) + np.eye(n) * code.shape[1]
        if (np.abs(code.sum(axis=0)) < n).all() and distance.min() > apart:
            best, apart = code, distance.min()
    return best


def _grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of the n-gram at each character and whether it lies in its text.

    Characters that are not letters count as spaces, so punctuation and digits say nothing.
    """
    text = data.tobytes().decode("utf-8", "replace").lower()
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    letters = _LETTER[np.minimum(points, len(_LETTER) - 1)]
    points = np.where(letters, points, 32).astype(np.uint64)
    # Lower-casing may change a text's length, so its end is found again.
    ends = np.array([len(data[a:b].tobytes().decode("utf-8", "replace").lower()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    starts = np.concatenate([[0], np.cumsum(ends)])
    owner = np.repeat(np.arange(len(ends)), ends)
    solid = np.concatenate([[0], np.cumsum(letters)])
    code = np.zeros(len(points), dtype=np.uint64)
    for k in range(1, max(ORDERS) + 1):
        n = len(points) - k + 1
        if n <= 0:
            return
        code = code[:n] * np.uint64(0x110000) + points[k - 1 :]
        if k in ORDERS:
            fits = (np.arange(n) + k <= starts[1:][owner[:n]]) & (solid[k:] > solid[:-k])
            yield (mix(code + np.uint64(k)) >> np.uint64(49)).astype(np.int64)[fits], owner[:n][fits]


_LETTER = np.array([chr(i).isalpha() for i in range(0x30000)])
_LETTER[-1] = False


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each bit's mean log-odds for each text."""
        n, bits = len(bounds) - 1, self.code.shape[1]
        total, count = np.zeros((n, bits)), np.zeros(n)
        for bucket, owner in _grams(data, bounds):
            if not len(bucket):
                continue
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[first]] += np.add.reduceat(self.weights[bucket], first, axis=0)
            count += np.bincount(owner, minlength=n)
        return total / np.maximum(count, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest codeword and how far it leads the next: 0 not at all, 1 beyond doubt."""
        if len(self.languages) == 1:
            return np.zeros(len(margins), dtype=np.int64), np.ones(len(margins))
        loss = np.zeros((len(margins), len(self.languages)))
        for k in range(len(self.languages)):
            loss[:, k] = (np.exp(-np.clip(margins * self.code[k] * 2, -20, 20)) * self.trust[k]).sum(axis=1)
        two = np.partition(loss, 1, axis=1)[:, :2]
        return loss.argmin(axis=1), 1 - two[:, 0] / two[:, 1]


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text, judge) of at most about ``sample`` rows a language that are not held out."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").count().collect()  # a row for each language, which the model has too
    rates = [(r["lang"], min(1.0, sample / r["count"]), r["count"] >= JUDGED) for r in counts]
    table = docs.sparkSession.createDataFrame(rates, "lang string, rate double, many boolean")
    place = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    judge = F.col("many") & (F.pmod(F.xxhash64(F.lit("judged"), "doc_id"), F.lit(HELD)) == 0)
    chosen = usable.where(F.col("text").isNotNull()).join(F.broadcast(table), "lang")  # a row for each language
    return chosen.where(place < F.col("rate")).select("lang", "text", judge.alias("judge"))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    rows = small_batches(training_rows(docs, sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for part, data, bounds in slices(batches):
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            for bucket, owner in _grams(data, bounds):
                for lang in set(langs.tolist()):
                    own = tables.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    own += np.bincount(bucket[(langs == lang)[owner]], minlength=BUCKETS)
        for lang, own in tables.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])

    grams = rows.where("NOT judge").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = grams.toArrow()  # at most BUCKETS rows for each language
    languages = sorted(set(table.column("lang").to_pylist()))
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((BUCKETS, 1)), code)
    counts = np.full((len(languages), BUCKETS), 0.5)
    counts[np.searchsorted(languages, table.column("lang").to_pylist()), table.column("bucket").to_numpy()] += table.column("n").to_numpy()
    share = counts / counts.sum(axis=1, keepdims=True)
    weights = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32)
    if len(languages) > 1:
        for bit in range(code.shape[1]):
            ones = code[:, bit] > 0
            weights[:, bit] = np.log(share[ones].mean(axis=0) / share[~ones].mean(axis=0))
    model = Model(languages, code, weights, np.ones(code.shape))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches):
            at = np.searchsorted(languages, part.column("lang").to_pylist())
            good = (np.sign(model.margins(data, bounds)) == code[at]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(good.tolist(), pa.list_(pa.int64()))], names=["lang", "good"])

    judged = rows.where("judge").where(F.col("lang").isin(*languages)).mapInArrow(right, "lang string, good array<long>").select("lang", F.posexplode("good").alias("bit", "ok")).groupBy("lang", "bit").agg(F.avg("ok").alias("ok"))
    for r in judged.collect():  # a row for each language and bit
        model.trust[languages.index(r.lang), r.bit] = max(r.ok, 1e-3)
    model.trust /= model.trust.sum(axis=1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """The language, its score and whether it is ambiguous for each row of ``docs``, as columns ``names`` after the columns ``keep`` (doc_id).

    A column of ``keep`` with one of these names gives way to the prediction.
    """
    own = list(names)
    keep = [c for c in keep or ["doc_id"] if c not in own]
    lettered, text = unused(docs, "lettered"), unused(docs, "text_to_tell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, dtype=object)
        for part, data, bounds in slices(batches, text):
            if len(names):
                best, score = model.decode(model.margins(data, bounds))
                known = part.column(lettered).to_numpy(zero_copy_only=False).astype(bool)
                lang, score = np.where(known, names[best], UNKNOWN), np.where(known, np.clip(score, 0, 1), 0.0)
            else:
                lang, score = np.full(part.num_rows, UNKNOWN, dtype=object), np.zeros(part.num_rows)
            columns = part.columns[: len(keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)], names=keep + own)

    some = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(lettered)
    schema = T.StructType([docs.schema[c] for c in keep]).add(own[0], "string").add(own[1], "double").add(own[2], "boolean")
    return small_batches(docs).select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(text), some).mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
