"""Resampling towards a target: documents drawn by hashed n-gram importance weights.

Two passes over the texts, each in Arrow batches.  The first counts each partition's
features in a vector of ``BUCKETS`` numbers with ``np.bincount``; ``treeReduce`` merges the
vectors, of the documents and of the target's texts.  The second sends the gains of all
buckets back to the partitions, gathers the gain of each feature and sums them by document.

Features are runs of 1 to ``n`` consecutive words, joined by a space, with repeats; words are
runs of ASCII letters and digits and of all beyond ASCII, with A-Z in lower case.  A
bucket's gain is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for its s of S features of
the documents and t of T of the target; a document's weight is the floored mean over its
features, 0 without any.  With noise from its id the ``percent`` of the documents of at
least ``least_words`` words that have the greatest sums are drawn, which is sampling
without replacement by weight.

Null and empty texts have no features; they are never drawn unless ``least_words`` is 0.
Rows without doc_id share the noise of an empty id.  Rows of one doc_id are documents of
their own; equal scores go by doc_id, null first, and rows equal in both in any order.
No rows give no rows, an empty target has T = 0.  Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronicle.llm.runs import LOWER, runs, table
from chronicle.llm.shared import documents, materialize, small_batches
from chronicle.llm.words import slices

BUCKETS, NGRAMS, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
_WORD = table(b"0123456789abcdefghijklmnopqrstuvwxyz")


def _features(data: np.ndarray, bounds: np.ndarray, ngrams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature, and the number of each text's words."""
    found = runs(LOWER[data], bounds, _WORD)
    text, grams = found.text_of(), found.strings
    texts, bucket = [], []
    for k in range(ngrams):
        if k:
            grams = pc.binary_join_element_wise(grams[:-1], found.strings[k:], " ") if len(found.strings) > k else grams[:0]
        inside = text[: len(grams)] == text[k : k + len(grams)]
        coded = grams.filter(pa.array(inside)).dictionary_encode()
        of = np.array([zlib.crc32(g.encode()) % buckets for g in coded.dictionary.to_numpy(zero_copy_only=False)], dtype=np.int64)
        texts.append(text[: len(grams)][inside])
        bucket.append(of[coded.indices.to_numpy(zero_copy_only=False)] if len(of) else np.zeros(0, np.int64))
    return np.concatenate(texts), np.concatenate(bucket), np.diff(found.offsets)


def bucket_counts(texts: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; a vector leaves each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, data, bounds in slices(batches):
            total += np.bincount(_features(data, bounds, ngrams, buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = small_batches(texts).select("text").mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, dtype=np.int64))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, dtype=np.int64)], 1)  # a table may have no partition at all
    return vectors.union(none).treeReduce(np.add, max(2, int(np.log2(vectors.getNumPartitions() + 1)) // 4))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths, floored."""
    s, t, b = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b))))


def weights(docs: DataFrame, gain: np.ndarray, ngrams: int = NGRAMS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches):
            text, bucket, words = _features(data, bounds, ngrams, buckets)
            many = np.bincount(text, minlength=len(words))
            total = np.bincount(text, weights=sent.value[bucket], minlength=len(words))  # whole numbers, exact in doubles
            mean = np.floor_divide(total.astype(np.int64), np.maximum(many, 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(many), pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def drawn(weighted: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``weighted`` with score and, where drawn, rank.

    Counts by score, whole numbers of a narrow range, say at which score drawing ends.
    Only rows of that score or more move, and are numbered in ranges of score and id.
    """
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.ln(-F.ln((noise + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(weighted.withColumn("score", score), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    draw = able.count() * percent // 100
    counts = sorted(((r.score, r.n) for r in able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # a row for each whole number between the least and the greatest score
    last, before = None, 0
    for value, n in counts:
        if before < draw:
            last = value
        before += n
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select("*", none)
    chosen = (F.col("n_words") >= least_words) & (F.col("score") >= last)
    order = [F.desc("score"), F.asc("doc_id")]
    # Rows equal in score and id go to several ranges by their place in the table.
    placed = scored.withColumn("_row", F.monotonically_increasing_id()).where(chosen)
    ranged = materialize(placed.repartitionByRange(*order, "_row").withColumn("_range", F.spark_partition_id()), "drawn")
    sizes = {r._range: r.n for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    starts, before = [], 0
    for k in sorted(sizes):
        starts.append((k, before))
        before += sizes[k]
    start = scored.sparkSession.createDataFrame(starts, "_range int, _start long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_row"))
    ranked = ranged.withColumn("rank", own).join(F.broadcast(start), "_range")  # a row a partition
    place = (F.col("rank") + F.col("_start")).cast("long")
    ranked = ranked.select(*scored.columns, F.when(place <= draw, place).alias("rank"))
    return scored.where(~chosen).select("*", none).unionByName(ranked)


def resampled(docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``docs``; rank is null where it is not drawn."""
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    return drawn(weights(docs, gain, ngrams), percent, least_words, seed)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of each distinct word by its bytes and a table of 256 entries, which a recursion makes.
OP13_SQL = r"""
WITH RECURSIVE c(b, k, v) AS (SELECT b, 0, b::BIGINT FROM range(256) AS r(b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM c WHERE k = 8),
src AS (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM src),
e AS (SELECT kind, doc_id, unnest(words) AS word FROM w),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM e)),
y AS (SELECT word, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT) AS bytes FROM h),
b AS (SELECT word, xor(list_reduce(bytes, lambda a, z: xor(t[(xor(a, z) & 255) + 1], a >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM y, crc),
f AS (SELECT kind, doc_id, bucket FROM e JOIN b USING (word)),
n AS (SELECT bucket, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM f GROUP BY bucket),
a AS (SELECT sum(s)::BIGINT AS ss, sum(t)::BIGINT AS tt FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM n, a),
m AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE kind = 0 GROUP BY doc_id),
z AS (SELECT w.doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || w.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM w LEFT JOIN m ON w.doc_id = m.doc_id WHERE kind = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS nn FROM z)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND k <= (10 * nn) // 100 THEN k END AS rank FROM r
"""
