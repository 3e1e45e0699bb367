"""An index of vectors: cells of a coarse quantiser, of which a search reads the nearest ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronicle.operators.retrieval import QUERY_BLOCK, _unit, ranked

#: Rows that the cells are fitted on at most, chosen by a hash of their key; every row is indexed.
SAMPLE = 50_000
#: Cells at most, and rounds of fitting.
MOST_CELLS, ROUNDS = 4096, 12
#: What part of the ``TUNED_K`` nearest sample rows of ``TUNED`` of them a search should find; it decides how many cells are read.
TARGET, TUNED, TUNED_K = 0.97, 500, 10


@dataclass
class VectorIndex:
    """The centres, as unit vectors, the path of all rows by cell, the name of the rows' key, and how many cells a search reads."""

    centres: np.ndarray
    path: str
    key: str
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit vectors by rounds of nearest centre and mean, begun far from each other; the same for the same rows."""
    rnd = np.random.default_rng(7)
    centres = sample[rnd.integers(len(sample))][None]
    near = sample @ centres[0]
    while len(centres) < min(cells, len(sample)):
        far = np.maximum(1 - near, 0)
        total = far.sum()
        if total <= 1e-12:
            break  # no other vectors
        centres = np.vstack([centres, sample[np.searchsorted(np.cumsum(far), rnd.random() * total)]])
        near = np.maximum(near, sample @ centres[-1])
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def needed(sample: np.ndarray, centres: np.ndarray) -> int:
    """The fewest cells that hold TARGET of the nearest sample rows of some of them.

    Rows without clusters need most of the cells; among all rows the nearest ones are nearer
    than in a sample, and found at least as often.
    """
    asked = sample[:: max(1, len(sample) // TUNED)]
    near = np.argpartition(-(asked @ sample.T), min(TUNED_K, len(sample)) - 1, axis=1)[:, :TUNED_K]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell for each asked row
    own = np.argmax(sample @ centres.T, axis=1)
    at = np.sort(place[np.arange(len(asked))[:, None], own[near]].ravel())
    return int(at[int(np.ceil(TARGET * len(at))) - 1]) + 1


def build(items: DataFrame, path: str, key: str = "id", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Write ``items`` (key, embedding) to ``path`` by their nearest centre.

    Centres are fitted on ``sample`` rows at most, those of the least hashes; all rows are
    assigned where they lie, and move only into their cell's files.  Null embeddings are no
    items.  A cell with a third of all rows is more files, not a larger task.
    """
    spark, rows = items.sparkSession, items.where("embedding IS NOT NULL").select(key, "embedding")
    total = rows.count()
    part = rows.orderBy(F.xxhash64(key), key).limit(sample).select("embedding").toArrow().column("embedding").combine_chunks()  # ``sample`` rows
    cells = cells or max(1, min(MOST_CELLS, int(total**0.5)))
    vectors = _unit(part)
    vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
    centres = fitted(vectors, cells) if len(vectors) else np.zeros((1, 1))
    sent = spark.sparkContext.broadcast(centres)  # MOST_CELLS rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.argmax(_unit(b.column("embedding")) @ sent.value.T, axis=1) if len(vectors) and b.num_rows else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=[*b.schema.names, "cell"])

    assigned = rows.mapInArrow(assign, T.StructType([*rows.schema]).add("cell", T.IntegerType()))
    assigned.repartition("cell", F.pmod(F.xxhash64(key), F.lit(16))).sortWithinPartitions("cell").write.partitionBy("cell").parquet(path)
    return VectorIndex(centres, path, key, needed(vectors, centres) if len(vectors) else 1)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` most alike rows of the ``probes`` cells whose centres are nearest to each query, or of as many as the index found to be needed.

    Queries, a stated set, go to the executors in blocks; only files of their cells are read,
    and each batch gives only its own best ``k`` of each query.  With all cells probed it is
    the exact search.
    """
    spark, key, cells = queries.sparkSession, index.key, len(index.centres)
    probes = min(cells, probes or index.probes)
    asked = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    rows, out = index.rows(spark), None
    kinds = T.StructType([asked.schema["query_id"], rows.schema[key]]).add("score", T.DoubleType())
    for n in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()  # one block
        ids, wanted = block.column("query_id").to_pylist(), _unit(block.column("embedding").combine_chunks())
        near = np.argsort(-(wanted @ index.centres.T), axis=1, kind="stable")[:, :probes] if ids else np.zeros((0, 0), int)
        probed = np.zeros((cells, len(ids)), dtype=bool)
        probed[near.T, np.arange(len(ids))] = True
        sent = spark.sparkContext.broadcast((ids, wanted, probed))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, wanted, probed = sent.value
            for b in batches:
                own = b.column("cell").to_numpy(zero_copy_only=False)
                for cell in np.unique(own):
                    asking, at = np.flatnonzero(probed[cell]), np.flatnonzero(own == cell)
                    if not len(asking):
                        continue
                    part = b.take(pa.array(at))
                    scores, keys = np.round(_unit(part.column("embedding")) @ wanted[asking].T, digits), part.column(key).to_numpy(zero_copy_only=False)
                    best = np.concatenate([np.lexsort((keys, -scores[:, j]))[:k] for j in range(len(asking))])
                    j = np.repeat(np.arange(len(asking)), min(k, len(at)))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[asking[x]] for x in j]), part.column(key).take(pa.array(best)), pa.array(scores[best, j])], names=["query_id", key, "score"])

        part = rows.where(F.col("cell").isin(np.unique(near).tolist()) if len(ids) else F.lit(False)).mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    return ranked(out, k, key)


def recall(found: DataFrame, exact: DataFrame, key: str = "id") -> DataFrame:
    """(queries, recall): what part of the exact rows were found."""
    hit = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), (F.coalesce(F.sum("hit"), F.lit(0)) / F.count(F.lit(1))).alias("recall"))
