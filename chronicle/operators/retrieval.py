"""Retrieval from a memory bank: lexical and vector ranking, fusion, people, budgets, bundles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronicle.functions.text import first_filled
from chronicle.tables import materialize

#: Fixed constants of the ranking formulas, from their public descriptions.
BM25_K1, BM25_B, RRF_K = 1.2, 0.75, 60
PEOPLE, FACT_TOKENS, QUERY_BLOCK, LEXICAL_ROWS = 25, 3000, 512, 500


def words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:'\p{L}+)*)"), F.lit(1))


def ranked(scored: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The ``k`` best of each query with their ranks; equal scores by key."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def of_types(memories: DataFrame, types: list[str] | None) -> DataFrame:
    return memories if not types else memories.where(F.col("fact_type").isin(*types))


def lexical(memories: DataFrame, queries: DataFrame, k: int, types: list[str] | None = None, key: str = "id", digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank) by BM25 over the memories (key, text), rounded to ``digits``; equal scores by key.

    The queries, a stated set, go to the executors in blocks of QUERY_BLOCK at most.  One pass
    counts the memories that have each of their terms; in a second one each batch of memories
    is scored against a block as one product of matrices and gives only its own best ``k`` of
    each query, so few rows move and a common term is no large group.  A null text has no words.
    """
    rows = of_types(memories, types).select(key, F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    terms = F.array_distinct(words(F.col("text"))).alias("terms")
    asked = queries.where("query_id IS NOT NULL AND text IS NOT NULL").select("query_id", terms)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    kinds = T.StructType([asked.schema["query_id"], memories.schema[key]]).add("score", "double")
    out = None
    for n in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect()  # one block
        known = pa.array(sorted({t for r in block for t in r.terms}), pa.string())
        number = {t: i for i, t in enumerate(known.to_pylist())}
        wanted = np.zeros((len(known), len(block)))
        for j, r in enumerate(block):
            wanted[[number[t] for t in r.terms], j] = 1.0

        def place(batch: pa.RecordBatch, known=known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Each memory's length, and memory and term of each of its words that are asked for."""
            lists = batch.column("w")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            term = pc.index_in(lists.flatten(), known)
            own = np.repeat(np.arange(batch.num_rows), size)
            there = term.is_valid().to_numpy(zero_copy_only=False)
            return size, own[there], term.drop_null().to_numpy()

        def count(batches: Iterator[pa.RecordBatch], place=place, width=len(known)) -> Iterator[pa.RecordBatch]:
            held, seen, total = np.zeros(width, dtype=np.int64), 0, 0
            for batch in batches:
                size, own, term = place(batch)
                held += np.bincount(np.unique(own * width + term) % width, minlength=width) if width else 0
                seen, total = seen + batch.num_rows, total + int(size.sum())
            at = np.arange(-2, width)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([[seen, total], held]))], names=["term", "n"])

        counts = {r.term: r.n for r in rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term
        seen, total = counts.get(-2, 0), counts.get(-1, 0)
        df = np.array([counts.get(i, 0) for i in range(len(known))], dtype=float)
        weight = np.log(1 + (seen - df + 0.5) / (df + 0.5))[:, None] * wanted
        sent = memories.sparkSession.sparkContext.broadcast(([r.query_id for r in block], weight, total / max(seen, 1)))

        def score(batches: Iterator[pa.RecordBatch], sent=sent, place=place) -> Iterator[pa.RecordBatch]:
            ids, weight, mean = sent.value
            for whole in batches:
                for batch in (whole.slice(i, LEXICAL_ROWS) for i in range(0, whole.num_rows, LEXICAL_ROWS)):
                    size, own, term = place(batch)
                    if not len(own) or not ids:
                        continue
                    tf = np.zeros((batch.num_rows, len(weight)))
                    np.add.at(tf, (own, term), 1.0)
                    tf *= (BM25_K1 + 1) / (tf + (BM25_K1 * (1 - BM25_B + BM25_B * size / max(mean, 1e-9)))[:, None])
                    scores = np.round(tf @ weight, digits)
                    keys = batch.column(key).to_numpy(zero_copy_only=False)
                    best = [np.lexsort((keys, -scores[:, j]))[:k] for j in range(len(ids))]
                    j = np.repeat(np.arange(len(ids)), [len(x) for x in best])
                    best = np.concatenate(best)
                    hit = scores[best, j] > 0
                    j, best = j[hit], best[hit]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in j], kinds_pa[0]), batch.column(key).take(pa.array(best)), pa.array(scores[best, j])], names=["query_id", key, "score"])

        kinds_pa = [to_arrow_type(f.dataType) for f in kinds.fields]
        part = rows.mapInArrow(score, kinds)
        out = part if out is None else out.unionByName(part)
    return ranked(out, k, key)


def vector(items: DataFrame, queries: DataFrame, k: int, key: str = "id", digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank) by cosine of ``embedding``, rounded to ``digits``; equal scores by key.

    The queries, a stated set, go to the executors in blocks of QUERY_BLOCK at most.  Each
    batch of items is multiplied with a block and gives only its own best ``k`` of each
    query, so few rows move.  A null embedding is no item and no query; a zero one has
    similarity 0 to all.
    """
    asked = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    kinds = T.StructType([asked.schema["query_id"], items.schema[key]]).add("score", "double")
    rows = items.where("embedding IS NOT NULL").select(key, "embedding")
    out = None
    for n in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()  # one block
        sent = items.sparkSession.sparkContext.broadcast((block.column("query_id").to_pylist(), _unit(block.column("embedding").combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, asked_for = sent.value
            for batch in batches:
                if not ids or not batch.num_rows:
                    continue
                keys = batch.column(key).to_numpy(zero_copy_only=False)
                scores = np.round(_unit(batch.column("embedding")) @ asked_for.T, digits)
                best = np.concatenate([np.lexsort((keys, -scores[:, j]))[:k] for j in range(len(ids))])
                j = np.repeat(np.arange(len(ids)), min(k, batch.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in j]), batch.column(key).take(pa.array(best)), pa.array(scores[best, j])], names=["query_id", key, "score"])

        part = rows.mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    return ranked(out, k, key)


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of length 1, or 0 for zero vectors."""
    if not len(vectors):
        return np.zeros((0, 1))
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(vectors), -1)
    length = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, length, out=np.zeros_like(flat), where=length > 0)


def fused(*rankings: DataFrame, k: int, key: str = "id", constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank) over the rankings."""
    out = None
    for r in rankings:
        part = r.select("query_id", key, (1.0 / (F.lit(constant) + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return ranked(out.groupBy("query_id", key).agg(F.sum("part").alias("score")), k, key)


def within_budget(hits: DataFrame, tokens, budget: int = FACT_TOKENS, by: str = "query_id") -> DataFrame:
    """The best hits of each query whose running sum of tokens stays within the budget; for hits that are few for each query."""
    spent = F.sum(tokens).over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("spent", spent).where(F.col("spent") <= budget)


def first_within_budget(rows: DataFrame, tokens, order: list[str], budget: int = FACT_TOKENS, by: str = "query_id") -> DataFrame:
    """``rows`` with ``spent``, in the order of ``order``, as long as their running sum of ``tokens`` stays within the budget of each ``by``.

    Rows are sorted into ranges; a row for each range and ``by`` says what was spent before,
    and only ranges that begin within the budget are looked at again, each by itself.  So a
    ``by`` with most of the rows is no large task.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    sized = rows.withColumn("_tokens", F.coalesce(tokens, F.lit(0)).cast("bigint"))
    ranged = materialize(sized.repartitionByRange(by, *order, F.xxhash64(*columns)).withColumn("_range", F.spark_partition_id()), "budget")
    sums = ranged.groupBy(by, "_range").agg(F.sum("_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    open_ = sums.select(F.col(by).alias("_by"), F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before")).where(F.col("_before") <= budget)
    kept = ranged.join(open_, (F.col("_range") == F.col("_at")) & F.col(by).eqNullSafe(F.col("_by")))
    own = F.sum("_tokens").over(Window.partitionBy("_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("spent", F.col("_before") + own).where(F.col("spent") <= budget).select(*columns, "spent")


def people(observations: DataFrame, n: int = PEOPLE) -> DataFrame:
    """(name, observations, first): the people most observed, with their first observation."""
    return observations.groupBy("name").agg(F.count(F.lit(1)).alias("observations"), F.min_by("text", F.struct("t", "text")).alias("first")).orderBy(F.desc("observations"), "name").limit(n)


def time_label(start, mentioned, end):
    return first_filled(start, mentioned, end)


def network_sizes(**networks: DataFrame) -> DataFrame:
    """(network, n): how many rows each network has."""
    out = None
    for name, df in networks.items():
        row = df.agg(F.lit(name).alias("network"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def networks(bank: str, episodic: DataFrame, semantic: DataFrame, persons: DataFrame, principles: DataFrame, connections: str) -> DataFrame:
    """One row for one user's page: arrays of the given short lists."""
    out = episodic.sparkSession.createDataFrame([(bank, connections)], "bank_id string, connections string").withColumn("_one", F.lit(1))
    for name, df in (("episodic", episodic), ("semantic", semantic), ("people", persons), ("principles", principles)):
        out = out.join(df.agg(F.lit(1).alias("_one"), F.collect_list(F.struct(*df.columns)).alias(name)), "_one")
    return out.drop("_one")
