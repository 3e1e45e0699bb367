"""Confidence as a ledger of changes: current state, decay, promotion, pruning, queues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronicle.tables import materialize

PRIORITIES = {"high": 0, "normal": 1}


def once(assertions: DataFrame, key: str = "assertion_key") -> DataFrame:
    """Each assertion counts as evidence once: the earliest row of a key."""
    fields = F.struct(*[c for c in assertions.columns if c != key])
    return assertions.groupBy(key).agg(F.min_by(fields, F.struct("t", "id")).alias("r")).select(key, "r.*")


def confidence(deltas: DataFrame, subject: str = "subject") -> DataFrame:
    """(subject, confidence, changes): the sum of all changes, kept between 0 and 1."""
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum("delta")))
    return deltas.groupBy(subject).agg(total.alias("confidence"), F.count(F.lit(1)).alias("changes"))


def _composed(delta: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the changes of its subject up to it as one function x -> min(high, max(low, x + total)).

    Adding and keeping within bounds, done one after another, is again of that form, and in
    any grouping the same, so all rows are composed by doubling.  ``new`` marks where a
    subject begins.
    """
    total, low, high = delta.copy(), np.zeros(len(delta)), np.ones(len(delta))
    start = np.maximum.accumulate(np.where(new, np.arange(len(delta)), 0))
    step = 1
    while step < len(delta):
        at = np.arange(step, len(delta))
        at = at[at - step >= start[at]]
        if not len(at):
            break
        before = at - step
        low2 = np.minimum(high[at], np.maximum(low[at], low[before] + total[at]))
        high2 = np.minimum(high[at], np.maximum(low[at], high[before] + total[at]))
        total2 = total[before] + total[at]
        total[at], low[at], high[at] = total2, low2, high2
        step *= 2
    return total, low, high


def running(deltas: DataFrame, subject: str = "subject", order: tuple[str, ...] = ("t", "id"), first: float = 0.0) -> DataFrame:
    """``deltas`` (subject, delta and more) with ``confidence`` after each change, kept between 0 and 1 every time.

    Rows are sorted into ranges of subject and order.  In a range each row gets the composition
    of its subject's changes since the range began, in Arrow batches; a row for each end of a
    range says with what value the next one begins.  So a subject of any length lies in many
    tasks.  A null delta changes nothing; rows without a subject are one subject.
    """
    names = deltas.columns
    schema = deltas.select(F.col(subject).alias("_subject"), F.lit(0).alias("_range"), F.lit(0).cast("bigint").alias("_at"), F.lit(0.0).alias("_total"), F.lit(0.0).alias("_low"), F.lit(0.0).alias("_high"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("_subject").dictionary_encode()
            code = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], code[1:] != code[:-1]])
            total, low, high = _composed(b.column("_delta").to_numpy(zero_copy_only=False).astype(float), new)
            lead = len(code) if new[1:].sum() == 0 else int(np.flatnonzero(new[1:])[0]) + 1
            if last is not None and last[0] == b.column("_subject")[0].as_py():  # the batch goes on with the subject of the one before
                _, t, lo, hi = last
                a, c = low[:lead].copy(), high[:lead].copy()
                low[:lead], high[:lead] = (np.minimum(c, np.maximum(a, x + total[:lead])) for x in (lo, hi))
                total[:lead] += t
            last = (b.column("_subject")[-1].as_py(), total[-1], low[-1], high[-1])
            columns = [b.column("_subject"), b.column("_range"), pa.array(np.arange(at, at + b.num_rows)), pa.array(total), pa.array(low), pa.array(high), b.column("_row")]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = deltas.select(F.col(subject).alias("_subject"), F.coalesce(F.col("delta").cast("double"), F.lit(0.0)).alias("_delta"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    keys = [F.col("_subject"), *[F.col(f"_row.{c}") for c in order]]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    scanned = materialize(ranged.mapInArrow(run, schema), "running")
    ends = scanned.groupBy("_range").agg(F.min_by(F.struct("_subject"), "_at").alias("a"), F.max_by(F.struct("_subject", "_total", "_low", "_high"), "_at").alias("z")).orderBy("_range").collect()  # a row a range
    starts, held, value = [], None, first
    for e in ends:
        if held is not None and held[0] == e.a["_subject"]:
            starts.append((e["_range"], value))
        goes_on = held is not None and held[0] == e.z["_subject"]
        value = min(e.z["_high"], max(e.z["_low"], (value if goes_on else first) + e.z["_total"]))
        held = (e.z["_subject"], e.a["_subject"])
    opening = {e["_range"]: e.a["_subject"] for e in ends}
    known = deltas.sparkSession.createDataFrame([(r, opening[r], v) for r, v in starts], f"_range int, _subject {schema['_subject'].dataType.simpleString()}, _start double").withColumnsRenamed({"_range": "_r", "_subject": "_s"})
    told = scanned.join(F.broadcast(known), (F.col("_range") == F.col("_r")) & F.col("_subject").eqNullSafe(F.col("_s")), "left")  # a row a range
    after = F.least(F.col("_high"), F.greatest(F.col("_low"), F.coalesce("_start", F.lit(first)) + F.col("_total")))
    return told.select("_row.*", after.alias("confidence"))


def current(history: DataFrame, subject: str = "subject", order: tuple[str, ...] = ("t", "id")) -> DataFrame:
    """The latest state of each subject in an append-only history."""
    fields = F.struct(*[c for c in history.columns if c != subject])
    return history.groupBy(subject).agg(F.max_by(fields, F.struct(*order)).alias("r")).select(subject, "r.*")


def decayed(value: Column, age_days: Column, half_life_days: float) -> Column:
    return value * F.exp(-F.ln(F.lit(2.0)) * age_days / half_life_days)


def state(value: Column, supporters: Column, promote_at: float = 0.7, least_supporters: int = 2, drop_at: float = 0.2) -> Column:
    """provisional, active after enough corroboration, or archived."""
    return F.when(value < drop_at, "archived").when((value >= promote_at) & (supporters >= least_supporters), "active").otherwise("provisional")


def pruned(subjects: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(kept, archived) by confidence."""
    return subjects.where(F.col("confidence") >= threshold), subjects.where((F.col("confidence") < threshold) | F.col("confidence").isNull())


def verdict(support: Column, against: Column, least: int = 2) -> Column:
    """reinforce, contradict, candidate or insufficient, by counts of evidence for and against."""
    both = support + against
    return F.when(both == 0, "insufficient").when(against > support, "contradict").when(support >= least, "reinforce").otherwise("candidate")


def queue(items: DataFrame) -> DataFrame:
    """Open items, urgent ones first, then the oldest."""
    band = F.lit(len(PRIORITIES))
    for name, place in PRIORITIES.items():
        band = F.when(F.col("priority") == name, place).otherwise(band)
    return items.withColumn("band", band).orderBy("band", "created_at", "id")


def places(items: DataFrame) -> DataFrame:
    """All items of the queue with their ``place`` in it, from 1.

    Rows are numbered inside ranges of the order; a row for each range carries the counts of those before.
    """
    order = ["band", "created_at", "id"]
    ranged = materialize(queue(items).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "queue")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    start = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(start), "_range").withColumn("place", (F.col("_start") + F.col("_own")).cast("bigint")).drop("_range", "_own", "_start")


def with_contradictions(capsules: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Capsules with the contradiction they answer; those get high priority."""
    told = contradictions.select(F.col("id").alias("parent_contradiction"), F.col("text").alias("contradiction"))
    out = capsules.join(told, "parent_contradiction", "left")
    return out.withColumn("priority", F.when(F.col("contradiction").isNotNull(), "high").otherwise(F.col("priority")))


def source_refs(units: DataFrame, by: str) -> DataFrame:
    """(by, source_refs): where each unit comes from, without repeats."""
    return units.groupBy(by).agg(F.array_sort(F.collect_set("raw_ref")).alias("source_refs"))


def tagged_handles(units: DataFrame, handles: DataFrame) -> DataFrame:
    """``units`` (id, author) with the ``contact`` and ``kind`` of their author's handle (handle, contact, kind).

    Handles are compared without blanks, dashes, dots and brackets and in lower case; an unknown one stays as it is.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, r"[\s().-]", ""))
    known = handles.select(plain("handle").alias("_handle"), "contact", "kind").dropDuplicates(["_handle"])
    out = units.withColumn("_own", plain("author")).join(known, F.col("_own") == F.col("_handle"), "left")
    return out.withColumn("contact", F.coalesce("contact", "author")).drop("_own", "_handle")


def dates_in(text: Column) -> Column:
    """ISO dates that a text names."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)))
