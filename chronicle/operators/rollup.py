"""Sums over sources, roles and days: stored once a day with sketches, and rolled up from there.

A day's row holds exact counts and two sketches: of its threads (HyperLogLog, for distinct
counts) and of the lengths of its contents (KLL, for quantiles).  Sketches merge without a
look at the events, so any union of days, sources and roles costs a row a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**HLL_BITS registers give a relative standard error of about 1.04 / 2**(HLL_BITS / 2), 1.6 %; KLL_K gives ranks within 1.33 % at 99 %.
HLL_BITS, KLL_K = 12, 200
KEYS = ("source", "kind", "day")


def daily(events: DataFrame) -> DataFrame:
    """(source, kind, day, n, first_t, last_t, threads, sizes): a row for each source, role and UTC day; the last two are sketches."""
    size = F.coalesce(F.char_length("content"), F.lit(0)).cast("bigint")
    return events.groupBy("source", F.col("author_role").alias("kind"), F.to_date("t_utc").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("t_utc").alias("first_t"), F.max("t_utc").alias("last_t"), F.hll_sketch_agg("thread_id", HLL_BITS).alias("threads"), F.kll_sketch_agg_bigint(size, KLL_K).alias("sizes")
    )


def _sums() -> list:
    return [
        F.sum("n").alias("n"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), F.count_distinct("day_").alias("days"),
        F.hll_union_agg("threads").alias("threads"), F.kll_merge_agg_bigint("sizes", KLL_K).alias("sizes"),
    ]


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored days with the days of events that came since; of the same events no more than one of the two may tell."""
    return stored.unionByName(new).withColumn("day_", F.col("day")).groupBy(*KEYS).agg(*_sums()).drop("days")


def cube(days: DataFrame) -> DataFrame:
    """Sums for all combinations of source, role and day; ``level`` tells null keys from sums over all (4 source, 2 kind, 1 day)."""
    return days.withColumn("day_", F.col("day")).cube(*KEYS).agg(*_sums(), F.grouping_id().alias("level"))


def grouping_sets(days: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """The same sums for the given sets of keys only."""
    keys = [k for k in KEYS if any(k in s for s in sets)]
    columns = lambda names: [F.col(k) for k in names]
    return days.withColumn("day_", F.col("day")).groupingSets([columns(s) for s in sets], *columns(keys)).agg(*_sums(), F.grouping_id().alias("level"))


def estimates(rolled: DataFrame) -> DataFrame:
    """``rolled`` with its sketches read: about how many threads, and the median and 95 % sizes."""
    at = lambda q: F.kll_sketch_get_quantile_bigint("sizes", F.lit(q))
    return rolled.withColumns({"median_size": at(0.5), "p95_size": at(0.95), "threads": F.coalesce(F.hll_sketch_estimate("threads"), F.lit(0))}).drop("sizes")
