"""The events table: union of sources, last-write-wins upsert, staged replace, integrity of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from chronicle.functions.ids import content_sha
from chronicle.operators.levels import LevelledTable
from chronicle.schema import EVENT


def union_sources(*events: DataFrame) -> DataFrame:
    """All events in one table; columns that a source lacks are null there."""
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out


def latest(versions: DataFrame, key: str = "id", order: str = "ingest_seq") -> DataFrame:
    """The whole last row of each key; of rows of equal order the one with the greatest content hash.

    One aggregation with a struct as long as the row would sort; ranking keeps rows in
    the shuffle's binary form instead.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), *_ties(versions)))
    return versions.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _ties(df: DataFrame) -> list[Column]:
    return [F.desc("content_sha")] if "content_sha" in df.columns else []


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "ingest_seq") -> DataFrame:
    """``old`` with the rows of ``new`` over it, whatever their order numbers; among new rows the last wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order), *_ties(both)))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def append_new(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Plain insertion: a key that is there already is an error."""
    clash = new.join(old.select(key), key, "left_semi").select(F.raise_error(F.concat(F.lit("duplicate id: "), F.col(key))).cast("string").alias(key))
    return old.unionByName(new).join(clash, key, "left_anti")


def by_source(events: DataFrame, source: str | None = None) -> DataFrame:
    """Events in time order, of one source or all; a source is a folder of the stored table."""
    rows = events if source is None else events.where(F.col("source") == source)
    return rows.orderBy("t_utc", "ingest_seq", "id")


def verify(events: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, intact): whether the row still has the hash it was stored with; null for an unknown id."""
    intact = events.select(F.col("id").alias("_id"), (content_sha(F.col("content"), F.col("additional_data")) == F.col("content_sha")).alias("intact"))
    return ids.join(intact, ids["id"] == intact["_id"], "left").select("id", "intact")


class EventTable(LevelledTable):
    """Events by id; a source is a folder of each bucket, and files are sorted by time."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, EVENT, "id", "ingest_seq", ("source",), ("t_utc",))


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines, over what is there; the number of rows."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get.get("n", 0)


def read_events_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Events from JSON lines; old ones without source or extra data get the defaults."""
    rows = spark.read.schema(EVENT).json(path)
    return rows.withColumns({"source": F.coalesce("source", F.lit("imessage")), "additional_data": F.coalesce("additional_data", F.lit("{}"))})
