"""Transcripts of episodes and the documents made of them."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.text import TRANSCRIPT_CHARS, contact_label, event_line, shorten
from chronicle.functions.time import iso_utc
from chronicle.operators.levels import LevelledTable, folders


def with_transcript(episodes: DataFrame, limit: int = TRANSCRIPT_CHARS) -> DataFrame:
    """``episodes`` with their contact's label and their transcript, one line an event."""
    out = episodes.withColumn("contact", contact_label(F.col("thread_id")))
    lines = F.transform("events", lambda e: event_line(e["author_role"], e["content"], F.col("contact")))
    return out.withColumn("transcript", shorten(F.array_join(lines, "\n"), limit))


def documents(episodes: DataFrame, limit: int | None = None, tag: str | None = None) -> DataFrame:
    """One document for each episode, for a memory bank: content, time, entities, tags, metadata.

    ``limit`` None or 0 means all.  ``tag`` replaces the episode's own source, as older
    banks have the same tag for every source.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    rows = with_transcript(episodes)
    if limit:
        rows = rows.orderBy("thread_seq", "thread_id", "episode").limit(limit)
    source = F.lit(tag) if tag else F.get("events", 0)["source"]
    return rows.select(
        F.col("transcript").alias("content"),
        F.col("start_utc").alias("timestamp"),
        F.array(F.struct(F.col("contact").alias("text"))).alias("entities"),
        F.array(source).alias("tags"),
        F.create_map(
            F.lit("episode_id"), F.col("episode_id"), F.lit("thread_id"), F.col("thread_id"), F.lit("start_utc"), iso_utc(F.col("start_utc")), F.lit("end_utc"), iso_utc(F.col("end_utc"))
        ).alias("metadata"),
    )


DOCUMENT = "id string, content string, timestamp timestamp, entities array<struct<text: string>>, tags array<string>, metadata map<string, string>"


def bank_table(spark: SparkSession, bank_path: str, bank: str) -> LevelledTable:
    """The documents of one bank, by episode; a bank is a folder under ``bank_path``, named so that any name is one."""
    return LevelledTable(spark, f"{bank_path.rstrip('/')}/{quote(bank, safe='')}", DOCUMENT, "id", sort=("timestamp",))


def create_bank(spark: SparkSession, bank_path: str, bank: str) -> bool:
    """Make an empty bank; False if it is there already, which changes nothing."""
    table = bank_table(spark, bank_path, bank)
    if table.exists():
        return False
    table.create()
    return True


def banks(spark: SparkSession, bank_path: str) -> list[str]:
    """The names of all banks, also of those without documents."""
    return [unquote(name) for name in folders(spark, bank_path)]


def retain(docs: DataFrame, bank_path: str, bank: str) -> int:
    """Put documents into a bank, which is made if need be; how many were given.

    A document takes the place of that of the same episode, so an episode that has grown since
    the last load has one document, the newer one.
    """
    return bank_table(docs.sparkSession, bank_path, bank).add(docs.withColumn("id", F.col("metadata")["episode_id"]))
