"""Events and episodes as JSON lines: the records that other tools write and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.ids import content_sha
from chronicle.functions.time import iso_utc, parse_iso
from chronicle.sources.common import COLUMNS

RECORD = "id string, t_utc string, author_role string, content string, thread_id string, reply_to string, raw_ref string, source string, additional_data string"
EPISODE_RECORD = f"id string, thread_id string, t_start string, t_end string, participants array<string>, events array<struct<{RECORD.replace(' string', ': string')}>>"
#: What a record without these fields has.
SOURCE, EXTRA = "imessage", "{}"


def record(field) -> Column:
    """An event as a record: ISO time, extra data as an object.  ``field`` gives the column of a name."""
    extra = F.parse_json(F.coalesce(field("additional_data"), F.lit(EXTRA)))
    plain = [field(c).cast("string").alias(c) for c in ("author_role", "content", "thread_id", "reply_to", "raw_ref", "source")]
    return F.struct(field("id").alias("id"), iso_utc(field("t_utc")).alias("t_utc"), *plain, extra.alias("additional_data"))


def event_records(events: DataFrame) -> DataFrame:
    """(value): each event as one line of JSON."""
    return events.select(F.to_json(record(F.col), {"ignoreNullFields": "false"}).alias("value"))


def episode_records(episodes: DataFrame) -> DataFrame:
    """(value): each episode, with its events, as one line of JSON; ``episodes`` as ``episodes.build`` gives them."""
    own = F.transform("events", lambda e: record(lambda c: F.col("thread_id") if c == "thread_id" else e[c]))
    fields = [F.col("episode_id").alias("id"), "thread_id", iso_utc(F.col("start_utc")).alias("t_start"), iso_utc(F.col("end_utc")).alias("t_end"), "participants", own.alias("events")]
    return episodes.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write(records: DataFrame, path: str) -> int:
    """Write lines over what is there; the number of lines."""
    seen = Observation()
    records.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return seen.get.get("n", 0)


def _event(field) -> dict[str, Column]:
    """An event's columns from a record; a missing source or extra data gets its default."""
    return {
        **{c: field(c) for c in ("id", "author_role", "content", "thread_id", "reply_to", "raw_ref")},
        "t_utc": parse_iso(field("t_utc")),
        "source": F.coalesce(field("source"), F.lit(SOURCE)),
        "additional_data": F.coalesce(field("additional_data"), F.lit(EXTRA)),
    }


def _in_file_order(rows: DataFrame) -> DataFrame:
    """``rows`` of files with ``ingest_seq``: files by name, in a file line by line, so that the last line of an id is the last row."""
    placed = rows.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()})
    parts = sorted(placed.select("_file", "_start").distinct().collect())  # a row for each split of a file
    number = rows.sparkSession.createDataFrame([(f, s, k) for k, (f, s) in enumerate(parts)], "_file string, _start bigint, _part bigint")
    # A task reads its splits from the first line to the last, so its own count orders the lines of one.
    seq = F.col("_part") * (1 << 33) + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(number), ["_file", "_start"]).withColumn("ingest_seq", seq.cast("bigint"))  # a row for each split


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events from their records; equal times, and rows of one id, have the order of the lines."""
    own = _event(F.col)
    rows = _in_file_order(spark.read.schema(RECORD).option("mode", "FAILFAST").json(path))
    out = rows.select(*[c.alias(name) for name, c in own.items()], "ingest_seq")
    return out.withColumn("content_sha", content_sha(F.col("content"), F.col("additional_data"))).select(*COLUMNS)


MEDIA_RECORD = "id string, capsule_id string, kind string, file_path string, mime string, byte_size bigint, exif_t string, exif_lat double, exif_lng double"
CAPSULE_RECORD = f"id string, created_at string, place_name string, lat double, lng double, media array<struct<{MEDIA_RECORD.replace(' string', ': string').replace(' bigint', ': bigint').replace(' double', ': double')}>>"


def media_record(field, capsule: Column) -> Column:
    """A media item as a record.  ``field`` gives the column of a name."""
    time = F.when(field("exif_t").isNotNull(), iso_utc(field("exif_t"))).alias("exif_t")
    return F.struct(field("id").alias("id"), capsule.alias("capsule_id"), *[field(c).alias(c) for c in ("kind", "file_path", "mime", "byte_size")], time, *[field(c).alias(c) for c in ("exif_lat", "exif_lng")])


def capsule_records(nested: DataFrame) -> DataFrame:
    """(value): each capsule with its media (as ``capsules.with_media`` gives them) as one line of JSON."""
    own = F.transform("media", lambda m: media_record(lambda c: m[c], F.col("id")))
    return nested.select(F.to_json(F.struct("id", iso_utc(F.col("created_at")).alias("created_at"), "place_name", "lat", "lng", own.alias("media")), {"ignoreNullFields": "false"}).alias("value"))


def read_capsules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(capsules, media) from records of capsules; a record without media has none."""
    rows = spark.read.schema(CAPSULE_RECORD).option("mode", "FAILFAST").json(path)
    media = rows.select(F.explode("media").alias("m")).select("m.*").withColumn("exif_t", F.when(F.col("exif_t") != "", parse_iso(F.col("exif_t"))))
    return rows.select("id", parse_iso(F.col("created_at")).alias("created_at"), "place_name", "lat", "lng"), media


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, thread_id, start_utc, end_utc, participants, events) from records of episodes."""
    rows = spark.read.schema(EPISODE_RECORD).option("mode", "FAILFAST").json(path)
    own = F.transform(F.coalesce("events", F.array().cast(rows.schema["events"].dataType)), lambda e: F.struct(*[c.alias(name) for name, c in _event(lambda n: e[n]).items()]))
    names = F.coalesce("participants", F.array().cast("array<string>"))
    return rows.select(F.col("id").alias("episode_id"), "thread_id", parse_iso(F.col("t_start")).alias("start_utc"), parse_iso(F.col("t_end")).alias("end_utc"), names.alias("participants"), own.alias("events"))
