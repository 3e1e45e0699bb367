"""Listening history: JSON arrays in files ``Streaming_History_*.json``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.ids import play_id
from chronicle.functions.text import filled, first_filled, play_kind
from chronicle.functions.time import iso_utc, parse_iso
from chronicle.schema import PLAY
from chronicle.sources.common import canonical

FILES = "Streaming_History_*.json"
THREAD = "spotify:listening"
MIN_MS = 30_000


def records(spark: SparkSession, folder: str) -> DataFrame:
    """All plays of a folder, or of its sub-folders if it has no such file itself; none at all is an error."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for pattern in (f"{folder}/{FILES}", f"{folder}/*/{FILES}"):
        path = fs_path(pattern)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
            return spark.read.schema(PLAY).option("multiLine", True).option("mode", "FAILFAST").json(pattern)
    raise FileNotFoundError(f"no {FILES} in {folder}")


def kind() -> Column:
    c = F.col
    return play_kind(c("spotify_track_uri"), c("master_metadata_track_name"), c("spotify_episode_uri"), c("episode_name"), c("audiobook_uri"), c("audiobook_title"))


def display_title() -> Column:
    return first_filled(F.col("master_metadata_track_name"), F.col("episode_name"), F.col("audiobook_chapter_title"))


def track_id() -> Column:
    return F.substring_index(filled(F.col("spotify_track_uri")), ":", -1)


def content_line() -> Column:
    """What was played, in words."""
    some = lambda name, fallback: F.coalesce(filled(F.col(name)), F.lit(fallback))
    also = lambda before, name, after="": F.coalesce(F.concat(F.lit(before), filled(F.col(name)), F.lit(after)), F.lit(""))
    music = F.concat(
        F.lit("Listened to '"), some("master_metadata_track_name", "unknown track"), F.lit("' by "), some("master_metadata_album_artist_name", "unknown artist"),
        also(" (album ", "master_metadata_album_album_name", ")"),
    )
    podcast = F.concat(F.lit("Listened to podcast '"), some("episode_name", "unknown episode"), F.lit("'"), also(" from ", "episode_show_name"))
    book = F.concat(F.lit("Listened to '"), some("audiobook_chapter_title", "a chapter"), F.lit("'"), also(" from ", "audiobook_title"))
    other = F.concat(F.lit("Played "), F.coalesce(display_title(), F.lit("unknown content")))
    return F.when(kind() == "music", music).when(kind() == "podcast", podcast).when(kind() == "audiobook", book).otherwise(other)


def events(plays: DataFrame, min_ms: int = MIN_MS) -> DataFrame:
    """Canonical events of plays of at least ``min_ms``; all in one thread of the user's own."""
    rows = plays.where(F.coalesce("ms_played", F.lit(0)) >= min_ms).withColumn("_t", parse_iso(F.col("ts")))
    uri = first_filled(F.col("spotify_track_uri"), F.col("spotify_episode_uri"), F.col("audiobook_uri"))
    ref = F.coalesce(uri, F.concat(F.lit("spotify:"), F.coalesce(display_title(), F.lit("None"))))
    raw_ref = F.concat(ref, F.lit("#"), iso_utc(F.col("_t")))
    return canonical(
        rows,
        [F.unix_micros("_t")],
        id=play_id(raw_ref), t_utc=F.col("_t"), author_role=F.lit("self"), content=content_line(), thread_id=F.lit(THREAD), raw_ref=raw_ref, source=F.lit("spotify"),
    )
