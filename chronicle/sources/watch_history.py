"""Watch history of a video service: only its music."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.ids import short_sha
from chronicle.functions.time import iso_utc, parse_iso
from chronicle.schema import WATCH_HISTORY
from chronicle.sources.common import canonical

HEADER = "YouTube Music"


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WATCH_HISTORY).option("multiLine", True).option("mode", "FAILFAST").json(path)


def video_id(url):
    return F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))


def events(history: DataFrame) -> DataFrame:
    """Canonical events of the music rows; without a video id the title names the row."""
    rows = history.where(F.col("header") == HEADER).withColumn("_t", parse_iso(F.col("time")))
    title = F.coalesce("title", F.lit(""))
    name = F.coalesce(F.concat(F.lit("yt:video:"), video_id(F.col("titleUrl"))), F.concat(F.lit("yt:title:"), title))
    raw_ref = F.concat(name, F.lit("#"), iso_utc(F.col("_t")))
    channel = F.get("subtitles", 0)["name"]
    line = F.concat(F.lit("Listened to '"), title, F.lit("'"), F.coalesce(F.concat(F.lit(" on "), channel), F.lit("")))
    return canonical(
        rows, [F.unix_micros("_t")], id=short_sha(raw_ref), t_utc=F.col("_t"), author_role=F.lit("self"), content=line, thread_id=F.lit("youtube_music:listening"), raw_ref=raw_ref, source=F.lit("youtube_music")
    )
