"""Places with media that a user made: capsules, their media, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronicle.functions.text import is_blank, media_kind, strip
from chronicle.sources.common import canonical


def with_media(capsules: DataFrame, media: DataFrame) -> DataFrame:
    """Each capsule with its media as an array ordered by id; without any, an empty one."""
    fields = [c for c in media.columns if c != "capsule_id"]
    own = media.groupBy(F.col("capsule_id").alias("_capsule")).agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in fields if c != "id"]))).alias("media"))
    joined = capsules.join(own, capsules["id"] == own["_capsule"], "left").drop("_capsule")
    return joined.withColumn("media", F.coalesce("media", F.array().cast(joined.schema["media"].dataType)))


def checked_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) uploads (capsule_id, pos, filename, content, content_type): only media kinds that are known."""
    kinds = uploads.withColumn("kind", media_kind(F.col("content_type")))
    return kinds.where("kind IS NOT NULL"), kinds.where("kind IS NULL").drop("kind").withColumn("reason", F.lit("unsupported media type"))


def notes(uploads: DataFrame) -> DataFrame:
    """(capsule_id, note): the first upload of a text type that is not blank."""
    text = F.expr("make_valid_utf8(cast(content AS string))")
    some = uploads.where(F.col("content_type").startswith("text/")).withColumn("_note", strip(text)).where(~is_blank(F.col("_note")))
    return some.groupBy("capsule_id").agg(F.min_by("_note", "pos").alias("note"))


def named(capsules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) capsules: a place needs a name."""
    blank = is_blank(F.col("place_name"))
    return capsules.where(~blank), capsules.where(blank).withColumn("reason", F.lit("blank place name"))


def media_json() -> Column:
    return F.transform("media", lambda m: F.struct(m["id"].alias("id"), m["kind"].alias("kind"), m["file_path"].alias("file_path"), m["mime"].alias("mime")))


def events(nested: DataFrame) -> DataFrame:
    """Canonical events of capsules with media, and a ``note`` if the column is there."""
    note = F.col("note") if "note" in nested.columns else F.lit(None)
    extra = F.struct("place_name", "lat", "lng", media_json().alias("media"))
    return canonical(
        nested,
        [F.unix_micros("created_at")],
        id=F.col("id"), t_utc=F.col("created_at"), author_role=F.lit("self"), content=note, raw_ref=F.concat(F.lit("capsule#"), F.col("id")), source=F.lit("capsule"),
        additional_data=F.to_json(extra, {"ignoreNullFields": "false"}),
    )


def cards(nested: DataFrame) -> DataFrame:
    """(id, title, cover, lat, lng, day, media): the first photo is the cover and stands in for a missing place."""
    shown = F.filter("media", lambda m: m["kind"].isin("photo", "video"))
    photo = F.get(F.filter("media", lambda m: m["kind"] == "photo"), 0)
    return nested.select(
        "id",
        F.col("place_name").alias("title"),
        photo["file_path"].alias("cover"),
        F.coalesce("lat", photo["exif_lat"]).alias("lat"),
        F.coalesce("lng", photo["exif_lng"]).alias("lng"),
        F.date_format("created_at", "yyyy-MM-dd").alias("day"),
        shown.alias("media"),
    )


def map_points(shown: DataFrame) -> DataFrame:
    """Cards that have a place."""
    return shown.where("lat IS NOT NULL AND lng IS NOT NULL")


def discovered(points: DataFrame) -> DataFrame:
    """(found, placed): pins whose column ``discovered`` holds, and all pins that have a place, in one row."""
    return map_points(points).agg(F.count_if("discovered").alias("found"), F.count(F.lit(1)).alias("placed"))


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))
