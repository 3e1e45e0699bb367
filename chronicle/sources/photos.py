"""Photo library: assets, their attributes, faces and persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronicle.functions.text import filled
from chronicle.functions.time import from_seconds_2001
from chronicle.sources.common import canonical

#: The value that stands for a missing coordinate.
NO_COORDINATE = -180.0


def coordinate(value: Column) -> Column:
    return F.nullif(value, F.lit(NO_COORDINATE))


def named_people(face: DataFrame, person: DataFrame) -> DataFrame:
    """(asset, people): the sorted distinct names on each asset; unnamed faces are left out."""
    named = person.where(filled(F.col("ZDISPLAYNAME")).isNotNull()).select(F.col("Z_PK").alias("_person"), "ZDISPLAYNAME")
    return face.join(named, face["ZPERSONFORFACE"] == F.col("_person")).groupBy(F.col("ZASSETFORFACE").alias("_asset")).agg(F.array_sort(F.collect_set("ZDISPLAYNAME")).alias("people"))


def records(asset: DataFrame, attributes: DataFrame, face: DataFrame, person: DataFrame) -> DataFrame:
    """One row for each asset with a capture time; of several attribute rows the first counts."""
    names = attributes.groupBy(F.col("ZASSET").alias("_owner")).agg(F.min_by("ZORIGINALFILENAME", "Z_PK").alias("_original"))
    people = named_people(face, person)
    rows = asset.where("ZDATECREATED IS NOT NULL").join(names, asset["Z_PK"] == names["_owner"], "left").join(people, asset["Z_PK"] == people["_asset"], "left")
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    flag = lambda name: F.coalesce(F.col(name), F.lit(0)) != 0
    return rows.select(
        F.col("Z_PK").alias("pk"),
        F.col("ZUUID").alias("id"),
        from_seconds_2001(F.col("ZDATECREATED")).alias("captured_at"),
        coordinate(F.col("ZLATITUDE")).alias("lat"),
        coordinate(F.col("ZLONGITUDE")).alias("lng"),
        F.coalesce(filled(F.col("_original")), text("ZFILENAME")).alias("original_filename"),
        F.concat(F.lit("originals/"), text("ZDIRECTORY"), F.lit("/"), text("ZFILENAME")).alias("original_path"),
        F.coalesce("ZWIDTH", F.lit(0)).alias("width"),
        F.coalesce("ZHEIGHT", F.lit(0)).alias("height"),
        flag("ZFAVORITE").alias("is_favorite"),
        flag("ZHIDDEN").alias("is_hidden"),
        flag("ZTRASHEDSTATE").alias("is_trashed"),
        F.when(F.col("ZKIND") == 1, "video").otherwise("photo").alias("kind"),
        F.coalesce("people", F.array().cast("array<string>")).alias("people"),
    )


_EXTRA = ["lat", "lng", "original_filename", "original_path", "width", "height", "is_favorite", "is_hidden", "is_trashed", "kind", "people"]


def events(photos: DataFrame) -> DataFrame:
    """Canonical events of photo records; they belong to no thread."""
    return canonical(
        photos,
        [F.col("pk")],
        id=F.col("id"),
        t_utc=F.col("captured_at"),
        raw_ref=F.concat(F.lit("photos.sqlite#"), F.col("pk").cast("string")),
        source=F.lit("photos"),
        additional_data=F.to_json(F.struct(*_EXTRA), {"ignoreNullFields": "false"}),
    )
