"""Extra data of events as variants: parsed once, stored as such, and read by path and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_extra(events: DataFrame, column: str = "additional_data", to: str = "extra") -> DataFrame:
    """``events`` with their extra data as a variant; text that is no JSON is a variant of that text, a missing one of ``{}``."""
    text = F.coalesce(F.col(column), F.lit("{}"))
    return events.withColumn(to, F.coalesce(F.try_parse_json(text), F.to_variant_object(F.struct(text.alias("text")))))


def value(path: str, kind: str, column: str = "extra") -> Column:
    """What stands at ``path`` (``$.a[0].b``) as ``kind``; null where it is missing or of another kind."""
    return F.try_variant_get(column, path, kind)


def fields(events: DataFrame, column: str = "extra") -> DataFrame:
    """(field, kind, n): each field of the extra data's objects with the type of its value, and in how many events."""
    each = events.select(F.col(column).alias("v"))
    exploded = each.lateralJoin(each.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return exploded.groupBy(F.col("key").alias("field"), F.schema_of_variant("value").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def shredded(events: DataFrame, paths: dict[str, tuple[str, str]], column: str = "extra") -> DataFrame:
    """``events`` with typed columns (name: path, kind) beside the variant, so that files have statistics of them."""
    return events.withColumns({name: value(path, kind, column) for name, (path, kind) in paths.items()})
