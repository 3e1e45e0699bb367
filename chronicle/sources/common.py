"""What all sources share: the canonical columns and checks of enumerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronicle.functions.ids import content_sha
from chronicle.schema import EVENT

COLUMNS = [part.split()[0] for part in EVENT.split(", ")]


def canonical(df: DataFrame, seq: list[Column], **values: Column) -> DataFrame:
    """Events with exactly the canonical columns; what is not given is null, extra data is ``{}``.

    ``ingest_seq`` orders rows of equal time; it packs the columns ``seq`` (of at most
    2**31 values each, outer ones first) into one number that does not depend on partitions.
    """
    values = {"additional_data": F.lit("{}")} | values
    values = {c: values.get(c, F.lit(None)) for c in COLUMNS}
    number = F.lit(0).cast("bigint")
    for s in seq:
        number = number * (1 << 31 if len(seq) > 1 else 1) + s.cast("bigint")
    values["ingest_seq"] = number
    values["content_sha"] = content_sha(values["content"].cast("string"), values["additional_data"])
    kinds = dict(part.split() for part in EVENT.split(", "))
    return df.select(*[values[c].cast(kinds[c]).alias(c) for c in COLUMNS])


def refused(df: DataFrame, value: str, allowed: tuple[str, ...]) -> DataFrame:
    """(value, n): what ``required`` would stop at, and how often; for a look before a load."""
    return df.where(F.col(value).isNull() | ~F.col(value).isin(*allowed)).groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def required(value: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The value, or an error that stops the job if it is none of the allowed ones."""
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))))
