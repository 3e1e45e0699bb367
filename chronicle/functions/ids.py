"""Deterministic ids and content hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronicle.functions.time import iso_utc, to_ns_2001

ID_LENGTH = 16


def short_sha(*parts: Column, by: str = "|") -> Column:
    """The first 16 hex digits of the SHA-256 of the joined parts, none of which may be null."""
    return F.substring(F.sha2(F.concat_ws(by, *parts).cast("binary"), 256), 1, ID_LENGTH)


def message_id(thread: Column, t: Column, from_me: Column, content: Column) -> Column:
    return short_sha(thread, to_ns_2001(t).cast("string"), F.when(from_me.cast("boolean"), "1").otherwise("0"), content)


def play_id(raw_ref: Column) -> Column:
    return short_sha(raw_ref)


def chat_id(conversation: Column, message: Column) -> Column:
    return short_sha(conversation, message)


def episode_id(thread: Column, first_event: Column, start: Column) -> Column:
    return short_sha(thread, first_event, iso_utc(start), by="\0")


def clocked_id(*parts: Column, clock: Column) -> Column:
    """An id that also depends on a time, which the caller passes, so runs can be repeated."""
    return short_sha(*parts, iso_utc(clock))


def content_sha(content: Column, additional_data: Column) -> Column:
    """SHA-256 of the canonical pair (extra JSON text, content); a null content differs from an empty one."""
    extra = F.coalesce(additional_data, F.lit("{}"))
    return F.sha2(F.to_json(F.struct(extra.alias("additional_data"), content.alias("content")), {"ignoreNullFields": "false"}).cast("binary"), 256)


@F.pandas_udf(StringType())
def content_sha_sorted_json(content: pd.Series, additional_data: pd.Series) -> pd.Series:
    """SHA-256 of sorted-key JSON with spaces and plain Unicode, as stores written by Python have it.

    An Arrow UDF, as number formats and nested key order of that JSON have no native form.
    """

    def one(text, extra):
        whole = {"content": None if text is None else text, "additional_data": json.loads(extra) if extra else {}}
        return hashlib.sha256(json.dumps(whole, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    return pd.Series([one(t, e) for t, e in zip(content, additional_data, strict=True)], dtype=object)
