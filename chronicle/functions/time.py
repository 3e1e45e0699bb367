"""Times: ISO-8601 text and counts since 2001-01-01 UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1970-01-01 to 2001-01-01 UTC.
EPOCH_2001 = 978307200


def parse_iso(text: Column) -> Column:
    """A timestamp from ISO-8601 text, also with a trailing Z; null stays null, other text is an error."""
    return F.to_timestamp(F.regexp_replace(text, "[zZ]$", "+00:00"))


def iso_utc(t: Column) -> Column:
    """ISO-8601 text in UTC, with six decimals only where they are not all zero."""
    whole = F.unix_micros(t.cast("timestamp")) % 1_000_000 == 0
    shown = lambda pattern: F.date_format(t, pattern)
    return F.concat(F.when(whole, shown("yyyy-MM-dd'T'HH:mm:ss")).otherwise(shown("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit("+00:00"))


def _from_seconds(seconds: Column) -> Column:
    """Seconds as a double to a timestamp, rounding microseconds half to even."""
    base = F.floor(seconds)
    return F.timestamp_micros(base * F.lit(1_000_000).cast("bigint") + F.rint((seconds - base) * 1e6).cast("bigint"))


def from_ns_2001(ns: Column) -> Column:
    return _from_seconds(ns.cast("double") / F.lit(1e9) + F.lit(float(EPOCH_2001)))


def from_seconds_2001(seconds: Column) -> Column:
    return _from_seconds(seconds.cast("double") + F.lit(float(EPOCH_2001)))


def to_ns_2001(t: Column) -> Column:
    """Nanoseconds since 2001 in double arithmetic, so ids made from them stay the same."""
    return ((F.unix_micros(t).cast("double") / F.lit(1e6) - F.lit(float(EPOCH_2001))) * F.lit(1e9)).cast("bigint")
