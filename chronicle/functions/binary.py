"""Message bodies in typed-stream BLOBs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed bytes of the format: the marker before a string's length, and the marks of longer lengths with their bytes.
MARKER = bytes([0x84, 0x01, 0x2B])
WIDE_LENGTHS = {0x81: 2, 0x82: 4}


def typed_stream_text(blob: bytes | None) -> str | None:
    """The first string of a BLOB; null without a marker, a whole length or any payload."""
    _, found, rest = (blob or b"").partition(MARKER)
    if not found or not rest:
        return None
    wide = WIDE_LENGTHS.get(rest[0], 0)
    if len(rest) < 1 + wide:
        return None
    length = int.from_bytes(rest[1 : 1 + wide], "little") if wide else rest[0]
    body = rest[1 + wide : 1 + wide + length]
    return body.decode("utf-8", "replace") if body else None


@F.pandas_udf(StringType())
def decode_body(blobs: pd.Series) -> pd.Series:
    """An Arrow UDF: byte offsets and lossy UTF-8 have no compact native form."""
    return pd.Series([typed_stream_text(b) for b in blobs], dtype=object)
