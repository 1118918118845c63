"""Names that are bytes, carried as text and brought back exactly.

A byte that is not part of valid UTF-8 travels as the character that lies that
many above ``BASE``; a character of that range that was there before is
escaped byte by byte itself, so the mapping has an inverse.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: byte b travels as this code point plus b.
BASE = 0x10FE00
_FIRST, _LAST = chr(BASE + 0x80), chr(BASE + 0xFF)


def escape(raw: bytes) -> str:
    text = raw.decode("utf-8", "surrogateescape")
    out = []
    for c in text:
        if "\udc80" <= c <= "\udcff":
            out.append(chr(BASE + ord(c) - 0xDC00))
        elif _FIRST <= c <= _LAST:
            out.extend(chr(BASE + b) for b in c.encode())
        else:
            out.append(c)
    return "".join(out)


def unescape(text: str) -> bytes:
    return b"".join(bytes([ord(c) - BASE]) if _FIRST <= c <= _LAST else c.encode() for c in text)


@F.pandas_udf(T.StringType())
def _escape_udf(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else escape(bytes(b)))


def display_name(raw) -> Column:
    """Text of a binary name; only names that are not plain UTF-8 reach Python."""
    b = F.col(raw) if isinstance(raw, str) else raw
    text = b.cast("string")
    plain = F.is_valid_utf8(text) & ~text.rlike(f"[{_FIRST}-{_LAST}]")
    return F.when(plain, text).otherwise(_escape_udf(F.when(~plain, b)))
