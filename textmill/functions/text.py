"""Shared column expressions for text: Unicode strip, lengths, UTF-8 cuts."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() is Unicode White_Space plus the four
# information separators U+001C..U+001F; Java's (?U)\s lacks the latter.
WS_CLASS = r"\s\x{1c}-\x{1f}"
_STRIP_RE = rf"(?U)^[{WS_CLASS}]+|[{WS_CLASS}]+$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_u(c) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends."""
    return F.regexp_replace(col_(c), _STRIP_RE, "")


def drop_undecodable(c) -> Column:
    """What decoding with ``errors="ignore"`` leaves of raw bytes read as text:
    bytes that are no UTF-8 go, all else stays.

    Undecodable bytes become U+FFFD and are then taken out; a genuine U+FFFD is
    written with an escape meanwhile.  Only values that hold undecodable bytes
    take this way, without leaving the JVM."""
    x, mark, bad = col_(c), "\ufdd0", "\ufffd"
    swap = lambda v, *pairs: functools.reduce(lambda v, p: F.replace(v, F.lit(p[0]), F.lit(p[1])), pairs, v)
    kept = F.make_valid_utf8(swap(x, (mark, mark + "0"), (bad, mark + "1")))
    return F.when(F.is_valid_utf8(x), x).otherwise(swap(kept, (bad, ""), (mark + "1", bad), (mark + "0", mark)))


def utf8_prefix(c, nbytes) -> Column:
    """Longest prefix of ``c`` holding at most ``nbytes`` UTF-8 bytes that ends on
    a character boundary (the bytes of a cut character are dropped).

    Tries the cut at n, n-1, n-2, n-3 bytes; a UTF-8 character is at most four
    bytes, so one of them is a boundary.
    """
    b = F.encode(col_(c), "UTF-8")
    n = F.greatest(F.lit(0), col_(nbytes).cast("int"))
    tries = [F.try_validate_utf8(F.substring(b, F.lit(1), F.greatest(F.lit(0), n - k)).cast("string"))
             for k in range(4)]
    return F.coalesce(*tries)


def is_falsy_json(v: Column) -> Column:
    """Python falsiness of a parsed JSON value held in a VARIANT column:
    missing/null, "", 0, 0.0, false, [] and {} are falsy."""
    t = F.schema_of_variant(v)
    s = F.try_variant_get(v, "$", "string")
    return (
        v.isNull()
        | (t == F.lit("VOID"))
        | ((t == F.lit("STRING")) & (s == F.lit("")))
        | (t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT).*")
           & (F.try_variant_get(v, "$", "double") == F.lit(0.0)))
        | ((t == F.lit("BOOLEAN")) & (~F.try_variant_get(v, "$", "boolean")))
        | ((t.startswith("ARRAY")) & (F.to_json(v) == F.lit("[]")))
        | ((t.startswith("OBJECT")) & (F.to_json(v) == F.lit("{}")))
    )
