"""Security identifiers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10)


def sid_text(sid: Column) -> Column:
    """``S-revision-authority-part-part...`` from a binary identifier.

    Byte 0 is the revision, byte 1 the number of parts, bytes 2 to 7 the
    authority (big-endian, written in hex), then four little-endian bytes for
    each part.
    """
    digits = F.hex(sid)

    def byte(position: Column) -> Column:
        return F.substring(digits, position * 2 + 1, F.lit(2))

    count = _number(byte(F.lit(1))).cast("int")
    authority = F.regexp_replace(F.lower(F.substring(digits, 5, 12)), "^0+(?=.)", "")

    def part(index: Column) -> Column:
        start = index * 4 + 8
        return _number(F.concat(*[byte(start + offset) for offset in (3, 2, 1, 0)]))

    parts = F.transform(F.filter(F.sequence(F.lit(0), count), lambda i: i < count), part)
    text = F.concat_ws(
        "-",
        F.lit("S"),
        _number(byte(F.lit(0))),
        authority,
        F.when(count > 0, F.array_join(parts, "-")),
    )
    return F.when(sid.isNotNull(), text)


def in_same_domain(sid: Column, relative_id: Column) -> Column:
    """The identifier text with its last part exchanged."""
    return F.concat(F.regexp_replace(sid, "[^-]*$", ""), relative_id)
