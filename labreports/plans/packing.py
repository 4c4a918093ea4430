"""Text columns that travel as one.

Every text column of a shuffled row takes at least sixteen bytes, most of them padding and places of
short codes and names. Wide rows that are shuffled several times carry such columns as one text instead,
from the scan to where they are read; each column comes back as it was, null, empty and separators too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BETWEEN, _MARK = "\x1f", "\x1e"
_NULL = _MARK + "n"
#: What stands for a mark and for a separator inside a text.
_ESCAPED = ((_MARK, _MARK + "e"), (_BETWEEN, _MARK + "s"))


def packed(columns: list[str], plain: tuple[str, ...] = ()) -> Column:
    """The columns as one text, which differs wherever one of them does. ``plain`` ones need no escapes."""
    texts = []
    for column in columns:
        text = F.col(column)
        if column in plain:
            text = text.cast("string")
        else:
            for found, escaped in _ESCAPED:
                text = F.replace(text, F.lit(found), F.lit(escaped))
        texts.append(F.coalesce(text, F.lit(_NULL)))
    return F.concat_ws(_BETWEEN, *texts)


def _whole_numbers(rows: DataFrame) -> tuple[str, ...]:
    return tuple(name for name, kind in rows.dtypes if kind in ("int", "bigint"))


def pack(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Replace columns of texts and whole numbers by the one column ``name``. All must be needed later:
    none is pruned."""
    return rows.withColumn(name, packed(columns, _whole_numbers(rows))).drop(*columns)


def pack_more(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Add columns behind those that ``name`` holds."""
    more = packed(columns, _whole_numbers(rows))
    return rows.withColumn(name, F.concat_ws(_BETWEEN, name, more)).drop(*columns)


def unpack_first(rows: DataFrame, name: str, column: str) -> DataFrame:
    """Take the first column, a text, out of those that ``name`` holds; the others stay together."""
    first = F.substring_index(name, _BETWEEN, 1)
    others = F.substr(F.col(name), F.length(first) + 2)
    return rows.withColumns({column: _text(first), name: others})


def _text(part: Column) -> Column:
    text = part
    for found, escaped in reversed(_ESCAPED):
        text = F.replace(text, F.lit(escaped), F.lit(found))
    return F.when(part != _NULL, text)


def unpack(
    rows: DataFrame, name: str, columns: list[str], kinds: dict[str, str] | None = None
) -> DataFrame:
    """Undo ``pack``; where the packed text is null, as beside a row without a match, all are null.
    ``kinds`` has the types of columns that are no texts."""

    def value(at: int, column: str) -> Column:
        part = F.split_part(F.col(name), F.lit(_BETWEEN), F.lit(at))
        if kinds and column in kinds:
            return F.when(part != _NULL, part).cast(kinds[column])
        return _text(part)

    return rows.withColumns({c: value(at, c) for at, c in enumerate(columns, 1)}).drop(name)
