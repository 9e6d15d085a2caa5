"""Column expressions of the lenient text rules; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(line: Column | str, separator: str = ",") -> Column:
    """Split on every separator, keeping trailing empties. There is no quoting."""
    return F.split(F.col(line) if isinstance(line, str) else line, separator, -1)


#: Every character up to U+0020.
CONTROLS = "".join(map(chr, range(0x21)))


def trim_controls(column: Column) -> Column:
    """Strip every character up to U+0020 from both ends, not only the space."""
    return F.btrim(column, F.lit(CONTROLS))


def to_int(column: Column, default: int | None = None, kind: str = "bigint") -> Column:
    """Parse a decimal integer; anything else is the default. Never raises under ANSI mode."""
    # The cast itself strips blanks and controls. It takes two forms that are no integers here: '1.0', and a DEL
    # at an end.
    parsed = F.when(~(F.contains(column, F.lit(".")) | F.contains(column, F.lit("\x7f"))), column.try_cast(kind))
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def equals_ignoring_case(left: Column, right: Column) -> Column:
    return F.lower(left) == F.lower(right)


def part(parts: Column, position: int) -> Column:
    """The field at a position, null when the row is shorter."""
    return F.get(parts, F.lit(position))
