"""Scalar helpers with one meaning across engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_scale(value: Column, scale: int) -> Column:
    """Round a double half away from zero at ``scale`` decimals, without decimal casts."""
    power = float(10**scale)
    return F.signum(value) * F.floor(F.abs(value) * power + 0.5) / power


def clamp_text(value: Column, max_len: int, unit: str = "chars") -> Column:
    """Keep at most ``max_len`` characters, or whole characters within so many bytes."""
    if unit == "chars":
        return F.substring(value, 1, max_len)
    # the longest prefix whose bytes fit; a prefix of max_len characters always covers it
    lengths = F.sequence(F.lit(0), F.least(F.length(value), F.lit(max_len)))
    fitting = F.filter(lengths, lambda n: F.octet_length(F.substring(value, F.lit(1), n)) <= max_len)
    return F.when(F.octet_length(value) <= max_len, value).otherwise(F.substring(value, F.lit(1), F.array_max(fitting)))


def fold(value: Column) -> Column:
    return F.lower(value)


def sql_literal(column: Column, kind: str) -> Column:
    """SQL literal text of a value; text is quoted with quotes doubled, null is NULL."""
    if kind in ("string", "varchar", "char", "date") or kind.startswith(("varchar", "char", "timestamp")):
        text = F.concat(F.lit("'"), F.replace(column.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind == "boolean":
        text = F.when(column, "TRUE").otherwise("FALSE")
    elif kind == "binary":
        text = F.concat(F.lit("X'"), F.hex(column), F.lit("'"))
    else:
        text = column.cast("string")
    return F.when(column.isNull(), "NULL").otherwise(text)
