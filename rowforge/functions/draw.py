"""Per-cell draws: a pure function of table seed, column, purpose and row id.

The same rows come out at any number of partitions, and dropping a column
leaves all others as they were.  Draws are Spark's own 64-bit hash (xxHash64,
a public algorithm) of salt and row, which has a twin in SQL here, so that
generated data can be checked by another engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: draws are whole numbers below this
P = 1 << 31
_MASK = (1 << 64) - 1
#: fixed values: the primes of xxHash64, and the seed with which Spark begins
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_START = 42


def fnv1a(text: str, start: int = 0xCBF29CE484222325) -> int:
    h = start
    for b in text.encode("utf-8"):
        h = (h ^ b) * 0x100000001B3 & _MASK
    return h


def table_seed(seed: int, table: str) -> int:
    """FNV-1a 64 of the table name, started from the offset basis mixed with the run's seed; never 0."""
    return fnv1a(table, 0xCBF29CE484222325 ^ (seed & _MASK)) or 1


def salt(seed: int, column: str, purpose: str = "value") -> int:
    """Salt of one column and purpose in [0, P); ``seed`` is the table's."""
    return fnv1a(f"{column}/{purpose}", 0xCBF29CE484222325 ^ (seed & _MASK)) % P


def bits(row: Column, s: int) -> Column:
    """64 bits for each row id (a long, of any size)."""
    return F.xxhash64(F.lit(s).cast("long"), row)


def draw(row: Column, s: int) -> Column:
    """A draw in [0, P) for each row id."""
    return F.shiftrightunsigned(bits(row, s), 33)


def unit(row: Column, s: int) -> Column:
    """A draw in [0, 1), of 53 bits."""
    return F.shiftrightunsigned(bits(row, s), 11) * F.lit(2.0**-53)


def below(row: Column, s: int, n: int | Column) -> Column:
    """A whole draw in [0, n): of 31 bits below small fixed n, else of 63."""
    if isinstance(n, int):
        return (draw(row, s) if n <= 1 << 16 else F.shiftrightunsigned(bits(row, s), 1)) % F.lit(n).cast("long")
    return F.shiftrightunsigned(bits(row, s), 1) % n


def _turned(x: int, by: int) -> int:
    return (x << by | x >> 64 - by) & _MASK


def hash_long(value: int, seed: int) -> int:
    """xxHash64 of one 64-bit number."""
    h = (seed + _P5 + 8 & _MASK) ^ (_turned(value * _P2 & _MASK, 31) * _P1 & _MASK)
    h = _turned(h, 27) * _P1 + _P4 & _MASK
    h = (h ^ h >> 33) * _P2 & _MASK
    h = (h ^ h >> 29) * _P3 & _MASK
    return h ^ h >> 32


def bits_sql(row: str, s: int) -> str:
    """:func:`bits` as an unsigned number, as SQL text for DuckDB; ``row`` is a non-negative BIGINT expression."""
    wide, whole = "CAST({} AS UHUGEINT)", f"CAST({1 << 64} AS UHUGEINT)"
    small = lambda x: f"CAST({x} AS UBIGINT)"
    times = lambda x, p: small(f"({wide.format(x)} * {wide.format(p)}) % {whole}")
    turned = lambda x, by: small(f"({wide.format(x)} * {wide.format(1 << by)}) % {whole} + {wide.format(f'({x} >> {64 - by})')}")
    steps = [
        lambda x: times(x, _P2),
        lambda x: times(turned(x, 31), _P1),
        lambda x: f"xor({x}, {small(hash_long(s, _START) + _P5 + 8 & _MASK)})",
        lambda x: turned(x, 27),
        lambda x: small(f"({wide.format(times(x, _P1))} + {wide.format(_P4)}) % {whole}"),
        lambda x: times(f"xor({x}, {x} >> 33)", _P2),
        lambda x: times(f"xor({x}, {x} >> 29)", _P3),
        lambda x: f"xor({x}, {x} >> 32)",
    ]
    out = small(row)
    for k, step in enumerate(steps):  # each step names its argument, so that it is not written out twice
        out = f"list_transform([{out}], lambda x{k}: {step(f'x{k}')})[1]"
    return out


def draw_sql(row: str, s: int) -> str:
    """:func:`draw` as SQL text for DuckDB."""
    return f"CAST({bits_sql(row, s)} >> 33 AS BIGINT)"


def unit_sql(row: str, s: int) -> str:
    """:func:`unit` as SQL text for DuckDB."""
    return f"(CAST({bits_sql(row, s)} >> 11 AS DOUBLE) * {2.0**-53!r}::DOUBLE)"


def below_sql(row: str, s: int, n: int | str) -> str:
    """:func:`below` as SQL text for DuckDB; a whole ``n`` stands for a fixed one, text for a column."""
    shift = 33 if isinstance(n, int) and n <= 1 << 16 else 1
    return f"(CAST({bits_sql(row, s)} >> {shift} AS BIGINT) % {n})"
