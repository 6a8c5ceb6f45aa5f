"""Compile a regular expression to a Column that generates matching text.

The pattern is parsed once on the driver; what runs is a concatenation of
built-in expressions.  Look-around and back-references are refused, as they
mean different things to different engines.
"""

from __future__ import annotations

from collections.abc import Callable
from math import prod
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowforge.functions.draw import P, below

PRINTABLE = [chr(c) for c in range(0x20, 0x7F)]
#: how far open repetitions go, and how far counted ones go beyond their minimum
STAR_MOST, EXTRA_MOST, DEEPEST = 8, 8, 20

_CATEGORY = {
    sre.CATEGORY_DIGIT: lambda c: c.isdigit(),
    sre.CATEGORY_SPACE: lambda c: c.isspace(),
    sre.CATEGORY_WORD: lambda c: c.isalnum() or c == "_",
    sre.CATEGORY_NOT_DIGIT: lambda c: not c.isdigit(),
    sre.CATEGORY_NOT_SPACE: lambda c: not c.isspace(),
    sre.CATEGORY_NOT_WORD: lambda c: not (c.isalnum() or c == "_"),
}


class PatternError(ValueError):
    pass


def _alphabet(items: list) -> str:
    negated = bool(items) and items[0][0] is sre.NEGATE
    chosen: set[str] = set()
    for op, value in items[negated:]:
        if op is sre.LITERAL:
            chosen.add(chr(value))
        elif op is sre.RANGE:
            low, high = value
            chosen |= {chr(c) for c in range(low, min(high, low + 255) + 1)}
        elif op is sre.CATEGORY:
            chosen |= {c for c in PRINTABLE if _CATEGORY[value](c)}
        else:
            raise PatternError(f"unsupported class item {op}")
    if negated:
        chosen = set(PRINTABLE) - chosen
    letters = sorted(c for c in chosen if c in PRINTABLE) or sorted(chosen)
    if not letters:
        raise PatternError("a class without printable members")
    return "".join(letters)


class _Compiler:
    def __init__(self, row: Column, salt: int):
        self.row, self.salt, self.used = row, salt, 0

    def next(self, n: int) -> Column:
        self.used += 1
        return below(self.row, (self.salt + 7919 * self.used) % P, n)

    def pick(self, alphabet: str) -> Column:
        if len(alphabet) == 1:
            return F.lit(alphabet)
        return F.substring(F.lit(alphabet), (self.next(len(alphabet)) + 1).cast("int"), F.lit(1))

    def sequence(self, nodes, depth: int) -> list[Column]:
        if depth > DEEPEST:
            return []
        return [c for op, value in nodes for c in self.node(op, value, depth)]

    def node(self, op, value, depth: int) -> list[Column]:
        if op is sre.LITERAL:
            return [F.lit(chr(value))]
        if op is sre.NOT_LITERAL:
            return [self.pick("".join(c for c in PRINTABLE if ord(c) != value))]
        if op is sre.ANY:
            return [self.pick("abcdefghijklmnopqrstuvwxyz")]
        if op is sre.IN:
            return [self.pick(_alphabet(list(value)))]
        if op is sre.AT:
            return []
        if op is sre.SUBPATTERN:
            return self.sequence(value[-1], depth + 1)
        if op is sre.BRANCH:
            ways = [F.concat(F.lit(""), *self.sequence(branch, depth + 1)) for branch in value[1]]
            which, out = self.next(len(ways)), ways[-1]
            for k in range(len(ways) - 2, -1, -1):
                out = F.when(which == k, ways[k]).otherwise(out)
            return [out]
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            most = max(low, STAR_MOST) if high is sre.MAXREPEAT else min(high, low + EXTRA_MOST)
            parts = [F.concat(F.lit(""), *self.sequence(inner, depth + 1)) for _ in range(most)]
            if most == low:
                return parts
            times = self.next(most - low + 1) + low
            return parts[:low] + [F.when(times > k, parts[k]).otherwise(F.lit("")) for k in range(low, most)]
        raise PatternError(f"unsupported construct {op}")


def compile_pattern(pattern: str, row: Column, salt: int) -> Column:
    """Text that matches ``pattern``, for each row id."""
    try:
        tree = parser.parse(pattern)
    except Exception as error:
        raise PatternError(f"{pattern!r}: {error}") from error
    return F.concat(F.lit(""), *_Compiler(row, salt).sequence(tree, 0))


class _Indexed(_Compiler):
    """Compiles patterns of one shape only (letters of classes at fixed places), the last places by a number of the row."""

    def __init__(self, row: Column, salt: int, digits: list[Column | None]):
        super().__init__(row, salt)
        self.digits = iter(digits)

    def next(self, n: int) -> Column:
        drawn, digit = super().next(n), next(self.digits)
        return drawn if digit is None else digit


def _places(nodes) -> list[int] | None:
    """Sizes of the classes at the places of a pattern with one shape; None for others, where two ways can give one text."""
    out: list[int] = []
    for op, value in nodes:
        if op in (sre.LITERAL, sre.AT):
            continue
        if op in (sre.IN, sre.NOT_LITERAL, sre.ANY):
            size = len(_alphabet(list(value))) if op is sre.IN else 26 if op is sre.ANY else sum(ord(c) != value for c in PRINTABLE)
            out += [size] if size > 1 else []
            continue
        if op is sre.SUBPATTERN:
            inner = _places(value[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] == value[1]:
            inner = _places(value[2])
            inner = inner * value[0] if inner is not None else None
        else:
            return None
        if inner is None:
            return None
        out += inner
    return out


def value_space(pattern: str) -> int | None:
    """How many texts a pattern of one shape gives; None for other patterns."""
    places = _places(parser.parse(pattern))
    return None if places is None else prod(places)


def compile_unique(pattern: str, row: Column, salt: int, n: int, number: Callable[[int], Column]) -> Column:
    """Texts of a pattern of one shape that cannot repeat in ``n`` rows; ``number(space)`` is the row's own place in ``space``.

    The last places, as many as ``n`` needs and some more, spell that number; the others are drawn.
    """
    tree = parser.parse(pattern)
    places = _places(tree)
    first, space = len(places), 1
    while first and (space < n or space * places[first - 1] < 2**30):
        first -= 1
        space *= places[first]
    own, digits = number(space), [None] * first
    for size in places[first:]:
        space //= size
        digits.append(F.pmod(_quotient(own, space), F.lit(size)))
    return F.concat(F.lit(""), *_Indexed(row, salt, digits).sequence(tree, 0))


def check_pattern(pattern: str) -> None:
    """Raise PatternError if ``pattern`` cannot be generated from."""
    _Probe(None, 0).sequence(parser.parse(pattern) if _parses(pattern) else _fail(pattern), 0)


def _quotient(value: Column, by: int) -> Column:
    """Whole quotient of longs."""
    return F.call_function("div", value, F.lit(by).cast("long")) if by > 1 else value


def _parses(pattern: str) -> bool:
    try:
        parser.parse(pattern)
    except Exception:
        return False
    return True


def _fail(pattern: str):
    raise PatternError(f"{pattern!r} does not compile")


class _Probe(_Compiler):
    """Walks a pattern without a session."""

    def node(self, op, value, depth: int) -> list:
        if op is sre.IN:
            _alphabet(list(value))
        elif op is sre.SUBPATTERN:
            self.sequence(value[-1], depth + 1)
        elif op is sre.BRANCH:
            for branch in value[1]:
                self.sequence(branch, depth + 1)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            self.sequence(value[2], depth + 1)
        elif op not in (sre.LITERAL, sre.NOT_LITERAL, sre.ANY, sre.AT):
            raise PatternError(f"unsupported construct {op}")
        return []
