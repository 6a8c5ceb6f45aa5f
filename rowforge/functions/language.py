"""Words of a pattern by number: the k-th text that it matches, counted and found without looking at other rows.

The pattern becomes an automaton in which every text has one path, so that
texts that it can match in two ways count once.  How many words of each length
a state leads to is one product with the transition matrix a letter; these
counts turn a number into a word, shortest first, then in order of code
points.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowforge.functions.pattern import EXTRA_MOST, PRINTABLE, STAR_MOST, PatternError, _alphabet

#: counts stop here; numbers of words are below
MOST = 1 << 62
#: states and table entries beyond which a pattern is not numbered
STATES, ENTRIES = 1_000, 20_000
#: numbers are dealt over so many words at least, and over all of them if they are fewer
SPREAD = 1 << 31


class _Parts:
    """Nested states: letters lead from one to another, and some ways lead on without a letter."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.by: list[list[tuple[frozenset[str], int]]] = []

    def state(self) -> int:
        if len(self.free) >= STATES:
            raise PatternError("too many states")
        self.free.append([])
        self.by.append([])
        return len(self.free) - 1

    def letters(self, at: int, chars) -> int:
        end = self.state()
        self.by[at].append((frozenset(chars), end))
        return end

    def sequence(self, nodes, at: int) -> int:
        for op, value in nodes:
            at = self.node(op, value, at)
        return at

    def node(self, op, value, at: int) -> int:
        if op is sre.LITERAL:
            return self.letters(at, chr(value))
        if op is sre.NOT_LITERAL:
            return self.letters(at, [c for c in PRINTABLE if ord(c) != value])
        if op is sre.ANY:
            return self.letters(at, "abcdefghijklmnopqrstuvwxyz")
        if op is sre.IN:
            return self.letters(at, _alphabet(list(value)))
        if op is sre.AT:
            return at
        if op is sre.SUBPATTERN:
            return self.sequence(value[-1], at)
        if op is sre.BRANCH:
            end = self.state()
            for branch in value[1]:
                start = self.state()
                self.free[at].append(start)
                self.free[self.sequence(branch, start)].append(end)
            return end
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            most = max(low, STAR_MOST) if high is sre.MAXREPEAT else min(high, low + EXTRA_MOST)
            ends = [at] if low == 0 else []
            for times in range(1, most + 1):
                at = self.sequence(inner, at)
                ends += [at] if times >= low else []
            end = self.state()
            for one in ends:
                self.free[one].append(end)
            return end
        raise PatternError(f"unsupported construct {op}")

    def closed(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for more in self.free[todo.pop()]:
                if more not in found:
                    found.add(more)
                    todo.append(more)
        return frozenset(found)


@dataclass
class Language:
    """An automaton's runs of letters, and its words by state and length."""

    #: by state: letters that follow each other in order and lead to one state, and that state
    runs: list[list[tuple[str, int]]]
    #: by state and length: words from there, MOST at most
    counts: list[list[int]]
    #: words from the start that are shorter than each length
    shorter: list[int]
    total: int

    def word(self, number: int) -> str:
        """The word of a number, in plain Python."""
        left = max(k for k, n in enumerate(self.shorter) if n <= number and self.counts[0][k])
        number, state, out = number - self.shorter[left], 0, ""
        while left:
            for chars, to in self.runs[state]:
                each = self.counts[to][left - 1]
                if number < each * len(chars):
                    out, state, number, left = out + chars[number // each], to, number % each, left - 1
                    break
                number -= each * len(chars)
        return out


@lru_cache(maxsize=256)
def language(pattern: str, max_len: int = 0, folded: bool = False) -> Language:
    """The words of ``pattern`` of up to ``max_len`` characters (0: any).

    Repetitions go as far as they do where texts are drawn.  ``folded``: of
    letters that stand in both cases the capitals are left out, so that no two
    words differ in case only.
    """
    parts = _Parts()
    start = parts.state()
    try:
        end = parts.sequence(parser.parse(pattern), start)
    except PatternError:
        raise
    except Exception as error:
        raise PatternError(f"{pattern!r}: {error}") from error
    used = {c for by in parts.by for chars, _ in by for c in chars}
    dropped = {c for c in used if folded and c.lower() != c and c.lower() in used}
    first = parts.closed([start])
    number, todo, runs, ends = {first: 0}, [first], [], []
    while todo:
        states, todo = todo, []
        for own in states:
            to: dict[str, set[int]] = {}
            for state in own:
                for chars, target in parts.by[state]:
                    for c in chars - dropped:
                        to.setdefault(c, set()).add(target)
            made: list[tuple[str, int]] = []
            closed: dict[frozenset[int], frozenset[int]] = {}
            for c in sorted(to):
                key = frozenset(to[c])
                target = closed.get(key) or closed.setdefault(key, parts.closed(key))
                if target not in number:
                    if len(number) >= STATES:
                        raise PatternError("too many states")
                    number[target] = len(number)
                    todo.append(target)
                if made and made[-1][1] == number[target]:
                    made[-1] = (made[-1][0] + c, made[-1][1])
                else:
                    made.append((c, number[target]))
            runs.append(made)
            ends.append(end in own)
    counts, longest = [[int(e)] for e in ends], 0
    # no letter leads back, so that there is a longest word
    while (not max_len or longest < max_len) and any(c[-1] for c in counts) or longest == 0:
        row = [min(MOST, sum(len(chars) * counts[to][longest] for chars, to in own)) for own in runs]
        for c, n in zip(counts, row, strict=True):
            c.append(n)
        longest += 1
        if longest > 4 * STATES or len(counts) * longest > ENTRIES:
            raise PatternError("too many states and lengths")
    if max_len:
        counts = [c[: max_len + 1] for c in counts]
    shorter = [0]
    for n in counts[0]:
        shorter.append(min(MOST, shorter[-1] + n))
    return Language(runs, counts, shorter[:-1], shorter[-1])


def word_at(own: Language, number: Column) -> Column:
    """The words of a column of numbers below ``own.total``, by built-in expressions over three constant tables."""
    lengths = len(own.counts[0])
    before, chars, to = [], [], []
    for runs in own.runs:
        chars.append([c for c, _ in runs])
        to.append([t for _, t in runs])
        by_left = [[]]
        for left in range(1, lengths):
            sums = [0]
            for c, t in runs:
                sums.append(min(MOST, sums[-1] + len(c) * own.counts[t][left - 1]))
            by_left.append(sums[:-1])
        before.append(by_left)
    # as text that Spark parses and folds to one constant each
    tables = {name: F.expr(_constant(value, kind)) for name, value, kind in (("before", before, "L"), ("chars", chars, "'"), ("to", to, ""), ("counts", own.counts, "L"))}
    ranks = F.array(*[F.lit(n) for n, c in zip(own.shorter, own.counts[0], strict=True) if c])
    sizes = F.array(*[F.lit(k) for k, c in enumerate(own.counts[0]) if c])
    place = F.size(F.filter(ranks, lambda n: n <= number)) - 1
    first = F.struct(F.lit(0).alias("state"), (number - F.get(ranks, place)).cast("long").alias("number"), F.get(sizes, place).alias("left"), F.lit("").alias("text"))

    def step(at: Column, _: Column) -> Column:
        sums = F.get(F.get(tables["before"], at["state"]), at["left"])
        run = F.size(F.filter(sums, lambda n: n <= at["number"])) - 1
        target = F.get(F.get(tables["to"], at["state"]), run)
        each = F.get(F.get(tables["counts"], target), at["left"] - 1)
        rest = at["number"] - F.get(sums, run)
        letter = F.substring(F.get(F.get(tables["chars"], at["state"]), run), (F.call_function("div", rest, each) + 1).cast("int"), F.lit(1))
        return F.struct(target.alias("state"), F.pmod(rest, each).alias("number"), (at["left"] - 1).alias("left"), F.concat(at["text"], letter).alias("text"))

    steps = F.get(sizes, place)
    return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), first, step, lambda at: at["text"])


def _constant(value, mark: str) -> str:
    """A nested list as text of SQL; ``mark`` is what whole numbers end in, or a quote for text."""
    if isinstance(value, list):
        kind = {"L": "BIGINT", "'": "STRING"}.get(mark, "INT")
        return f"array({', '.join(_constant(x, mark) for x in value)})" if value else f"CAST(array() AS ARRAY<{kind}>)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if mark == "'" else f"{value}{mark}"


def numbers(own: Language, n: int) -> tuple[int, int]:
    """Over how many numbers ``n`` rows are dealt, and how far apart their words lie."""
    size = min(own.total, max(SPREAD, n))
    return size, own.total // size
