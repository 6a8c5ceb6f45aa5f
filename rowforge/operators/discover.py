"""Keys and references that tables hold, found from their rows.

Keys: level-wise over combinations of columns.  In large tables a pass over a
slice of the values rules most of a level out: what repeats there is no key.
Sketches of the others come from one pass and rule out more; what is left is
counted exactly over all rows, again in one pass.  References: an inverted index of values
over all columns that ranges and sketches leave, each value with the set of
columns that hold it; a column lies within those that stand with all its
values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.operators import audit
from rowforge.plans import model

#: columns of a key at most, relative deviation of the sketches, and how many deviations below the rows a sketch may lie
WIDEST, DEVIATION, SLACK = 3, 0.02, 5
#: combinations whose sketches are found in one pass, and columns whose sets share a word
TOGETHER, WORD = 40, 62
#: tables of so many rows are first searched for repeats in one of so many slices of the values at least; a slice holds about as many rows at most
SLICED_ROWS, SLICES = 1_000_000, 32
#: kinds of values that keys and references are made of; columns of other types take no part
KINDS = {"whole": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "text": (T.StringType, T.VarcharType, T.CharType), "time": (T.DateType, T.TimestampType, T.TimestampNTZType), "decimal": (T.DecimalType,)}


def kind_of(data_type: T.DataType) -> str | None:
    return next((kind for kind, types in KINDS.items() if isinstance(data_type, types)), None)


@dataclass
class ColumnFacts:
    table: str
    column: str
    kind: str
    rows: int
    present: int
    distinct: float
    low: object
    high: object


def _sketch(*columns: Column) -> Column:
    """About how many distinct values columns have together, by one buffer of a few kilobytes."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in columns]), F.xxhash64(*columns)), F.lit(12)))


def column_facts(name: str, df: DataFrame) -> list[ColumnFacts]:
    """Counts, sketches and ranges of the columns of a table that can be keys, by one pass."""
    own = [(f.name, kind_of(f.dataType)) for f in df.schema.fields if kind_of(f.dataType)]
    if not own:
        return []
    quoted = lambda c: F.col(f"`{c}`")
    each = [x for k, (c, _) in enumerate(own) for x in (F.count(quoted(c)).alias(f"n{k}"), _sketch(quoted(c)).alias(f"d{k}"), F.min(quoted(c)).alias(f"l{k}"), F.max(quoted(c)).alias(f"h{k}"))]
    r = df.agg(F.count("*").alias("rows"), *each).first()
    return [ColumnFacts(name, c, kind, r["rows"], r[f"n{k}"], r[f"d{k}"] or 0, r[f"l{k}"], r[f"h{k}"]) for k, (c, kind) in enumerate(own)]


def _enough(distinct: float, rows: int) -> bool:
    return distinct >= rows * (1 - SLACK * DEVIATION)


def minimal_keys(name: str, df: DataFrame, widest: int = WIDEST, facts: list[ColumnFacts] | None = None) -> list[list[str]]:
    """The smallest combinations of up to ``widest`` columns that no two rows share and that hold no null.

    Columns of whole numbers, text, times and decimals take part.  A table
    without rows has no keys.  A sketch rules a combination out only if it
    lies SLACK deviations below the rows, a slice only if two of its rows share
    the combination; what remains is counted exactly over all rows.
    """
    facts = column_facts(name, df) if facts is None else facts
    own = [f for f in facts if f.rows and f.present == f.rows]
    if not own:
        return []
    rows, found = own[0].rows, []
    sketch = {(f.column,): f.distinct for f in own}
    open_sets = [(f.column,) for f in own]
    eligible = set(open_sets)
    for width in range(1, widest + 1):
        likely = [c for c in open_sets if c in eligible and _enough(sketch[c], rows)]
        unique = _exactly_unique(name, df, likely)
        found += unique
        rest = {c for c in open_sets if c not in unique}
        if width == widest or not rest:
            break
        order = sorted({x for c in rest for x in c})
        # a key's parts are all among what is left, and their counts multiply to enough
        candidates = [c for c in combinations(order, width + 1) if all(part in rest for part in combinations(c, width))]
        most = lambda c: min(sketch[a] * (1 + SLACK * DEVIATION) * sketch[b] * (1 + SLACK * DEVIATION) for a, b in _splits(c, sketch))  # noqa: B023, E731
        # what their parts' counts rule out needs no sketch, but may be part of a key
        sketch |= {c: most(c) for c in candidates}
        counted = [c for c in candidates if sketch[c] >= rows]
        repeated = _repeated_in_slice(df, counted, sketch, max(SLICES, rows // SLICED_ROWS)) if rows >= SLICED_ROWS else set()
        counted = [c for c in counted if c not in repeated]
        for at in range(0, len(counted), TOGETHER):
            some = counted[at : at + TOGETHER]
            together = [_sketch(*[F.col(f"`{x}`") for x in c]).alias(f"d{k}") for k, c in enumerate(some)]
            r = df.agg(*together).first()
            sketch |= {c: r[f"d{k}"] for k, c in enumerate(some)}
        open_sets, eligible = candidates, set(counted)
    return [list(c) for c in sorted(found, key=lambda c: (len(c), c))]


def _splits(columns: tuple[str, ...], sketch: dict) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """A combination in two known parts."""
    return [((x,), rest) for x in columns if (rest := tuple(c for c in columns if c != x)) in sketch]


def _repeated_in_slice(df: DataFrame, combos: list[tuple[str, ...]], sketch: dict, slices: int) -> set[tuple[str, ...]]:
    """Those of ``combos`` that two rows share whose most varied column lies in one of ``slices`` slices of its values.

    Rows that share a combination share that column, so that all of them stand in one slice.
    """
    if not combos:
        return set()
    typed = {f.name: audit._meeting(f.dataType)[1] for f in df.schema.fields}
    lead = [max(c, key=lambda x: sketch[(x,)]) for c in combos]
    inside = {x: F.pmod(F.xxhash64(F.col(f"`{x}`")), F.lit(slices)) == 0 for x in dict.fromkeys(lead)}
    entries = [F.when(inside[x], F.struct(F.lit(k).alias("number"), F.array(*[typed[y](F.col(f"`{y}`")).cast("string") for y in c]).alias("key"))) for k, (x, c) in enumerate(zip(lead, combos, strict=True))]
    rows = df.where(reduce(lambda a, b: a | b, inside.values())).select(F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select("e.*")
    return {combos[r.number] for r in rows.groupBy("number", "key").count().where("count > 1").select("number").distinct().collect()}


def _exactly_unique(name: str, df: DataFrame, combos: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Those of ``combos`` that no two rows share, all by one scan and one shuffle."""
    if not combos:
        return []
    table = model.Table(name, [model.Column(c, "text") for c in sorted({x for c in combos for x in c})], uniques=[list(c) for c in combos])
    broken = {r.rule for r in audit.check({name: df}, model.Schema([table])).where("violations > 0").collect()}
    return [c for c in combos if f"unique {', '.join(c)}" not in broken]


def _value(column: Column, kind: str) -> Column:
    """A value as text that equal values of a kind share, whatever their width."""
    if kind == "time":
        return F.unix_micros(column.cast("timestamp")).cast("string")
    return F.regexp_replace(column.cast("string"), r"\.?0+$", "") if kind == "decimal" else column.cast("string")


def inclusions(tables: dict[str, DataFrame], parents: set[tuple[str, str]], facts: list[ColumnFacts] | None = None) -> list[tuple[str, str, str, str]]:
    """(child table, column, parent table, column): all values of the child stand in the parent; ``parents`` may be parents.

    Columns without values are within nothing.  Only columns that kind, range
    and count leave a partner enter the index; it holds each distinct value of
    each of them once.
    """
    facts = [f for name, df in tables.items() for f in column_facts(name, df)] if facts is None else facts
    own = [f for f in facts if f.present]
    may = [
        (child, parent)
        for parent in own
        if (parent.table, parent.column) in parents
        for child in own
        if child is not parent and child.kind == parent.kind and _within(child, parent)
    ]
    used = [f for f in own if any(f is a or f is b for a, b in may)]
    if not may:
        return []
    number = {id(f): k for k, f in enumerate(used)}
    words = -(-len(used) // WORD)

    def values(name: str) -> DataFrame:
        entries = F.explode(F.array(*[F.struct(F.lit(number[id(f)]).alias("column"), F.lit(f.kind).alias("kind"), _value(F.col(f"`{f.column}`"), f.kind).alias("value")) for f in used if f.table == name]))
        return tables[name].select(entries.alias("e")).select("e.*").where("value IS NOT NULL")

    listed = reduce(DataFrame.unionAll, [values(name) for name in dict.fromkeys(f.table for f in used)])
    bit = lambda w: F.when((F.col("column") >= w * WORD) & (F.col("column") < (w + 1) * WORD), F.expr(f"shiftleft(1L, column - {w * WORD})")).otherwise(F.lit(0).cast("long"))
    holders = listed.groupBy("kind", "value").agg(*[F.bit_or(bit(w)).alias(f"w{w}") for w in range(words)])
    # with all of a column's values: what every one of their sets of columns has
    has = lambda k: F.col(f"w{k // WORD}").bitwiseAND(F.lit(1 << k % WORD)) != 0
    r = holders.agg(*[F.bit_and(F.when(has(k), F.col(f"w{w}"))).alias(f"c{k}_{w}") for k in range(len(used)) for w in range(words)]).first()
    holds = lambda child, parent: r[f"c{number[id(child)]}_{number[id(parent)] // WORD}"] >> number[id(parent)] % WORD & 1
    return sorted((a.table, a.column, b.table, b.column) for a, b in may if holds(a, b))


def _within(child: ColumnFacts, parent: ColumnFacts) -> bool:
    if child.distinct > parent.distinct * (1 + 2 * SLACK * DEVIATION):
        return False
    plain = lambda x: str(x) if isinstance(x, str) else x
    try:
        return plain(parent.low) <= plain(child.low) and plain(child.high) <= plain(parent.high)
    except TypeError:  # a date and a time
        return True


def _suffix(name: str) -> str:
    """A name without the short prefix that says in which table it stands."""
    head, _, tail = name.partition("_")
    return tail if tail and len(head) <= 2 else name


def speaks_of(child_column: str, parent_table: str, parent_column: str) -> bool:
    """Whether a column's name says that it refers to the parent."""
    if child_column == parent_column != "id" or _suffix(child_column) == _suffix(parent_column) != "id":
        return True
    return child_column in (f"{t}_{parent_column}" for t in (parent_table, parent_table.removesuffix("s")))


def discover(tables: dict[str, DataFrame], widest: int = WIDEST) -> model.Schema:
    """A schema of ``tables`` with the keys and references that their rows and names speak for.

    The primary key is the first of the smallest keys, one of whole numbers
    before others; other keys of one column are unique.  A reference is an
    inclusion in another table's key of one column whose name the column's
    name speaks of.
    """
    facts = {name: column_facts(name, df) for name, df in tables.items()}
    found = []
    for name, df in tables.items():
        table = model.from_struct(name, df.schema)
        keys = minimal_keys(name, df, widest, facts[name])
        whole = {f.column for f in facts[name] if f.kind == "whole"}
        keys.sort(key=lambda key: (len(key), not set(key) <= whole, [c for c in df.columns if c in key]))  # noqa: B023
        if keys:
            table.primary_key = [c for c in df.columns if c in keys[0]]
        for key in keys[1:]:
            if len(key) == 1:
                table.column(key[0]).unique = True
            else:
                table.uniques.append(key)
        for f in facts[name]:
            table.column(f.column).nullable = f.present < f.rows
        found.append(table)
    parents = {(t.name, t.primary_key[0]) for t in found if len(t.primary_key) == 1}
    schema = model.Schema(found)
    for child, column, parent, key in inclusions(tables, parents, [f for own in facts.values() for f in own]):
        own = schema.table(child).column(column)
        if child != parent and not own.references and speaks_of(column, parent, key):
            own.references = f"{parent}.{key}"
    return schema
