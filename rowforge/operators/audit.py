"""All rules of a schema over all its tables, by one scan of each and one shuffle.

Every row gives one entry for the rules about itself (a word with a bit for
each rule that it breaks, so that a table's entries are as many groups as
there are combinations of broken rules) and one for each of its keys, typed.
Entries of all tables are counted together: partly in the tasks that scan,
then by key.  A parent's keys meet its children's under the same number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions.scalars import fold
from rowforge.plans import model
from rowforge.plans.plan import ColumnPlan, Plan, regex_check

#: rules whose bits share a word
WORD = 62
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


@dataclass
class Rule:
    table: str
    rule: str
    #: "row", "unique" or "reference"
    kind: str
    #: row rules: what a row that breaks it has
    broken: Column | None = None
    columns: list[str] = field(default_factory=list)
    folded: bool = False
    parent: str = ""
    parent_column: str = ""


def row_rules(table: model.Table, plans: dict[str, ColumnPlan]) -> list[Rule]:
    """Rules that a row keeps or breaks alone; null breaks only NOT NULL."""
    out: list[Rule] = []

    def add(rule: str, broken: Column) -> None:
        out.append(Rule(table.name, rule, "row", broken))

    for c in table.columns:
        value, cp = F.col(f"`{c.name}`"), plans.get(c.name, ColumnPlan())
        if c.always_null:
            add(f"{c.name} is null", value.isNotNull())
        elif not c.nullable or c.name in table.primary_key:
            add(f"{c.name} is not null", value.isNull())
        if c.max_len:
            add(f"{c.name} has at most {c.max_len} characters", F.length(value) > c.max_len)
        if c.precision:
            add(f"{c.name} has at most {c.precision - c.scale} digits before the point", F.abs(value) >= F.lit(10.0 ** (c.precision - c.scale)))
        values = c.enum or (cp.values if cp.generator == "enum" else None)
        if values:
            add(f"{c.name} is in its list", ~value.isin(list(values)))
        if cp.min is not None:
            add(f"{c.name} is at least {cp.min}", value < F.lit(cp.min))
        if cp.max is not None:
            add(f"{c.name} is at most {cp.max}", value > F.lit(cp.max))
        if cp.pattern:
            add(f"{c.name} matches {cp.pattern}", ~value.rlike(cp.pattern))
    for check in table.checks:
        pattern = regex_check(check.expression, check.columns[0]) if check.enforceable() else None
        add(f"check {check.expression}", ~(F.col(f"`{check.columns[0]}`").rlike(pattern) if pattern else F.expr(check.expression)))
    return out


def key_rules(table: model.Table) -> list[Rule]:
    """Unique keys, a null in which exempts the row, and references."""
    out = [Rule(table.name, f"primary key {', '.join(table.primary_key)}", "unique", columns=list(table.primary_key))] if table.primary_key else []
    out += [Rule(table.name, f"unique {', '.join(key)}", "unique", columns=list(key)) for key in table.uniques]
    for c in table.columns:
        if c.unique and table.primary_key != [c.name]:
            out.append(Rule(table.name, f"unique {c.name}", "unique", columns=[c.name]))
        if c.unique_fold:
            out.append(Rule(table.name, f"unique {c.name} in any case", "unique", columns=[c.name], folded=True))
        ref = model.split_ref(c.references)
        if ref:
            out.append(Rule(table.name, f"{c.name} refers to {c.references}", "reference", columns=[c.name], parent=ref[0], parent_column=ref[1]))
    return out


def rules_of(schema: model.Schema, plan: Plan | None = None) -> list[Rule]:
    """All rules of a schema and, if given, of the bounds, lists and patterns of a plan."""
    out = []
    for table in schema.tables:
        tp = plan.tables.get(table.name) if plan else None
        out += row_rules(table, tp.columns if tp else {}) + key_rules(table)
    return out


def _meeting(*kinds: T.DataType) -> tuple[str, Callable[[Column], Column]]:
    """In which columns ("long" or "text") keys of these types meet, and as what."""
    if all(isinstance(k, WHOLE) for k in kinds):
        return "long", lambda c: c.cast("long")
    if all(isinstance(k, T.DateType) for k in kinds):
        return "long", lambda c: F.unix_date(c).cast("long")
    if all(isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)) for k in kinds):
        return "long", lambda c: F.unix_micros(c.cast("timestamp"))
    if all(isinstance(k, (*WHOLE, T.DecimalType)) for k in kinds):
        scale = max((k.scale for k in kinds if isinstance(k, T.DecimalType)), default=0)
        return "text", lambda c: c.cast(T.DecimalType(38, scale)).cast("string")
    if all(isinstance(k, (*WHOLE, T.DecimalType, T.FloatType, T.DoubleType)) for k in kinds):
        return "text", lambda c: (c.cast("double") + F.lit(0.0)).cast("string")  # -0.0 is 0.0
    return "text", lambda c: c.cast("string")


@dataclass
class _Entry:
    """A key of a table's rows under a rule's number."""

    number: int
    parts: list[tuple[str, Column]]
    parent: bool = False


def check(tables: dict[str, DataFrame], schema: model.Schema, plan: Plan | None = None) -> DataFrame:
    """(table_name, rule, rows, violations), one row per rule of ``schema`` and ``plan``.

    ``rows`` are those that the rule speaks of: all for rules about a row,
    those without a null in the key for keys.  A unique key's violations are
    the rows beyond the first of a key, a reference's the rows whose key no
    parent has.  Tables that are not given are left out; a reference to one
    has null violations.  Empty tables count 0.  A column that the schema has
    and the table has not is an error; further columns are ignored.

    Each table is scanned once, whatever the number of rules, and reads the
    columns that they name.  Keys are compared as what they are: numbers as
    numbers, also of different types.
    """
    rules = [r for r in rules_of(schema, plan) if r.table in tables]
    for table in schema.tables:
        if table.name in tables and (gone := [c.name for c in table.columns if c.name not in tables[table.name].columns]):
            raise ValueError(f"{table.name}: no column {gone[0]}")
    open_refs = {id(r) for r in rules if r.kind == "reference" and r.parent not in tables}
    bits = {t: [r for r in rules if r.table == t and r.kind == "row"] for t in tables}
    listed, words, entries, number = [], {t: [] for t in tables}, {t: [] for t in tables}, 0
    for t in [t.name for t in schema.tables if t.name in tables]:
        for at in range(0, max(1, len(bits[t])), WORD):
            words[t].append((number, bits[t][at : at + WORD]))
            listed += [(number, bit, r.table, r.rule, r.kind) for bit, r in enumerate(bits[t][at : at + WORD])]
            number += 1
    n_words = number
    kind_of = lambda t, c: tables[t].schema[c].dataType
    for r in (r for r in rules if r.kind != "row"):
        listed.append((number, 0, r.table, r.rule, "open" if id(r) in open_refs else r.kind))
        parts = []
        for c in r.columns:
            kinds = [kind_of(r.table, c)] + ([kind_of(r.parent, r.parent_column)] if r.kind == "reference" and r.parent in tables else [])
            where, as_met = _meeting(*kinds)
            parts.append((where, fold(F.col(f"`{c}`").cast("string")) if r.folded else as_met(F.col(f"`{c}`"))))
            if len(kinds) > 1:
                entries[r.parent].append(_Entry(number, [(where, as_met(F.col(f"`{r.parent_column}`")))], parent=True))
        entries[r.table].append(_Entry(number, parts))
        number += 1
    widths = {w: max([1 if w == "long" else 0] + [sum(p == w for p, _ in e.parts) for own in entries.values() for e in own]) for w in ("long", "text")}
    names = [f"{w}{k}" for w in ("long", "text") for k in range(widths[w])]

    def struct(number: int, parts: list[tuple[str, Column]], parent: bool) -> Column:
        left = {w: [c for p, c in parts if p == w] for w in widths}
        keys = [(left[w].pop(0) if left[w] else F.lit(None).cast("long" if w == "long" else "string")).alias(f"{w}{k}") for w in ("long", "text") for k in range(widths[w])]
        return F.struct(F.lit(number).alias("number"), F.lit(parent).alias("parent"), *keys)

    def of(t: str) -> DataFrame:
        own = []
        for word, held in words[t]:
            broken = reduce(lambda a, b: a.bitwiseOR(b), [F.when(r.broken, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, r in enumerate(held)], F.lit(0).cast("long"))
            own.append(struct(word, [("long", broken)], False))
        for e in entries[t]:
            whole = reduce(lambda a, b: a & b, [c.isNotNull() for _, c in e.parts])
            own.append(F.when(whole, struct(e.number, e.parts, e.parent)))
        return tables[t].select(F.explode(F.array(*own)).alias("e")).where("e IS NOT NULL").select("e.*")

    rule_list = next(iter(tables.values())).sparkSession.createDataFrame(listed, "number int, bit int, table_name string, rule string, kind string")
    met = reduce(DataFrame.unionAll, [of(t.name) for t in schema.tables if t.name in tables])
    keyed = met.groupBy("number", *names).agg(F.count_if(~F.col("parent")).alias("n"), F.max("parent").alias("known"))
    word = F.when(F.col("number") < n_words, F.col("long0"))
    counted = keyed.groupBy("number", word.alias("word")).agg(
        F.sum("n").alias("rows"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("extra"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("lost")
    )
    # all that is left is a row for each key rule and each combination of broken rules
    broken = F.when(F.col("kind") == "unique", F.col("extra")).when(F.col("kind") == "reference", F.col("lost"))
    broken = broken.when((F.col("kind") == "row") & (F.expr("shiftright(word, bit)").bitwiseAND(F.lit(1)) == 1), F.col("rows"))
    found = rule_list.join(counted, "number", "left").groupBy("table_name", "rule", "number", "bit", "kind").agg(F.sum("rows").alias("rows"), F.sum(broken).alias("violations"))
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return found.select("table_name", "rule", whole("rows").alias("rows"), F.when(F.col("kind") != "open", whole("violations")).alias("violations"))
