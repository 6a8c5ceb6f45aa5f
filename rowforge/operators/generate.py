"""Generation: a plan and a schema give one lazy DataFrame per table."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowforge.functions.draw import salt, table_seed, unit
from rowforge.functions.kinds import KINDS, LOCALES, OWN, Draws, longest
from rowforge.functions.kinds import generate as generate_kind
from rowforge.functions.language import language, numbers, word_at
from rowforge.functions.pattern import PatternError, compile_pattern, compile_unique, value_space
from rowforge.functions.scalars import clamp_text, round_scale
from rowforge.operators import relate, unique
from rowforge.plans import model
from rowforge.plans.plan import DEFAULT_ROWS, ColumnPlan, Plan, TablePlan, table_order, validate

ID = "_row"


class GenerationError(ValueError):
    pass


@dataclass
class Options:
    seed: int = 0
    rows: int | None = None
    #: new rows go beside those that a target holds, or in their place (for single tables: TablePlan.truncate); else a target must be empty
    append: bool = False
    truncate: bool = False
    #: "construct": unique text, uuids and integers carry their row and need no shuffle; "repair": only later duplicates change
    uniqueness: str = "construct"
    #: rows that exist already, by table; parents outside the plan and, when appending, the values to go on from
    existing: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Result:
    tables: dict[str, DataFrame]
    seed: int
    order: list[str]
    options: Options = field(default_factory=Options)
    #: tables whose earlier rows go
    truncated: frozenset[str] = frozenset()
    seconds: dict[str, float] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def rows_per_second(self) -> float:
        return sum(self.counts.values()) / max(1e-9, sum(self.seconds.values()))

    def _run(self, name: str, save: Callable[[DataFrame], None], progress: Callable[[str, int, float], None] | None) -> None:
        """Compute a table once, counting its rows on the way."""
        seen, began = Observation(), time.time()
        save(self.tables[name].observe(seen, F.count(F.lit(1)).alias("rows")))
        self.seconds[name], self.counts[name] = time.time() - began, seen.get["rows"]
        if progress:
            progress(name, self.counts[name], self.seconds[name])


def _rows(tp: TablePlan, options: Options) -> int:
    own = tp.rows if tp.rows is not None else DEFAULT_ROWS
    return options.rows if options.rows is not None and own else own


def written_columns(table: model.Table, tp: TablePlan) -> list[tuple[model.Column, ColumnPlan]]:
    """Columns that get a value, in catalog order."""
    pairs = [(c, tp.columns[c.name]) for c in table.columns if c.name in tp.columns]
    return [(c, p) for c, p in pairs if not p.skip and p.generator != "default" and not c.generated]


def _value(row: Column, column: model.Column, cp: ColumnPlan, seed: int, locale: str, numbered: bool = False) -> Column:
    """The value of a row; ``numbered``: an address that carries the row."""
    kind, own = model.spark_type(column), salt(seed, column.name)
    if cp.generator == "sequence":
        value = row + (cp.start if cp.start is not None else 1)
    elif cp.generator == "pattern":
        value = compile_pattern(cp.pattern, row, own)
    elif cp.generator == "null":
        value = F.lit(None)
    elif cp.generator == "const":
        value = F.lit(cp.const)
    else:
        options = {k: getattr(cp, k) for k in ("min", "max", "values", "weights", "true_weight")}
        value = generate_kind(cp.generator, Draws(row, own, cp.locale or locale), options | ({"number": row} if numbered else {}))
    if cp.true_weight is not None:
        value = unit(row, salt(seed, column.name, "bool")) < cp.true_weight
    if column.cls == "float" and column.precision and cp.generator not in ("const", "null"):
        value = round_scale(value.cast("double"), column.scale)
    if cp.null_rate:
        value = F.when(unit(row, salt(seed, column.name, "null")) >= cp.null_rate, value)
    value = value.cast(kind)
    if column.max_len and column.cls == "string" and cp.generator != "pattern" and not (numbered or _fits(column, cp, locale)):
        value = clamp_text(value, column.max_len)
    return value.alias(column.name)


def _fits(column: model.Column, cp: ColumnPlan, locale: str, further: int = 0) -> bool:
    """Whether no value of a kind of this library is too long."""
    if OWN.get(cp.generator) is not KINDS.get(cp.generator) or cp.generator not in OWN:
        return False
    most = longest(cp.generator, cp.locale or locale)
    return most is not None and (not column.max_len or most + further <= column.max_len)


def _is_one_to_one(table: model.Table, column: model.Column, cp: ColumnPlan) -> bool:
    return cp.unique or column.unique or table.primary_key == [column.name]


def _composite(table: model.Table, tp: TablePlan) -> list[str]:
    """The columns of a composite key that consists of foreign keys only."""
    key = table.primary_key
    plans = [tp.columns.get(c) for c in key]
    return list(key) if len(key) > 1 and all(p is not None and p.generator == "foreign_key" and not p.skip for p in plans) else []


def _parent_keys(ref: str, made: dict[str, DataFrame], schema: model.Schema, options: Options) -> DataFrame | None:
    table, column = model.split_ref(ref)
    out = None
    for source in (made.get(table), options.existing.get(table)):
        if source is not None and column in source.columns:
            out = source.select(column) if out is None else out.union(source.select(column))
    return out


def _self_filling(table: model.Table, tp: TablePlan) -> str | None:
    """A single integer key that the database would fill; it becomes 1..n here."""
    if len(table.primary_key) != 1:
        return None
    column = table.column(table.primary_key[0])
    cp = tp.columns.get(column.name)
    return column.name if column.cls == "int" and (cp is None or cp.skip or cp.generator == "default") else None


def _row_value(row: Column, name: str, table: model.Table, column: model.Column, cp: ColumnPlan, seed: int, n: int, locale: str, options: Options) -> Column | None:
    """A column's final value as a function of the row id; None where it takes a look at other rows to be unique."""
    plain = _value(row, column, cp, seed, locale)
    if not (cp.unique or column.unique or column.unique_fold) or cp.generator == "null":
        return plain
    cls, held = column.cls, options.append and name in options.existing
    if cls == "bool" or cp.generator == "const":
        if n > (2 if cls == "bool" else 1):
            raise GenerationError(f"{name}.{column.name}: {n} rows cannot have unique values of {cp.generator}")
        return plain
    if held:
        return None
    if cp.generator == "sequence":
        return plain
    if cp.generator == "pattern":
        value = _numbered_pattern(row, name, column, cp, seed, n, options)
        return None if value is None else F.when(plain.isNotNull(), value).cast(model.spark_type(column)).alias(column.name)
    if cls == "time":
        stepped = F.timestamp_seconds(F.unix_timestamp(plain) - F.pmod(F.unix_timestamp(plain), F.lit(n)) + row)
        return stepped.alias(column.name) if model.spark_type(column).simpleString() == "timestamp" else _refuse(name, column)
    if options.uniqueness == "construct" and cls in ("string", "uuid", "int"):
        if cls == "string" and cp.generator == "email" and _fits(column, cp, locale, 1 + len(str(n))):
            return _value(row, column, cp, seed, locale, numbered=True)
        # the kinds of this library hold an @ only in addresses
        own = OWN.get(cp.generator) is KINDS.get(cp.generator)
        is_mail = (cp.generator == "email") if own and cp.generator in OWN and cp.generator != "enum" else None
        value = unique.constructed(plain, row, cls, n, cp.min, cp.max, seed, column.max_len, is_mail)
        return value.cast(model.spark_type(column)).alias(column.name)
    return None if cls in ("string", "enum", "uuid", "int", "float") else _refuse(name, column)


def _refuse(name: str, column: model.Column):
    raise GenerationError(f"{name}.{column.name}: no way to make {column.cls} values unique")


def _key_function(schema: model.Schema, plan: Plan, ref: str, options: Options, seed: int) -> Callable[[Column], Column] | None:
    """The key of a parent's row as a function of the row id, where the parent is made here and its keys are unique by construction.

    A child then draws a row and computes its key: no pool, no join.
    """
    name, key = model.split_ref(ref)
    table, tp = schema.table(name), plan.tables.get(name)
    if tp is None or table is None or name in options.existing:
        return None
    column, cp, n = table.column(key), tp.columns.get(key), _rows(tp, options)
    if _self_filling(table, tp) == key:
        return lambda row: (row + 1).cast(model.spark_type(column))
    if cp is None or cp.skip or cp.null_rate or cp.generator in ("foreign_key", "default", "null", "const") or column.generated or column.cls == "bool":
        return None
    if cp.generator != "sequence" and not (cp.unique or column.unique):
        return None
    make = lambda row: _row_value(row, name, table, column, cp, table_seed(seed, name), n, plan.locale, options)
    return make if make(F.lit(0).cast("long")) is not None else None


def _forest(schema: model.Schema, plan: Plan, table: model.Table, column: model.Column, cp: ColumnPlan, n: int, own: int, options: Options, seed: int, pools: dict):
    """How a row refers into its own table: (key of its parent as a function of the row, or None; else a pool of existing keys, and its size).

    New rows form trees of bounded depth, by rows before them.  Roots are
    null, or refer to themselves where null is not allowed.  Where the keys
    are no function of the row, rows refer to what exists already.
    """
    name, key = model.split_ref(cp.references)
    target, tp = table.column(key), plan.tables[name]
    kcp, beside = tp.columns.get(key), options.append and name in options.existing
    made = None
    if beside and not _is_one_to_one(table, column, cp):
        held = _pool(cp.references, {}, schema, options, pools)
        if held[1]:
            return None, *held
    if _self_filling(table, tp) == key:
        start = 1
        if beside:
            start += options.existing[name].agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
        made = lambda row: (row + start).cast(model.spark_type(target))
    elif kcp is not None and not kcp.skip and kcp.generator not in ("foreign_key", "default") and (kcp.unique or target.unique or table.primary_key == [key]):
        if _row_value(F.lit(0).cast("long"), name, table, target, kcp, own, n, plan.locale, options) is not None:
            made = lambda row: _row_value(row, name, table, target, kcp, own, n, plan.locale, options)
    if made is None:
        return None, None, 0
    bound = column.name in table.primary_key or not column.nullable
    place = relate.chain_parent if _is_one_to_one(table, column, cp) else lambda row: relate.forest_parent(row, n, salt(own, column.name, "parent"))

    def parent(row: Column) -> Column:
        at = place(row)
        return made(F.coalesce(at, row)) if bound else F.when(at.isNotNull(), made(at))

    return parent, None, 0


def _pool(ref: str, made: dict[str, DataFrame], schema: model.Schema, options: Options, pools: dict) -> tuple[DataFrame | None, int]:
    """The numbered keys of a parent and how many there are; each parent is looked at once."""
    if ref not in pools:
        parents = _parent_keys(ref, made, schema, options)
        if parents is None:
            pools[ref] = (None, 0)
        else:
            key = parents.columns[0]
            pools[ref] = (relate.indexed(parents, key), parents.where(F.col(key).isNotNull()).select(F.count_distinct(key)).first()[0])
    return pools[ref]


def make_table(
    spark: SparkSession,
    schema: model.Schema,
    plan: Plan,
    name: str,
    made: dict[str, DataFrame],
    options: Options,
    seed: int,
    splits: int | None = None,
    pools: dict | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """One table; ``rows``: the row ids (a column ID) to make it of, which may be a stream, instead of all of them."""
    table, tp = schema.table(name), plan.tables[name]
    n, pools = _rows(tp, options), {} if pools is None else pools
    own = table_seed(seed, name)
    columns = written_columns(table, tp)
    if rows is not None:
        base = rows.select(F.col(ID).cast("long").alias(ID)).where((F.col(ID) >= 0) & (F.col(ID) < n))
    else:
        base = spark.range(0, n, 1, splits).withColumnRenamed("id", ID) if splits else spark.range(n).withColumnRenamed("id", ID)
    row, keys = F.col(ID), [(c, p) for c, p in columns if p.generator == "foreign_key"]
    values = {c.name: _row_value(row, name, table, c, p, own, n, plan.locale, options) for c, p in columns if p.generator != "foreign_key"}
    streamed = base.isStreaming
    if streamed:
        base, values = _streamed_uniques(base, table, columns, values, own, plan.locale, options)
    plain = [_value(row, c, p, own, plan.locale) if values[c.name] is None else values[c.name] for c, p in columns if c.name in values]
    nulls = lambda column, cp, key: F.when(unit(row, salt(own, column.name, "null")) >= cp.null_rate, key) if cp.null_rate else key

    # each key: how a place among its parents becomes a key (a function or a pool), and how many there are
    sources: dict[str, tuple[Callable[[Column], Column] | None, DataFrame | None, int]] = {}
    for column, cp in keys:
        parent, make, pool, size = model.split_ref(cp.references)[0], None, None, 0
        if parent == name:
            make, pool, size = _forest(schema, plan, table, column, cp, n, own, options, seed, pools)
            if make:
                plain.append(nulls(column, cp, make(row)).alias(column.name))
                continue
        elif parent in made:
            make = _key_function(schema, plan, cp.references, options, seed)
            size = _rows(plan.tables[parent], options) if make else 0
        if parent != name and make is None:
            pool, size = _pool(cp.references, made, schema, options, pools)
        if size == 0 and (not column.nullable or column.name in table.primary_key):
            raise GenerationError(f"{name}.{column.name}: {cp.references} has no rows to refer to")
        sources[column.name] = (make, pool, size)

    composite, places = _composite(table, tp), {}
    beside = bool(composite) and options.append and name in options.existing
    if beside:
        if streamed:
            raise GenerationError(f"{name}: a stream cannot be appended to a table whose key is made of references")
        ways = [(c, sources[c][1] if sources[c][1] is not None else _pool(table_ref(tp, c), made, schema, options, pools)[0], sources[c][2]) for c in composite]
        base = relate.append_composite(base, ID, ways, options.existing[name], n, own)
        plain += [F.col(c).cast(model.spark_type(table.column(c))).alias(c) for c in composite]
    elif composite:
        places = dict(zip(composite, relate.composite_places(row, [sources[c][2] for c in composite], n, own), strict=True))
    joined = []
    for column, cp in keys:
        if beside and column.name in composite:
            continue
        if column.name not in sources:  # a reference into the table itself that is a function of the row
            continue
        make, pool, size = sources[column.name]
        if size == 0:
            plain.append(F.lit(None).cast(model.spark_type(column)).alias(column.name))
            continue
        place = places.get(column.name)
        if place is None and _is_one_to_one(table, column, cp):
            if n > size:
                raise relate.CapacityError(f"{column.name}: {n} rows for {size} parents")
            place = relate.own_place(row, size, below_offset(own, size))
        elif place is None:
            place = relate.drawn(row, salt(own, column.name, "fk"), size)
            if make:
                plain.append(nulls(column, cp, make(place)).alias(column.name))
                continue
        if make:
            plain.append(make(place).alias(column.name))
        else:
            joined.append((column, cp, place, pool, size))
    out = base.select(row, *plain)
    for column, cp, place, pool, size in joined:
        out = relate.attach(out, place, pool, column.name, size)
        if not (column.name in places or _is_one_to_one(table, column, cp)):
            out = out.withColumn(column.name, nulls(column, cp, F.col(column.name)))

    for column, cp in columns:
        if column.name not in values or values[column.name] is not None:
            continue
        folded, cls, held = column.unique_fold, column.cls, options.existing.get(name) if options.append else None
        if cp.generator == "pattern":
            out = _redraw(out, column, cp, own, held)
        elif held is not None and cls in ("int", "float"):
            out = unique.append_counter(out, column.name, ID, held)
        elif held is not None and cls != "uuid":
            out = unique.append_unique(out, column.name, ID, held, folded, column.max_len)
        else:
            out = unique.repair(out, column.name, ID, "string" if cls == "enum" else cls, folded, column.max_len, column.scale if column.precision else None)

    surrogate = _self_filling(table, tp)
    if surrogate:
        start = 1
        if options.append and name in options.existing:
            start += options.existing[name].agg(F.coalesce(F.max(surrogate), F.lit(0))).first()[0]
        out = out.withColumn(surrogate, (row + start).cast(model.spark_type(table.column(surrogate))))
    present = [c.name for c in table.columns if c.name in out.columns]
    return out.select(*present)


def _streamed_uniques(base: DataFrame, table: model.Table, columns: list, values: dict, own: int, locale: str, options: Options) -> tuple[DataFrame, dict]:
    """The row ids of a stream with the columns that take a look at other rows, and where each column comes from."""
    values = dict(values)
    open_columns = [(c, p) for c, p in columns if c.name in values and values[c.name] is None]
    if len(open_columns) > 1:
        raise GenerationError(f"{table.name}: a stream keeps the state of one column, not of {', '.join(c.name for c, _ in open_columns)}")
    for column, cp in open_columns:
        if cp.generator == "pattern" or column.cls not in ("string", "uuid", "enum") or (options.append and table.name in options.existing):
            raise GenerationError(f"{table.name}.{column.name}: no way to make {column.cls} values of {cp.generator} unique in a stream")
        base = unique.repair_stream(base.withColumn(column.name, _value(F.col(ID), column, cp, own, locale)), column.name, ID, column.unique_fold, column.max_len)
        values[column.name] = F.col(column.name)
    return base, values


def table_ref(tp: TablePlan, column: str) -> str:
    return tp.columns[column].references


def below_offset(seed: int, size: int) -> int:
    return seed % size


def _numbered_pattern(row: Column, table: str, column: model.Column, cp: ColumnPlan, seed: int, n: int, options: Options) -> Column | None:
    """The words of a pattern are numbered, and each row has a number of its own; None for patterns too large to number.

    Patterns of one shape spell the number in their last places, all others
    look it up in the counts of their words by length.
    """
    if column.cls != "string":
        return None
    own, space = salt(seed, column.name), value_space(cp.pattern) if not column.unique_fold else None
    words = None
    if space is None:
        try:
            words = language(cp.pattern, column.max_len, column.unique_fold)
        except PatternError:
            return None
        space = words.total
    if space < n and not cp.null_rate:
        raise GenerationError(f"{table}.{column.name}: {n} rows cannot have unique values of a pattern with {space}")
    if space < n or options.uniqueness != "construct":
        return None
    number = lambda size: unique.constructed(F.lit(0), row, "int", n, 0, size - 1, own)
    if words is None:
        return compile_unique(cp.pattern, row, own, n, number)
    size, apart = numbers(words, n)
    return word_at(words, number(size) * F.lit(apart).cast("long"))


def _redraw(out: DataFrame, column: model.Column, cp: ColumnPlan, seed: int, held: DataFrame | None) -> DataFrame:
    """Duplicates of a pattern are drawn again: a suffix would break it."""
    key, known = unique._keyed(column.name, column.unique_fold), None
    if held is not None:
        known = held.select(key.alias("_held")).where("_held IS NOT NULL").distinct()
    for attempt in range(1, unique.ROUNDS + 2):
        if known is not None:
            out = out.join(known, key == F.col("_held"), "left")
        else:
            out = out.withColumn("_held", F.lit(None).cast("string"))
        first = unique.Window.partitionBy(key).orderBy(ID)
        late = F.col(column.name).isNotNull() & ((F.row_number().over(first) > 1) | F.col("_held").isNotNull())
        other = compile_pattern(cp.pattern, F.col(ID), salt(seed, column.name, f"attempt {attempt}"))
        out = out.withColumn("_late", late).withColumn(column.name, F.when(F.col("_late"), other).otherwise(F.col(column.name))).drop("_late", "_held")
    return unique.refuse_duplicates(out, column.name, column.unique_fold, known)


def generate(spark: SparkSession, schema: model.Schema, plan: Plan, options: Options | None = None, splits: int | None = None) -> Result:
    """Lazy DataFrames of all tables, parents first.  All refusals come before anything is written."""
    options = options or Options()
    if options.append and options.truncate:
        raise GenerationError("append and truncate exclude each other")
    problems = validate(plan, schema)
    if options.append:
        problems += [f"{n}: append and truncate exclude each other" for n, tp in plan.tables.items() if tp.truncate and not tp.skip]
    if problems:
        raise GenerationError("; ".join(problems))
    unknown = {plan.locale, *(cp.locale for tp in plan.tables.values() for cp in tp.columns.values())} - {"", *LOCALES}
    if unknown:
        warnings.warn(f"no word lists for {', '.join(sorted(unknown))}: en_US is used", stacklevel=2)
    seed = options.seed or plan.seed or time.time_ns() % 2**31
    order = table_order(plan, schema)
    made: dict[str, DataFrame] = {}
    pools: dict = {}
    for name in order:
        made[name] = make_table(spark, schema, plan, name, made, options, seed, splits, pools)
    return Result(made, seed, order, options, frozenset(n for n in order if options.truncate or plan.tables[n].truncate))


def preview(spark: SparkSession, schema: model.Schema, plan: Plan, table: str, rows: int = 5, nonce: int = 0, existing: dict[str, DataFrame] | None = None) -> DataFrame:
    """A few rows of one table, without its parents' rows: proposed keys 1..20 stand in for parents that are empty."""
    seed = (plan.seed or 1) ^ (nonce * 0x9E3779B97F4A7C15 & (2**63 - 1))
    stand_ins = dict(existing or {})
    for cp in plan.tables[table].columns.values():
        ref = model.split_ref(cp.references) if cp.generator == "foreign_key" else None
        if ref and ref[0] not in stand_ins and ref[0] != table:
            column = schema.table(ref[0]).column(ref[1])
            stand_ins[ref[0]] = spark.range(1, 21).select(F.col("id").cast(model.spark_type(column)).alias(ref[1]))
    options = Options(rows=min(50, rows), existing=stand_ins)
    return make_table(spark, schema, plan, table, {}, options, seed, 1)


def dry_run(result: Result, progress: Callable[[str, int, float], None] | None = None) -> Result:
    """Compute every table once and write nothing; ``progress`` hears of each table, its rows and seconds."""
    for name in result.order:
        result._run(name, lambda df: df.write.format("noop").mode("overwrite").save(), progress)
    return result


def write_tables(result: Result, path: str, fmt: str = "parquet", progress: Callable[[str, int, float], None] | None = None) -> Result:
    """Write all tables under ``path``: into a staging folder first, moved only when all are complete.

    A table that is there already is an error, unless its rows go (truncate)
    or stay beside the new ones (append).
    """
    spark = next(iter(result.tables.values())).sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    staging = f"{path.rstrip('/')}/_staging"
    held = [n for n in result.order if fs.exists(jpath(f"{path}/{n}"))]
    if taken := [n for n in held if n not in result.truncated and not result.options.append]:
        raise GenerationError(f"{path}/{taken[0]} exists")
    try:
        for name in result.order:
            result._run(name, lambda df, name=name: df.write.format(fmt).save(f"{staging}/{name}"), progress)
        for name in reversed(result.order):  # children first, as they refer to what goes
            if name in held and name in result.truncated:
                fs.delete(jpath(f"{path}/{name}"), True)
        for name in result.order:
            made, target = jpath(f"{staging}/{name}"), jpath(f"{path}/{name}")
            if not fs.exists(target):
                fs.rename(made, target)
                continue
            for part in fs.listStatus(made):  # the names of part files are unique
                if not part.getPath().getName().startswith("_"):
                    fs.rename(part.getPath(), target)
    finally:
        fs.delete(jpath(staging), True)
    return result
