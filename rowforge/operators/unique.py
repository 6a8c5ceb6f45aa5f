"""Uniqueness repair: the first row of a key keeps it, later ones are changed by their row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.functions.scalars import fold
from rowforge.operators.cut import cut
from rowforge.operators.relate import stride_for

ROUNDS = 3


class RepairError(ValueError):
    pass


def suffixed(value: Column, number: Column, max_len: int = 0, is_mail: bool | None = None) -> Column:
    """``value-number``; for an e-mail the local part takes the number and the domain stays whole.

    ``is_mail``: whether values are e-mail addresses, where that is known.
    """
    tail = number.cast("string")
    domain = F.concat(F.lit("@"), F.substring_index(value, "@", -1))
    local = F.substring(value, F.lit(1), F.length(value) - F.length(domain))
    if is_mail and not max_len:
        local = F.substring_index(value, "@", 1)
    mail = value.contains("@") if is_mail is None else F.lit(is_mail)
    if not max_len:
        return F.when(mail, F.concat(local, F.lit("+"), tail, domain)).otherwise(F.concat(value, F.lit("-"), tail))

    def fit(head: Column, mark: str, end: Column) -> Column:
        room = F.lit(max_len) - F.length(end) - len(mark)
        joined = F.concat(F.substring(head, F.lit(1), F.greatest(room, F.lit(0))), F.lit(mark), end)
        return F.when(room < 1, F.substring(end, F.lit(1), F.lit(max_len))).otherwise(joined)

    return F.when(mail, fit(local, "+", F.concat(tail, domain))).otherwise(fit(value, "-", tail))


def constructed(value: Column, row: Column, kind: str, n: int, low, high, seed: int, max_len: int = 0, is_mail: bool | None = None) -> Column:
    """Values that cannot repeat, without looking at other rows: text ends in the row, a uuid's last part is the row,
    integers step through their range (from its start upwards if it is too small for ``n`` rows)."""
    if kind == "uuid":
        return F.when(value.isNotNull(), F.concat(F.substring(value, 1, 24), F.lpad(F.lower(F.hex(row)), 12, "0")))
    if kind == "string":
        if max_len and max_len < len(str(max(0, n - 1))):
            raise RepairError(f"{n} unique values do not fit {max_len} characters")
        return suffixed(value, row, max_len, is_mail)
    first = int(low) if low is not None else 1
    space = (int(high) if high is not None else first + 998) - first + 1
    if space < n:
        return F.when(value.isNotNull(), row + first)
    step = stride_for(space, seed)
    step = step if space * step < 2**63 else 1
    return F.when(value.isNotNull(), F.pmod(row * step + seed % space, F.lit(space).cast("long")) + first)


def _keyed(column: str, folded: bool) -> Column:
    return fold(F.col(column)) if folded else F.col(column)


def late_rows(df: DataFrame, column: str, id_col: str, folded: bool = False) -> DataFrame:
    """(id, value, key) of the rows beyond the first of their key, without a window.

    First rows are found by a partial aggregation and left out by a join on the
    row id, so that a key that most rows share is no task of its own.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(column).alias("value"), _keyed(column, folded).alias("key")).where("key IS NOT NULL")
    firsts = own.groupBy("key").agg(F.min("id").alias("first"))
    return own.join(firsts.select("first"), F.col("id") == F.col("first"), "left_anti")


def repair(df: DataFrame, column: str, id_col: str, kind: str, folded: bool = False, max_len: int = 0, scale: int | None = None) -> DataFrame:
    """``df`` with duplicates in ``column`` changed; null keys stay.  Row ids have to be distinct.

    The first row of a key, by row id, keeps it.  Others take a suffix from the
    row id (text), go on after the largest value (integers) or by steps of the
    last place (decimals).  A changed value that meets another gives way and is
    changed again, a bounded number of times; what meets another after that is
    refused.
    """
    if kind not in ("string", "uuid", "int", "float"):
        raise RepairError(f"{column}: no repair for {kind}")
    late, rest = late_rows(df, column, id_col, folded), [c if c != column else None for c in df.columns]
    put = lambda changes: df.join(changes.select(F.col("id").alias("_id"), F.col("value").alias("_new")), F.col(id_col) == F.col("_id"), "left").select(
        *[F.coalesce(F.col("_new"), F.col(column)).alias(column) if c is None else F.col(c) for c in rest]
    )
    if kind in ("int", "float"):
        top = df.agg(F.max(column)).first()[0]
        step = 1 if kind == "int" or scale is None else 10.0**-scale
        out = put(late.select("id", (F.lit(top) + (F.col("id") + 1) * step).cast(df.schema[column].dataType).alias("value")))
        return refuse_duplicates(out, column, folded) if kind == "float" else out
    late = cut(late.select("id", "value"))
    if late.isEmpty():
        return df
    keys = df.where(F.col(column).isNotNull()).select(_keyed(column, folded).alias("taken")).distinct()
    changed, open_rows = None, late
    for turn in range(1, ROUNDS + 1):
        number = F.col("id") if turn == 1 else F.concat_ws("-", F.col("id").cast("string"), F.lit(turn).cast("string"))
        tried = open_rows.select("id", "value", suffixed(F.col("value"), number, max_len).alias("new"))
        key = fold(F.col("new")) if folded else F.col("new")
        # one of those that got the same value may have it, if no earlier row has
        first = tried.groupBy(key.alias("taken")).agg(F.min("id").alias("first")).join(keys, "taken", "left_anti")
        good = tried.join(first.select("first"), F.col("id") == F.col("first"), "left_semi").select("id", F.col("new").alias("value"))
        changed = good if changed is None else changed.unionAll(good)
        open_rows = cut(tried.join(first.select("first"), F.col("id") == F.col("first"), "left_anti").select("id", "value"))
        if open_rows.isEmpty():
            return put(changed)
        keys = keys.unionAll(first.select("taken"))
    raise RepairError(f"{column}: values are still duplicated after {ROUNDS} rounds of repair")


def repair_stream(df: DataFrame, column: str, id_col: str, folded: bool = False, max_len: int = 0) -> DataFrame:
    """:func:`repair` of text for a stream: a value that came before, in this batch of the stream or an earlier one, takes its row id.

    ``df`` has the columns ``id_col``, ``column`` and others made by this
    function.  A key's state is that it was seen.  Rows of a batch are taken
    by row id, so that a stream in the order of its ids gives what the batch
    gives, unless a changed value meets another.
    """
    import pandas as pd

    names = df.columns
    key = F.coalesce(_keyed(column, folded), F.concat(F.lit("\0"), F.pmod(F.col(id_col), F.lit(64)).cast("string")))  # null keys are no duplicates

    def seen(_, pieces, state):
        own = pd.concat(list(pieces)).sort_values(id_col)
        late = own[column].notna()
        if not state.exists:
            late.iloc[0] = False
            state.update((True,))
        own["_late"] = late
        yield own[[*names, "_late"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    met = df.withColumn("_key", key).groupBy("_key").applyInPandasWithState(seen, f"{kinds}, _late boolean", "seen boolean", "append", "NoTimeout")
    changed = F.when(F.col("_late"), suffixed(F.col(column), F.col(id_col), max_len)).otherwise(F.col(column))
    return met.select(*[changed.alias(column) if c == column else c for c in names])


def refuse_duplicates(df: DataFrame, column: str, folded: bool = False, held: DataFrame | None = None) -> DataFrame:
    """``df``, unless ``column`` has duplicates, or values among ``held`` (a column ``_held``)."""
    if still_duplicated(df, column, folded):
        raise RepairError(f"{column}: values are still duplicated after {ROUNDS} rounds of repair")
    if held is not None and not df.join(held, _keyed(column, folded) == F.col("_held"), "left_semi").isEmpty():
        raise RepairError(f"{column}: values still meet existing ones after {ROUNDS} rounds of repair")
    return df


def still_duplicated(df: DataFrame, column: str, folded: bool = False) -> bool:
    keys = df.where(F.col(column).isNotNull()).groupBy(_keyed(column, folded).alias("k")).agg(F.count("*").alias("n"))
    return not keys.where("n > 1").isEmpty()


def append_counter(df: DataFrame, column: str, id_col: str, existing: DataFrame) -> DataFrame:
    """Numbers that go on after the largest existing one: every row takes its own."""
    top = existing.agg(F.max(column)).first()[0]
    return df.withColumn(column, (F.lit(int(top) if top is not None else 0) + 1 + F.col(id_col)).cast(df.schema[column].dataType))


def append_unique(df: DataFrame, column: str, id_col: str, existing: DataFrame, folded: bool = False, max_len: int = 0) -> DataFrame:
    """New text rows made unique among themselves and against what exists, without reading it to the driver."""
    held = existing.select(_keyed(column, folded).alias("_held")).where("_held IS NOT NULL").distinct()
    met = df.join(held, _keyed(column, folded) == F.col("_held"), "left")
    changed = F.when(F.col("_held").isNotNull(), suffixed(F.col(column), F.col(id_col), max_len)).otherwise(F.col(column))
    out = repair(met.withColumn(column, changed).drop("_held"), column, id_col, "string", folded, max_len)
    return refuse_duplicates(out, column, folded, held)
