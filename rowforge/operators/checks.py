"""Data-quality queries over tables, each a lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.scalars import fold
from rowforge.operators import audit
from rowforge.plans.model import Column as SchemaColumn
from rowforge.plans.model import Schema, Table


def _present(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def duplicates(df: DataFrame, keys: list[str], folded: bool = False) -> DataFrame:
    """Keys that occur more than once, with their counts; a null in a key exempts the row."""
    named = [(fold(F.col(k)) if folded else F.col(k)).alias(k) for k in keys]
    return df.where(_present(keys)).select(*named).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def uniqueness(df: DataFrame, keys: list[str], folded: bool = False) -> DataFrame:
    """rows, distinct_keys, duplicated_keys, extra_rows: counted by one shuffle of partial counts."""
    named = [(fold(F.col(k)) if folded else F.col(k)).alias(k) for k in keys]
    groups = df.where(_present(keys)).select(*named).groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
        F.count("*").alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("duplicated_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("extra_rows"),
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent; a self-reference is the same with one table."""
    parents = parent.select(F.col(parent_key).alias("_parent")).where("_parent IS NOT NULL")
    return child.where(F.col(key).isNotNull()).join(parents, F.col(key) == F.col("_parent"), "left_anti")


def orphan_count(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row (name, checked, orphans).  Keys are counted before the join, so that a hot key is one row in it."""
    keys = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"))
    parents = parent.select(F.col(parent_key).alias("_parent")).where("_parent IS NOT NULL").distinct()
    met = keys.join(parents, F.col("_key") == F.col("_parent"), "left")
    lost = F.coalesce(F.sum(F.when(F.col("_parent").isNull(), F.col("n"))), F.lit(0)).cast("long")
    return met.agg(F.lit(name).alias("edge"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("checked"), lost.alias("orphans"))


def orphan_report(tables: dict[str, DataFrame], edges: list[tuple[str, str, str, str]]) -> DataFrame:
    """:func:`orphan_count` of many edges (child, key, parent, key): each table is read once, keys are counted as what they are before they meet."""
    named = dict.fromkeys(t for child, _, parent, _ in edges for t in (child, parent))
    schema = Schema([Table(t, [SchemaColumn(key, references=f"{parent}.{parent_key}") for child, key, parent, parent_key in edges if child == t]) for t in named])
    found = audit.check({t: tables[t] for t in named}, schema).where(F.col("rule").contains(" refers to "))
    return found.select(F.concat_ws(".", "table_name", F.substring_index("rule", " refers to ", 1)).alias("edge"), F.col("rows").alias("checked"), F.col("violations").alias("orphans"))


def one_to_one(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count(key).alias("rows"), F.count_distinct(key).alias("distinct_keys")).withColumn("one_to_one", F.col("rows") == F.col("distinct_keys"))


def value_range(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, nulls, rate), one row a column, from one pass."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{k}") for k, c in enumerate(columns)])
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{k}").alias("nulls")) for k, c in enumerate(columns)]))
    return counts.select("rows", stacked.alias("s")).select(
        "s.column", "rows", "s.nulls", F.when(F.col("rows") > 0, F.col("s.nulls") / F.col("rows")).otherwise(0.0).alias("rate")
    )


def _failing(df: DataFrame, what: str, failed: Column) -> DataFrame:
    return df.agg(F.lit(what).alias("rule"), F.count("*").alias("rows"), F.count_if(failed).alias("violations"))


def pattern_violations(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return _failing(df, f"{column} ~ {pattern}", ~F.col(column).rlike(pattern))


def length_violations(df: DataFrame, column: str, max_len: int, unit: str = "chars") -> DataFrame:
    size = F.length(column) if unit == "chars" else F.octet_length(column)
    return _failing(df, f"{unit}({column}) <= {max_len}", size > max_len)


def enum_violations(df: DataFrame, column: str, values: list) -> DataFrame:
    return _failing(df, f"{column} in list", ~F.col(column).isin(values))


def check_violations(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which a check, across any columns, is false; null passes, as in SQL."""
    return _failing(df, expression, ~F.expr(expression))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Children per parent: parents, min, max, mean."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("parents"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one table and not the other, with multiplicity: empty for equal tables."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def key_pool(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The smallest non-null keys: an ordered, hence repeatable, pool."""
    return df.select(column).where(F.col(column).isNotNull()).orderBy(column).limit(limit)


def max_value(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("max_value"), F.count(column).alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of many tables in one job."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out
