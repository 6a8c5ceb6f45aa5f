"""Constraints of a live source, from the standard catalog views, and DDL against Spark's catalog."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowforge.plans.ddl import Change, index_facts, quote
from rowforge.plans.model import Check, Column, Schema, Table, spark_type
from rowforge.sources.catalog import jdbc_table

#: the views of the standard's information schema that are read
VIEWS = ("table_constraints", "key_column_usage", "referential_constraints", "check_constraints", "columns")
#: rendered index definitions, for the dialects that hold unique indexes which are no constraints
INDEX_QUERIES = {
    "postgres": "(SELECT schemaname AS table_schema, tablename AS table_name, indexdef AS definition FROM pg_indexes WHERE indexdef LIKE 'CREATE UNIQUE%') AS d"
}
#: labels of enum types, for the dialects that do not spell them in a column's type
ENUM_QUERIES = {
    "postgres": "(SELECT n.nspname AS udt_schema, t.typname AS udt_name, e.enumlabel AS label, e.enumsortorder AS place "
    "FROM pg_enum e JOIN pg_type t ON t.oid = e.enumtypid JOIN pg_namespace n ON n.oid = t.typnamespace) AS d"
}


def jdbc_views(spark: SparkSession, url: str, dialect: str = "postgres", **options) -> dict[str, DataFrame]:
    """The catalog views of a source over JDBC."""
    views = {view: jdbc_table(spark, url, f"information_schema.{view}", **options) for view in VIEWS}
    for name, queries in (("indexes", INDEX_QUERIES), ("enums", ENUM_QUERIES)):
        if dialect in queries:
            views[name] = jdbc_table(spark, url, queries[dialect], **options)
    return views


def _read(view: DataFrame, *optional: str) -> DataFrame:
    """A view with names in lower case; columns that an engine leaves out are null."""
    lower = view.toDF(*[c.lower() for c in view.columns])
    return lower.select("*", *[F.lit(None).cast("string").alias(c) for c in optional if c not in lower.columns])


def key_facts(views: dict[str, DataFrame]) -> DataFrame:
    """(table_schema, table_name, column_name, kind, width, place, ref_schema, ref_table, ref_column) of primary, unique and foreign keys.

    ``width`` counts the columns of a key; a reference names the column that
    stands in the key it refers to where the view says, which need not be its
    own place.
    """
    by_name, own = ["constraint_schema", "constraint_name"], ["constraint_schema", "constraint_name", "table_schema", "table_name"]
    usage = _read(views["key_column_usage"], "table_schema", "position_in_unique_constraint")
    place = F.col("ordinal_position").cast("int")
    usage = usage.select(*own, "column_name", place.alias("place"), F.coalesce(F.col("position_in_unique_constraint").cast("int"), place).alias("ref_place"))
    kinds = _read(views["table_constraints"], "table_schema").select(*own, F.lower("constraint_type").alias("kind"))
    same = [usage[c].eqNullSafe(kinds[c]) for c in own]
    keys = usage.join(kinds, same).select(*[usage[c] for c in usage.columns], "kind").where(F.col("kind").isin("primary key", "unique", "foreign key"))
    keys = keys.withColumn("width", F.count("*").over(Window.partitionBy(*own, "kind")))
    refers = _read(views["referential_constraints"]).select(*by_name, F.col("unique_constraint_schema").alias("key_schema"), F.col("unique_constraint_name").alias("key_name"))
    target = usage.select(
        F.col("constraint_schema").alias("key_schema"),
        F.col("constraint_name").alias("key_name"),
        F.col("place").alias("ref_place"),
        F.col("table_schema").alias("ref_schema"),
        F.col("table_name").alias("ref_table"),
        F.col("column_name").alias("ref_column"),
    )
    found = keys.join(refers, by_name, "left").join(target, ["key_schema", "key_name", "ref_place"], "left")
    return found.select("table_schema", "table_name", "column_name", "kind", "width", "place", "ref_schema", "ref_table", "ref_column").orderBy("table_schema", "table_name", "kind", "place")


class _Names:
    """Tables of a schema by (namespace, name) of the views.

    A plain name is that of the given namespace; without one it has to stand
    in one namespace only.
    """

    def __init__(self, schema: Schema, views: dict[str, DataFrame], namespace: str | None):
        self.schema, self.namespace = schema, namespace
        found = _read(views["columns"] if "columns" in views else views["table_constraints"], "table_schema").select("table_schema", "table_name").distinct().collect()
        self.spaces: dict[str, set] = {}
        for r in found:  # the tables of one database
            self.spaces.setdefault(r.table_name, set()).add(r.table_schema)

    def table(self, space: str | None, name: str) -> Table | None:
        if own := self.schema.table(f"{space}.{name}"):
            return own
        plain = self.schema.table(name)
        if plain is None or (self.namespace is not None and space is not None and space != self.namespace):
            return None
        if self.namespace is None and len(self.spaces.get(name, ())) > 1:
            raise ValueError(f"{name} stands in several schemas ({', '.join(sorted(map(str, self.spaces[name])))}): give one of them, or tables by full name")
        return plain


def with_constraints(schema: Schema, views: dict[str, DataFrame], namespace: str | None = None) -> Schema:
    """``schema`` with the keys, checks, unique indexes, defaults and enum labels that the views tell of.

    Tables are those of ``namespace``, or go by their full names
    (``audit.users``); tables of one name in two schemas are never mixed.
    Only keys of one column make a column unique or a reference: a part of a
    wider key is neither.  A check that only says NOT NULL is left out.
    """
    names, primary = _Names(schema, views, namespace), {}
    for r in key_facts(views).collect():  # the catalog of one database
        table = names.table(r.table_schema, r.table_name)
        column = table.column(r.column_name) if table else None
        if column is None:
            continue
        if r.kind == "primary key":
            primary.setdefault(table.name, []).append(r.column_name)
            column.nullable = False
        if r.width == 1 and r.kind != "foreign key":
            column.unique = True
        if r.width == 1 and r.kind == "foreign key" and r.ref_table:
            parent = names.table(r.ref_schema, r.ref_table)
            column.references = f"{parent.name if parent else r.ref_table}.{r.ref_column}"
    for name, key in primary.items():
        schema.table(name).primary_key = key
    if "columns" in views:
        _columns(names, views)
    if "check_constraints" in views:
        _checks(names, views)
    if "indexes" in views:
        _indexes(names, views["indexes"])
    return schema


def scan(views: dict[str, DataFrame], namespace: str | None = None) -> Schema:
    """The schema of a live source from its views alone: the tables of ``namespace``, or of all, by their full names."""
    columns = _read(views["columns"], "udt_name", "column_type").where(~F.lower("table_schema").isin("information_schema", "pg_catalog"))
    if namespace is not None:
        columns = columns.where(F.col("table_schema") == namespace)
    tables: dict[str, Table] = {}
    for r in columns.orderBy("table_schema", "table_name", F.col("ordinal_position").cast("int")).collect():
        name = r.table_name if namespace is not None else f"{r.table_schema}.{r.table_name}"
        native = r.udt_name if r.data_type.upper() in ("ARRAY", "USER-DEFINED") and r.udt_name else r.data_type
        tables.setdefault(name, Table(name, [])).columns.append(Column(r.column_name, native))
    return with_constraints(Schema(list(tables.values())), views, namespace)


def _columns(names: _Names, views: dict[str, DataFrame]) -> None:
    """Nullability, defaults, identity, generated columns, widths and enum labels."""
    columns = _read(
        views["columns"], "is_identity", "is_generated", "generation_expression", "column_type", "udt_schema", "udt_name", "character_maximum_length", "numeric_precision", "numeric_scale", "extra"
    )
    labels: dict[tuple, list[str]] = {}
    if "enums" in views:
        for r in _read(views["enums"]).orderBy("udt_schema", "udt_name", F.col("place").cast("double")).collect():
            labels.setdefault((r.udt_schema, r.udt_name), []).append(r.label)
    yes = lambda value: str(value).upper() in ("YES", "ALWAYS", "TRUE")
    for r in columns.collect():
        table = names.table(r.table_schema, r.table_name)
        column = table.column(r.column_name) if table else None
        if column is None:
            continue
        extra = (r.extra or "").lower()
        column.nullable = column.nullable and str(r.is_nullable).upper() != "NO"
        column.generated |= yes(r.is_generated) or bool(r.generation_expression) or " generated" in f" {extra}".replace("default_generated", "")
        column.has_default |= (r.column_default is not None and not column.generated) or yes(r.is_identity) or "auto_increment" in extra
        if column.cls == "string" and r.character_maximum_length and not column.max_len and 0 < int(r.character_maximum_length) < 2**31 - 1:
            column.max_len = int(r.character_maximum_length)
        if column.native.lower().split("(")[0].strip() in ("numeric", "decimal") and r.numeric_precision and not column.precision:
            column.precision, column.scale = int(r.numeric_precision), int(r.numeric_scale or 0)
        own = labels.get((r.udt_schema, r.udt_name)) or _spelled(r.column_type) or _spelled(r.data_type)
        if own:
            column.enum = own


def _spelled(kind: str | None) -> list[str]:
    """The labels of a type that spells them: enum('a', 'it''s')."""
    m = re.match(r"enum\s*\((.*)\)\s*$", kind or "", re.I | re.S)
    return [x.replace("''", "'") for x in re.findall(r"'((?:[^']|'')*)'", m[1])] if m else []


def _checks(names: _Names, views: dict[str, DataFrame]) -> None:
    by_name = ["constraint_schema", "constraint_name"]
    owners = _read(views["table_constraints"], "table_schema").where(F.lower("constraint_type") == "check").select(*by_name, "table_schema", "table_name").distinct()
    found = _read(views["check_constraints"]).select(*by_name, "check_clause").distinct().join(owners, by_name).orderBy("table_schema", "table_name", "constraint_name")
    for r in found.where(~F.col("check_clause").rlike("(?i)^\\W*[\\w\"]+\\W+is\\s+not\\s+null\\W*$")).collect():
        table = names.table(r.table_schema, r.table_name)
        if table:
            words = set(_words(r.check_clause))
            named = [c.name for c in table.columns if c.name in words]
            table.checks.append(Check(r.constraint_name, r.check_clause, named))


def _words(text: str) -> list[str]:
    out, word = [], ""
    for c in text + " ":
        if c.isalnum() or c == "_":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def _indexes(names: _Names, indexes: DataFrame) -> None:
    """Unique indexes of one key; a column is always null if every index that is bound to conditions asks for it."""
    wanted: dict[str, list[list[str]]] = {}
    for r in _read(indexes, "table_schema").select("table_schema", "table_name", "definition").orderBy("table_schema", "table_name", "definition").collect():
        table = names.table(r.table_schema, r.table_name)
        name, folded, nulls = index_facts(r.definition)
        if table is None:
            continue
        if nulls or " where " in r.definition.lower():
            wanted.setdefault(table.name, []).append(nulls)
        column = table.column(name) if name else None
        if column is not None:
            column.unique_fold |= folded
            column.unique |= not folded
    for table_name, lists in wanted.items():
        for column in names.schema.table(table_name).columns:
            column.always_null |= column.nullable and all(column.name in nulls for nulls in lists)


def execute(spark: SparkSession, changes: list[Change]) -> list[str]:
    """Carry out changes in Spark's catalog, whose tables hold no constraints but NOT NULL; returns the statements."""
    done = []
    name = lambda t: quote(t, "spark")
    column = lambda c: f"{quote(c.name, 'spark')} {spark_type(c).simpleString()}"
    for change in changes:
        if change.kind == "create_table":
            body = ", ".join(column(c) + ("" if c.nullable else " NOT NULL") for c in change.columns)
            statement = f"CREATE TABLE {name(change.table)} ({body}) USING parquet"
        elif change.kind == "add_column":
            statement = f"ALTER TABLE {name(change.table)} ADD COLUMNS ({column(change.columns[0])})"
        elif change.kind == "drop_table":
            statement = f"DROP TABLE {name(change.table)}"
        else:
            raise ValueError(f"{change.table}: Spark's catalog has no {change.kind.replace('_', ' ')}")
        spark.sql(statement)
        done.append(statement)
    return done
