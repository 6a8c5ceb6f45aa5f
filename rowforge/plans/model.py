"""Schema and plan model, and its passage through StructField metadata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

CLASSES = ("string", "int", "float", "bool", "time", "uuid", "json", "bytes", "enum", "unknown")

#: fixed values: exact type spellings of each class
SPELLINGS = {
    "uuid": ["uuid", "uniqueidentifier"],
    "bool": ["bool", "boolean", "bit"],
    "int": [
        "smallint", "integer", "int", "int2", "int4", "int8", "bigint", "tinyint", "mediumint", "serial", "bigserial", "smallserial",
        "serial2", "serial4", "serial8", "year",
    ],
    "float": ["real", "double", "float", "float4", "float8", "numeric", "decimal", "money", "smallmoney", "dec", "fixed"],
    "time": ["date", "time", "timetz", "timestamp", "timestamptz", "datetime", "datetime2", "smalldatetime", "datetimeoffset"],
    "json": ["json", "jsonb"],
    "bytes": ["bytea", "blob", "binary", "varbinary", "image", "longblob", "mediumblob", "tinyblob"],
    "string": [
        "char", "varchar", "character", "text", "citext", "nchar", "nvarchar", "ntext", "longtext", "mediumtext", "tinytext", "name", "bpchar", "clob", "xml",
    ],
}
#: spellings of Spark and other engines that are known besides
FURTHER = {"int": ["long", "short", "byte"], "float": ["number", "binary_double", "float64"], "time": ["timestamp_ntz"], "json": ["variant", "super"], "bytes": ["bytes", "varbyte"], "string": ["string"]}
_BY_NAME = {name: cls for table in (SPELLINGS, FURTHER) for cls, names in table.items() for name in names}
#: fixed values: what a type name may carry after the type itself
SUFFIXES = (" unsigned", " zerofill", " without time zone", " with time zone", " precision", " varying")


def classify(native: str) -> str:
    """Class of an engine's type name.  ``interval`` and ``point`` are unknown, though they hold other names."""
    name = native.strip().lower().split("(")[0].strip().removesuffix("[]").strip()
    for suffix in SUFFIXES:
        name = name.removesuffix(suffix).strip()
    if name in _BY_NAME:
        return _BY_NAME[name]
    if name in ("interval", "point"):
        return "unknown"
    if "char" in name or "text" in name:
        return "string"
    if "int" in name:
        return "int"
    return "time" if "time" in name or "date" in name else "unknown"


def bounds(native: str) -> tuple[int, int, int]:
    """(max_len, precision, scale) spelled in a type name."""
    m = re.match(r"\s*(\w[\w ]*?)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", native.lower())
    if not m:
        return 0, 0, 0
    name, a, b = m[1], int(m[2]), int(m[3] or 0)
    if "char" in name or name in ("text", "string"):
        return a, 0, 0
    return (0, a, b) if name in ("numeric", "decimal", "dec", "number", "fixed") else (0, 0, 0)


@dataclass
class Column:
    name: str
    native: str = "text"
    nullable: bool = True
    has_default: bool = False
    generated: bool = False
    unique: bool = False
    unique_fold: bool = False
    always_null: bool = False
    max_len: int = 0
    precision: int = 0
    scale: int = 0
    enum: list[str] = field(default_factory=list)
    references: str = ""

    def __post_init__(self):
        if not (self.max_len or self.precision):
            self.max_len, self.precision, self.scale = bounds(self.native)

    @property
    def cls(self) -> str:
        return "enum" if self.enum else classify(self.native)


@dataclass
class Check:
    name: str
    expression: str
    columns: list[str]

    def enforceable(self) -> bool:
        return len(self.columns) == 1


@dataclass
class Table:
    name: str
    columns: list[Column]
    primary_key: list[str] = field(default_factory=list)
    checks: list[Check] = field(default_factory=list)
    existing_rows: int = 0
    #: unique keys of several columns, besides the primary one
    uniques: list[list[str]] = field(default_factory=list)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass
class Schema:
    tables: list[Table]

    def table(self, name: str) -> Table | None:
        return next((t for t in self.tables if t.name == name), None)


def split_ref(ref: str) -> tuple[str, str] | None:
    """(table, column) by the last dot; tables may carry a namespace."""
    table, dot, column = ref.rpartition(".")
    return (table, column) if dot and table and column else None


def spark_type(column: Column) -> T.DataType:
    """The Spark type that a column is generated in."""
    name = column.native.lower()
    cls = column.cls
    if cls == "int":
        if "unsigned" in name and "big" in name:
            return T.DecimalType(20, 0)
        if name.startswith(("big", "int8", "long", "serial8")) or "serial" in name:
            return T.LongType()
        return T.ShortType() if name.startswith(("small", "tiny", "int2", "short")) else T.IntegerType()
    if cls == "float":
        if column.precision:
            return T.DecimalType(min(38, column.precision), column.scale)
        return T.FloatType() if name in ("real", "float4") else T.DoubleType()
    if cls == "time":
        return T.DateType() if name == "date" else T.TimestampType()
    return {"bool": T.BooleanType(), "bytes": T.BinaryType()}.get(cls, T.StringType())


def to_struct(table: Table) -> T.StructType:
    """A StructType whose field metadata carries all that the type does not."""
    facts = lambda c: {k: v for k, v in vars(c).items() if k not in ("name", "nullable") and v not in (False, 0, "", [])}
    return T.StructType([T.StructField(c.name, spark_type(c), c.nullable, facts(c) | ({"primary_key": True} if c.name in table.primary_key else {})) for c in table.columns])


def from_struct(name: str, struct: T.StructType) -> Table:
    """The inverse of :func:`to_struct`; fields without metadata speak by their type. Nested structs become dotted columns."""
    columns: list[Column] = []
    key: list[str] = []

    def walk(fields, prefix: str) -> None:
        for f in fields:
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType.fields, f"{prefix}{f.name}.")
                continue
            facts: dict[str, Any] = dict(f.metadata or {})
            if facts.pop("primary_key", False):
                key.append(prefix + f.name)
            native = facts.pop("native", None) or f.dataType.simpleString()
            known = {k: v for k, v in facts.items() if k in Column.__dataclass_fields__}
            columns.append(Column(prefix + f.name, native, f.nullable, **known))

    walk(struct.fields, "")
    return Table(name, columns, key)
