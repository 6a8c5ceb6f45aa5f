"""DDL text: parse, render, validate, replay migrations, draw ER diagrams."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace

from rowforge.plans.model import Check, Column, Schema, Table

CHANGE_KINDS = ("create_table", "drop_table", "add_column", "drop_column", "add_foreign_key", "add_unique")
IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")
#: what each dialect writes for a class of types (this library's own choice); {0}: a length, {1} and {2}: precision and scale
TYPE_MENUS = {
    "postgres": {
        "int": "bigint", "string": "text", "bounded": "varchar({0})", "bool": "boolean", "decimal": "numeric({1},{2})", "float": "double precision",
        "time": "timestamptz", "date": "date", "uuid": "uuid", "json": "jsonb", "bytes": "bytea",
    },
    "redshift": {
        "int": "bigint", "string": "varchar(65535)", "bounded": "varchar({0})", "bool": "boolean", "decimal": "numeric({1},{2})", "float": "double precision",
        "time": "timestamptz", "date": "date", "uuid": "varchar(36)", "json": "super", "bytes": "varbyte",
    },
    "mysql": {
        "int": "bigint", "string": "text", "bounded": "varchar({0})", "bool": "tinyint(1)", "decimal": "decimal({1},{2})", "float": "double",
        "time": "datetime", "date": "date", "uuid": "char(36)", "json": "json", "bytes": "blob",
    },
    "sqlite": {
        "int": "INTEGER", "string": "TEXT", "bounded": "VARCHAR({0})", "bool": "BOOLEAN", "decimal": "NUMERIC({1},{2})", "float": "REAL",
        "time": "TIMESTAMP", "date": "DATE", "uuid": "TEXT", "json": "TEXT", "bytes": "BLOB",
    },
    "sqlserver": {
        "int": "bigint", "string": "nvarchar(max)", "bounded": "nvarchar({0})", "bool": "bit", "decimal": "decimal({1},{2})", "float": "float",
        "time": "datetime2", "date": "date", "uuid": "uniqueidentifier", "json": "nvarchar(max)", "bytes": "varbinary(max)",
    },
    "oracle": {
        "int": "number(19)", "string": "clob", "bounded": "varchar2({0})", "bool": "number(1)", "decimal": "number({1},{2})", "float": "binary_double",
        "time": "timestamp", "date": "date", "uuid": "varchar2(36)", "json": "clob", "bytes": "blob",
    },
    "hana": {
        "int": "bigint", "string": "nclob", "bounded": "nvarchar({0})", "bool": "boolean", "decimal": "decimal({1},{2})", "float": "double",
        "time": "timestamp", "date": "date", "uuid": "varchar(36)", "json": "nclob", "bytes": "blob",
    },
    "vertica": {
        "int": "int", "string": "long varchar", "bounded": "varchar({0})", "bool": "boolean", "decimal": "numeric({1},{2})", "float": "float",
        "time": "timestamptz", "date": "date", "uuid": "uuid", "json": "long varchar", "bytes": "varbinary",
    },
    "firebird": {
        "int": "bigint", "string": "blob sub_type text", "bounded": "varchar({0})", "bool": "boolean", "decimal": "decimal({1},{2})", "float": "double precision",
        "time": "timestamp", "date": "date", "uuid": "char(36)", "json": "blob sub_type text", "bytes": "blob",
    },
    "clickhouse": {
        "int": "Int64", "string": "String", "bounded": "String", "bool": "Bool", "decimal": "Decimal({1},{2})", "float": "Float64",
        "time": "DateTime", "date": "Date", "uuid": "UUID", "json": "String", "bytes": "String",
    },
    "trino": {
        "int": "bigint", "string": "varchar", "bounded": "varchar({0})", "bool": "boolean", "decimal": "decimal({1},{2})", "float": "double",
        "time": "timestamp", "date": "date", "uuid": "uuid", "json": "json", "bytes": "varbinary",
    },
    "databricks": {
        "int": "BIGINT", "string": "STRING", "bounded": "STRING", "bool": "BOOLEAN", "decimal": "DECIMAL({1},{2})", "float": "DOUBLE",
        "time": "TIMESTAMP", "date": "DATE", "uuid": "STRING", "json": "STRING", "bytes": "BINARY",
    },
    "snowflake": {
        "int": "number(38,0)", "string": "varchar", "bounded": "varchar({0})", "bool": "boolean", "decimal": "number({1},{2})", "float": "float",
        "time": "timestamp_tz", "date": "date", "uuid": "varchar(36)", "json": "variant", "bytes": "binary",
    },
    "bigquery": {
        "int": "INT64", "string": "STRING", "bounded": "STRING({0})", "bool": "BOOL", "decimal": "NUMERIC({1},{2})", "float": "FLOAT64",
        "time": "TIMESTAMP", "date": "DATE", "uuid": "STRING", "json": "JSON", "bytes": "BYTES",
    },
    "spark": {
        "int": "BIGINT", "string": "STRING", "bounded": "STRING", "bool": "BOOLEAN", "decimal": "DECIMAL({1},{2})", "float": "DOUBLE",
        "time": "TIMESTAMP", "date": "DATE", "uuid": "STRING", "json": "STRING", "bytes": "BINARY",
    },
}


def menu(dialect: str) -> dict[str, str]:
    """The type of each class in a dialect, with places for a length, a precision and a scale."""
    return dict(TYPE_MENUS[dialect])


def native_for(column: Column, dialect: str) -> str:
    """A column's type as another dialect writes it; a type of no known class stays as it is."""
    types, cls = menu(dialect), column.cls
    if cls == "string" and column.max_len:
        cls = "bounded"
    elif cls == "float" and column.precision:
        cls = "decimal"
    elif cls == "time" and column.native.lower() == "date":
        cls = "date"
    kind = types.get("string" if cls == "enum" else cls)
    return column.native if kind is None else kind.format(column.max_len, column.precision, column.scale)


def translated(table: Table, dialect: str) -> Table:
    """The table with its types as ``dialect`` writes them."""
    return replace(table, columns=[replace(c, native=native_for(c, dialect)) for c in table.columns])


@dataclass
class Change:
    kind: str
    table: str
    columns: list[Column] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    references: str = ""
    checks: list[Check] = field(default_factory=list)


class DDLError(ValueError):
    pass


def quote(name: str, dialect: str = "postgres") -> str:
    left, right = {"mysql": "``", "spark": "``", "databricks": "``", "bigquery": "``", "clickhouse": "``", "sqlserver": "[]"}.get(dialect, '""')
    return ".".join(left + part.replace(right, right * 2) + right for part in name.split("."))


def strip_comments(text: str) -> str:
    """Without -- and /* */ comments; quoted text stays."""
    token = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
    return token.sub(lambda m: " " if m[0][:2] in ("--", "/*") else m[0], text)


def split_top(text: str, by: str) -> list[str]:
    """Split at a character outside brackets and quotes."""
    parts, depth, at, quote_char = [], 0, 0, ""
    for k, c in enumerate(text):
        if quote_char:
            quote_char = "" if c == quote_char else quote_char
        elif c in "'\"`":
            quote_char = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == by and depth == 0:
            parts.append(text[at:k])
            at = k + 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


_NAME = r"((?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\])(?:\.(?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\]))*)"
_CREATE = re.compile(rf"create\s+(?:temp(?:orary)?\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?{_NAME}\s*\((.*)\)[^)]*$", re.I | re.S)
_STOP = re.compile(r"\b(not\s+null|null|primary\s+key|unique|default|references|check|constraint|generated|auto_increment|autoincrement|identity|collate|comment|on\s+delete|on\s+update)\b", re.I)


def _bare(name: str) -> str:
    return ".".join(re.sub(r'^["`\[]|["`\]]$', "", p) for p in name.strip().split("."))


def _names(text: str) -> list[str]:
    return [_bare(re.split(r"\s", p)[0]) for p in split_top(text, ",")]


def _check_columns(expression: str, columns: list[Column]) -> list[str]:
    plain = re.sub(r"'(?:[^']|'')*'", "", expression)
    return [c.name for c in columns if re.search(rf"\b{re.escape(c.name)}\b", plain)]


def parse_table(statement: str) -> Table | None:
    """The table of a CREATE TABLE statement; None for any other statement."""
    m = _CREATE.match(statement.strip())
    if not m:
        return None
    table, checks = Table(_bare(m[1]), []), []
    for item in split_top(m[2], ","):
        head = re.sub(rf"^constraint\s+{_NAME}\s+", "", item, flags=re.I)
        if k := re.match(r"primary\s+key\s*\((.*?)\)", head, re.I | re.S):
            table.primary_key = _names(k[1])
        elif k := re.match(r"unique(?:\s+key|\s+index)?\s*[\w`\"]*\s*\((.*?)\)", head, re.I | re.S):
            names = _names(k[1])
            if len(names) == 1 and table.column(names[0]):
                table.column(names[0]).unique = True
        elif k := re.match(rf"foreign\s+key\s*\((.*?)\)\s*references\s+{_NAME}\s*(?:\((.*?)\))?", head, re.I | re.S):
            targets = _names(k[3]) if k[3] else ["id"]
            for n, name in enumerate(_names(k[1])):
                if table.column(name):
                    table.column(name).references = f"{_bare(k[2])}.{targets[min(n, len(targets) - 1)]}"
        elif k := re.match(r"check\s*\((.*)\)", head, re.I | re.S):
            checks.append(k[1])
        elif re.match(r"(key|index|exclude|like|partition)\b", head, re.I):
            continue
        else:
            _parse_column(item, table, checks)
    for name in table.primary_key:
        if table.column(name):
            table.column(name).nullable = False
    table.checks = [Check(f"{table.name}_check{k + 1}", e.strip(), _check_columns(e, table.columns)) for k, e in enumerate(checks)]
    return table


def _parse_column(item: str, table: Table, checks: list[str]) -> None:
    m = re.match(rf"{_NAME}\s*(.*)$", item, re.S)
    if not m:
        raise DDLError(f"cannot read {item!r}")
    name, rest = _bare(m[1]), m[2].strip()
    stop = _STOP.search(rest)
    native = re.sub(r"\s+", " ", rest[: stop.start()] if stop else rest).strip()
    tail = rest[stop.start() :] if stop else ""
    low = tail.lower()
    enum = re.match(r"enum\s*\((.*)\)$", native, re.I | re.S)
    column = Column(name, "text" if enum or not native else native, nullable=not re.search(r"not\s+null", low))
    if enum:
        column.enum = [v[1:-1].replace("''", "'") for v in split_top(enum[1], ",")]
    if re.search(r"\bprimary\s+key\b", low):
        table.primary_key, column.nullable = [name], False
        column.has_default = column.native.lower() in ("integer", "int")  # such a key fills itself in SQLite
    column.unique = bool(re.search(r"\bunique\b", low))
    generated = re.search(r"\bgenerated\s+(always|by\s+default)\s+as\s+(identity|\()", low)
    column.generated = bool(generated and generated[2] == "(")
    column.has_default |= bool(re.search(r"\bdefault\b|auto_?increment|\bidentity\b", low)) or "serial" in native.lower()
    if r := re.search(rf"\breferences\s+{_NAME}\s*(?:\(\s*{_NAME}\s*\))?", tail, re.I):
        column.references = f"{_bare(r[1])}.{_bare(r[2]) if r[2] else 'id'}"
    at = re.search(r"\bcheck\s*\(", tail, re.I)
    if at:
        depth, k = 1, at.end()
        while depth and k < len(tail):
            depth += (tail[k] == "(") - (tail[k] == ")")
            k += 1
        checks.append(tail[at.end() : k - 1])
    table.columns.append(column)


def parse(text: str) -> list[Change]:
    """CREATE TABLE statements as changes; other statements are left aside, none at all is an error."""
    tables = [t for t in (parse_table(s) for s in split_top(strip_comments(text), ";")) if t]
    if not tables:
        raise DDLError("no CREATE TABLE statement")
    return [Change("create_table", t.name, t.columns, t.primary_key, checks=t.checks) for t in tables]


def parse_schema(text: str) -> Schema:
    return Schema([Table(c.table, c.columns, c.primary_key, c.checks) for c in parse(text)])


def _column_sql(c: Column, key: list[str], dialect: str, inline_reference: bool = True) -> str:
    kind = c.native
    if c.enum and dialect == "mysql":
        kind = "enum(" + ",".join("'" + v.replace("'", "''") + "'" for v in c.enum) + ")"
    parts = [quote(c.name, dialect), kind]
    if key == [c.name]:
        parts.append("PRIMARY KEY")
    elif not c.nullable:
        parts.append("NOT NULL")
    if c.unique and key != [c.name]:
        parts.append("UNIQUE")
    if c.references and inline_reference and dialect != "spark":
        table, _, column = c.references.rpartition(".")
        parts.append(f"REFERENCES {quote(table, dialect)} ({quote(column, dialect)})")
    return " ".join(parts)


def create_sql(table: Table, dialect: str = "postgres") -> str:
    lines = [_column_sql(c, table.primary_key, dialect) for c in table.columns]
    if len(table.primary_key) > 1:
        lines.append(f"PRIMARY KEY ({', '.join(quote(k, dialect) for k in table.primary_key)})")
    lines += [f"CHECK ({c.expression})" for c in table.checks if dialect != "spark"]
    return f"CREATE TABLE {quote(table.name, dialect)} (\n  " + ",\n  ".join(lines) + "\n);"


def _parents_first(tables: list[Table]) -> list[Table]:
    left, out = {t.name: t for t in tables}, []
    while left:
        ready = sorted(n for n, t in left.items() if not {c.references.rpartition(".")[0] for c in t.columns if c.references} & (set(left) - {n}))
        if not ready:
            raise DDLError("tables refer to each other: " + ", ".join(sorted(left)))
        out.append(left.pop(ready[0]))
    return out


def render(changes: list[Change], dialect: str = "postgres") -> list[str]:
    """Statements: creations (parents first), additions, dropped columns, dropped tables."""
    made = [Table(c.table, c.columns, c.primary_key, c.checks) for c in changes if c.kind == "create_table"]
    out = [create_sql(t, dialect) for t in _parents_first(made)]
    t = lambda c: quote(c.table, dialect)
    out += [f"ALTER TABLE {t(c)} ADD COLUMN {_column_sql(c.columns[0], [], dialect)};" for c in changes if c.kind == "add_column"]
    for c in changes:
        if c.kind == "add_foreign_key":
            table, _, column = c.references.rpartition(".")
            out.append(f"ALTER TABLE {t(c)} ADD FOREIGN KEY ({quote(c.columns[0].name, dialect)}) REFERENCES {quote(table, dialect)} ({quote(column, dialect)});")
        elif c.kind == "add_unique":
            out.append(f"ALTER TABLE {t(c)} ADD UNIQUE ({', '.join(quote(x.name, dialect) for x in c.columns)});")
    out += [f"ALTER TABLE {t(c)} DROP COLUMN {quote(c.columns[0].name, dialect)};" for c in changes if c.kind == "drop_column"]
    return out + [f"DROP TABLE {t(c)};" for c in changes if c.kind == "drop_table"]


def validate_changes(changes: list[Change], schema: Schema, dialect: str = "postgres") -> list[str]:
    """Every problem of a list of changes against what exists."""
    problems, new = [], {c.table for c in changes if c.kind == "create_table"}
    exists = {t.name for t in schema.tables} | new
    for c in changes:
        table = schema.table(c.table)
        if c.kind not in CHANGE_KINDS:
            problems.append(f"{c.table}: unknown change {c.kind}")
            continue
        if c.kind == "create_table":
            if table:
                problems.append(f"{c.table}: exists already")
            if not c.columns:
                problems.append(f"{c.table}: no columns")
            if not c.primary_key:
                problems.append(f"{c.table}: no primary key")
            names = [x.name.lower() for x in c.columns]
            problems += [f"{c.table}.{n}: given twice" for n in sorted({n for n in names if names.count(n) > 1})]
            problems += [f"{c.table}: key column {k} does not exist" for k in c.primary_key if k.lower() not in names]
        elif table is None and c.table not in new:
            problems.append(f"{c.table}: no such table")
            continue
        for name in [c.table.rpartition(".")[2], *(x.name for x in c.columns)]:
            if not IDENT.fullmatch(name):
                problems.append(f"{c.table}: {name!r} is not a usable name")
        if c.kind == "add_column" and table:
            column = c.columns[0]
            if table.column(column.name):
                problems.append(f"{c.table}.{column.name}: exists already")
            if not column.nullable and not column.has_default and table.existing_rows:
                problems.append(f"{c.table}.{column.name}: required, without a default, on a table with rows")
        if c.kind == "drop_column" and table and not table.column(c.columns[0].name):
            problems.append(f"{c.table}.{c.columns[0].name}: no such column")
        if c.kind in ("add_foreign_key", "add_unique") and dialect == "sqlite":
            problems.append(f"{c.table}: SQLite cannot {c.kind.replace('_', ' ')} later")
        for ref in [c.references, *(x.references for x in c.columns)]:
            if ref and ref.rpartition(".")[0] not in exists:
                problems.append(f"{c.table}: {ref} does not exist")
    try:
        _parents_first([Table(c.table, c.columns) for c in changes if c.kind == "create_table"])
    except DDLError as error:
        problems.append(str(error))
    return problems


def script(schema: Schema, dialect: str = "postgres") -> str:
    return "\n\n".join(create_sql(t, dialect) for t in _parents_first(schema.tables)) + "\n"


def mermaid(schema: Schema) -> str:
    """An ER diagram: one-to-one where the reference is unique or the sole key, optional where it may be null."""
    lines = ["erDiagram"]
    for t in schema.tables:
        lines.append(f"  {t.name.replace('.', '_')} {{")
        for c in t.columns:
            marks = [m for m, on in (("PK", c.name in t.primary_key), ("FK", bool(c.references)), ("UK", c.unique)) if on]
            lines.append(f"    {re.sub(r'[^A-Za-z0-9_]', '_', c.native)} {c.name}" + (f" {', '.join(marks)}" if marks else ""))
        lines.append("  }")
    for t in schema.tables:
        for c in t.columns:
            if c.references:
                parent = c.references.rpartition(".")[0].replace(".", "_")
                one = c.unique or t.primary_key == [c.name]
                lines.append(f"  {parent} {'|o' if c.nullable else '||'}--{'o|' if one else 'o{'} {t.name.replace('.', '_')} : {c.name}")
    return "\n".join(lines) + "\n"


#: fixed values: what marks files and folders of reverse migrations, and the lines from which a file reverses
DOWN_FILES, DOWN_FOLDERS = (".down.", "_down.", ".rollback.", ".undo."), ("down", "rollback", "revert")
DOWN_LINE = re.compile(r"^\s*--\s*(\+goose\s+down|migrate:down|\+migrate\s+down|@undo|down\b)", re.I | re.M)


def replay(folder: str) -> Schema:
    """The schema after all migrations of a folder, statement by statement, in the order of the names."""
    files = []
    for place, folders, names in os.walk(folder):
        folders[:] = sorted(d for d in folders if d.lower() not in DOWN_FOLDERS)
        files += [os.path.join(place, n) for n in names if n.lower().endswith(".sql") and not any(m in n.lower() for m in DOWN_FILES)]
    texts = []
    for path in sorted(files):
        with open(path, encoding="utf-8") as file:
            texts.append(file.read())
    return replay_texts(texts)


def replay_texts(texts: list[str]) -> Schema:
    tables: dict[str, Table] = {}
    for text in texts:
        cut = DOWN_LINE.search(text)
        for s in split_top(strip_comments(text[: cut.start()] if cut else text), ";"):
            if made := parse_table(s):
                tables.setdefault(made.name, made)
            elif m := re.match(rf"drop\s+table\s+(?:if\s+exists\s+)?{_NAME}", s, re.I):
                tables.pop(_bare(m[1]), None)
            elif m := re.match(rf"alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{_NAME}\s+(.*)$", s, re.I | re.S):
                table = tables.get(_bare(m[1]))
                for action in split_top(m[2], ",") if table else []:
                    if a := re.match(rf"drop\s+column\s+(?:if\s+exists\s+)?{_NAME}", action, re.I):
                        table.columns = [c for c in table.columns if c.name != _bare(a[1])]
                    elif a := re.match(r"add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?(?!constraint\b|primary\b|foreign\b|unique\b|check\b)(.*)$", action, re.I | re.S):
                        _parse_column(a[1], table, [])
    return Schema(list(tables.values()))


def missing(scanned: Schema, live: Schema) -> tuple[list[str], list[str]]:
    """(tables that migrations make and the database lacks, tables in both)."""
    have = {t.name for t in live.tables}
    return [t.name for t in scanned.tables if t.name not in have], [t.name for t in scanned.tables if t.name in have]


def index_facts(definition: str) -> tuple[str, bool, list[str]]:
    """(column, folded, columns that must be null) of a rendered single-key unique index; column '' if it is none.

    A column must be null if a top-level AND of the predicate says so; OR
    decides nothing, and IS NOT NULL anywhere speaks against it.
    """
    head = re.search(r"\bunique\s+index\b[^(]*\(", definition, re.I)
    if not head:
        return "", False, []
    depth, end = 1, head.end()
    while depth and end < len(definition):
        depth += (definition[end] == "(") - (definition[end] == ")")
        end += 1
    keys, tail = split_top(definition[head.end() : end - 1], ","), definition[end:]
    if len(keys) != 1:
        return "", False, []
    key = re.sub(r"::[\w ]+", "", keys[0]).strip()
    folded = re.fullmatch(r"lower\(\(?\"?(\w+)\"?\)?\)", key, re.I)
    column = folded[1] if folded else (key.strip('"') if re.fullmatch(r'"?\w+"?', key) else "")
    where = re.search(r"\bwhere\s+(.*)$", tail, re.I | re.S)
    predicate = where[1].strip() if where else ""
    terms = [] if re.search(r"\bor\b", predicate, re.I) else re.split(r"\band\b", predicate, flags=re.I)
    nulls = [k[1] for k in (re.fullmatch(r"\W*\"?(\w+)\"?\)?\s+is\s+null\W*", t.strip(), re.I) for t in terms) if k]
    return column, bool(folded), [n for n in nulls if not re.search(rf"\b{n}\"?\)?\s+is\s+not\s+null", predicate, re.I)]
