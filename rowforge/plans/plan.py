"""The editable plan: inference, merge, validation, order, files."""

from __future__ import annotations

import json
import os
import re
import tempfile
from dataclasses import dataclass, field, fields
from typing import Any

from rowforge.functions.kinds import KINDS, STRUCTURE
from rowforge.functions.pattern import PatternError, check_pattern
from rowforge.plans.model import Column, Schema, Table, split_ref

VERSION, DEFAULT_ROWS, NULL_RATE = 1, 1000, 0.05

#: fixed values: column names that say nothing about what they hold
AMBIGUOUS = (
    "name", "title", "label", "type", "kind", "code", "value", "key", "description", "comment", "note", "notes", "data", "content",
    "text", "reference", "source", "target", "tag", "tags",
)
#: fixed values: tables whose plain `name` is a person's
PEOPLE_TABLES = (
    "user", "users", "person", "people", "persons", "customer", "customers", "client", "clients", "member", "members", "employee",
    "employees", "staff", "author", "authors", "contact", "contacts", "account", "accounts", "profile", "profiles", "student",
    "students", "teacher", "teachers", "doctor", "doctors", "patient", "patients", "guest", "guests", "subscriber", "subscribers",
)

#: column names (without separators) that name a kind, beside the kinds' own names
_SYNONYMS = {
    "fname": "firstname", "lname": "lastname", "surname": "lastname", "fullname": "name", "mail": "email", "emailaddress": "email", "mobile": "phone",
    "phonenumber": "phone", "telephone": "phone", "zip": "postcode", "zipcode": "postcode", "postalcode": "postcode", "state": "region",
    "province": "region", "address": "street", "addressline1": "street", "line1": "street", "lat": "latitude", "lng": "longitude", "lon": "longitude",
    "price": "amount", "total": "amount", "balance": "amount", "cost": "amount", "unitprice": "amount", "colour": "color", "website": "url",
    "ip": "ipv4", "ipaddress": "ipv4", "createdat": "time", "updatedat": "time", "deletedat": "time", "timestamp": "time", "birthdate": "time",
    "bio": "paragraph", "body": "paragraph", "summary": "paragraph", "description": "sentence", "comment": "sentence", "notes": "sentence",
    "note": "sentence", "subject": "title", "login": "username", "companyname": "company", "avatarurl": "imageurl", "useragentstring": "useragent",
}
#: what each kind can be written into; text kinds are not listed
_NUMBER_KINDS = {"amount": "float", "latitude": "float", "longitude": "float", "float": "float", "int": "int", "unixtime": "int", "year": "int", "httpstatus": "int"}


@dataclass
class ColumnPlan:
    generator: str = ""
    skip: bool = False
    confidence: str = ""
    why: str = ""
    unique: bool = False
    locale: str = ""
    min: Any = None
    max: Any = None
    values: list | None = None
    weights: list | None = None
    true_weight: float | None = None
    null_rate: float = 0.0
    references: str = ""
    pattern: str = ""
    start: int | None = None
    const: Any = None
    unenforced: list[str] = field(default_factory=list)


@dataclass
class TablePlan:
    columns: dict[str, ColumnPlan] = field(default_factory=dict)
    rows: int | None = None  # absent differs from 0
    truncate: bool = False
    skip: bool = False


@dataclass
class Plan:
    tables: dict[str, TablePlan] = field(default_factory=dict)
    seed: int = 0
    locale: str = "en_US"
    version: int = VERSION


_ADVISORY = ("confidence", "why", "unenforced")


def plain_name(name: str) -> str:
    return re.sub(r"[_\- ]", "", name.lower())


def regex_check(expression: str, column: str) -> str | None:
    """The pattern of a check ``column ~ 'pattern'``, as catalogs print it."""
    text = expression.strip()
    while text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    m = re.fullmatch(r"(.+?) ~\*? (.+)", text, re.S)
    if not m:
        return None
    operand = re.sub(r"::[\w ]+$", "", m[1].strip()).strip()
    while operand.startswith("(") and operand.endswith(")"):
        operand = operand[1:-1].strip()
    literal = re.sub(r"::[\w ]+$", "", m[2].strip()).strip()
    if operand.strip('"') != column or len(literal) < 3 or literal[0] != "'" or literal[-1] != "'":
        return None
    pattern = literal[1:-1].replace("''", "'")
    try:
        check_pattern(pattern)
    except PatternError:
        return None
    return pattern


def _kind_by_name(column: Column) -> str | None:
    name = plain_name(column.name)
    kind = name if name in KINDS else _SYNONYMS.get(name)
    if kind is None or kind in ("int", "float", "bool", "uuid", "enum", "word"):
        return None
    produced = "time" if kind == "time" else _NUMBER_KINDS.get(kind, "string")
    fits = {"int": produced == "int", "float": produced in ("int", "float"), "bool": False, "time": produced == "time", "string": produced != "time"}
    return kind if fits.get(column.cls, False) else None


def _by_type(column: Column) -> ColumnPlan:
    cls = column.cls
    if cls == "bool":
        return ColumnPlan("bool", true_weight=0.5, confidence="medium", why="by type")
    if cls in ("uuid", "time", "int", "float"):
        return ColumnPlan(cls, confidence="medium", why="by type")
    if cls == "json":
        return ColumnPlan("const", const="{}", confidence="low", why="json without a known shape")
    if cls == "string":
        return ColumnPlan("word" if 0 < column.max_len <= 40 else "sentence", confidence="low", why="text without a telling name")
    return ColumnPlan("default", skip=True, confidence="low", why=f"no generator for {column.native}")


def infer_column(table: Table, column: Column) -> ColumnPlan:
    """Structure first, then the name, then the type; checks and nullability last."""
    if column.always_null:
        return ColumnPlan("null", confidence="high", why="every unique index asks for it to be null")
    if column.generated:
        return ColumnPlan("default", skip=True, confidence="high", why="computed by the database")
    if column.references:
        return ColumnPlan("foreign_key", references=column.references, unique=column.unique, confidence="high", why="foreign key")
    if column.enum:
        return ColumnPlan("enum", values=list(column.enum), confidence="high", why="enum type")
    if column.has_default and column.name in table.primary_key and column.cls == "int":
        return ColumnPlan("default", skip=True, confidence="high", why="key that fills itself")
    kind = _kind_by_name(column)
    if kind is None:
        plan = _by_type(column)
    else:
        plan = ColumnPlan(kind, confidence="high", why="by name")
        if kind in ("name", "firstname", "lastname") and plain_name(table.name) not in PEOPLE_TABLES:
            plan = ColumnPlan("word", confidence="low", why=f"{table.name} may not hold people")
        elif plain_name(column.name) in AMBIGUOUS and not (kind == "name" and plain_name(table.name) in PEOPLE_TABLES):
            plan.confidence, plan.why = "low", "the name does not say what it holds"
    if column.cls == "string" and column.max_len:
        plan.max = column.max_len
    if column.cls == "float" and 0 < column.precision - column.scale <= 15:
        plan.min, plan.max = 0, 10 ** (column.precision - column.scale) - 1
    if plan.generator not in ("default", "null"):
        for check in (c for c in table.checks if column.name in c.columns):
            pattern = regex_check(check.expression, column.name) if check.enforceable() else None
            if pattern:
                plan.generator, plan.pattern, plan.confidence, plan.min, plan.max = "pattern", pattern, "high", None, None
            else:
                plan.unenforced.append(check.expression)
                plan.confidence = "low"
    plan.unique = column.unique or column.unique_fold
    if plan.skip and not column.nullable and not column.has_default:
        plan.skip = False
        if plan.generator == "default":
            plan.generator = "const" if column.cls == "json" else "word"
    if column.nullable and not plan.null_rate and plan.generator != "default":
        plan.null_rate = NULL_RATE
    return plan


def infer(schema: Schema) -> Plan:
    return Plan({t.name: TablePlan({c.name: infer_column(t, c) for c in t.columns}, DEFAULT_ROWS) for t in schema.tables})


def merge(old: Plan, fresh: Plan) -> Plan:
    """The fresh plan with all that a person chose: their columns become manual, gone tables and columns go."""
    out = Plan({}, old.seed or fresh.seed, old.locale or fresh.locale, fresh.version)
    for name, table in fresh.tables.items():
        was = old.tables.get(name)
        if was is None:
            out.tables[name] = table
            continue
        rows = was.rows if was.rows is not None else table.rows
        columns = {}
        for column, plan in table.columns.items():
            kept = was.columns.get(column)
            if kept is not None and (kept.generator or kept.skip):
                kept.confidence = "manual"
                kept.unenforced = plan.unenforced if kept.generator != "pattern" else []
                plan = kept
            columns[column] = plan
        out.tables[name] = TablePlan(columns, rows, was.truncate, was.skip)
    return out


def restore_order(before: list[str], now: list[str]) -> list[str]:
    """The order a person left, without what is gone, with what is new at the end."""
    return [c for c in before if c in now] + [c for c in now if c not in before]


def validate(plan: Plan, schema: Schema) -> list[str]:
    """Every problem, not only the first."""
    problems = []
    for name, tp in plan.tables.items():
        table = schema.table(name)
        if table is None:
            problems.append(f"{name}: no such table")
            continue
        if tp.rows is not None and tp.rows < 0:
            problems.append(f"{name}: rows is negative")
        for column_name, cp in tp.columns.items():
            at, column = f"{name}.{column_name}", table.column(column_name)
            if column is None:
                problems.append(f"{at}: no such column")
                continue
            required = not column.nullable
            if cp.skip:
                if required and not column.has_default and not column.generated:
                    problems.append(f"{at}: required and without a default, cannot be skipped")
                continue
            if not cp.generator:
                problems.append(f"{at}: no generator")
            elif cp.generator not in KINDS and cp.generator not in STRUCTURE:
                problems.append(f"{at}: unknown generator {cp.generator}")
            if not 0 <= cp.null_rate <= 1:
                problems.append(f"{at}: null_rate outside 0 to 1")
            elif cp.null_rate and required:
                problems.append(f"{at}: null_rate on a required column")
            if cp.true_weight is not None and not 0 <= cp.true_weight <= 1:
                problems.append(f"{at}: true_weight outside 0 to 1")
            if cp.weights and len(cp.weights) != len(cp.values or []):
                problems.append(f"{at}: {len(cp.weights)} weights for {len(cp.values or [])} values")
            if cp.generator == "enum" and not cp.values:
                problems.append(f"{at}: enum without values")
            if cp.generator == "foreign_key":
                target = split_ref(cp.references)
                parent = schema.table(target[0]) if target else None
                if target is None:
                    problems.append(f"{at}: reference {cp.references!r} is not table.column")
                elif parent is None or parent.column(target[1]) is None:
                    problems.append(f"{at}: reference {cp.references} does not exist")
            if cp.generator == "const" and cp.const is None and required:
                problems.append(f"{at}: const null on a required column")
            if cp.generator == "null" and required:
                problems.append(f"{at}: null on a required column")
            if cp.generator == "pattern":
                try:
                    check_pattern(cp.pattern)
                    if not cp.pattern:
                        problems.append(f"{at}: empty pattern")
                except PatternError as error:
                    problems.append(f"{at}: {error}")
            if cp.generator == "default" and required and not column.has_default and not column.generated:
                problems.append(f"{at}: required and without a default")
            if cp.unique and (column.cls == "bool" and (tp.rows or 0) > 2):
                problems.append(f"{at}: {tp.rows} unique values of a boolean")
        for column in table.columns:
            if column.name not in tp.columns and not column.nullable and not column.has_default and not column.generated and not tp.skip:
                problems.append(f"{name}.{column.name}: required and without a default or generator")
    return problems


def unenforced(plan: Plan, schema: Schema) -> list[tuple[str, str]]:
    """(table, expression) of the checks that generation does not promise, over written columns only."""
    out = []
    for table in schema.tables:
        tp = plan.tables.get(table.name)
        for check in table.checks if tp and not tp.skip else []:
            plans = [tp.columns.get(c) for c in check.columns]
            written = [p for p in plans if p and not p.skip and p.generator != "default"]
            own = check.enforceable() and plans[0] and plans[0].generator == "pattern" and regex_check(check.expression, check.columns[0]) == plans[0].pattern
            if written and not own:
                out.append((table.name, check.expression))
    return out


class CycleError(ValueError):
    pass


def table_order(plan: Plan, schema: Schema) -> list[str]:
    """Parents first, ties by name; tables without rows or skipped are left out; self-references do not count."""
    chosen = {n for n, tp in plan.tables.items() if not tp.skip and (tp.rows if tp.rows is not None else DEFAULT_ROWS) > 0 and schema.table(n)}
    needs = {}
    for name in chosen:
        refs = {split_ref(c.references) for c in plan.tables[name].columns.values() if c.generator == "foreign_key" and not c.skip}
        needs[name] = {r[0] for r in refs if r and r[0] != name and r[0] in chosen}
    out: list[str] = []
    while needs:
        ready = sorted(n for n, parents in needs.items() if not parents - set(out))
        if not ready:
            raise CycleError("tables refer to each other: " + ", ".join(sorted(needs)))
        out.append(ready[0])
        del needs[ready[0]]
    return out


def to_dict(plan: Plan) -> dict:
    def column(cp: ColumnPlan) -> dict:
        empty = ColumnPlan()
        return {f.name: getattr(cp, f.name) for f in fields(cp) if f.name not in _ADVISORY and getattr(cp, f.name) != getattr(empty, f.name)}

    def table(tp: TablePlan) -> dict:
        head = {k: v for k, v in (("rows", tp.rows), ("truncate", tp.truncate), ("skip", tp.skip)) if v not in (None, False)}
        return head | {"columns": {n: column(c) for n, c in tp.columns.items()}}

    return {"version": plan.version, "seed": plan.seed, "locale": plan.locale, "tables": {n: table(t) for n, t in plan.tables.items()}}


def from_dict(data: dict) -> Plan:
    """Strict at every level: a misspelled option is an error."""

    def strict(what: str, given: dict, known) -> dict:
        if extra := set(given) - set(known):
            raise ValueError(f"{what}: unknown options {sorted(extra)}")
        return given

    strict("plan", data, ("version", "seed", "locale", "tables"))
    if data.get("version", VERSION) > VERSION:
        raise ValueError(f"version {data['version']} is newer than {VERSION}")
    names = {f.name for f in fields(ColumnPlan)} - set(_ADVISORY)
    tables = {}
    for name, t in (data.get("tables") or {}).items():
        strict(name, t, ("rows", "truncate", "skip", "columns"))
        columns = {c: ColumnPlan(**strict(f"{name}.{c}", p or {}, names)) for c, p in (t.get("columns") or {}).items()}
        tables[name] = TablePlan(columns, t.get("rows"), t.get("truncate", False), t.get("skip", False))
    return Plan(tables, data.get("seed", 0), data.get("locale", "en_US"), data.get("version", VERSION))


def save(plan: Plan, path: str) -> None:
    """Write by renaming, as YAML if the library is there and the name asks for it, else JSON (which YAML readers take too)."""
    text = json.dumps(to_dict(plan), indent=2, ensure_ascii=False) + "\n"
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml

            text = yaml.safe_dump(to_dict(plan), sort_keys=False, allow_unicode=True)
        except ImportError:
            pass
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(temporary, path)


def load(path: str) -> Plan:
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    return from_dict(data or {})


def load_or_infer(path: str, schema: Schema) -> Plan:
    fresh = infer(schema)
    return merge(load(path), fresh) if os.path.exists(path) else fresh
