"""python -m rowforge scan | validate | run | dump | script | check | version

Options win over ROWFORGE_* environment variables.
"""

from __future__ import annotations

import argparse
import os
import sys

from rowforge.functions.kinds import LOCALES
from rowforge.operators import export
from rowforge.operators.generate import Options, dry_run, generate, write_tables
from rowforge.plans import ddl
from rowforge.plans.model import Schema
from rowforge.plans.plan import load, load_or_infer, save, unenforced, validate

VERSION = "0.1.0"


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("rowforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _schema(args) -> Schema:
    """The tables of a DDL file, of a folder of migrations, of a database (a jdbc: address), or of a folder of Parquet files."""
    if args.schema.startswith("jdbc:"):
        from rowforge.sources import live
        from rowforge.sources.catalog import scheme

        options = {"driver": args.driver} if args.driver else {}
        return live.scan(live.jdbc_views(_session(), args.schema, scheme(args.schema), **options), args.namespace)
    if args.schema.endswith(".sql"):
        with open(args.schema, encoding="utf-8") as file:
            return ddl.parse_schema(file.read())
    if os.path.isdir(args.schema) and any(n.endswith(".sql") for n in os.listdir(args.schema)):
        return ddl.replay(args.schema)
    from rowforge.operators.discover import discover
    from rowforge.sources.catalog import introspect, parquet_tables

    tables = parquet_tables(_session(), args.schema)
    return discover(tables) if args.discover else introspect(tables)


def _check(args, schema: Schema) -> int:
    """Print the rules that rows break; 1 if there are any."""
    from rowforge.operators.audit import check
    from rowforge.sources.catalog import parquet_tables

    tables = parquet_tables(_session(), args.data)
    tables |= {t.name: _session().read.parquet(f"{args.data}/{t.name}") for t in schema.tables if t.name not in tables and os.path.isdir(f"{args.data}/{t.name}")}
    broken = check({t.name: tables[t.name] for t in schema.tables if t.name in tables}, schema).where("violations > 0").orderBy("table_name", "rule").collect()
    for r in broken:
        print(f"{r.table_name}: {r.rule}: {r.violations} of {r.rows} rows")
    print("" if broken else "no rule is broken")
    return int(bool(broken))


def main(argv: list[str] | None = None) -> int:
    env = lambda name, default=None: os.environ.get(f"ROWFORGE_{name}", default)
    parser = argparse.ArgumentParser(prog="rowforge", description=__doc__)
    parser.add_argument("command", choices=["scan", "validate", "run", "dump", "script", "check", "version"])
    parser.add_argument("--schema", default=env("SCHEMA", "schema.sql"))
    parser.add_argument("--plan", default=env("PLAN", "plan.json"))
    parser.add_argument("-o", "--out", default=env("OUT", "out"))
    parser.add_argument("--format", default=env("FORMAT", "csv"), choices=["csv", "json", "sql"])
    parser.add_argument("--rows", type=int, default=int(env("ROWS")) if env("ROWS") else None)
    parser.add_argument("--seed", type=int, default=int(env("SEED", "0")))
    parser.add_argument("--locale", default=env("LOCALE"), choices=sorted(LOCALES))
    parser.add_argument("--dialect", default=env("DIALECT", "postgres"), choices=sorted(ddl.TYPE_MENUS), help="what script writes")
    parser.add_argument("--data", default=env("DATA"), help="a folder of <table>.parquet or <table> to check")
    parser.add_argument("--dsn", default=env("DSN"), help="a jdbc: address to which run loads all tables or none, through files in --out")
    parser.add_argument("--driver", default=env("DRIVER"), help="the JDBC driver's class")
    parser.add_argument("--namespace", default=env("NAMESPACE"), help="the database schema that is scanned")
    parser.add_argument("--consent", action="store_true", help="write to an address that speaks of production")
    parser.add_argument("--discover", action="store_true", help="find keys and references from the rows of Parquet files")
    parser.add_argument("--append", action="store_true", help="keep what a target holds")
    parser.add_argument("--truncate", action="store_true", help="replace what a target holds")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--quiet", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    schema = _schema(args)
    if args.command == "scan":
        plan = load_or_infer(args.plan, schema)
        save(plan, args.plan)
        low = sum(c.confidence == "low" for t in plan.tables.values() for c in t.columns.values())
        print(f"{len(plan.tables)} tables, {low} columns to look at")
        for table, check in unenforced(plan, schema):
            print(f"not promised: {table}: {check}")
        return 0
    if args.command == "validate":
        problems = validate(load(args.plan), schema)
        print("\n".join(problems) or "no problems")
        return int(bool(problems))
    if args.command == "script":
        print(ddl.script(Schema([ddl.translated(t, args.dialect) for t in schema.tables]), args.dialect), end="")
        return 0
    if args.command == "check":
        return _check(args, schema)
    plan, held = load_or_infer(args.plan, schema), {}
    plan.locale = args.locale or plan.locale
    if args.append:
        held = {t.name: _session().read.parquet(f"{args.out}/{t.name}") for t in schema.tables if os.path.exists(f"{args.out}/{t.name}")}
    made = generate(_session(), schema, plan, Options(seed=args.seed, rows=args.rows, append=args.append, truncate=args.truncate, existing=held))
    say = None if args.quiet else lambda name, rows, seconds: print(f"{name}: {rows} rows in {seconds:.1f} s", file=sys.stderr)
    if args.dry_run:
        dry_run(made, say)
        print(f"seed {made.seed}: {sum(made.counts.values())} rows, {made.rows_per_second():.0f} a second, nothing written")
    elif args.command == "run" and args.dsn:
        from rowforge.operators.load import load_tables

        done = load_tables(made, args.dsn, args.out, consent=args.consent, progress=say, **({"driver": args.driver} if args.driver else {}))
        print(f"seed {made.seed}: {', '.join(done.rows)}")
    elif args.command == "run":
        write_tables(made, args.out, progress=say)
        print(f"seed {made.seed}: {', '.join(made.order)}")
    else:
        print("\n".join(export.dump(made.tables, made.order, args.out, args.format)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
