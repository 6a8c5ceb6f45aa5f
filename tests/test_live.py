"""Introspection of catalog views (DuckDB's stand in for a database's), DDL in Spark's catalog, migration history."""

import duckdb
import pytest

from rowforge.plans import ddl
from rowforge.plans.model import Column, Schema, Table
from rowforge.sources import catalog, live

DDL = """
CREATE TABLE users (id BIGINT PRIMARY KEY, email VARCHAR NOT NULL UNIQUE, age INTEGER CHECK (age > 17), deleted_at TIMESTAMP);
CREATE TABLE orders (id BIGINT PRIMARY KEY, user_id BIGINT NOT NULL REFERENCES users (id), code VARCHAR, place INTEGER, UNIQUE (code, place));
CREATE TABLE items (order_id BIGINT REFERENCES orders (id), n INTEGER, PRIMARY KEY (order_id, n));
"""


def views(spark, text=DDL):
    con = duckdb.connect()
    con.execute(text)
    out = {}
    for view in live.VIEWS:
        rows = con.execute(f"SELECT * FROM information_schema.{view}")
        names = [d[0] for d in rows.description]
        out[view] = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows.fetchall()], ", ".join(f"{n} string" for n in names))
    return out


def test_constraints_of_a_live_source(spark):
    found = views(spark)
    facts = [(r.table_name, r.column_name, r.kind, r.width) for r in live.key_facts(found).collect()]
    assert ("items", "n", "primary key", 2) in facts and ("orders", "code", "unique", 2) in facts and ("users", "email", "unique", 1) in facts
    plain = Schema([Table(t.name, [Column(c.name, c.native) for c in t.columns]) for t in ddl.parse_schema(DDL).tables])
    found["indexes"] = spark.createDataFrame(
        [("users", "CREATE UNIQUE INDEX a ON users USING btree (lower(email)) WHERE (deleted_at IS NULL)"), ("gone", "CREATE UNIQUE INDEX b ON gone (x)")], "table_name string, definition string"
    )
    schema = live.with_constraints(plain, found)
    users, orders, items = (schema.table(n) for n in ("users", "orders", "items"))
    assert users.primary_key == ["id"] and items.primary_key == ["order_id", "n"]
    assert users.column("email").unique and users.column("email").unique_fold and users.column("deleted_at").always_null
    assert orders.column("user_id").references == "users.id" and items.column("order_id").references == "orders.id"
    assert not orders.column("code").unique and not items.column("n").unique and not users.column("age").always_null
    assert [c.columns for c in users.checks] == [["age"]]


TWO = """
CREATE SCHEMA audit; CREATE SCHEMA app; CREATE TYPE mood AS ENUM ('good', 'it''s'); CREATE SEQUENCE n;
CREATE TABLE app.users (id BIGINT PRIMARY KEY DEFAULT nextval('n'), email VARCHAR, price DECIMAL(8, 2) NOT NULL, twice BIGINT GENERATED ALWAYS AS (id * 2), m mood, UNIQUE (email, price));
CREATE TABLE audit.users (id BIGINT, email VARCHAR PRIMARY KEY, state INTEGER CHECK (state > 3));
CREATE TABLE app.orders (id BIGINT PRIMARY KEY, user_id BIGINT REFERENCES app.users (id));
"""


def test_tables_of_one_name_in_two_schemas(spark):
    found = views(spark, TWO)
    one = lambda: Schema([Table("users", [Column(c, "text") for c in ("id", "email", "state")])])
    app, audit = live.with_constraints(one(), found, "app").table("users"), live.with_constraints(one(), found, "audit").table("users")
    assert app.primary_key == ["id"] and app.column("id").unique and not app.column("email").unique and not app.checks
    assert audit.primary_key == ["email"] and audit.column("email").unique and not audit.column("id").unique and [c.columns for c in audit.checks] == [["state"]]
    with pytest.raises(ValueError, match="several schemas"):
        live.with_constraints(one(), found)
    both = live.scan(found)
    assert {t.name: t.primary_key for t in both.tables} == {"app.users": ["id"], "audit.users": ["email"], "app.orders": ["id"]}
    assert both.table("app.orders").column("user_id").references == "app.users.id"


def test_defaults_generated_columns_and_labels(spark):
    users = live.scan(views(spark, TWO), "app").table("users")
    assert users.column("id").has_default and not users.column("id").generated and not users.column("email").has_default
    assert users.column("twice").generated and not users.column("twice").has_default
    assert users.column("m").enum == ["good", "it's"] and users.column("m").cls == "enum"
    assert not users.column("price").nullable and (users.column("price").precision, users.column("price").scale) == (8, 2)
    # labels, identity and widths as other engines tell of them
    columns = "table_schema string, table_name string, column_name string, ordinal_position string, data_type string, is_nullable string, column_default string, is_identity string, udt_schema string, udt_name string, character_maximum_length int, extra string"
    rows = [
        ("s", "t", "id", "1", "bigint", "NO", None, "YES", "pg_catalog", "int8", None, None),
        ("s", "t", "m", "2", "USER-DEFINED", "YES", None, "NO", "s", "mood", None, None),
        ("s", "t", "name", "3", "character varying", "NO", "''x''", "NO", "pg_catalog", "varchar", 40, None),
        ("s", "t", "n", "4", "int", "NO", None, None, None, None, None, "auto_increment"),
        ("s", "t", "g", "5", "int", "YES", None, None, None, None, None, "VIRTUAL GENERATED"),
        ("s", "t", "d", "6", "int", "YES", "now()", None, None, None, None, "DEFAULT_GENERATED"),
    ]
    empty = {v: spark.createDataFrame([], "constraint_schema string, constraint_name string, table_schema string, table_name string, constraint_type string, column_name string, ordinal_position int, unique_constraint_schema string, unique_constraint_name string") for v in live.VIEWS[:3]}
    enums = spark.createDataFrame([("s", "mood", "b", 2.0), ("s", "mood", "a", 1.0), ("other", "mood", "z", 1.0)], "udt_schema string, udt_name string, label string, place double")
    t = live.scan(empty | {"columns": spark.createDataFrame(rows, columns), "enums": enums}, "s").table("t")
    assert [(c.name, c.has_default, c.generated) for c in t.columns] == [("id", True, False), ("m", False, False), ("name", True, False), ("n", True, False), ("g", False, True), ("d", True, False)]
    assert t.column("m").enum == ["a", "b"] and t.column("name").max_len == 40 and not t.column("name").nullable


def test_a_reference_names_the_column_of_its_place_in_the_key(spark):
    """A key (a, b) referred to by (y, x) in the other order."""
    kinds = [("s", "pk", "s", "p", "PRIMARY KEY"), ("s", "fk", "s", "c", "FOREIGN KEY")]
    usage = [("s", "pk", "s", "p", "a", 1, None), ("s", "pk", "s", "p", "b", 2, None), ("s", "fk", "s", "c", "y", 1, 2), ("s", "fk", "s", "c", "x", 2, 1)]
    found = {
        "table_constraints": spark.createDataFrame(kinds, "constraint_schema string, constraint_name string, table_schema string, table_name string, constraint_type string"),
        "key_column_usage": spark.createDataFrame(usage, "constraint_schema string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int, position_in_unique_constraint int"),
        "referential_constraints": spark.createDataFrame([("s", "fk", "s", "pk")], "constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string"),
    }
    assert {(r.column_name, r.ref_column) for r in live.key_facts(found).where("kind = 'foreign key'").collect()} == {("y", "b"), ("x", "a")}


def test_documents_by_a_lattice_of_kinds(spark):
    docs = ['{"n": 1, "d": "12", "o": {"x": 1, "y": {"z": true}}, "m": 1, "l": [1], "e": null, "_id": 5}', '{"n": 2.5, "d": "abc", "o": {"x": 2, "q\'s": "t"}, "m": "x", "l": [], "a.b": 1}', "[1]", "broken {", "7", None, '{"n": 3, "d": "x", "o": {"x": null}, "m": false, "l": null, "big": 123456789012345678901}']
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    want = {
        ("n", "double", False), ("d", "text", False), ("o.x", "bigint", True), ("o.y.z", "boolean", True), ("o.q's", "text", True), ("m", "text", False), ("l", "json", True), ("e", "text", True),
        ("a.b", "bigint", True), ("big", "numeric(21, 0)", True),
    }
    assert {tuple(r) for r in catalog.sample_json(df, "j").collect()} == want
    assert {tuple(r) for r in catalog.sample_json(df.repartition(4), "j", None).collect()} == want
    few = spark.range(1000).selectExpr("concat('{\"k', id % 50, '\": 1}') AS j")
    assert sorted(map(tuple, catalog.sample_json(few, "j", 9).collect())) == sorted(map(tuple, catalog.sample_json(few.orderBy("j"), "j", 9).collect()))
    assert catalog.sample_json(df.limit(0), "j").count() == 0
    table = catalog.json_table(df, "j", "t")
    assert table.column("o.x").cls == "int" and not table.column("n").nullable


def test_ddl_in_the_catalog(spark):
    changes = ddl.parse("CREATE TABLE rowforge_t (id bigserial PRIMARY KEY, name varchar(20) NOT NULL, price numeric(8,2), at timestamptz)")
    try:
        live.execute(spark, changes)
        live.execute(spark, [ddl.Change("add_column", "rowforge_t", [Column("flag", "boolean")])])
        table = spark.table("rowforge_t")
        assert [(f.name, f.dataType.simpleString()) for f in table.schema] == [
            ("id", "bigint"), ("name", "string"), ("price", "decimal(8,2)"), ("at", "timestamp"), ("flag", "boolean"),
        ]
    finally:
        live.execute(spark, [ddl.Change("drop_table", "rowforge_t")])
    assert not spark.catalog.tableExists("rowforge_t")


def test_history_of_every_tool(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = {
        "schema_migrations": make([("12", True)], "version string, dirty boolean"),
        "flyway_schema_history": make([("1", "first", "2024-01-01 00:00:00", True)], "version string, description string, installed_on string, success boolean"),
        "goose_db_version": make([(7, False, "2024-02-01 00:00:00")], "version_id long, is_applied boolean, tstamp string"),
        "alembic_version": make([("abc",)], "version_num string"),
        "atlas_schema_revisions": make([("3", "third", "2024-03-01 00:00:00")], "version string, description string, executed_at string"),
        "django_migrations": make([("auth", "0001", "2024-04-01 00:00:00")], "app string, name string, applied string"),
        "knex_migrations": make([("n.js", 2, "2024-05-01 00:00:00"), ("m.js", None, None)], "name string, batch int, migration_time string"),
        "ar_internal_metadata": make([("environment", "test", "2024-06-01 00:00:00")], "key string, value string, updated_at string"),
        "flyway": make([(1,)], "version int"),
    }
    out = [(r.source, r.version, r.name, r.applied) for r in catalog.migration_history(tables).collect()]
    assert out == [
        ("rails", "test", "environment", None), ("knex", "n.js", "2", True), ("django", "0001", "auth", True), ("atlas", "3", "third", None), ("goose", "7", "", False),
        ("flyway", "1", "first", True), ("alembic", "abc", "", None), ("golang-migrate", "12", "dirty", False), ("knex", "m.js", "", True),
    ]
    # a table of that name without the tool's columns is not that tool's
    assert catalog.migration_history({"schema_migrations": make([("1",)], "version string")}) is None


def test_jdbc_round_trip(spark):
    """Against the database that Spark brings along for its catalog, in memory."""
    url, options = "jdbc:derby:memory:rowforge;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i, f"n{i}", i / 4) for i in range(100)], "id int, name string, price double").repartition(3)
    catalog.write_jdbc(rows, url, "T", **options)
    catalog.write_jdbc(rows.where("id < 10"), url, "T", **options)
    back = catalog.jdbc_table(spark, url, "T", key="id", parts=4, **options)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 110
    catalog.write_jdbc(rows.where("id < 5"), url, "T", truncate=True, **options)
    back = catalog.jdbc_table(spark, url, "T", **options)
    assert sorted(map(tuple, back.collect())) == [(i, f"n{i}", i / 4) for i in range(5)]
    assert [(c.name.lower(), c.cls) for c in catalog.introspect({"t": back}).tables[0].columns] == [("id", "int"), ("name", "string"), ("price", "float")]
    with pytest.raises(PermissionError):
        catalog.write_jdbc(rows, "jdbc:postgresql://db.example.com/live", "T")
