"""Driver-side planning: classes, inference, merge, validation, order, files, DDL."""

import json

import pytest

from rowforge.functions.draw import fnv1a, table_seed
from rowforge.functions.pattern import PatternError, check_pattern
from rowforge.plans import ddl
from rowforge.plans import plan as plans
from rowforge.plans.model import Column, Schema, Table, classify, from_struct, split_ref, to_struct
from rowforge.queries import SCHEMA
from rowforge.sources.catalog import guard, json_schema_table, scheme


def test_fnv_and_seed():
    assert fnv1a("") == 0xCBF29CE484222325 and fnv1a("a") == 0xAF63DC4C8601EC8C
    assert table_seed(1, "a") != table_seed(2, "a") != table_seed(2, "b")


@pytest.mark.parametrize(
    ("native", "want"),
    [("varchar(20)", "string"), ("BIGINT UNSIGNED", "int"), ("numeric(10,2)", "float"), ("timestamp without time zone", "time"), ("tinyint", "int"), ("point", "unknown"), ("text[]", "string"), ("mediumint(8)", "int"), ("serial2", "int"), ("variant", "json")],
)
def test_classify(native, want):
    assert classify(native) == want


def test_struct_round_trip():
    table = SCHEMA.table("orders")
    back = from_struct("orders", to_struct(table))
    assert [(c.name, c.cls, c.nullable, c.max_len, c.references) for c in back.columns] == [(c.name, c.cls, c.nullable, c.max_len, c.references) for c in table.columns]
    assert back.primary_key == ["id"]


def test_ambiguous_names_follow_the_table():
    for name, want in (("users", "name"), ("customers", "name"), ("categories", "word"), ("products", "word")):
        got = plans.infer_column(Table(name, []), Column("name", "varchar(80)", False))
        assert (got.generator, got.confidence) == (want, "high" if want == "name" else "low")


def test_checks_become_patterns_or_stay_open():
    schema = ddl.parse_schema(
        "CREATE TABLE people (id int PRIMARY KEY, nickname varchar(30) NOT NULL CHECK ((nickname ~ '^[a-z_]{3,30}$'::text)), phone text, code text, CHECK ((phone IS NULL) = (code IS NULL)))"
    )
    plan = plans.infer(schema)
    nickname = plan.tables["people"].columns["nickname"]
    assert (nickname.generator, nickname.pattern, nickname.confidence) == ("pattern", "^[a-z_]{3,30}$", "high")
    assert plan.tables["people"].columns["phone"].confidence == "low"
    assert plans.unenforced(plan, schema) == [("people", "(phone IS NULL) = (code IS NULL)")]


def test_merge_keeps_choices_and_rows():
    fresh = plans.infer(SCHEMA)
    old = plans.from_dict({"seed": 5, "tables": {"users": {"rows": 0, "columns": {"city": {"generator": "word"}, "gone": {"generator": "word"}}}, "lost": {"columns": {}}}})
    merged = plans.merge(old, fresh)
    assert merged.seed == 5 and merged.tables["users"].rows == 0 and merged.tables["orders"].rows == 1000
    assert merged.tables["users"].columns["city"].confidence == "manual" and "gone" not in merged.tables["users"].columns and "lost" not in merged.tables
    assert plans.restore_order(["b", "x", "a"], ["a", "b", "c"]) == ["b", "a", "c"]


def test_validate_reports_everything():
    plan = plans.infer(SCHEMA)
    users, orders = plan.tables["users"].columns, plan.tables["orders"].columns
    users["email"].null_rate, users["city"].null_rate, users["is_active"].true_weight = 0.5, 2, 3
    users["first_name"].generator, users["last_name"].generator, users["last_name"].pattern = "nonsense", "pattern", "(?=a)"
    orders["user_id"].references, orders["status"].values, orders["status"].weights = "nobody.id", ["a"], [1, 2]
    plan.tables["none"] = plans.TablePlan()
    assert len(plans.validate(plan, SCHEMA)) == 8


def test_strict_files(tmp_path):
    path = str(tmp_path / "plan.json")
    plan = plans.infer(SCHEMA)
    plans.save(plan, path)
    again = plans.load(path)
    assert plans.to_dict(again) == plans.to_dict(plan)
    for bad in ({"tabels": {}}, {"tables": {"t": {"colums": {}}}}, {"tables": {"t": {"columns": {"c": {"genrator": "x"}}}}}, {"version": 99}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            plans.load(str(tmp_path / "bad.json"))


def test_order_and_cycles():
    ref = lambda t: plans.TablePlan({"r": plans.ColumnPlan("foreign_key", references=f"{t}.id")}, 5)
    schema = Schema([Table(n, [Column("id", "int"), Column("r", "int")]) for n in "abcd"])
    plan = plans.Plan({"a": ref("b"), "b": ref("c"), "c": plans.TablePlan({}, 5), "d": ref("d")})
    assert plans.table_order(plan, schema) == ["c", "b", "a", "d"]
    plan.tables["c"] = ref("a")
    with pytest.raises(plans.CycleError, match="a, b, c"):
        plans.table_order(plan, schema)
    plan.tables["c"].rows = 0
    assert "c" not in plans.table_order(plan, schema)


def test_patterns_are_checked():
    check_pattern(r"^\$argon2id\$v=\d+(a|b){2,3}[^x]?")
    for bad in ("(?=a)b", "a(?<!b)", r"(a)\1", "(", "[z-a]"):
        with pytest.raises(PatternError):
            check_pattern(bad)


def test_ddl_round_trip_and_script_order():
    text = ddl.script(SCHEMA)
    assert text.index('"users"') < text.index('"orders"')
    again = ddl.parse_schema(text)
    assert [(t.name, [(c.name, c.native, c.nullable, c.references) for c in t.columns], t.primary_key) for t in again.tables] == [
        (t.name, [(c.name, c.native, c.nullable, c.references) for c in t.columns], t.primary_key) for t in SCHEMA.tables
    ]
    with pytest.raises(ddl.DDLError):
        ddl.parse("CREATE INDEX i ON table_x (a); SELECT 1")


def test_ddl_details():
    schema = ddl.parse_schema(
        """-- people
        CREATE TABLE IF NOT EXISTS "app"."members" (a int, b int, kind ENUM('x','it''s') , note text DEFAULT 'a, (b)',
          PRIMARY KEY (a, b), CONSTRAINT f FOREIGN KEY (a) REFERENCES users, UNIQUE (note)); /* x; */"""
    )
    t = schema.tables[0]
    assert t.name == "app.members" and t.primary_key == ["a", "b"] and not t.column("a").nullable
    assert t.column("a").references == "users.id" and t.column("kind").enum == ["x", "it's"] and t.column("note").unique and t.column("note").has_default


def test_replay_follows_the_text(tmp_path):
    (tmp_path / "down").mkdir()
    (tmp_path / "down" / "1.sql").write_text("DROP TABLE x;")
    (tmp_path / "1.sql").write_text("CREATE TABLE x (id int, a int);")
    (tmp_path / "2.sql").write_text("DROP TABLE IF EXISTS x; CREATE TABLE x (id int);")
    (tmp_path / "2.down.sql").write_text("DROP TABLE x;")
    (tmp_path / "3.sql").write_text("ALTER TABLE x ADD COLUMN b text NOT NULL, DROP COLUMN id;\n-- +goose Down\nDROP TABLE x;")
    assert [(t.name, [c.name for c in t.columns]) for t in ddl.replay(str(tmp_path)).tables] == [("x", ["b"])]


def test_changes_are_validated_and_ordered():
    new = Table("items", [Column("id", "int", False), Column("order_id", "bigint", references="orders.id")], ["id"])
    changes = [
        ddl.Change("drop_table", "orders"), ddl.Change("create_table", new.name, new.columns, new.primary_key), ddl.Change("add_column", "users", [Column("age", "int")]),
        ddl.Change("drop_column", "users", [Column("city")]),
    ]
    assert [s.split()[0] + s.split()[-1][-1] for s in ddl.render(changes)] == ["CREATE;", "ALTER;", "ALTER;", "DROP;"]
    assert ddl.validate_changes(changes, SCHEMA) == []
    bad = [ddl.Change("create_table", "users", [Column("a b")]), ddl.Change("drop_column", "users", [Column("zip")]), ddl.Change("add_column", "nobody", [Column("x")])]
    assert len(ddl.validate_changes(bad, SCHEMA)) == 5
    assert "users ||--o{ orders : user_id" in ddl.mermaid(SCHEMA)


def test_index_facts():
    assert ddl.index_facts("CREATE UNIQUE INDEX i ON public.users USING btree (lower((nick)::text)) WHERE (deleted_at IS NULL)") == ("nick", True, ["deleted_at"])
    assert ddl.index_facts("CREATE UNIQUE INDEX i ON u (a) WHERE ((x IS NULL) OR (y IS NULL))") == ("a", False, [])
    assert ddl.index_facts("CREATE UNIQUE INDEX i ON u (a, b)")[0] == ""
    assert ddl.index_facts("CREATE UNIQUE INDEX i ON u (a) WHERE d IS NOT NULL")[2] == []


def test_addresses():
    assert scheme("postgresql://h/db") == "postgres" and scheme("u:p@tcp(h:1)/d") == "mysql" and scheme("file:x.db") == "sqlite" and scheme("./x.db") == "sqlite"
    with pytest.raises(ValueError):
        scheme("nonsense")
    assert guard("postgres://localhost/app") == "" and "prod" in guard("postgres://db-prod.example/x") and guard("postgres://reproduction.example/x") and guard("x.db") == ""
    assert split_ref("app.users.id") == ("app.users", "id") and split_ref("id") is None
    t = json_schema_table("t", {"required": ["a"], "properties": {"_id": {}, "a": {"bsonType": ["int", "null"]}, "b": {"type": "string", "enum": ["x"]}}})
    assert [(c.name, c.native, c.nullable, c.enum) for c in t.columns] == [("a", "int", False, []), ("b", "text", True, ["x"])]


def test_type_menus_cover_every_dialect():
    table = Table("t", [Column("a", "bigint"), Column("b", "varchar(20)"), Column("c", "numeric(8,3)"), Column("d", "timestamptz"), Column("e", "point"), Column("f", "date"), Column("g", "text", enum=["x"])])
    assert len(ddl.TYPE_MENUS) == 15
    for dialect in ddl.TYPE_MENUS:
        kinds = [c.native for c in ddl.translated(table, dialect).columns]
        assert kinds[4] == "point" and classify(kinds[0]) in ("int", "float") and "{" not in "".join(kinds), dialect
        assert ddl.create_sql(ddl.translated(table, dialect), dialect).startswith("CREATE TABLE")
    assert [c.native for c in ddl.translated(table, "mysql").columns] == ["bigint", "varchar(20)", "decimal(8,3)", "datetime", "point", "date", "text"]
