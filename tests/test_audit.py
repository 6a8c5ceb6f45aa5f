"""All rules of a schema in one plan, against rows chosen to break them."""

import pytest

from rowforge.operators import audit
from rowforge.plans import ddl
from rowforge.plans.model import Column, Schema, Table
from rowforge.plans.plan import ColumnPlan, Plan, TablePlan

DDL = """
CREATE TABLE parent (id int PRIMARY KEY, code varchar(3) UNIQUE, kind enum('a', 'b') NOT NULL, price numeric(4, 1), CHECK (price > 0 OR kind = 'a'));
CREATE TABLE child (a bigint, b text, ref decimal(10, 2) REFERENCES parent(id), own double REFERENCES parent(id), word text REFERENCES parent(code) CHECK (word ~ '^[a-z]+$'), PRIMARY KEY (a, b));
"""
PARENTS = [(1, "x", "a", 5.0, 9), (1, "X", "c", -1.0, 9), (3, None, None, 1000.0, 9), (None, "long", "b", None, 9), (None, "x", "b", -5.0, 9)]
CHILDREN = [(1, "k", "1.00", 1.0, "x"), (1, "k", "2.50", -0.0, "long"), (1, None, None, None, None), (2, "k", "3.00", 3.0, "Z9"), (None, "k", "3.00", 7.0, "x")]


def tables(spark):
    parent = spark.createDataFrame(PARENTS, "id int, code string, kind string, price double, more int")
    child = spark.createDataFrame(CHILDREN, "a long, b string, ref string, own double, word string").selectExpr("a", "b", "CAST(ref AS DECIMAL(10, 2)) AS ref", "own", "word")
    return {"parent": parent, "child": child}


def found(df):
    return {(r.table_name, r.rule): (r.rows, r.violations) for r in df.collect()}


def test_every_kind_of_rule(spark):
    got = found(audit.check(tables(spark), ddl.parse_schema(DDL)))
    assert got == {
        ("parent", "id is not null"): (5, 2),
        ("parent", "code has at most 3 characters"): (5, 1),
        ("parent", "kind is not null"): (5, 1),
        ("parent", "kind is in its list"): (5, 1),
        ("parent", "price has at most 3 digits before the point"): (5, 1),
        ("parent", "check price > 0 OR kind = 'a'"): (5, 2),
        ("parent", "primary key id"): (3, 1),
        ("parent", "unique code"): (4, 1),
        ("child", "a is not null"): (5, 1),
        ("child", "b is not null"): (5, 1),
        ("child", "ref has at most 8 digits before the point"): (5, 0),
        ("child", "check word ~ '^[a-z]+$'"): (5, 1),
        ("child", "primary key a, b"): (3, 1),
        ("child", "ref refers to parent.id"): (4, 1),
        ("child", "own refers to parent.id"): (4, 2),
        ("child", "word refers to parent.code"): (4, 1),
    }


def test_missing_tables_empty_tables_and_columns(spark):
    both, schema = tables(spark), ddl.parse_schema(DDL)
    assert found(audit.check({"child": both["child"]}, schema))["child", "ref refers to parent.id"] == (4, None)
    none = found(audit.check({name: df.limit(0) for name, df in both.items()}, schema))
    assert len(none) == 16 and set(none.values()) == {(0, 0)}
    assert found(audit.check({"parent": both["parent"].limit(0), "child": both["child"]}, schema))["child", "word refers to parent.code"] == (4, 4)
    with pytest.raises(ValueError, match="child: no column own"):
        audit.check(both | {"child": both["child"].drop("own")}, schema)


def test_rules_of_a_plan_and_many_rules(spark):
    """More rules than a word has bits; bounds and patterns of a plan; folded keys; always null."""
    names = [f"c{k}" for k in range(150)]
    df = spark.range(20).selectExpr(*[f"IF(id % 10 < {k % 11}, NULL, 'v') AS c{k}" for k in range(150)], "CAST(id AS INT) AS n", "IF(id < 2, 'Aa', IF(id < 5, 'aA', NULL)) AS mixed", "IF(id = 0, 1, NULL) AS gone")
    schema = Schema([Table("t", [Column(c, "text", nullable=False) for c in names] + [Column("n", "int"), Column("mixed", "text", unique_fold=True), Column("gone", "int", always_null=True)])])
    plan = Plan({"t": TablePlan({"n": ColumnPlan("int", min=3, max=15), "mixed": ColumnPlan("pattern", pattern="^a")})})
    got = found(audit.check({"t": df}, schema, plan))
    for k in range(150):
        assert got["t", f"c{k} is not null"] == (20, 2 * min(10, k % 11))
    assert got["t", "n is at least 3"] == (20, 3) and got["t", "n is at most 15"] == (20, 4) and got["t", "mixed matches ^a"] == (20, 2)
    assert got["t", "unique mixed in any case"] == (5, 4) and got["t", "gone is null"] == (20, 1)


def test_one_scan_of_a_table_and_one_shuffle_of_rows(spark, tmp_path):
    for name, df in tables(spark).items():
        df.write.parquet(str(tmp_path / name))
    stored = {name: spark.read.parquet(str(tmp_path / name)) for name in ("parent", "child")}
    plan = audit.check(stored, ddl.parse_schema(DDL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "more" not in plan.split("ReadSchema", 1)[1].split("\n")[0]
    assert plan.count("Exchange hashpartitioning(number") <= 2  # rows by key; what is left by rule
