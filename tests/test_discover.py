"""Keys and references found from rows, against counting every combination."""

import random
from datetime import datetime
from decimal import Decimal
from itertools import combinations

from rowforge.operators import discover as discover_module
from rowforge.operators.discover import discover, inclusions, minimal_keys, speaks_of


def plain_keys(columns, rows, widest):
    found = []
    for width in range(1, widest + 1):
        for c in combinations(sorted(columns), width):
            at = [columns.index(x) for x in c]
            values = [tuple(r[i] for i in at) for r in rows]
            if rows and not any(None in v for v in values) and len(set(values)) == len(rows) and not any(set(f) <= set(c) for f in found):
                found.append(c)
    return [list(c) for c in found]


def test_minimal_keys_against_all_combinations(spark):
    rng = random.Random(2)
    rows = [(i // 20, i % 20, "x" if i % 3 else "y", rng.randrange(40), None if i == 3 else i, i % 7, datetime(2024, 1, 1 + i % 9)) for i in range(400)]
    columns = ["a", "b", "kind", "n", "holed", "seven", "day"]
    df = spark.createDataFrame([(*r, 1.5, [1]) for r in rows], "a int, b long, kind string, n int, holed int, seven short, day timestamp, price double, list array<int>")
    assert minimal_keys("t", df) == plain_keys(columns, rows, 3)
    assert minimal_keys("t", df, widest=2) == plain_keys(columns, rows, 2)
    assert minimal_keys("t", df.limit(0)) == [] and minimal_keys("t", df.select("price", "list")) == []
    assert minimal_keys("t", df.unionAll(df)) == []


def test_a_slice_rules_out_what_repeats_and_no_key(spark, monkeypatch):
    """Combinations with a few repeats only are found by a slice; what it leaves is counted over all rows."""
    # nearly unique pairs of a, the key (a, b), and a triple whose only repeat stands in one value of a
    rng = random.Random(5)
    rows = [(i // 4, i % 4, rng.randrange(900), Decimal(rng.randrange(800)), f"t{i % 600}", i % 3) for i in range(4000)]
    columns = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(rows, "a long, b int, c int, d decimal(9,2), e string, f int")
    whole = []
    exactly = discover_module._exactly_unique
    monkeypatch.setattr(discover_module, "_exactly_unique", lambda name, df, combos: whole.extend(combos) or exactly(name, df, combos))
    monkeypatch.setattr(discover_module, "SLICED_ROWS", 1000)
    monkeypatch.setattr(discover_module, "SLICES", 3)
    found = minimal_keys("t", df)
    assert found == plain_keys(columns, rows, 3)
    assert ("a", "c") not in whole and ("a", "d") not in whole and {tuple(k) for k in found} <= set(whole)
    one = [*rows, (17, 3, 5000, Decimal(5000), "t", 0), (17, 2, 5000, Decimal(5000), "t", 0)]
    lone = spark.createDataFrame(one, "a long, b int, c int, d decimal(9,2), e string, f int")
    for slices in (1, 3, 50):
        monkeypatch.setattr(discover_module, "SLICES", slices)
        assert minimal_keys("t", lone) == plain_keys(columns, one, 3)


def test_inclusions_over_many_columns_and_types(spark):
    """More columns than a word has bits; widths differ; nulls stand in nothing."""
    wide = spark.range(30).selectExpr(*[f"CAST(id % {k + 1} AS SHORT) AS c{k}" for k in range(70)], "CAST(NULL AS INT) AS gone", "CAST(id AS STRING) AS word")
    keys = spark.range(25).selectExpr("id", "CAST(id AS STRING) AS word", "CAST(id AS DECIMAL(10,2)) AS price")
    tables = {"wide": wide, "keys": keys.unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS id, CAST(NULL AS STRING) AS word, CAST(NULL AS DECIMAL(10,2)) AS price"))}
    got = inclusions(tables, {("keys", "id"), ("keys", "word"), ("wide", "c69"), ("wide", "c3")})
    want = [("wide", f"c{k}", "keys", "id") for k in range(25)] + [("keys", "id", "wide", "c69"), ("keys", "word", "wide", "word")][:1]
    want += [("wide", f"c{k}", "wide", "c69") for k in range(69)] + [("wide", f"c{k}", "wide", "c3") for k in range(3)]
    assert got == sorted(want)
    assert inclusions({"wide": wide.limit(0)}, {("wide", "c1")}) == []


def test_a_schema_from_rows(spark):
    users = spark.range(1, 60).selectExpr("CAST(id AS INT) AS id", "concat('u', id, '@x.org') AS email", "CAST(id % 5 AS INT) AS team")
    orders = spark.range(300).selectExpr("id AS o_id", "CAST(id % 59 + 1 AS LONG) AS user_id", "IF(id % 4 = 0, NULL, 'note') AS note")
    lines = spark.range(900).selectExpr("id DIV 3 AS o_id", "CAST(id % 3 AS INT) AS line", "id % 2 AS flag")
    schema = discover({"users": users, "orders": orders, "lines": lines})
    assert [t.primary_key for t in schema.tables] == [["id"], ["o_id"], ["o_id", "line"]]
    assert schema.table("users").column("email").unique and not schema.table("users").column("team").unique
    assert schema.table("orders").column("user_id").references == "users.id" and schema.table("lines").column("o_id").references == "orders.o_id"
    assert schema.table("orders").column("note").nullable and not schema.table("orders").column("user_id").nullable
    assert speaks_of("o_custkey", "customer", "c_custkey") and speaks_of("user_id", "users", "id") and not speaks_of("l_linenumber", "region", "r_regionkey") and not speaks_of("id", "x", "id")
