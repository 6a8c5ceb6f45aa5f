"""Generation, relations, uniqueness, export and streaming on small tables."""

import csv
import json
import os
import re
import time
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowforge.functions import draw
from rowforge.functions.draw import salt, table_seed
from rowforge.functions.kinds import KINDS, LOCALES, OWN, Draws, generate, longest, register_generator
from rowforge.functions.kinds_sql import KINDS_SQL
from rowforge.functions.pattern import compile_pattern
from rowforge.functions.scalars import clamp_text
from rowforge.operators import checks, export, relate, unique
from rowforge.operators.cut import finished
from rowforge.operators.generate import GenerationError, Options, dry_run, preview, write_tables
from rowforge.operators.generate import generate as run
from rowforge.plans import ddl
from rowforge.plans.plan import ColumnPlan, infer
from rowforge.queries import GROUPS, QUERIES, SCHEMA, users_plan
from rowforge.sources import catalog
from rowforge.streaming.stream import stream_columns, windowed_counts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_same_rows_at_any_parallelism(spark):
    plan = users_plan(200, 300)
    one = run(spark, SCHEMA, plan, splits=1).tables
    for splits in (3, 7):
        other = run(spark, SCHEMA, plan, splits=splits).tables
        assert rows(one["users"]) == rows(other["users"]) and rows(one["orders"]) == rows(other["orders"])
    assert rows(run(spark, SCHEMA, plan, Options(seed=8)).tables["users"]) != rows(one["users"])
    del plan.tables["users"].columns["city"]
    fewer = run(spark, SCHEMA, plan).tables["users"]
    assert rows(fewer) == rows(one["users"].drop("city"))


def test_foreign_keys_unique_mail_and_widths(spark):
    schema = ddl.parse_schema(
        "CREATE TABLE users (id BIGSERIAL PRIMARY KEY, email VARCHAR(30) NOT NULL UNIQUE, first_name VARCHAR(50) NOT NULL); CREATE TABLE orders (id BIGSERIAL PRIMARY KEY, user_id bigint NOT NULL REFERENCES users, note varchar(9))"
    )
    plan = infer(schema)
    plan.seed, plan.tables["users"].rows, plan.tables["orders"].rows = 7, 500, 2000
    made = run(spark, schema, plan).tables
    assert checks.orphans(made["orders"], "user_id", made["users"], "id").isEmpty()
    mails = [r.email for r in made["users"].collect()]
    assert len(set(mails)) == 500 and all(len(m) <= 30 and m.split("@")[1].startswith("example.") for m in mails)
    assert checks.length_violations(made["orders"], "note", 9).first().violations == 0
    assert 0.01 < checks.null_rates(made["orders"], ["note"]).first().rate < 0.1


def test_empty_parents_self_references_and_capacity(spark):
    schema = ddl.parse_schema(
        "CREATE TABLE c (id serial PRIMARY KEY, parent_id int REFERENCES c); CREATE TABLE p (id serial PRIMARY KEY, c_id int NOT NULL REFERENCES c); CREATE TABLE prof (c_id int PRIMARY KEY REFERENCES c, x text)"
    )
    plan = infer(schema)
    plan.seed = 3
    plan.tables["c"].rows, plan.tables["p"].rows, plan.tables["prof"].rows = 20, 50, 20
    made = run(spark, schema, plan).tables
    assert made["c"].where("parent_id IS NULL").count() >= 8 and made["p"].where("c_id IS NULL").isEmpty()
    assert checks.one_to_one(made["prof"], "c_id").first().one_to_one
    plan.tables["prof"].rows = 21
    with pytest.raises(relate.CapacityError):
        run(spark, schema, plan)
    plan.tables["c"].rows = 0
    with pytest.raises(GenerationError, match="no rows to refer to"):
        run(spark, schema, plan)


def test_join_table(spark):
    schema = ddl.parse_schema(
        "CREATE TABLE users (id serial PRIMARY KEY, n int); CREATE TABLE tags (id serial PRIMARY KEY, n int); CREATE TABLE user_tags (user_id int REFERENCES users, tag_id int REFERENCES tags, PRIMARY KEY (user_id, tag_id))"
    )
    plan = infer(schema)
    plan.seed = 99
    plan.tables["users"].rows, plan.tables["tags"].rows, plan.tables["user_tags"].rows = 20, 10, 200
    made = run(spark, schema, plan).tables["user_tags"]
    assert checks.uniqueness(made, ["user_id", "tag_id"]).first().extra_rows == 0
    spread = checks.spread(made, "user_id").first()
    assert (spread.parents, spread.least, spread.most) == (20, 10, 10)
    plan.tables["user_tags"].rows = 201
    with pytest.raises(relate.CapacityError, match="20 x 10"):
        run(spark, schema, plan)


def test_append_to_a_join_table(spark, monkeypatch):
    """Existing pairs anywhere in the space, the whole space, ranges of few rows."""
    monkeypatch.setattr(relate, "LOOKED_UP", 16)
    schema = ddl.parse_schema(
        "CREATE TABLE users (id serial PRIMARY KEY, n int); CREATE TABLE tags (id serial PRIMARY KEY, n int); CREATE TABLE user_tags (user_id int REFERENCES users, tag_id int REFERENCES tags, note text, PRIMARY KEY (user_id, tag_id))"
    )
    plan = infer(schema)
    plan.seed = 99
    plan.tables["users"].skip = plan.tables["tags"].skip = True
    keys = {"users": spark.range(1, 21).selectExpr("CAST(id AS INT) AS id"), "tags": spark.range(1, 11).selectExpr("CAST(id AS INT) AS id")}
    pairs = [(u, t) for u in range(1, 21) for t in range(1, 11)]
    for held in (pairs[:90], pairs[::3] + [(None, 3), (77, 1)], pairs[150:], pairs[:199], []):
        taken = {p for p in held if p in pairs}
        held = {"user_tags": spark.createDataFrame(held + held[:5], "user_id int, tag_id int")}
        for n in (200 - len(taken), 1):
            plan.tables["user_tags"].rows = n
            made = run(spark, schema, plan, Options(append=True, existing=keys | held)).tables["user_tags"].select("user_id", "tag_id").collect()
            new = {tuple(r) for r in made}
            assert len(made) == len(new) == n and new <= set(pairs) and not new & taken
        plan.tables["user_tags"].rows = 201 - len(taken)
        with pytest.raises(relate.CapacityError, match="are taken|200 combinations"):
            run(spark, schema, plan, Options(append=True, existing=keys | held))


def test_patterns_sequences_and_impossible_uniques(spark):
    schema = ddl.parse_schema("CREATE TABLE a (nick varchar(30) NOT NULL UNIQUE, secret text NOT NULL, n bigint NOT NULL, uid varchar(32) NOT NULL, flag boolean NOT NULL)")
    plan = infer(schema)
    plan.seed, plan.tables["a"].rows = 1, 500
    columns = plan.tables["a"].columns
    columns["nick"] = ColumnPlan("pattern", pattern="^[a-z]{2}$", unique=True)
    columns["secret"] = ColumnPlan("pattern", pattern=r"^\$argon2id\$v=\d+\$m=\d+,t=\d+,p=\d+\$")
    columns["n"] = columns["uid"] = ColumnPlan("sequence", start=800000001000)
    made = run(spark, schema, plan).tables["a"]
    got = made.collect()
    assert all(re.fullmatch("[a-z]{2}", r.nick) and re.match(r"^\$argon2id\$v=\d+\$m=\d+,t=\d+,p=\d+\$", r.secret) for r in got)
    assert [min(r.n for r in got), max(r.n for r in got)] == [800000001000, 800000001499] and all(r.uid == str(r.n) for r in got)
    columns["flag"].unique = True
    with pytest.raises(GenerationError):
        run(spark, schema, plan)
    with pytest.raises(GenerationError, match="append"):
        run(spark, schema, plan, Options(append=True, truncate=True))


def test_repair_gives_way_to_originals(spark):
    def repaired(values):
        df = spark.createDataFrame(list(enumerate(values)), "id long, v string")
        return [r.v for r in unique.repair(df, "v", "id", "string").orderBy("id").collect()]

    # values that were there first stay; the changed one gives way once more
    assert repaired(["a", "a", "b", "a-1", "c"]) == ["a", "a-1-2", "b", "a-1", "c"]
    assert repaired(["a", None, None, "a"]) == ["a", None, None, "a-3"]
    folded = spark.createDataFrame([(0, "Bob"), (1, "bob"), (2, "x@y.z"), (3, "X@y.z")], "id long, v string")
    assert [r.v for r in unique.repair(folded, "v", "id", "string", folded=True).orderBy("id").collect()] == ["Bob", "bob-1", "x@y.z", "X+3@y.z"]
    long = spark.createDataFrame([(0, "abcdefgh@ex.com"), (1, "abcdefgh@ex.com")], "id long, v string")
    assert unique.repair(long, "v", "id", "string", max_len=15).where("id = 1").first().v == "abcdef+1@ex.com"
    numbers = spark.createDataFrame([(0, 5), (1, 5), (2, None), (3, 6)], "id long, v long")
    assert [r.v for r in unique.repair(numbers, "v", "id", "int").orderBy("id").collect()] == [5, 8, None, 6]
    with pytest.raises(unique.RepairError):
        unique.repair(numbers, "v", "id", "bool")


def test_uniqueness_by_construction_and_by_repair(spark):
    schema = ddl.parse_schema("CREATE TABLE t (u uuid NOT NULL UNIQUE, code int NOT NULL UNIQUE, few int NOT NULL UNIQUE, word varchar(6) NOT NULL UNIQUE, tiny varchar(2) NOT NULL)")
    plan = infer(schema)
    plan.seed, plan.tables["t"].rows = 5, 300
    plan.tables["t"].columns["few"].min, plan.tables["t"].columns["few"].max = 1, 10
    for how in ("construct", "repair"):
        made = run(spark, schema, plan, Options(uniqueness=how)).tables["t"]
        for column in ("u", "code", "few", "word"):
            assert checks.uniqueness(made, [column]).first().extra_rows == 0, (how, column)
        assert made.where("length(word) > 6 OR NOT u RLIKE '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'").isEmpty()
    plan.tables["t"].columns["tiny"].unique = True
    with pytest.raises(unique.RepairError):
        run(spark, schema, plan)


def test_append(spark):
    schema = ddl.parse_schema("CREATE TABLE t (id serial PRIMARY KEY, code int NOT NULL UNIQUE, email varchar(40) NOT NULL UNIQUE)")
    plan = infer(schema)
    plan.seed, plan.tables["t"].rows = 5, 100
    first = run(spark, schema, plan).tables["t"]
    second = run(spark, schema, plan, Options(append=True, existing={"t": first})).tables["t"]
    both = first.union(second)
    for column in ("id", "code", "email"):
        assert checks.uniqueness(both, [column]).first().extra_rows == 0
    assert second.agg(F.min("code")).first()[0] > first.agg(F.max("code")).first()[0]


def test_every_kind_gives_values(spark):
    df = spark.range(20).select(*[generate(k, Draws(F.col("id"), salt(1, k)), {"values": [1, 2]} if k == "enum" else {}).alias(k) for k in sorted(KINDS)])
    assert all(v is not None for r in df.collect() for v in r)
    assert set(KINDS) == set(OWN) == set(KINDS_SQL) == {k for names in GROUPS.values() for k in names.split()}
    for locale in LOCALES:
        for k in OWN:
            most = longest(k, locale)
            if most is not None:
                assert spark.range(300).select(generate(k, Draws(F.col("id"), 3, locale), {}).alias("v")).where(F.length("v") > most).isEmpty(), k
    register_generator("three", lambda d, o: F.lit(3))
    assert spark.range(1).select(generate("three", Draws(F.col("id"), 1), {})).first()[0] == 3
    del KINDS["three"]
    with pytest.raises(ValueError):
        generate("nonsense", Draws(F.lit(0), 1), {})
    iban, vin = spark.range(50).select(generate("iban", Draws(F.col("id"), 1), {}), generate("vin", Draws(F.col("id"), 2), {})).toPandas().T.values
    assert all(int(i[4:] + "1314" + i[2:4]) % 97 == 1 for i in iban) and all(len(v) == 17 for v in vin)


def test_unknown_locales_are_spoken_of(spark):
    plan = users_plan(3)
    plan.locale = "xx_XX"
    with pytest.warns(UserWarning, match="xx_XX"):
        assert run(spark, SCHEMA, plan).tables["users"].count() == 3


def test_clamp_by_bytes(spark):
    df = spark.createDataFrame([("aé日x",), ("ab",), (None,)], "v string")
    assert [r[0] for r in df.select(clamp_text(F.col("v"), 4, "bytes")).collect()] == ["aé", "ab", None]
    assert [r[0] for r in df.select(clamp_text(F.col("v"), 2)).collect()] == ["aé", "ab", None]
    assert spark.range(30).select(compile_pattern("(ab|c+){2}[^a-z]?", F.col("id"), 4).alias("v")).where("NOT v RLIKE '^(ab|c+){2}[^a-z]?$'").isEmpty()


def test_dump_files(spark, tmp_path):
    made = run(spark, SCHEMA, users_plan(20, 30))
    for fmt in ("csv", "json", "sql"):
        paths = export.dump(made.tables, made.order, str(tmp_path / fmt), fmt)
        assert [os.path.basename(p) for p in paths] == [f"01_users.{fmt}", f"02_orders.{fmt}"]
        again = export.dump(made.tables, made.order, str(tmp_path / "again"), fmt)
        assert [open(p).read() for p in paths] == [open(p).read() for p in again]
    got = list(csv.DictReader(open(tmp_path / "csv" / "01_users.csv")))
    assert len(got) == 20 and all(re.fullmatch(r"\d+\.\d\d", r["balance"]) for r in got)
    assert len(json.load(open(tmp_path / "json" / "02_orders.json"))) == 30
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE users (id BIGINT, email VARCHAR, first_name VARCHAR, last_name VARCHAR, city VARCHAR, phone VARCHAR, company VARCHAR, balance DECIMAL(10,2), is_active BOOLEAN, created_at TIMESTAMP)")
    con.execute(open(tmp_path / "sql" / "01_users.sql").read())
    assert con.execute("SELECT count(*) FROM users").fetchall() == [(20,)]
    with pytest.raises(KeyError):
        export.dump(made.tables, ["users", "none"], str(tmp_path / "failed"), "csv")
    assert not os.path.exists(tmp_path / "failed")
    statement = export.sql_inserts(spark.createDataFrame([("it's", None)], "a string, b int"), "t").first().statement
    assert statement == 'INSERT INTO "t" ("a", "b") VALUES\n(\'it\'\'s\', NULL);'


def test_single_files_of_odd_rows(spark, tmp_path):
    """Text that needs quotes, nulls, bytes, times, empty parts and tables."""
    kinds = "a string, b int, c boolean, d binary, e timestamp, `f,g` decimal(8,2), h double, i array<int>"
    texts = ["x,y", 'q"uo"te', "two\nlines", "", None, "it's", "é日", " pad ", "#", "\\"]
    data = [(t, k, k % 2 == 0, b"raw", datetime(2024, 1, 2, 3, 4, 5, 678), Decimal("1.50"), 0.1, [1, 2]) for k, t in enumerate(texts)] + [(None,) * 8]
    df = spark.createDataFrame(data, kinds).repartitionByRange(4, "b").unionAll(spark.createDataFrame([], kinds))
    tables = {"t": df.drop("i"), "u": df, "none": df.drop("i").limit(0)}
    order = ["t", "none"]
    read = lambda name: open(tmp_path / "out" / name, newline="").read()
    export.dump(tables, order, str(tmp_path / "out"), "csv")
    got = list(csv.reader(open(tmp_path / "out" / "01_t.csv", newline="")))
    assert got[0] == ["a", "b", "c", "d", "e", "f,g", "h"] and read("02_none.csv").count("\n") == 1
    by_b = {r[1]: r for r in got[1:]}
    assert [by_b[str(k)][0] for k in range(len(texts))] == [t or "" for t in texts] and by_b["0"][1:] == ["0", "true", "raw", "2024-01-02T03:04:05.000678Z", "1.50", "0.1"] and by_b[""] == [""] * 7
    export.dump({"u": df, "none": tables["none"]}, ["u", "none"], str(tmp_path / "out"), "json")
    back = json.load(open(tmp_path / "out" / "01_u.json"))
    assert sorted((r["a"] for r in back), key=str) == sorted([*texts, None], key=str) and json.load(open(tmp_path / "out" / "02_none.json")) == []
    assert list(back[0]) == ["a", "b", "c", "d", "e", "f,g", "h", "i"] and next(r for r in back if r["b"] == 0)["i"] == [1, 2] and next(r for r in back if r["b"] is None)["h"] is None
    export.dump(tables, order, str(tmp_path / "out"), "sql")
    assert read("02_none.sql") == "-- none: no rows\n"
    import duckdb

    con = duckdb.connect()
    con.execute('CREATE TABLE t (a VARCHAR, b INT, c BOOLEAN, d VARCHAR, e TIMESTAMP, "f,g" DECIMAL(8,2), h DOUBLE)')
    con.execute(read("01_t.sql"))
    assert sorted(con.execute("SELECT a FROM t").fetchall(), key=str) == sorted([(t,) for t in [*texts, None]], key=str)
    assert not list((tmp_path / "out").glob("*.parts")) and not list((tmp_path / "out").glob("*.crc"))


def test_repair_leaves_no_window(spark):
    """One value in nine of ten rows: no task gets them all."""
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, "same").otherwise(F.concat(F.lit("own"), "id")).alias("v"))
    out = unique.repair(df, "v", "id", "string")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 5000 and checks.uniqueness(out, ["v"]).first().extra_rows == 0
    assert out.where("v = 'same'").first().id == 1


def test_write_preview_and_dry_run(spark, tmp_path):
    plan = users_plan(10, 10)
    made = dry_run(run(spark, SCHEMA, plan))
    assert made.counts == {"users": 10, "orders": 10} and made.rows_per_second() > 0
    write_tables(made, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["orders", "users"]
    tables = catalog.parquet_tables(spark, "/root/testdata/sf0.001")
    assert len(tables) == 14 and catalog.profile_keys(tables["orders"], "orders").primary_key == ["o_orderkey"]
    shown = preview(spark, SCHEMA, plan, "orders", 5).collect()
    assert len(shown) == 5 and all(1 <= r.user_id <= 20 for r in shown)
    assert catalog.introspect({"users": made.tables["users"]}, SCHEMA).tables[0].column("email").unique
    history = catalog.migration_history({"goose_db_version": spark.createDataFrame([(1, None, True), (2, None, None)], "version_id long, tstamp timestamp, is_applied boolean")})
    assert [(r.version, r.applied) for r in history.collect()] == [("2", None), ("1", True)]


def test_draws_against_their_definition(spark):
    places = [0, 1, 5, 2**31 - 1 + 3, 2**31 + 3, 2 * (2**31 - 1) + 3, 2**33, 2**62]
    df = spark.createDataFrame([(r,) for r in places], "r long")
    got = df.select("r", draw.draw(F.col("r"), 77), draw.unit(F.col("r"), 77), draw.below(F.col("r"), 77, 9), draw.below(F.col("r"), 77, 10**12)).collect()
    for r, whole, unit, nine, wide in got:
        own = draw.hash_long(r, draw.hash_long(77, 42))
        assert (whole, unit, nine, wide) == (own >> 33, (own >> 11) * 2.0**-53, (own >> 33) % 9, (own >> 1) % 10**12)
    assert len({x[1] for x in got}) == len(places)
    import duckdb

    for r, whole, unit, _, wide in got:
        assert duckdb.sql(f"SELECT {draw.draw_sql(str(r), 77)}, {draw.unit_sql(str(r), 77)}, {draw.below_sql(str(r), 77, 10**12)}").fetchall() == [(whole, unit, wide)]


def test_generated_methods_are_small_enough_to_compile(spark):
    """HotSpot leaves methods of more than 8,000 bytes to the interpreter."""
    text = spark._jvm.PythonSQLUtils.explainString(run(spark, SCHEMA, users_plan(1000, 1000)).tables["users"]._jdf.queryExecution(), "codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8_000


def test_keys_that_are_functions_of_the_row_need_no_join(spark):
    schema = ddl.parse_schema(
        "CREATE TABLE p (id serial PRIMARY KEY, code varchar(20) NOT NULL UNIQUE, u uuid NOT NULL UNIQUE, n int); "
        "CREATE TABLE c (id serial PRIMARY KEY, p_id int NOT NULL REFERENCES p, p_code varchar(20) NOT NULL REFERENCES p (code), p_u uuid REFERENCES p (u)); "
        "CREATE TABLE one (p_id int PRIMARY KEY REFERENCES p, x int); CREATE TABLE pair (p_id int REFERENCES p, c_id int REFERENCES c, PRIMARY KEY (p_id, c_id))"
    )
    plan = infer(schema)
    plan.seed = 4
    for name, n in (("p", 300), ("c", 1000), ("one", 300), ("pair", 5000)):
        plan.tables[name].rows = n
    plan.tables["c"].columns["p_u"].null_rate = 0.1
    made = run(spark, schema, plan).tables
    for name in ("c", "one", "pair"):
        plan_text = made[name]._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan_text and "Join" not in plan_text, name
    for child, key, parent, parent_key in (("c", "p_id", "p", "id"), ("c", "p_code", "p", "code"), ("c", "p_u", "p", "u"), ("one", "p_id", "p", "id"), ("pair", "c_id", "c", "id")):
        assert checks.orphans(made[child], key, made[parent], parent_key).isEmpty(), (child, key)
    assert checks.one_to_one(made["one"], "p_id").first().one_to_one and checks.uniqueness(made["pair"], ["p_id", "c_id"]).first().extra_rows == 0
    assert made["c"].select("p_code").distinct().count() > 250 and 0 < made["c"].where("p_u IS NULL").count() < 200
    # parents that exist already are numbered and joined
    del plan.tables["p"]
    again = run(spark, schema, plan, Options(existing={"p": made["p"]})).tables
    assert checks.orphans(again["c"], "p_code", made["p"], "code").isEmpty() and rows(again["c"].select("p_id")) == rows(made["c"].select("p_id"))


def test_pools_are_numbered_in_order(spark):
    for values, kind in (([f"k{i:04}" for i in range(3000)] * 2 + [None], "string"), (list(range(0, 9000, 3)), "long"), ([], "long"), (["one"], "string")):
        pool = relate.indexed(spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(5), "v")
        assert [(r.i, r.key) for r in pool.orderBy("i").collect()] == list(enumerate(sorted({v for v in values if v is not None})))


def test_truncate_append_and_progress(spark, tmp_path):
    plan, path = users_plan(10, 20), str(tmp_path / "out")
    heard = []
    first = write_tables(run(spark, SCHEMA, plan), path, progress=lambda *x: heard.append(x[:2]))
    assert heard == [("users", 10), ("orders", 20)] and first.counts == dict(heard)
    with pytest.raises(GenerationError, match="exists"):
        write_tables(run(spark, SCHEMA, plan), path)
    held = {n: spark.read.parquet(f"{path}/{n}").cache() for n in ("users", "orders")}
    assert [df.count() for df in held.values()] == [10, 20]
    write_tables(run(spark, SCHEMA, plan, Options(seed=9, append=True, existing=held)), path)
    for df in held.values():
        df.unpersist()
    both = spark.read.parquet(f"{path}/users")
    assert both.count() == 20 and checks.uniqueness(both, ["id"]).first().extra_rows == 0 and checks.uniqueness(both, ["email"]).first().extra_rows == 0
    write_tables(run(spark, SCHEMA, plan, Options(seed=9, truncate=True)), path)
    assert spark.read.parquet(f"{path}/orders").count() == 20
    plan.tables["users"].truncate = True
    with pytest.raises(GenerationError, match="orders exists"):
        write_tables(run(spark, SCHEMA, plan), path)
    with pytest.raises(GenerationError, match="append and truncate"):
        run(spark, SCHEMA, plan, Options(append=True))


def streamed(df, name):
    query = df.writeStream.format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_streamed_rows_are_the_rows_of_the_batch(spark, tmp_path):
    """All columns: unique mail, keys of made parents and of finished ones, references within a table, patterns."""
    schema = ddl.parse_schema(
        "CREATE TABLE users (id bigserial PRIMARY KEY, email varchar(120) NOT NULL UNIQUE, code varchar(9) NOT NULL UNIQUE, number int UNIQUE, boss bigint REFERENCES users(id));"
        "CREATE TABLE orders (id bigserial PRIMARY KEY, user_id bigint NOT NULL REFERENCES users(id), mail varchar(120) REFERENCES users(email), shop int NOT NULL REFERENCES shops(id), total decimal(10,2), at timestamp);"
        "CREATE TABLE shops (id int PRIMARY KEY, name text)"
    )
    plan = infer(schema)
    plan.seed, plan.tables["users"].rows, plan.tables["orders"].rows = 42, 2000, 300
    plan.tables["shops"].skip = True
    plan.tables["users"].columns["code"] = ColumnPlan("pattern", pattern="^[a-z]{1,3}$", unique=True)
    options = Options(existing={"shops": spark.range(5, 60, 5).selectExpr("CAST(id AS INT) AS id")})
    batch = run(spark, schema, plan, options).tables
    for part in range(3):  # several batches of the stream, ids beyond the plan's rows among them
        spark.range(part * 700, (part + 1) * 700).withColumnRenamed("id", "_row").coalesce(2).write.mode("append").parquet(str(tmp_path / "ids"))
    for name in ("users", "orders"):
        ids = spark.readStream.schema("_row long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "ids"))
        made = streamed(stream_columns(ids, schema, plan, name, options), f"made_{name}")
        assert sorted(map(str, made.collect())) == sorted(map(str, batch[name].collect()))
    assert checks.uniqueness(spark.table("made_users"), ["email"]).first().extra_rows == 0


def test_streams_keep_uniqueness_in_state(spark, tmp_path):
    schema = ddl.parse_schema("CREATE TABLE t (id bigserial PRIMARY KEY, name varchar(40) UNIQUE, town varchar(40) UNIQUE, n int UNIQUE)")
    plan = infer(schema)
    plan.seed, plan.tables["t"].rows = 5, 900
    columns = plan.tables["t"].columns
    columns["name"], columns["town"] = ColumnPlan("firstname", unique=True, null_rate=0.2), ColumnPlan("city", unique=True)
    columns["n"].skip = columns["town"].skip = True
    for part in range(3):
        spark.range(part * 300, (part + 1) * 300, 1, 1).withColumnRenamed("id", "_row").write.mode("append").parquet(str(tmp_path / "ids"))
        time.sleep(1.1)  # a stream takes files in the order of their times
    ids = spark.readStream.schema("_row long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ids"))
    repaired = Options(uniqueness="repair")
    made = streamed(stream_columns(ids, schema, plan, "t", repaired), "kept_unique")
    assert made.count() == 900 and made.where("name IS NULL").count() > 100
    assert checks.uniqueness(made, ["name"]).first().extra_rows == 0
    assert rows(made) == rows(run(spark, schema, plan, repaired).tables["t"])
    columns["town"].skip = False
    with pytest.raises(GenerationError, match="name, town"):
        stream_columns(ids, schema, plan, "t", repaired)
    columns["n"].skip, columns["name"].skip, columns["town"].skip = False, True, True
    with pytest.raises(GenerationError, match="in a stream"):
        stream_columns(ids, schema, plan, "t", repaired)


def test_a_finished_stream_stands_in_files(spark, tmp_path):
    """Rows of the stream are written by tasks, whatever their number, and stay out of the driver."""
    made = QUERIES["stream_rows"](spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert made.inputFiles() and all(spark.conf.get("spark.checkpoint.dir") in file for file in made.inputFiles())
    assert rows(made.select("id")) == rows(orders.selectExpr("o_orderkey + 1"))
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert finished(spark.readStream.schema("id long").parquet(str(tmp_path / "none"))).collect() == []


def test_windowed_counts(spark, tmp_path):
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    query = windowed_counts(events, "ts", "event_type", "1 day").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_checks_on_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "A"), (None, "b"), (None, "b")], "k int, v string")
    assert rows(checks.duplicates(df, ["k"])) == [(1, 2)] and rows(checks.duplicates(df, ["v"], folded=True)) == [("a", 2), ("b", 2)]
    empty = df.limit(0)
    assert checks.uniqueness(empty, ["k"]).first().rows == 0 and checks.null_rates(empty, ["k"]).first().rate == 0.0
    assert checks.orphan_count("e", df, "k", empty, "k").first().orphans == 2
    assert checks.differences(df, df).isEmpty() and checks.differences(df, empty).count() == 4
    assert checks.check_violations(df, "k > 1").first().violations == 2
    assert table_seed(0, "") != 0


def test_unique_patterns_are_unique_or_refused(spark):
    schema = ddl.parse_schema("CREATE TABLE a (nick varchar(30) NOT NULL UNIQUE, code varchar(40) NOT NULL UNIQUE, word varchar(30) NOT NULL UNIQUE)")
    plan = infer(schema)
    plan.seed, plan.tables["a"].rows = 1, 500
    columns = plan.tables["a"].columns
    columns["nick"] = ColumnPlan("pattern", pattern="^[a-z]{2}$", unique=True)
    columns["code"] = ColumnPlan("pattern", pattern=r"^(AB|CD)?x\d{9}-[A-F]{4}$", unique=True)
    columns["word"] = ColumnPlan("pattern", pattern=r"^[A-Z]{3}-(\d{4}[a-f]){3}$", unique=True)
    made = run(spark, schema, plan).tables["a"]
    for r in made.collect():
        assert re.fullmatch("[a-z]{2}", r.nick) and re.fullmatch(r"(AB|CD)?x\d{9}-[A-F]{4}", r.code) and re.fullmatch(r"[A-Z]{3}-(\d{4}[a-f]){3}", r.word)
    for name in ("nick", "code", "word"):
        assert checks.uniqueness(made, [name]).first().extra_rows == 0, name
    plan.tables["a"].rows = 677
    with pytest.raises(GenerationError, match="677 rows cannot"):
        run(spark, schema, plan)
    plan.tables["a"].rows = 500
    with pytest.raises(unique.RepairError, match="nick: values are still duplicated"):
        run(spark, schema, plan, Options(uniqueness="repair"))
    columns["nick"] = ColumnPlan("pattern", pattern="^[ab]{1,3}$", unique=True)
    with pytest.raises(GenerationError, match="500 rows cannot"):
        run(spark, schema, plan)


def test_repair_refuses_what_it_cannot_end(spark):
    short = spark.createDataFrame([(i, "a") for i in range(12)], "id long, v string")
    with pytest.raises(unique.RepairError, match="still duplicated"):
        unique.repair(short, "v", "id", "string", max_len=1)
    new, held = spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([("a",), ("a-1",)], "v string")
    with pytest.raises(unique.RepairError, match="existing"):
        unique.append_unique(new, "v", "id", held)
