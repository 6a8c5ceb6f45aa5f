"""Loading as a unit, against the database that Spark brings along for its catalog, in memory."""

import pytest
from pyspark.sql import functions as F

from rowforge.operators import checks, load
from rowforge.operators.generate import GenerationError, Options
from rowforge.operators.generate import generate as run
from rowforge.queries import SCHEMA, users_plan
from rowforge.sources.catalog import jdbc_table

OPTIONS = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
NAMES = {"users": "USERS_T", "orders": "ORDERS_T"}


def url(name):
    return f"jdbc:derby:memory:{name};create=true"


def read(spark, at, name):
    return jdbc_table(spark, at, NAMES[name], **OPTIONS)


def test_all_tables_come_whole_and_staging_goes(spark, tmp_path):
    at, heard = url("whole"), []
    made = run(spark, SCHEMA, users_plan(300, 500))
    done = load.load_tables(made, at, str(tmp_path / "a"), names=NAMES, progress=lambda *x: heard.append(x[:2]), **OPTIONS)
    assert done.rows == {"users": 300, "orders": 500} and heard == [("users", 300), ("orders", 500)]
    assert sorted(map(str, read(spark, at, "users").select("id", "email").collect())) == sorted(map(str, made.tables["users"].select("id", "email").collect()))
    assert checks.orphans(read(spark, at, "orders"), "user_id", read(spark, at, "users"), "id").isEmpty()
    database = load.Database(spark, at, OPTIONS)
    assert all(database.number(f"SELECT count(*) FROM {stage}") is None for stage in done.staged) and len(done.staged) == 2
    with pytest.raises(GenerationError, match="holds rows"):
        load.load_tables(made, at, str(tmp_path / "b"), names=NAMES, **OPTIONS)
    again = run(spark, SCHEMA, users_plan(40, 60), Options(truncate=True))
    assert load.load_tables(again, at, str(tmp_path / "c"), names=NAMES, **OPTIONS).rows == {"users": 40, "orders": 60}
    assert read(spark, at, "users").count() == 40 and read(spark, at, "orders").count() == 60
    with pytest.raises(PermissionError):
        load.load_tables(made, "jdbc:postgresql://db.example.com/live", str(tmp_path / "d"))


def test_a_task_that_ran_twice_leaves_no_row_twice(spark, tmp_path, monkeypatch):
    at, real = url("twice"), load._stage

    def twice(df, to, table, batch, options):
        real(df, to, table, batch, options)
        if load.PLACE in df.columns:  # what the first task wrote before it was lost, beside its second attempt
            real(df.where(F.spark_partition_id() == 0), to, table, batch, options)

    monkeypatch.setattr(load, "_stage", twice)
    done = load.load_tables(run(spark, SCHEMA, users_plan(200, 100)), at, str(tmp_path / "a"), names=NAMES, **OPTIONS)
    assert done.rows == {"users": 200, "orders": 100} and read(spark, at, "users").select("id").distinct().count() == read(spark, at, "users").count() == 200


def test_a_load_that_fails_changes_nothing_and_is_taken_up(spark, tmp_path, monkeypatch):
    at, real, path = url("fails"), load._stage, str(tmp_path / "a")
    first = run(spark, SCHEMA, users_plan(20, 10))
    load.load_tables(first, at, str(tmp_path / "first"), names=NAMES, **OPTIONS)
    made = run(spark, SCHEMA, users_plan(200, 100), Options(truncate=True))

    def dies(df, to, table, batch, options):
        real(df.where(F.spark_partition_id() == 0) if table.startswith("orders") else df, to, table, batch, options)
        if table.startswith("orders"):
            raise load.LoadError("lost")

    monkeypatch.setattr(load, "_stage", dies)
    with pytest.raises(load.LoadError, match="lost"):
        load.load_tables(made, at, path, names=NAMES, **OPTIONS)
    assert read(spark, at, "users").count() == 20 and read(spark, at, "orders").count() == 10
    monkeypatch.setattr(load, "_stage", lambda df, *a: real(df.limit(50) if load.PLACE in df.columns else df, *a))
    with pytest.raises(load.LoadError, match="50 of 200 rows"):
        load.load_tables(made, at, path, names=NAMES, **OPTIONS)
    monkeypatch.setattr(load, "_stage", real)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "a").rglob("*.parquet")}
    assert load.load_tables(made, at, path, names=NAMES, **OPTIONS).rows == {"users": 200, "orders": 100}
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "a").rglob("*.parquet")}
    assert read(spark, at, "users").count() == 200
