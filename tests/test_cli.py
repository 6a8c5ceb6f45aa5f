from rowforge.__main__ import main


def test_scan_validate_dump(spark, tmp_path, capsys):
    schema, plan = tmp_path / "schema.sql", tmp_path / "plan.json"
    schema.write_text("CREATE TABLE users (id serial PRIMARY KEY, email varchar(40) NOT NULL UNIQUE); CREATE TABLE orders (id serial PRIMARY KEY, user_id int NOT NULL REFERENCES users)")
    common = ["--schema", str(schema), "--plan", str(plan)]
    assert main(["scan", *common]) == 0 and plan.exists()
    assert main(["validate", *common]) == 0
    assert main(["dump", *common, "-o", str(tmp_path / "out"), "--rows", "5", "--seed", "3"]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["01_users.csv", "02_orders.csv"]
    run = ["run", *common, "-o", str(tmp_path / "made"), "--rows", "4", "--seed", "3"]
    assert main(run) == 0 and "users: 4 rows" in capsys.readouterr().err
    assert main([*run, "--append", "--quiet"]) == 0 and capsys.readouterr().err == ""
    assert spark.read.parquet(str(tmp_path / "made" / "users")).select("email").distinct().count() == 8
    assert main([*run, "--truncate", "--locale", "de_DE"]) == 0 and spark.read.parquet(str(tmp_path / "made" / "orders")).count() == 4
    assert main(["script", *common, "--dialect", "mysql"]) == 0 and "`email` varchar(40)" in capsys.readouterr().out
    plan.write_text(plan.read_text().replace('"email"', '"mail"'))
    assert main(["validate", *common]) == 1 and "no such column" in capsys.readouterr().out
    assert main(["version"]) == 0


def test_check_discover_and_load(spark, tmp_path, capsys):
    schema, data = tmp_path / "schema.sql", tmp_path / "data"
    schema.write_text("CREATE TABLE users (id bigint PRIMARY KEY, email varchar(9) NOT NULL UNIQUE); CREATE TABLE orders (id bigint PRIMARY KEY, user_id bigint NOT NULL REFERENCES users(id))")
    spark.range(40).selectExpr("id", "concat('u', id) AS email").write.parquet(str(data / "users.parquet"))
    spark.range(90).selectExpr("id", "id % 40 AS user_id").write.parquet(str(data / "orders"))
    check = ["check", "--schema", str(schema), "--data", str(data)]
    assert main(check) == 0 and "no rule is broken" in capsys.readouterr().out
    spark.range(3).selectExpr("id", "CAST(NULL AS STRING) AS email").write.mode("append").parquet(str(data / "users.parquet"))
    assert main(check) == 1 and "users: primary key id: 3 of 43 rows" in capsys.readouterr().out
    plan = tmp_path / "plan.json"
    spark.range(90).selectExpr("id AS order_id", "id % 40 AS user_id").write.parquet(str(tmp_path / "found" / "orders.parquet"))
    assert main(["scan", "--schema", str(tmp_path / "found"), "--plan", str(plan), "--discover"]) == 0 and "order_id" in plan.read_text()
    url, driver = "jdbc:derby:memory:cli;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    run = ["run", "--schema", str(schema), "--plan", str(tmp_path / "p2.json"), "-o", str(tmp_path / "files"), "--rows", "7", "--seed", "3", "--dsn", url, "--driver", driver]
    assert main(run) == 0 and "seed 3: users, orders" in capsys.readouterr().out
    assert spark.read.format("jdbc").options(url=url, dbtable="users", driver=driver).load().count() == 7
