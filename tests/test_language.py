"""Words of patterns by number, and references within one table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rowforge.functions.language import language, word_at
from rowforge.functions.pattern import PatternError
from rowforge.operators import checks, forest, relate
from rowforge.operators.forest import forest_report, jump
from rowforge.operators.generate import GenerationError, Options
from rowforge.operators.generate import generate as run
from rowforge.plans import ddl
from rowforge.plans.plan import ColumnPlan, infer

PATTERNS = ["^[a-z]{1,2}$", "^(ab|a)(c|bc)?$", "^a?a?a?b*$", r"^(x|[0-9]{1,2})(-[A-C])?$", r"^\d-[A-Z]$", "^$", "^(foo|fo+)$", "^[^!-z]?['\\\\]$", "^(a|b){2,3}(c(d|)){1}$"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_every_word_once_in_order(spark, pattern):
    own = language(pattern)
    words = [own.word(k) for k in range(own.total)]
    assert words == sorted(set(words), key=lambda w: (len(w), w)) and all(re.fullmatch(pattern, w) for w in words)
    got = spark.range(own.total).select("id", word_at(own, F.col("id")).alias("w")).orderBy("id").collect()
    assert [r.w for r in got] == words


def test_counts_are_of_texts_and_not_of_ways():
    assert language("^[a-z]{1,3}$").total == 26 + 26**2 + 26**3
    assert language("^(a|a|aa)(a|)$").total == 3  # a, aa, aaa
    assert language("^[a-z]{1,9}$", max_len=2).total == 26 + 26**2
    assert language("^[A-Za-z]{2}$", folded=True).total == 26**2
    big = language(r"^[A-Za-z0-9._%+-]{8,30}@[a-z]{3,20}\.(com|org)$")
    assert big.total == 1 << 62 and re.fullmatch(r"[A-Za-z0-9._%+-]{8,30}@[a-z]{3,20}\.(com|org)", big.word(10**18))
    with pytest.raises(PatternError):
        language("((((a{9}){9}){9}){9})")
    with pytest.raises(PatternError):
        language(r"(a)\1")


def test_unique_patterns_of_any_shape_fill_their_language(spark):
    """All words of three lengths, in as many rows, without an exchange."""
    schema = ddl.parse_schema("CREATE TABLE a (nick varchar(30) NOT NULL UNIQUE, code varchar(3) NOT NULL UNIQUE, mixed varchar(9) NOT NULL)")
    schema.table("a").column("mixed").unique_fold = True
    plan = infer(schema)
    plan.seed, plan.tables["a"].rows = 1, 18_278
    columns = plan.tables["a"].columns
    columns["nick"] = ColumnPlan("pattern", pattern="^[a-z]{1,3}$", unique=True)
    columns["code"] = ColumnPlan("pattern", pattern="^[a-z0-9]{1,6}$", unique=True)
    columns["mixed"] = ColumnPlan("pattern", pattern="^[A-Za-z]{2,4}$")
    made = run(spark, schema, plan).tables["a"]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    for name in ("nick", "code"):
        assert checks.uniqueness(made, [name]).first().distinct_keys == 18_278
    assert checks.uniqueness(made, ["mixed"], folded=True).first().extra_rows == 0
    assert made.where("NOT nick RLIKE '^[a-z]{1,3}$' OR NOT code RLIKE '^[a-z0-9]{1,3}$' OR NOT mixed RLIKE '^[A-Za-z]{2,4}$'").isEmpty()
    plan.tables["a"].rows = 18_279
    with pytest.raises(GenerationError, match="18279 rows cannot"):
        run(spark, schema, plan)


def test_references_within_a_table_form_a_forest(spark):
    schema = ddl.parse_schema(
        "CREATE TABLE c (id serial PRIMARY KEY, parent_id int REFERENCES c, boss int NOT NULL REFERENCES c, next int UNIQUE REFERENCES c);"
        "CREATE TABLE p (id serial PRIMARY KEY, c_id int NOT NULL REFERENCES c); CREATE TABLE k (code uuid PRIMARY KEY, up uuid REFERENCES k(code))"
    )
    plan = infer(schema)
    plan.seed = 3
    plan.tables["c"].rows, plan.tables["p"].rows, plan.tables["k"].rows = 3000, 50, 700
    made = run(spark, schema, plan).tables
    assert "Join" not in made["c"]._jdf.queryExecution().executedPlan().toString()
    for column in ("parent_id", "boss", "next"):
        found = forest_report(made["c"], "id", column).first()
        assert (found.rows, found.orphans, found.in_cycles) == (3000, 0, 0) and 1 <= found.depth <= 7
    assert made["c"].where("boss IS NULL").isEmpty() and made["c"].where("boss = id").count() == 8
    assert checks.uniqueness(made["c"], ["next"]).first().extra_rows == 0
    assert made["p"].where("c_id IS NULL").isEmpty()
    keys = forest_report(made["k"], "code", "up").first()
    assert keys.orphans == keys.in_cycles == 0 and keys.depth >= 2
    # beside existing rows, new ones refer to those
    held = {"c": spark.range(1, 101).selectExpr("CAST(id AS INT) AS id")}
    more = run(spark, schema, plan, Options(append=True, existing=held)).tables["c"]
    assert more.agg(F.min("id")).first()[0] == 101 and more.where("parent_id IS NULL OR parent_id > 100").isEmpty()


def test_levels_of_a_forest():
    assert relate.levels(1) == [0] and relate.levels(8) == [0] and relate.levels(9) == [0, 8] and relate.levels(10**6)[-1] < 10**6 and len(relate.levels(10**6)) == 7


def plain_forest(rows):
    parents = {}
    for key, parent in rows:
        if key is not None:
            old = parents.get(key)
            parents[key] = parent if old is None else old if parent is None else max(old, parent)
    out = {}
    for key in parents:
        at, depth, seen = key, 0, set()
        while True:
            up = parents[at]
            if up is None or up == at:
                out[key] = (at, depth, "root" if depth == 0 else "under")
                break
            if up not in parents:
                out[key] = (at, depth, "orphan" if depth == 0 else "under orphan")
                break
            if at in seen:
                out[key] = (None, None, "cycle")
                break
            seen.add(at)
            at, depth = up, depth + 1
    return out


def test_pointer_jumping_against_plain_walks(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 4), (5, 99), (6, 5), (7, 8), (8, 9), (9, 7), (10, 7), (11, 10), (None, 1), (2, None)]
    rows += [(100 + k, 99 + k if k else 3) for k in range(70)] + [(1000 + k, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, p long")
    assert {r.key: (r.root, r.depth, r.state) for r in jump(df, "k", "p").collect()} == plain_forest(rows)
    assert forest_report(df, "k", "p").first().in_cycles == 5
    assert forest_report(df.limit(0), "k", "p").first().asDict() == {"rows": 0, "roots": 0, "orphans": 0, "in_cycles": 0, "depth": None}


def test_rounds_of_a_forest_neither_swell_the_plan_nor_go_on_after_the_depth(spark, monkeypatch):
    stored, made, dropped = forest.stored, [], []
    monkeypatch.setattr(forest, "stored", lambda df: made.append(stored(df)) or made[-1])
    monkeypatch.setattr(forest, "drop_stored", dropped.append)
    dice = random.Random(4)
    rows = [(k, dice.randrange(300) if k % 11 else None) for k in range(3000)] + [(5001, 5000), (5000, 5001)] + [(6000 + k, 6000 + (k + 1) % 7) for k in range(7)]
    df, plain = spark.createDataFrame(rows, "k long, p long"), plain_forest(rows)
    found = jump(df, "k", "p")
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
    assert {r.key: (r.root, r.depth, r.state) for r in found.collect()} == plain
    deepest = max(depth for _, depth, _ in plain.values() if depth is not None)
    # keys, all rows, those that others refer to, and a round for each digit of the depth and for the cycles; all but all rows and the last are dropped
    assert len(made) <= 3 + deepest.bit_length() + 1 < 11 and len(dropped) == len(made) - 2
    assert made[2].count() <= 309


def test_long_chains_beside_cycles(spark):
    for n in (1, 2, 3, 4, 5, 8, 9, 33):
        rows = [(k, k - 1) for k in range(1, n)] + [(0, None), (100, 101), (101, 100), (102, 101)] + [(200 + k, 199 + k if k else 999) for k in range(n)]
        assert {r.key: (r.root, r.depth, r.state) for r in jump(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()} == plain_forest(rows)
    assert forest_report(spark.sql("SELECT id AS k, NULL AS p FROM range(3)"), "k", "p").first().roots == 3
