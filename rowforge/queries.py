"""Registered queries of the engine and their twins in SQL."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.functions.draw import P, below_sql, draw, draw_sql, salt, table_seed, unit_sql
from rowforge.functions.kinds import Draws, generate
from rowforge.functions.kinds_sql import KINDS_SQL, SqlDraws
from rowforge.functions.language import language, word_at
from rowforge.functions.pattern import compile_pattern
from rowforge.functions.scalars import clamp_text, round_scale
from rowforge.operators import audit, checks, discover, export, forest, relate, unique
from rowforge.operators import generate as engine
from rowforge.operators.cut import finished
from rowforge.plans import ddl
from rowforge.plans.model import Schema, Table, classify
from rowforge.plans.plan import ColumnPlan, infer, merge, table_order, validate
from rowforge.sources import catalog
from rowforge.streaming.stream import stream_columns, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEED = table_seed(7, "orders")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def _on(table: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_table(spark, sf_dir, table))


#: child table, column, parent table, column
EDGES = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
]


def _edge(spark: SparkSession, sf_dir: str, edge: tuple[str, str, str, str]) -> DataFrame:
    child, key, parent, parent_key = edge
    return checks.orphan_count(f"{child}.{key}", _table(spark, sf_dir, child), key, _table(spark, sf_dir, parent), parent_key)


def _edge_sql(edge: tuple[str, str, str, str]) -> str:
    child, key, parent, parent_key = edge
    return (
        f"SELECT '{child}.{key}' AS edge, count(c.{key}) AS checked, count(*) FILTER (WHERE c.{key} IS NOT NULL AND p.k IS NULL) AS orphans "
        f"FROM {child} c LEFT JOIN (SELECT DISTINCT {parent_key} AS k FROM {parent}) p ON p.k = c.{key}"
    )


def _fk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {table for child, _, parent, _ in EDGES for table in (child, parent)}
    return checks.orphan_report({n: _table(spark, sf_dir, n) for n in names}, EDGES)


_add("check_fk_report", _fk_report, " UNION ALL ".join(map(_edge_sql, EDGES)))
for _e in EDGES:
    _add(f"check_fk_orphans_{_e[0]}_{_e[1]}", lambda s, d, e=_e: _edge(s, d, e), _edge_sql(_e))

_add(
    "check_fk_orphan_rows",
    lambda s, d: checks.orphans(_table(s, d, "lineitem"), "l_linenumber", _table(s, d, "region"), "r_regionkey").select("l_orderkey", "l_linenumber"),
    "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_linenumber IS NOT NULL AND NOT EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey = l.l_linenumber)",
)
_add(
    "check_self_reference",
    lambda s, d: checks.orphans((c := _table(s, d, "customer").select("c_custkey", (F.col("c_custkey") * 2).alias("referrer"))), "referrer", c, "c_custkey"),
    "SELECT c_custkey, c_custkey * 2 AS referrer FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer p WHERE p.c_custkey = c.c_custkey * 2)",
)
_add(
    "check_pk_duplicates",
    _on("lineitem", lambda t: checks.duplicates(t, ["l_orderkey", "l_linenumber"])),
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)


def _unique_sql(table: str, keys: list[str], shown: list[str]) -> str:
    return (
        f"SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicated_keys, "
        f"CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT {', '.join(shown)}, count(*) AS n FROM {table} "
        f"WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY ALL)"
    )


_add("check_composite_unique", _on("lineitem", lambda t: checks.uniqueness(t, ["l_orderkey", "l_linenumber"])), _unique_sql("lineitem", ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"]))
_add("check_unique_key", _on("orders", lambda t: checks.uniqueness(t, ["o_orderkey"])), _unique_sql("orders", ["o_orderkey"], ["o_orderkey"]))
_add("check_unique_fold", _on("customer", lambda t: checks.uniqueness(t, ["c_mktsegment"], folded=True)), _unique_sql("customer", ["c_mktsegment"], ["lower(c_mktsegment) AS k"]))
_add(
    "check_one_to_one",
    _on("orders", lambda t: checks.one_to_one(t, "o_custkey")),
    "SELECT count(o_custkey) AS rows, count(DISTINCT o_custkey) AS distinct_keys, count(o_custkey) = count(DISTINCT o_custkey) AS one_to_one FROM orders",
)
_add(
    "check_value_range",
    _on("lineitem", lambda t: checks.value_range(t, ["l_quantity", "l_discount", "l_shipdate"])),
    "SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_discount) AS min_l_discount, max(l_discount) AS max_l_discount, "
    "min(l_shipdate) AS min_l_shipdate, max(l_shipdate) AS max_l_shipdate FROM lineitem",
)
_NULLABLE = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_add(
    "check_null_rate",
    _on("orders", lambda t: checks.null_rates(t, _NULLABLE)),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, (count(*) - count({c})) / count(*)::DOUBLE AS rate FROM orders" for c in _NULLABLE),
)


def _rule_sql(table: str, rule: str, failed: str) -> str:
    return f"SELECT '{rule}' AS rule, count(*) AS rows, count(*) FILTER (WHERE {failed}) AS violations FROM {table}"


_add("check_pattern", _on("customer", lambda t: checks.pattern_violations(t, "c_name", "^Customer#[0-9]+$")), _rule_sql("customer", "c_name ~ ^Customer#[0-9]+$", "NOT regexp_matches(c_name, '^Customer#[0-9]+$')"))
_add("check_length", _on("documents", lambda t: checks.length_violations(t, "text", 2000)), _rule_sql("documents", "chars(text) <= 2000", "length(text) > 2000"))
_add("check_length_bytes", _on("documents", lambda t: checks.length_violations(t, "text", 2000, "bytes")), _rule_sql("documents", "bytes(text) <= 2000", "strlen(text) > 2000"))
_add("check_enum", _on("orders", lambda t: checks.enum_violations(t, "o_orderstatus", ["F", "O"])), _rule_sql("orders", "o_orderstatus in list", "o_orderstatus NOT IN ('F', 'O')"))
_add("check_cross_column", _on("lineitem", lambda t: checks.check_violations(t, "l_discount <= l_tax + 0.05")), _rule_sql("lineitem", "l_discount <= l_tax + 0.05", "NOT (l_discount <= l_tax + 0.05)"))
_add(
    "check_spread",
    _on("orders", lambda t: checks.spread(t, "o_custkey")),
    "SELECT count(*) AS parents, min(n) AS least, max(n) AS most, avg(n) AS mean FROM (SELECT count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)",
)
_add("key_pool", _on("customer", lambda t: checks.key_pool(t, "c_custkey", 100)), "SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL ORDER BY 1 LIMIT 100")
_add("max_value", _on("orders", lambda t: checks.max_value(t, "o_orderkey")), "SELECT max(o_orderkey) AS max_value, count(o_orderkey) AS n FROM orders")
_COUNTED = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]
_add("table_counts", lambda s, d: checks.table_counts({n: _table(s, d, n) for n in _COUNTED}), " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in _COUNTED))

# --- all rules of a schema at once ---------------------------------------------------------------
#: the rules of the given tables; some are broken by their rows, so that there is something to count
RULES = """
CREATE TABLE region (r_regionkey int PRIMARY KEY, r_name varchar(8) NOT NULL);
CREATE TABLE nation (n_nationkey int PRIMARY KEY, n_name text NOT NULL UNIQUE, n_regionkey int NOT NULL REFERENCES region(r_regionkey));
CREATE TABLE customer (c_custkey bigint PRIMARY KEY, c_name varchar(18) NOT NULL CHECK (c_name ~ '^Customer#[0-9]+$'), c_nationkey int REFERENCES nation(n_nationkey),
  c_acctbal numeric(6, 2), c_mktsegment enum('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY') NOT NULL);
CREATE TABLE supplier (s_suppkey bigint PRIMARY KEY, s_name text UNIQUE, s_nationkey int NOT NULL REFERENCES nation(n_nationkey), s_acctbal double CHECK (s_acctbal >= 0));
CREATE TABLE part (p_partkey bigint PRIMARY KEY, p_name text UNIQUE, p_brand varchar(7), p_type text, p_size int CHECK (p_size BETWEEN 1 AND 40), p_retailprice numeric(10, 2));
CREATE TABLE orders (o_orderkey bigint PRIMARY KEY, o_custkey bigint NOT NULL UNIQUE REFERENCES customer(c_custkey), o_orderstatus enum('F', 'O'), o_totalprice numeric(12, 2),
  o_orderdate timestamp NOT NULL, o_orderpriority varchar(6));
CREATE TABLE lineitem (l_orderkey bigint REFERENCES orders(o_orderkey), l_partkey bigint REFERENCES part(p_partkey), l_suppkey bigint REFERENCES supplier(s_suppkey), l_linenumber int REFERENCES region(r_regionkey),
  l_quantity double CHECK (l_quantity < 45), l_extendedprice double, l_discount double, l_tax double, l_returnflag enum('A', 'N'), l_linestatus text, l_shipdate timestamp,
  PRIMARY KEY (l_orderkey, l_linenumber), CHECK (l_discount <= l_tax + 0.05));
CREATE TABLE events (event_id bigint PRIMARY KEY, ts timestamp NOT NULL UNIQUE, user_id bigint REFERENCES customer(c_custkey), event_type enum('click', 'view'), value double CHECK (value >= 1), props text);
CREATE TABLE documents (doc_id bigint PRIMARY KEY, text varchar(2000) NOT NULL UNIQUE, lang varchar(2), source text, n_chars bigint, CHECK (n_chars = length(text)));
CREATE TABLE embeddings (vec_id bigint PRIMARY KEY, label int NOT NULL);
CREATE TABLE pages (page_id bigint PRIMARY KEY, url text UNIQUE CHECK (url ~ '^https://'), html varchar(4000) NOT NULL);
CREATE TABLE benchmark (item_id bigint PRIMARY KEY, text text UNIQUE);
CREATE TABLE labels (doc_id bigint PRIMARY KEY REFERENCES documents(doc_id), quality int CHECK (quality IN (0, 1)), toxic int CHECK (toxic = 0));
CREATE TABLE conversations (conv_id bigint, turn bigint CHECK (turn < 5), role enum('user', 'assistant'), text text NOT NULL, PRIMARY KEY (conv_id, turn));
"""
_RULED = ddl.parse_schema(RULES)


def _rules_sql() -> str:
    """Each rule by a query of its own."""
    out = []
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    for t in _RULED.tables:
        row = []
        for c in t.columns:
            row += [(f"{c.name} is not null", f"{c.name} IS NULL")] if not c.nullable else []
            row += [(f"{c.name} has at most {c.max_len} characters", f"length({c.name}) > {c.max_len}")] if c.max_len else []
            row += [(f"{c.name} has at most {c.precision - c.scale} digits before the point", f"abs({c.name}) >= 1e{c.precision - c.scale}")] if c.precision else []
            row += [(f"{c.name} is in its list", f"{c.name} NOT IN ({', '.join(map(quoted, c.enum))})")] if c.enum else []
        for k in t.checks:
            text = re.sub(r"^(\w+) ~ (.*)$", r"regexp_matches(\1, \2)", k.expression)
            row.append((f"check {k.expression}", f"NOT ({text})"))
        out += [f"SELECT '{t.name}' AS table_name, {quoted(rule)} AS rule, count(*) AS rows, count(*) FILTER (WHERE {failed}) AS violations FROM {t.name}" for rule, failed in row]
        keys = [(f"primary key {', '.join(t.primary_key)}", t.primary_key)] + [(f"unique {c.name}", [c.name]) for c in t.columns if c.unique]
        for rule, key in keys:
            whole = " AND ".join(f"{k} IS NOT NULL" for k in key)
            out.append(f"SELECT '{t.name}', '{rule}', count(*), count(*) - count(DISTINCT ({', '.join(key)})) FROM {t.name} WHERE {whole}")
        for c in t.columns:
            if c.references:
                parent, key = c.references.split(".")
                lost = f"count(*) FILTER (WHERE {c.name} NOT IN (SELECT {key} FROM {parent} WHERE {key} IS NOT NULL))"
                out.append(f"SELECT '{t.name}', '{c.name} refers to {c.references}', count(*), {lost} FROM {t.name} WHERE {c.name} IS NOT NULL")
    return " UNION ALL ".join(out)


_add("check_schema", lambda s, d: audit.check({t.name: _table(s, d, t.name) for t in _RULED.tables}, _RULED), _rules_sql())

# --- draws and values over the keys of orders -------------------------------------------------
_ROW = "o_orderkey"


def _salted(purpose: str) -> int:
    return salt(SEED, purpose)


def _kind_draw(s: int, use: int, draw_of=draw_sql) -> str:
    """SQL of the ``use``-th draw of a kind with salt ``s``."""
    return draw_of(_ROW, (s + 104729 * use) % P)


_add("draw_value", _on("orders", lambda t: t.select(_ROW, draw(F.col(_ROW), _salted("v")).alias("v"))), f"SELECT {_ROW}, {draw_sql(_ROW, _salted('v'))} AS v FROM orders")
_add("clamp_text", _on("orders", lambda t: t.select(_ROW, clamp_text(F.col("o_orderpriority"), 5).alias("v"))), f"SELECT {_ROW}, substr(o_orderpriority, 1, 5) AS v FROM orders")
_LIST = ["new", "paid", "sent", "returned"]
_add(
    "enum_pick",
    _on("orders", lambda t: t.select(_ROW, generate("enum", Draws(F.col(_ROW), _salted("e")), {"values": _LIST}).alias("v"))),
    f"SELECT {_ROW}, ['new', 'paid', 'sent', 'returned'][CAST({_kind_draw(_salted('e'), 1)} % 4 AS INTEGER) + 1] AS v FROM orders",
)
_add(
    "enum_weighted",
    _on("orders", lambda t: t.select(_ROW, generate("enum", Draws(F.col(_ROW), _salted("w")), {"values": ["a", "b", "c"], "weights": [2, 1, 1]}).alias("v"))),
    f"SELECT {_ROW}, CASE WHEN {_kind_draw(_salted('w'), 1, unit_sql)} < 0.5::DOUBLE THEN 'a' "
    f"WHEN {_kind_draw(_salted('w'), 1, unit_sql)} < 0.75::DOUBLE THEN 'b' ELSE 'c' END AS v FROM orders",
)
_add(
    "min_max_int",
    _on("orders", lambda t: t.select(_ROW, generate("int", Draws(F.col(_ROW), _salted("i")), {"min": 10, "max": 99}).alias("v"))),
    f"SELECT {_ROW}, {_kind_draw(_salted('i'), 1)} % 90 + 10 AS v FROM orders",
)
_add(
    "round_scale",
    _on("lineitem", lambda t: t.select("l_orderkey", "l_linenumber", round_scale(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("v"))),
    "SELECT l_orderkey, l_linenumber, sign(l_extendedprice * l_discount) * floor(abs(l_extendedprice * l_discount) * 100 + 0.5) / 100 AS v FROM lineitem",
)
_PATTERN = "^[A-C]{2}-[0-9]{3}x?$"


def _pattern_sql() -> str:
    s, parts = _salted("p"), []
    at = lambda use: draw_sql(_ROW, (s + 7919 * use) % P)
    for use in (1, 2):
        parts.append(f"substr('ABC', CAST({at(use)} % 3 AS INTEGER) + 1, 1)")
    parts.append("'-'")
    for use in (3, 4, 5):
        parts.append(f"substr('0123456789', CAST({at(use)} % 10 AS INTEGER) + 1, 1)")
    parts.append(f"CASE WHEN {at(6)} % 2 > 0 THEN 'x' ELSE '' END")
    return f"SELECT {_ROW}, {' || '.join(parts)} AS v FROM orders"


_add("pattern_generate", _on("orders", lambda t: t.select(_ROW, compile_pattern(_PATTERN, F.col(_ROW), _salted("p")).alias("v"))), _pattern_sql())

# --- relations and uniqueness ------------------------------------------------------------------


def _pool(spark: SparkSession, sf_dir: str, table: str, key: str) -> tuple[DataFrame, int]:
    keys = _table(spark, sf_dir, table)
    return relate.indexed(keys, key), keys.select(key).where(F.col(key).isNotNull()).distinct().count()


def _fk_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, size = _pool(spark, sf_dir, "customer", "c_custkey")
    return relate.draw_keys(_table(spark, sf_dir, "orders").select(_ROW), _ROW, "custkey", pool, size, _salted("fk"))


_POOL_SQL = "(SELECT {k} AS key, row_number() OVER (ORDER BY {k}) - 1 AS i FROM (SELECT DISTINCT {k} FROM {t} WHERE {k} IS NOT NULL))"
_CUSTOMERS = _POOL_SQL.format(k="c_custkey", t="customer")
_add(
    "fk_draw",
    _fk_draw,
    f"WITH o AS MATERIALIZED (SELECT {_ROW}, {below_sql(_ROW, _salted('fk'), 'n')} AS i FROM orders, (SELECT count(DISTINCT c_custkey) AS n FROM customer)) "
    f"SELECT {_ROW}, p.key AS custkey FROM o JOIN {_CUSTOMERS} p USING (i)",
)


def _fk_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, size = _pool(spark, sf_dir, "orders", "o_orderkey")
    customers = _table(spark, sf_dir, "customer").select("c_custkey")
    return relate.assign_one_to_one(customers, "c_custkey", "orderkey", pool, size, customers.count(), 17)


_add(
    "fk_one_to_one",
    _fk_one_to_one,
    f"SELECT c_custkey, p.key AS orderkey FROM customer JOIN {_POOL_SQL.format(k='o_orderkey', t='orders')} p ON p.i = (c_custkey + 17) % (SELECT count(DISTINCT o_orderkey) FROM orders)",
)


def _mixed_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, n_parts = _pool(spark, sf_dir, "part", "p_partkey")
    suppliers, n_suppliers = _pool(spark, sf_dir, "supplier", "s_suppkey")
    rows = spark.range(2 * n_parts).withColumnRenamed("id", "row")
    return relate.assign_composite(rows, "row", [("partkey", parts, n_parts), ("suppkey", suppliers, n_suppliers)], 2 * n_parts, 0)


_add(
    "mixed_radix_pairs",
    _mixed_radix,
    "WITH p AS " + _POOL_SQL.format(k="p_partkey", t="part") + ", s AS " + _POOL_SQL.format(k="s_suppkey", t="supplier") + ", "
    "c AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM s) AS ns), r AS (SELECT range AS row FROM range((SELECT 2 * np FROM c))), "
    "n AS (SELECT row, row % (np * ns) AS n, ns FROM r, c) "
    "SELECT row, p.key AS partkey, s.key AS suppkey FROM n JOIN s ON s.i = n.n % n.ns JOIN p ON p.i = n.n // n.ns",
)


def _append_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many new pairs of part and supplier as there are parts, beside those that orders were placed for."""
    parts, n_parts = _pool(spark, sf_dir, "part", "p_partkey")
    suppliers, n_suppliers = _pool(spark, sf_dir, "supplier", "s_suppkey")
    held = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"))
    rows = spark.range(n_parts).withColumnRenamed("id", "row")
    return relate.append_composite(rows, "row", [("partkey", parts, n_parts), ("suppkey", suppliers, n_suppliers)], held, n_parts, 0)


_add(
    "append_pairs",
    _append_pairs,
    "WITH p AS " + _POOL_SQL.format(k="p_partkey", t="part") + ", s AS " + _POOL_SQL.format(k="s_suppkey", t="supplier") + ", "
    "c AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM s) AS ns, (SELECT count(DISTINCT (l_partkey, l_suppkey)) FROM lineitem) AS nl), "
    "r AS (SELECT range AS turn FROM range((SELECT least(np * ns, np + nl) FROM c))), "
    "w AS (SELECT turn, p.key AS partkey, s.key AS suppkey FROM r, c JOIN s ON s.i = r.turn % c.ns JOIN p ON p.i = (r.turn // c.ns) % c.np), "
    "f AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = w.partkey AND l.l_suppkey = w.suppkey)) "
    "SELECT row_number() OVER (ORDER BY turn) - 1 AS row, partkey, suppkey FROM f QUALIFY row_number() OVER (ORDER BY turn) <= (SELECT np FROM c)",
)


def _repair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    return unique.repair(t, "v", "c_custkey", "string")


_add(
    "unique_repair_text",
    _repair_text,
    "SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) > 1 THEN c_mktsegment || '-' || c_custkey ELSE c_mktsegment END AS v FROM customer",
)


def _repair_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.concat(F.lower("c_mktsegment"), F.lit("@Example.com"))
    return unique.repair(_table(spark, sf_dir, "customer").select("c_custkey", mail.alias("v")), "v", "c_custkey", "string", folded=True)


_add(
    "unique_repair_email",
    _repair_email,
    "SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) > 1 "
    "THEN lower(c_mktsegment) || '+' || c_custkey || '@Example.com' ELSE lower(c_mktsegment) || '@Example.com' END AS v FROM customer",
)
_add(
    "unique_repair_int",
    _on("part", lambda t: unique.repair(t.select("p_partkey", F.col("p_size").cast("long").alias("v")), "v", "p_partkey", "int")),
    "SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) > 1 THEN (SELECT max(p_size) FROM part) + p_partkey + 1 ELSE p_size END::BIGINT AS v FROM part",
)
_add(
    "append_counter_int",
    lambda s, d: unique.append_counter(s.range(500).select(F.col("id").alias("row"), F.col("id").alias("v")), "v", "row", _table(s, d, "orders").select(F.col("o_orderkey").alias("v"))),
    "SELECT range AS row, (SELECT max(o_orderkey) FROM orders) + 1 + range AS v FROM range(500)",
)
_add(
    "append_unique_text",
    lambda s, d: unique.append_unique(
        s.range(300).select(F.col("id").alias("row"), F.concat(F.lit("Customer#"), F.lpad((F.col("id") * 7).cast("string"), 9, "0")).alias("v")),
        "v", "row", _table(s, d, "customer").select(F.col("c_name").alias("v")),
    ),
    "WITH n AS (SELECT range AS row, 'Customer#' || lpad(CAST(range * 7 AS VARCHAR), 9, '0') AS v FROM range(300)) "
    "SELECT row, CASE WHEN EXISTS (SELECT 1 FROM customer c WHERE c.c_name = n.v) THEN v || '-' || row ELSE v END AS v FROM n",
)

# --- keys and references found from the rows -----------------------------------------------------
#: columns that can be keys, by table
_KEYED = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"],
    "labels": ["doc_id", "quality", "toxic"], "documents": ["doc_id", "text", "lang", "source", "n_chars"], "conversations": ["conv_id", "turn", "role", "text"],
}


#: tables of which some have keys of several columns only
_SEVERAL = ["nation", "orders", "lineitem", "labels", "conversations"]


def _found_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(t, ", ".join(key)) for t in _SEVERAL for key in discover.minimal_keys(t, _table(spark, sf_dir, t))]
    return spark.createDataFrame(found, "table_name string, key string")


def _found_keys_sql() -> str:
    """All combinations of up to three columns, counted each."""
    out = []
    for t in _SEVERAL:
        for width in range(1, 4):
            for c in itertools.combinations(sorted(_KEYED[t]), width):
                out.append(f"SELECT '{t}' AS t, {list(c)} AS c, count(*) = count(DISTINCT ({', '.join(c)})) AND count(*) > 0 AND {' AND '.join(f'count({x}) = count(*)' for x in c)} AS u FROM {t}")
    return (
        f"WITH u AS MATERIALIZED (SELECT t, c FROM ({' UNION ALL '.join(out)}) WHERE u) SELECT t AS table_name, array_to_string(c, ', ') AS key FROM u "
        "WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.t = u.t AND len(v.c) < len(u.c) AND list_has_all(u.c, v.c))"
    )


_add("discover_keys", _found_keys, _found_keys_sql())


def _found_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: _table(spark, sf_dir, t) for t in _KEYED}
    schema = discover.discover(tables, widest=1)
    found = [(t.name, c.name, c.references) for t in schema.tables for c in t.columns if c.references]
    return spark.createDataFrame(found, "child string, key string, parent string")


def _found_references_sql() -> str:
    """The named pairs of columns, each looked up; a parent's column has to be a key."""
    pairs = [e for e in EDGES if e[0] != "events"] + [("documents", "doc_id", "labels", "doc_id")]
    each = [
        f"SELECT '{c}' AS child, '{k}' AS key, '{p}.{pk}' AS parent WHERE NOT EXISTS (SELECT 1 FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)) "
        f"AND (SELECT count(*) = count(DISTINCT {pk}) FROM {p})"
        for c, k, p, pk in pairs
    ]
    return " UNION ALL ".join(each)


_add("discover_references", _found_references, _found_references_sql())


def _all_inclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: _table(spark, sf_dir, t).select(*columns) for t, columns in _WHOLE.items()}
    found = discover.inclusions(tables, {(t, c) for t, columns in _WHOLE.items() for c in columns})
    return spark.createDataFrame(found, "child_table string, child string, parent_table string, parent string")


_WHOLE = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"],
    "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id", "user_id"], "labels": ["doc_id", "quality", "toxic"],
}
_add(
    "discover_inclusions",
    _all_inclusions,
    " UNION ALL ".join(
        f"SELECT '{a}' AS child_table, '{c}' AS child, '{b}' AS parent_table, '{p}' AS parent WHERE EXISTS (SELECT 1 FROM {a} WHERE {c} IS NOT NULL) "
        f"AND NOT EXISTS (SELECT {c} FROM {a} WHERE {c} IS NOT NULL EXCEPT SELECT {p} FROM {b})"
        for a, children in _WHOLE.items() for c in children for b, keys in _WHOLE.items() for p in keys if (a, c) != (b, p)
    ),
)

# --- words of a pattern by number, references within a table -----------------------------------
_WORDS = "^[a-z]{1,3}[0-9]?$"


def _pattern_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer gets a word of its own, however many words the customers need."""
    words = language(_WORDS)
    number = F.pmod(F.col("c_custkey") * 7919, F.lit(words.total))
    return _table(spark, sf_dir, "customer").select("c_custkey", word_at(words, number).alias("v"))


_LETTERS = "(SELECT chr(CAST(97 + range AS INTEGER)) AS c FROM range(26))"
_add(
    "unique_pattern_words",
    _pattern_words,
    f"WITH l AS {_LETTERS}, w AS (SELECT c AS w FROM l UNION ALL SELECT a.c || b.c FROM l a, l b UNION ALL SELECT a.c || b.c || d.c FROM l a, l b, l d), "
    "all_words AS (SELECT w FROM w UNION ALL SELECT w || range FROM w, range(10)), "
    "numbered AS (SELECT w, row_number() OVER (ORDER BY length(w), w) - 1 AS i FROM all_words) "
    "SELECT c_custkey, w AS v FROM customer JOIN numbered ON i = (c_custkey * 7919) % (SELECT count(*) FROM all_words)",
)


def _forest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer")
    return customers.select("c_custkey", relate.forest_parent(F.col("c_custkey"), customers.count(), _salted("parent")).alias("parent"))


def _forest_sql() -> str:
    """Levels of any number of rows; those beyond the table's rows are not reached."""
    first, cases = relate.levels(10**9), []
    for k in range(len(first) - 1, 0, -1):
        cases.append(f"WHEN c_custkey >= {first[k]} THEN {first[k - 1]} + {below_sql('c_custkey', _salted('parent'), str(first[k] - first[k - 1]))}")
    return f"SELECT c_custkey, CASE {' '.join(cases)} END AS parent FROM customer"


_add("self_reference_forest", _forest_rows, _forest_sql())
_add("check_forest", lambda s, d: forest.forest_report(_forest_rows(s, d), "c_custkey", "parent"),
     f"WITH RECURSIVE f AS MATERIALIZED ({_forest_sql()}), t AS (SELECT c_custkey AS k, 0 AS d FROM f WHERE parent IS NULL UNION ALL SELECT f.c_custkey, d + 1 FROM f JOIN t ON f.parent = t.k) "
     "SELECT (SELECT count(*) FROM f) AS rows, count(*) FILTER (WHERE d = 0) AS roots, (SELECT count(*) FROM f WHERE parent NOT IN (SELECT c_custkey FROM f)) AS orphans, "
     "(SELECT count(*) FROM f) - count(*) AS in_cycles, CAST(max(d) AS BIGINT) AS depth FROM t")  # fmt: skip


def _broken_forest(t: DataFrame) -> DataFrame:
    """Orders that refer to others by their customer and date, with roots, orphans, long ways and cycles among them."""
    key = F.col("o_orderkey")
    return t.select(key, F.when(key % 11 > 0, F.when(key % 13 > 0, (key * key + F.col("o_custkey")) % 9973).otherwise(-key)).alias("parent"))


_BROKEN = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 > 0 THEN CASE WHEN o_orderkey % 13 > 0 THEN (o_orderkey * o_orderkey + o_custkey) % 9973 ELSE -o_orderkey END END AS p FROM orders"
_add(
    "check_forest_broken",
    _on("orders", lambda t: forest.forest_report(_broken_forest(t), "o_orderkey", "parent")),
    f"WITH RECURSIVE f AS MATERIALIZED ({_BROKEN}), o AS (SELECT k FROM f WHERE p NOT IN (SELECT k FROM f)), "
    "t AS (SELECT k, 0 AS d, TRUE AS good FROM f WHERE p IS NULL OR p = k UNION ALL SELECT k, 0, FALSE FROM o UNION ALL SELECT f.k, d + 1, good FROM f JOIN t ON f.p = t.k WHERE f.p <> f.k) "
    "SELECT (SELECT count(*) FROM f) AS rows, count(*) FILTER (WHERE d = 0 AND good) AS roots, (SELECT count(*) FROM o) AS orphans, (SELECT count(*) FROM f) - count(*) AS in_cycles, "
    "CAST(max(d) FILTER (WHERE good) AS BIGINT) AS depth FROM t",
)

# --- planning, sources and export --------------------------------------------------------------
_add(
    "sql_literal_rows",
    _on("region", export.sql_rows),
    "SELECT '(' || r_regionkey || ', ' || '''' || replace(r_name, '''', '''''') || '''' || ')' AS row_sql FROM region",
)
#: documents of orders, whose fields hold values of one kind, of several, of none, and objects within
_DOCS = (
    "'{\"key\": ' || o_orderkey || ', \"status\": \"' || o_orderstatus || '\", \"number\": ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '.5' END || "
    "', \"mixed\": ' || CASE WHEN o_orderkey % 5 = 0 THEN '7' ELSE '\"abc\"' END || ', \"code\": \"' || o_orderkey || '\", \"gone\": null, \"flag\": ' || "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'null' END || ', \"place\": {\"customer\": ' || o_custkey || CASE WHEN o_orderkey % 4 = 0 THEN ', \"note\": \"x\"' ELSE '' END || "
    "'}, \"list\": [1, \"a\"], \"_id\": 1}'"
)
_PATHS = ["key", "status", "number", "mixed", "code", "gone", "flag", "place.customer", "place.note", "list"]


def _documents_sql() -> str:
    """The types that each path has in all documents, by the engine's own reading of JSON."""
    each = " UNION ALL ".join(f"SELECT '{p}' AS field, json_type(doc, '$.{p}') AS t FROM d" for p in _PATHS)
    return (
        f"WITH d AS (SELECT CAST({_DOCS} AS JSON) AS doc FROM orders), t AS ({each}), k AS (SELECT field, coalesce(t, 'NULL') AS t FROM t) "
        "SELECT field, CASE WHEN bool_and(t = 'NULL') THEN 'text' WHEN bool_and(t IN ('NULL', 'UBIGINT', 'BIGINT')) THEN 'bigint' WHEN bool_and(t IN ('NULL', 'UBIGINT', 'BIGINT', 'DOUBLE')) THEN 'double' "
        "WHEN bool_and(t IN ('NULL', 'BOOLEAN')) THEN 'boolean' WHEN bool_and(t IN ('NULL', 'ARRAY')) THEN 'json' ELSE 'text' END AS native, bool_or(t = 'NULL') AS nullable FROM k GROUP BY field"
    )


_add("sample_infer_json", _on("orders", lambda t: catalog.sample_json(t.select(F.expr(_DOCS).alias("doc")), "doc", None)), _documents_sql())

_DDL = """
CREATE TABLE users (id BIGSERIAL PRIMARY KEY, email VARCHAR(120) NOT NULL UNIQUE, first_name VARCHAR(50) NOT NULL, last_name VARCHAR(50) NOT NULL,
  city VARCHAR(60), phone VARCHAR(30), company VARCHAR(80), balance DECIMAL(10,2) NOT NULL, is_active BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL);
CREATE TABLE orders (id BIGSERIAL PRIMARY KEY, user_id BIGINT NOT NULL REFERENCES users (id), status VARCHAR(20) NOT NULL, total DECIMAL(10,2) NOT NULL, placed_at TIMESTAMP NOT NULL);
"""
SCHEMA = ddl.parse_schema(_DDL)
def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the stored tables, written as DDL and read again."""
    schema = ddl.parse_schema(ddl.script(catalog.introspect({n: _table(spark, sf_dir, n) for n in _COUNTED})))
    rows = [(t.name, k, c.name, c.cls, c.nullable) for t in schema.tables for k, c in enumerate(t.columns, 1)]
    return spark.createDataFrame(rows, "table_name string, place long, column_name string, class string, nullable boolean")


_LISTED = ", ".join(f"'{n}'" for n in _COUNTED)
_CLASS = (
    "CASE WHEN data_type LIKE '%[]' THEN 'unknown' WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'int' WHEN data_type = 'DOUBLE' THEN 'float' "
    "WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'time' ELSE 'string' END"
)
_STORED = f"information_schema.columns WHERE table_schema = 'main' AND table_name IN ({_LISTED})"
_add("ddl_parse_columns", _parsed, f"SELECT table_name, ordinal_position::BIGINT AS place, column_name, {_CLASS} AS class, is_nullable = 'YES' AS nullable FROM {_STORED}")
def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored columns' types as three dialects write them, and the class of each."""
    schema = catalog.introspect({n: _table(spark, sf_dir, n) for n in _COUNTED if n != "embeddings"})
    rows = {(dialect, c.cls, ddl.native_for(c, dialect), classify(ddl.native_for(c, dialect))) for t in schema.tables for c in t.columns for dialect in ("postgres", "mysql", "sqlserver")}
    return spark.createDataFrame(sorted(rows), "dialect string, stored string, native string, class string")


_WRITTEN = "('int', 'bigint', 'bigint', 'bigint'), ('float', 'double precision', 'double', 'float'), ('time', 'timestamptz', 'datetime', 'datetime2'), ('string', 'text', 'text', 'nvarchar(max)')"
_add(
    "classify_types",
    _classified,
    f"WITH w AS (SELECT * FROM (VALUES {_WRITTEN}) w(stored, postgres, mysql, sqlserver)), c AS (SELECT DISTINCT {_CLASS} AS stored FROM {_STORED} AND table_name <> 'embeddings') "
    "SELECT dialect, stored, native, stored AS class FROM (UNPIVOT w ON postgres, mysql, sqlserver INTO NAME dialect VALUE native) JOIN c USING (stored)",
)
#: tables whose references are found from their rows before they are put in order or drawn
_STAR = ["orders", "customer", "supplier", "nation", "region"]


def _star(spark: SparkSession, sf_dir: str):
    return discover.discover({t: _table(spark, sf_dir, t) for t in _STAR}, widest=1)


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference found, and whether its parent comes first."""
    schema = _star(spark, sf_dir)
    order = table_order(infer(schema), schema)
    rows = [(t.name, c.references, order.index(c.references.split(".")[0]) < order.index(t.name)) for t in schema.tables for c in t.columns if c.references]
    return spark.createDataFrame(rows, "child string, parent string, parent_first boolean")


def _star_sql(what: str) -> str:
    """``what`` of every reference of these tables that no row breaks."""
    own = [e for e in EDGES if e[0] in _STAR and e[2] in _STAR]
    holds = "NOT EXISTS (SELECT 1 FROM {0} WHERE {1} NOT IN (SELECT {3} FROM {2}))"
    return " UNION ALL ".join(f"SELECT {what.format(*e)} WHERE {holds.format(*e)}" for e in own)


_add("topo_order", _ordered, _star_sql("'{0}' AS child, '{2}.{3}' AS parent, TRUE AS parent_first"))
def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored tables by three migrations: all columns but the last, the last one, and a reversed one."""
    schema = catalog.introspect({n: _table(spark, sf_dir, n) for n in _COUNTED})
    first = "".join(f"{ddl.create_sql(Table(t.name, t.columns[:-1]))}; CREATE TABLE {t.name}_old (id int);" for t in schema.tables)
    then = "".join(f"ALTER TABLE {t.name} ADD COLUMN {t.columns[-1].name} {t.columns[-1].native}; DROP TABLE {t.name}_old;" for t in schema.tables)
    last = "\n-- +goose Down\n" + "".join(f"DROP TABLE {t.name};" for t in schema.tables)
    return spark.createDataFrame([(t.name, c.name) for t in ddl.replay_texts([first, then + last]).tables for c in t.columns], "table_name string, column_name string")


_add("migration_replay", _replayed, f"SELECT table_name, column_name FROM {_STORED}")
def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored tables of which a source with those of at most four columns has none."""
    schema = catalog.introspect({n: _table(spark, sf_dir, n) for n in _COUNTED})
    return spark.createDataFrame([(n,) for n in ddl.missing(schema, Schema([t for t in schema.tables if len(t.columns) <= 4]))[0]], "table_name string")


_add("missing_tables", _missing, f"SELECT table_name FROM {_STORED} GROUP BY table_name HAVING count(*) > 4")
def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the stored tables: class, generator, confidence and null rate of every column."""
    schema = catalog.introspect({n: _table(spark, sf_dir, n) for n in _COUNTED})
    plan = infer(schema)
    rows = [(t.name, c.name, c.cls, p.generator, p.confidence, p.null_rate) for t in schema.tables for c in t.columns for p in [plan.tables[t.name].columns[c.name]]]
    return spark.createDataFrame(rows, "table_name string, column_name string, class string, generator string, confidence string, null_rate double")


_add(
    "infer_tables",
    _inferred,
    f"SELECT table_name, column_name, class, CASE WHEN column_name = 'url' THEN 'url' WHEN class = 'string' THEN 'sentence' WHEN class = 'unknown' THEN 'default' ELSE class END AS generator, "
    "CASE WHEN column_name = 'url' THEN 'high' WHEN class IN ('string', 'unknown') THEN 'low' ELSE 'medium' END AS confidence, "
    "CASE WHEN is_nullable = 'YES' AND class <> 'unknown' THEN 0.05 ELSE 0.0 END::DOUBLE AS null_rate FROM "
    f"(SELECT table_name, column_name, is_nullable, {_CLASS} AS class FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN ({_LISTED}))",
)
def _planned_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a plan of the discovered schema fills with parents' keys."""
    plan = infer(_star(spark, sf_dir))
    rows = [(t, c, p.references, p.confidence) for t, tp in plan.tables.items() for c, p in tp.columns.items() if p.generator == "foreign_key"]
    return spark.createDataFrame(rows, "table_name string, column_name string, parent string, confidence string")


_add("infer_columns", _planned_references, _star_sql("'{0}' AS table_name, '{1}' AS column_name, '{2}.{3}' AS parent, 'high' AS confidence"))


def _tables_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE lines of the stored tables as MySQL writes their types."""
    schema = catalog.introspect({n: _table(spark, sf_dir, n) for n in _COUNTED})
    rows = [(t.name, k, line.strip().rstrip(",")) for t in schema.tables for k, line in enumerate(ddl.create_sql(ddl.translated(t, "mysql"), "mysql").splitlines()[1:-1])]
    return spark.createDataFrame(rows, "table_name string, place long, line string")


_add(
    "ddl_render_tables",
    _tables_script,
    "SELECT table_name, ordinal_position::BIGINT - 1 AS place, '`' || column_name || '` ' || CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'bigint' WHEN data_type = 'DOUBLE' THEN 'double' "
    "WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type = 'DATE' THEN 'date' WHEN data_type LIKE '%[]' THEN 'array<' || lower(replace(data_type, '[]', '')) || '>' ELSE 'text' END AS line "
    f"FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN ({_LISTED})",
)
def _drawn_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an ER diagram of the discovered schema that join two tables."""
    return spark.createDataFrame([(line.strip(),) for line in ddl.mermaid(_star(spark, sf_dir)).splitlines() if "--" in line], "text string")


_add("er_diagram", _drawn_references, _star_sql("'{2} ||--o{{ {0} : {1}' AS text"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of a plan that puts nulls into every second column of the stored tables and names a column too many in each."""
    schema = catalog.introspect({n: _table(spark, sf_dir, n) for n in _COUNTED})
    for t in schema.tables:
        for c in t.columns:
            c.nullable = False
    plan = infer(schema)
    for t in schema.tables:
        for k, c in enumerate(t.columns):
            plan.tables[t.name].columns[c.name].null_rate = 0.5 if k % 2 else 0.0
        plan.tables[t.name].columns["surplus"] = ColumnPlan("int")
    return spark.createDataFrame([(p,) for p in validate(plan, schema)], "problem string")


_add(
    "validate_plan",
    _validated,
    f"SELECT table_name || '.' || column_name || ': null_rate on a required column' AS problem FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN ({_LISTED}) AND ordinal_position % 2 = 0 "
    "AND data_type NOT LIKE '%[]' "
    f"UNION ALL SELECT table_name || '.surplus: no such column' FROM information_schema.tables WHERE table_schema = 'main' AND table_name IN ({_LISTED}) "
    "UNION ALL SELECT 'embeddings.embedding: null_rate on a required column'",
)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of old tables, in which a person chose each second generator, merged into a fresh one without ``region``'s columns."""
    schema = catalog.introspect({n: _table(spark, sf_dir, n) for n in ("region", "nation", "customer")})
    old, fresh = infer(schema), infer(schema)
    for tp in old.tables.values():
        tp.rows = 7
        for k, cp in enumerate(tp.columns.values()):
            cp.generator = "const" if k % 2 else ""
    del fresh.tables["region"]
    merged = merge(old, fresh)
    return spark.createDataFrame([(t, c, p.generator, p.confidence, tp.rows) for t, tp in merged.tables.items() for c, p in tp.columns.items()], "table_name string, column_name string, generator string, confidence string, rows long")


_add(
    "merge_plans",
    _merged,
    f"SELECT table_name, column_name, CASE WHEN ordinal_position % 2 = 0 THEN 'const' WHEN class = 'string' THEN 'sentence' ELSE class END AS generator, "
    "CASE WHEN ordinal_position % 2 = 0 THEN 'manual' WHEN class = 'string' THEN 'low' ELSE 'medium' END AS confidence, CAST(7 AS BIGINT) AS rows FROM "
    f"(SELECT table_name, column_name, ordinal_position, {_CLASS} AS class FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN ('nation', 'customer'))",
)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by a stream over the stored files, by day and type."""
    source = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    events = source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    name = f"rowforge_{uuid.uuid4().hex}"
    query = windowed_counts(events, "ts", "event_type", "1 day").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.col("start").cast("string").alias("day"), "event_type", "n")


_add(
    "stream_windowed_counts",
    _streamed,
    "SELECT strftime(date_trunc('day', ts::TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
)


def _streamed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' users, made by a stream of their ids."""
    ids = spark.readStream.schema(_table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parquet*").select(F.col("o_orderkey").alias(engine.ID))
    made = stream_columns(ids, SCHEMA, users_plan(2**40), "users")
    return finished(made.select("id", "email", "first_name", "city", "is_active"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as a migration tool's history: the newest 200, unknown times last."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), (F.col("o_orderstatus") == "F").alias("is_applied"), F.col("o_orderdate").cast("timestamp").alias("tstamp"))
    return catalog.migration_history({"goose_db_version": orders}).select("source", "version", F.col("applied_at").cast("string").alias("applied_at"), "applied")


_add(
    "migration_history",
    _history,
    "SELECT 'goose' AS source, CAST(o_orderkey AS VARCHAR) AS version, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS applied_at, o_orderstatus = 'F' AS applied "
    "FROM orders ORDER BY o_orderdate::TIMESTAMP DESC NULLS LAST, CAST(o_orderkey AS VARCHAR) DESC LIMIT 200",
)


def users_plan(rows: int, orders: int = 0):
    plan = infer(SCHEMA)
    plan.seed, plan.tables["users"].rows, plan.tables["orders"].rows = 42, rows, orders
    return plan


def generate_users(spark: SparkSession, rows: int) -> DataFrame:
    return engine.generate(spark, SCHEMA, users_plan(rows)).tables["users"]


def _users_sql(rows: str) -> str:
    """The users table of row ids ``row`` in the table expression ``rows``."""
    own = table_seed(42, "users")
    d = lambda column: SqlDraws("row", salt(own, column))
    null = lambda column, value: f"CASE WHEN {unit_sql('row', salt(own, column, 'null'))} >= 0.05::DOUBLE THEN {value} END"
    mail = d("email")
    cents = f"(floor({d('balance').number(0.0, 99999999.0)} * 100) / 100)"
    return (
        f"SELECT row + 1 AS id, {mail.handle()} || '+' || row || '@example.' || {mail.pick(['com', 'org', 'net'])} AS email, {KINDS_SQL['firstname'](d('first_name'))} AS first_name, "
        f"{KINDS_SQL['lastname'](d('last_name'))} AS last_name, {null('city', KINDS_SQL['city'](d('city')))} AS city, {null('phone', KINDS_SQL['phone'](d('phone')))} AS phone, "
        f"{null('company', KINDS_SQL['company'](d('company')))} AS company, floor({cents} * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS balance, "
        f"{unit_sql('row', salt(own, 'is_active', 'bool'))} < 0.5::DOUBLE AS is_active, {KINDS_SQL['time'](d('created_at'))} AS created_at FROM {rows}"
    )


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and times as text, which engines compare alike."""
    change = {"decimal": "double", "timestamp": "string"}
    return df.select(*[F.col(f.name).cast(change[t]).alias(f.name) if (t := f.dataType.typeName()) in change else F.col(f.name) for f in df.schema])


def _rows_of(spark: SparkSession, sf_dir: str, table: str) -> int:
    return _table(spark, sf_dir, table).count()


_add("stream_rows", _streamed_rows, f"SELECT id, email, first_name, city, is_active FROM ({_users_sql('(SELECT o_orderkey AS row FROM orders)')})")
_add("generate_users", lambda s, d: _plain(generate_users(s, _rows_of(s, d, "customer"))), _users_sql("(SELECT range AS row FROM range((SELECT count(*) FROM customer)))"))


def _orders_sql(users: str, orders: str) -> str:
    own = table_seed(42, "orders")
    d = lambda column: SqlDraws("row", salt(own, column))
    cents = f"(floor({d('total').number(0.0, 99999999.0)} * 100) / 100)"
    return (
        f"SELECT row + 1 AS id, {below_sql('row', salt(own, 'user_id', 'fk'), users)} + 1 AS user_id, substr({KINDS_SQL['word'](d('status'))}, 1, 20) AS status, "
        f"floor({cents} * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS total, {KINDS_SQL['time'](d('placed_at'))} AS placed_at FROM (SELECT range AS row FROM range({orders}))"
    )


_add(
    "generate_orders",
    lambda s, d: _plain(engine.generate(s, SCHEMA, users_plan(_rows_of(s, d, "customer"), _rows_of(s, d, "orders"))).tables["orders"]),
    _orders_sql("(SELECT count(*) FROM customer)", "(SELECT count(*) FROM orders)"),
)
_RULES = ddl.parse_schema("CREATE TABLE r (id bigserial PRIMARY KEY, n bigint NOT NULL, t varchar(30) NOT NULL, b boolean NOT NULL, c varchar(5), z text, v varchar(8))")


def _rules(*columns: str) -> Query:
    """Columns of a table generated with as many rows as ``orders``, by rules that look at no name."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = infer(_RULES)
        plan.seed, plan.tables["r"].rows = 42, _rows_of(spark, sf_dir, "orders")
        plan.tables["r"].columns |= {
            "n": ColumnPlan("sequence", start=800000001000), "t": ColumnPlan("sequence"), "b": ColumnPlan("bool", true_weight=0.8),
            "c": ColumnPlan("const", const="x"), "z": ColumnPlan("null"), "v": ColumnPlan("enum", values=["new", "paid", "sent", "returned again"], null_rate=0.05),
        }
        return engine.generate(spark, _RULES, plan).tables["r"].select("id", *columns)

    return query


def _rules_sql(columns: str) -> str:
    return f"SELECT row + 1 AS id, {columns} FROM (SELECT range AS row FROM range((SELECT count(*) FROM orders)))"


_R = table_seed(42, "r")
_add("sequence_start", _rules("n"), _rules_sql("row + 800000001000 AS n"))
_add("sequence_text", _rules("t"), _rules_sql("CAST(row + 1 AS VARCHAR) AS t"))
_add("weighted_bool", _rules("b"), _rules_sql(f"{unit_sql('row', salt(_R, 'b', 'bool'))} < 0.8::DOUBLE AS b"))
_add("const_null_surrogate", _rules("c", "z"), _rules_sql("'x' AS c, CAST(NULL AS VARCHAR) AS z"))
_add(
    "null_rate_apply",
    _rules("v"),
    _rules_sql(
        f"CASE WHEN {unit_sql('row', salt(_R, 'v', 'null'))} >= 0.05::DOUBLE THEN substr({SqlDraws('row', salt(_R, 'v')).pick(['new', 'paid', 'sent', 'returned again'])}, 1, 8) END AS v"
    ),
)
_add(
    "check_reproducible",
    lambda s, d: (lambda plan: checks.differences(*[engine.generate(s, SCHEMA, plan, splits=n).tables["orders"] for n in (3, 7)]).agg(F.count("*").alias("differences"), F.lit(plan.tables["orders"].rows).cast("long").alias("rows")))(
        users_plan(_rows_of(s, d, "customer"), _rows_of(s, d, "orders"))
    ),
    "SELECT CAST(0 AS BIGINT) AS differences, count(*) AS rows FROM orders",
)
_PAIRS = ddl.parse_schema("CREATE TABLE a (id bigserial PRIMARY KEY, x int); CREATE TABLE b (id bigserial PRIMARY KEY, x int); CREATE TABLE ab (a_id bigint REFERENCES a, b_id bigint REFERENCES b, PRIMARY KEY (a_id, b_id))")


def _join_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = infer(_PAIRS)
    plan.seed, plan.tables["a"].rows, plan.tables["b"].rows, plan.tables["ab"].rows = 5, _rows_of(spark, sf_dir, "supplier"), _rows_of(spark, sf_dir, "nation"), _rows_of(spark, sf_dir, "supplier") * 20
    return checks.spread(engine.generate(spark, _PAIRS, plan).tables["ab"], "a_id")


_add(
    "generate_join_table",
    _join_table,
    "SELECT count(*) AS parents, min(n) AS least, max(n) AS most, avg(n) AS mean FROM (SELECT a, count(DISTINCT b) AS n FROM "
    "(SELECT (x // nb) % na AS a, x % nb AS b FROM (SELECT (s0 % (na * nb) + range * step) % (na * nb) AS x, na, nb FROM "
    f"(SELECT (SELECT count(*) FROM supplier) AS na, (SELECT count(*) FROM nation) AS nb, {table_seed(5, 'ab')}::HUGEINT AS s0, "
    f"(SELECT min(k) FROM (SELECT {table_seed(5, 'ab')}::HUGEINT % (SELECT count(*) FROM supplier, nation) + range AS k FROM range(1000)) "
    "WHERE k > 0 AND gcd(k, (SELECT count(*) FROM supplier, nation)::HUGEINT) = 1) AS step), range((SELECT count(*) * 20 FROM supplier)))) GROUP BY a)",
)


def _generated_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = engine.generate(spark, SCHEMA, users_plan(_rows_of(spark, sf_dir, "customer"), _rows_of(spark, sf_dir, "orders"))).tables
    facts = checks.orphan_count("orders.user_id", made["orders"], "user_id", made["users"], "id").select("checked", "orphans")
    return facts.crossJoin(checks.uniqueness(made["users"], ["email"]).select("rows", "extra_rows"))  # one row each


_add("generated_integrity", _generated_integrity, "SELECT (SELECT count(*) FROM orders) AS checked, CAST(0 AS BIGINT) AS orphans, count(*) AS rows, CAST(0 AS BIGINT) AS extra_rows FROM customer")
_add(
    "preview",
    lambda s, d: _plain(engine.preview(s, SCHEMA, users_plan(100, 100), "orders", 5, existing={"users": _table(s, d, "customer").select((F.col("c_custkey") + 1).alias("id"))})),
    f"SELECT * FROM ({_orders_sql('(SELECT count(*) FROM customer)', '5')})",
)


#: the kinds by theme
GROUPS = {
    "person": "name firstname lastname middlename username email phone password ssn passport namesuffix gender maritalstatus education bloodtype",
    "address": "street city region postcode country countrycode continent latitude longitude timezone airport",
    "business": "company catchphrase job department jobarea joblevel brand university airline",
    "finance": "amount iban swift card cardexpiry stockticker currency currencyname currencysymbol bankname accounttype paymentmethod crypto",
    "commerce": "product productcategory productmaterial sku ean13 isbn color hexcolor vehiclemake vehiclemodel licenseplate vin",
    "internet": "url domain slug ipv4 ipv6 mac httpstatus httpmethod mimetype useragent imageurl semver md5 sha256 os browser device fileext framework",
    "text": "word sentence paragraph lorem title emoji food drink animal sport musicgenre languagename",
    "time": "time unixtime year month weekday",
    "primitive": "int float bool uuid enum",
}


def _kinds(names: list[str]) -> Query:
    options = {"enum": {"values": ["a", "b"]}}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = {k: generate(k, Draws(F.col("c_custkey"), salt(9, k)), options.get(k, {})) for k in names}
        return _table(spark, sf_dir, "customer").select("c_custkey", *[(v.cast("string") if k == "time" else v).alias(k) for k, v in values.items()])

    return query


def _kinds_sql(names: list[str]) -> str:
    return f"SELECT c_custkey, {', '.join(f'{KINDS_SQL[k](SqlDraws(chr(99) + "_custkey", salt(9, k)))} AS "{k}"' for k in names)} FROM customer"


for _group, _names in GROUPS.items():
    _add(f"kinds_{_group}", _kinds(_names.split()), _kinds_sql(_names.split()))
_add(
    "check_digits",
    _on("customer", lambda t: t.select(generate("ean13", Draws(F.col("c_custkey"), 3), {}).alias("ean"), generate("card", Draws(F.col("c_custkey"), 4), {}).alias("card"))
    .select((F.expr("aggregate(sequence(1, 13), 0, (t, i) -> t + int(substr(ean, i, 1)) * if(i % 2 = 0, 3, 1))") % 10).alias("ean_rest"), F.expr("luhn_check(card)").alias("card_good"))
    .groupBy("ean_rest", "card_good").agg(F.count("*").alias("n"))),
    "SELECT CAST(0 AS INTEGER) AS ean_rest, true AS card_good, count(*) AS n FROM customer",
)
