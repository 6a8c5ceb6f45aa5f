"""Schemas and tables from Parquet folders, Spark catalogs, JDBC and samples."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.plans.model import Column, Schema, Table, from_struct

#: URL scheme of a JDBC or native source -> dialect
SCHEMES = {
    "postgres": "postgres", "postgresql": "postgres", "cockroach": "postgres", "yugabyte": "postgres", "mysql": "mysql", "mariadb": "mysql",
    "sqlite": "sqlite", "sqlite3": "sqlite", "file": "sqlite", "sqlserver": "sqlserver", "mssql": "sqlserver", "oracle": "oracle", "hana": "hana", "hdb": "hana",
    "vertica": "vertica", "firebird": "firebird", "fdb": "firebird", "clickhouse": "clickhouse", "ch": "clickhouse", "trino": "trino", "presto": "trino",
    "redshift": "redshift", "databricks": "databricks", "snowflake": "snowflake", "bigquery": "bigquery", "mongodb": "mongodb", "elasticsearch": "elasticsearch",
    "es": "elasticsearch", "cassandra": "cassandra", "scylla": "cassandra", "dynamodb": "dynamodb", "neo4j": "neo4j", "bolt": "neo4j", "redis": "redis",
}


def scheme(url: str) -> str:
    """Dialect of a source's address."""
    url = url.removeprefix("jdbc:")
    if "://" in url or url.startswith("file:"):
        name = url.split(":", 1)[0].lower().split("+")[0]
        if name in SCHEMES:
            return SCHEMES[name]
        raise ValueError(f"unknown scheme {name}")
    if "@tcp(" in url or "@unix(" in url:
        return "mysql"
    if re.search(r"[/\\.]", url):
        return "sqlite"
    raise ValueError(f"{url!r} names no source")


#: fixed values: words in an address that speak of production
PRODUCTION_WORDS = ("prod", "production", "live", "master", "primary")
#: domains of managed services (this library's own choice)
MANAGED_HOSTS = (".rds.amazonaws.com", ".database.windows.net", ".cloud.google.com", ".neon.tech", ".supabase.co", ".aivencloud.com", ".snowflakecomputing.com")


def guard(url: str) -> str:
    """Why a target must not be written to without consent; '' for a local one."""
    m = re.search(r"(?://|@tcp\()(?:[^@/]*@)?([^:/?)]+)", url)
    host = (m[1] if m else "").lower()
    if host in ("", "localhost", "127.0.0.1", "::1", "[::1]", "0.0.0.0"):
        return ""
    words = set(re.split(r"[^a-z0-9]+", url.lower()))
    if found := [w for w in PRODUCTION_WORDS if w in words]:
        return f"the address says {found[0]}"
    if host.endswith(MANAGED_HOSTS):
        return f"{host} is a managed service"
    return f"{host} is not local"


def parquet_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of a folder of ``<name>.parquet`` files or folders, listed through Spark's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(s.getPath().getName() for s in found)
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{folder}/{n}") for n in names if n.endswith(".parquet")}


def catalog_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Base tables of a catalog; views are left out."""
    listed = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return {t.name: spark.table(f"{database}.{t.name}" if database else t.name) for t in listed if t.tableType not in ("VIEW", "TEMPORARY")}


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 0, **options) -> DataFrame:
    """A table over JDBC, read in ``parts`` ranges of ``key``."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and parts > 1:
        name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
        low, high = spark.read.format("jdbc").options(url=url, query=f"SELECT min({name}) AS a, max({name}) AS b FROM {table}", **options).load().first()
        if low is not None:
            reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, truncate: bool = False, batch: int = 10_000, consent: bool = False, **options) -> None:
    """Append or truncate and write, in batches, a connection per partition; refused for guarded targets."""
    if (why := guard(url)) and not consent:
        raise PermissionError(f"refusing to write: {why}")
    writer = df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, truncate=truncate, **options)
    writer.mode("overwrite" if truncate else "append").save()


def introspect(tables: dict[str, DataFrame], constraints: Schema | None = None) -> Schema:
    """Schema of DataFrames: types from Spark, all else from field metadata or a declared schema."""
    found = []
    for name, df in tables.items():
        table, declared = from_struct(name, df.schema), constraints.table(name) if constraints else None
        if declared:
            table.primary_key, table.checks = declared.primary_key, declared.checks
            table.columns = [declared.column(c.name) or c for c in table.columns]
        found.append(table)
    return Schema(found)


def profile_keys(df: DataFrame, name: str) -> Table:
    """Candidate keys by one pass: columns without nulls and with as many distinct values as rows.

    Distinct counts are approximate first; only columns that come close are counted exactly.
    """
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.StringType))]
    first = df.agg(F.count("*").alias("rows"), *[F.approx_count_distinct(c).alias(f"d_{c}") for c in plain], *[F.count(c).alias(f"n_{c}") for c in plain]).first()
    likely = [c for c in plain if first["rows"] and first[f"n_{c}"] == first["rows"] and first[f"d_{c}"] > 0.8 * first["rows"]]
    table = from_struct(name, df.schema)
    for c in likely:
        if df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            table.column(c).unique = True
    numbers = [c for c in likely if table.column(c).unique and table.column(c).cls == "int"]
    table.primary_key = numbers[:1]
    return table


#: rows from which the fields of documents are taken, unless more are asked for
SAMPLE_ROWS = 200


def _chosen(df: DataFrame, column: str, rows: int | None) -> DataFrame:
    """Documents as variants, those that are objects; ``rows`` of them by the smallest hash, so that the choice does not hang on the order of rows."""
    docs = df.select(F.col(column).alias("doc")).where(F.col(column).isNotNull())
    if rows is not None:
        docs = docs.orderBy(F.xxhash64("doc"), "doc").limit(rows)
    return docs.select(F.try_parse_json("doc").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT<"))


def _leaves(kind: T.DataType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    if isinstance(kind, T.StructType) and kind.fields:
        return [x for f in kind.fields for x in _leaves(f.dataType, (*path, f.name))]
    return [(path, kind)]


def _native(kind: T.DataType) -> str:
    """The type of a field whose values meet in ``kind``; values of kinds that do not meet are text."""
    if isinstance(kind, T.DecimalType):
        return "double" if kind.scale else f"numeric({kind.precision}, 0)"
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return "json"
    return {T.LongType: "bigint", T.DoubleType: "double", T.BooleanType: "boolean"}.get(type(kind), "text")


def _step(name: str) -> str:
    return f"['{name}']" if '"' in name else f'["{name}"]'


def sample_json(df: DataFrame, column: str, rows: int | None = SAMPLE_ROWS) -> DataFrame:
    """(field, native, nullable) of JSON documents, from ``rows`` of them or all (None).

    Kinds meet in a lattice: null is below all, whole numbers are below other
    numbers, and what does not meet is text; objects become fields with dotted
    names, arrays are json.  The kinds of all documents are merged by a partial
    aggregation, whatever their order.  A field is nullable unless all
    documents have a value of it.  What is no JSON, or no object, is left
    out, and so is ``_id``.
    """
    docs = _chosen(df, column, rows)
    merged = docs.agg(F.schema_of_variant_agg("v")).first()[0]
    # names stand in backquotes if they hold more than letters
    spelled = "`".join(part if k % 2 else part.replace("OBJECT<", "STRUCT<") for k, part in enumerate(merged.split("`")))
    kind = T._parse_datatype_string(spelled) if spelled.startswith("STRUCT<") else T.StructType()
    leaves = [(path, k) for path, k in _leaves(kind) if path and path[0] != "_id"]
    if not leaves:
        return df.sparkSession.createDataFrame([], "field string, native string, nullable boolean")
    value = lambda path: F.try_variant_get("v", "$" + "".join(map(_step, path)), "variant")
    seen = [F.count_if(value(path).isNotNull() & ~F.is_variant_null(value(path))).alias(f"n{k}") for k, (path, _) in enumerate(leaves)]
    counts = docs.agg(F.count("*").alias("documents"), *seen)
    fields = [F.struct(F.lit(".".join(path)).alias("field"), F.lit(_native(k)).alias("native"), (F.col(f"n{i}") < F.col("documents")).alias("nullable")) for i, (path, k) in enumerate(leaves)]
    return counts.select(F.explode(F.array(*fields)).alias("f")).select("f.*")


def json_table(df: DataFrame, column: str, name: str, rows: int | None = SAMPLE_ROWS) -> Table:
    """A table model of JSON documents."""
    return Table(name, [Column(r.field, r.native, r.nullable) for r in sample_json(df, column, rows).collect()])


def json_schema_table(name: str, schema: dict) -> Table:
    """A table from a declared JSON schema: required fields are not null, a union takes its first member."""
    kinds = {"integer": "bigint", "int": "int", "long": "bigint", "number": "double", "double": "double", "boolean": "boolean", "bool": "boolean", "date": "timestamp", "object": "json", "array": "json"}
    columns = []
    for field, spec in (schema.get("properties") or {}).items():
        if field == "_id":
            continue
        kind = spec.get("bsonType") or spec.get("type") or "string"
        kind = kind[0] if isinstance(kind, list) else kind
        columns.append(Column(field, kinds.get(kind, "text"), field not in (schema.get("required") or []), enum=list(spec.get("enum") or [])))
    return Table(name, columns)


#: fixed values: migration tools, their history tables and the columns read; then version, name, applied time and whether applied, as SQL
HISTORY = {
    "golang-migrate": ("schema_migrations", ["version", "dirty"], "version", "if(dirty, 'dirty', '')", "null", "not dirty"),
    "flyway": ("flyway_schema_history", ["version", "description", "installed_on", "success"], "version", "description", "installed_on", "success"),
    "goose": ("goose_db_version", ["version_id", "is_applied", "tstamp"], "version_id", "''", "tstamp", "is_applied"),
    "alembic": ("alembic_version", ["version_num"], "version_num", "''", "null", "null"),
    "atlas": ("atlas_schema_revisions", ["version", "description", "executed_at"], "version", "description", "executed_at", "null"),
    "django": ("django_migrations", ["app", "name", "applied"], "name", "app", "applied", "true"),
    "knex": ("knex_migrations", ["name", "batch", "migration_time"], "name", "coalesce(cast(batch as string), '')", "migration_time", "true"),
    "rails": ("ar_internal_metadata", ["key", "value", "updated_at"], "value", "key", "updated_at", "null"),
}


def migration_history(tables: dict[str, DataFrame], last: int = 200) -> DataFrame | None:
    """(source, version, name, applied_at, applied) of the history tables found, newest first, unknown times last.

    A table without a tool's columns is not that tool's.
    """
    out = None
    for source, (table, needed, *facts) in HISTORY.items():
        df = tables.get(table)
        if df is None or not set(needed) <= set(df.columns):
            continue
        kinds = (("version", "string"), ("name", "string"), ("applied_at", "timestamp"), ("applied", "boolean"))
        own = [F.expr(fact).cast(kind).alias(name) for fact, (name, kind) in zip(facts, kinds, strict=True)]
        one = df.select(F.lit(source).alias("source"), *own).orderBy(F.desc_nulls_last("applied_at"), F.desc("version")).limit(last)
        out = one if out is None else out.unionByName(one)
    return None if out is None else out.orderBy(F.desc_nulls_last("applied_at"), "source", F.desc("version"))
