"""Fixture files: CSV, JSON arrays and SQL inserts in load order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.functions.scalars import sql_literal
from rowforge.plans.ddl import quote

ROWS_PER_INSERT = 1_000


def csv(df: DataFrame, path: str) -> None:
    """Header, null as empty, times in full."""
    df.write.csv(path, header=True, nullValue="", emptyValue='""', timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def ndjson(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def sql_rows(df: DataFrame) -> DataFrame:
    """A row of SQL literals in brackets for each row, in column order."""
    cells = [sql_literal(F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in df.schema.fields]
    return df.select(F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(")")).alias("row_sql"))


def sql_inserts(df: DataFrame, table: str, dialect: str = "postgres") -> DataFrame:
    """Whole INSERT statements, a row each; every task makes its own from ROWS_PER_INSERT rows at a time."""
    head = f"INSERT INTO {quote(table, dialect)} ({', '.join(quote(c, dialect) for c in df.columns)}) VALUES\n"
    numbered = sql_rows(df).withColumn("at", F.monotonically_increasing_id())
    part = F.spark_partition_id()
    batch = F.floor(F.col("at") / ROWS_PER_INSERT)
    grouped = numbered.withColumn("batch", F.concat_ws("-", part, batch)).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("at", "row_sql"))).alias("rows"))
    return grouped.select(F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["row_sql"]), ",\n"), F.lit(";")).alias("statement"))


def _texts(df: DataFrame) -> dict[str, Column]:
    """Columns as what files hold: times in full, bytes as text."""
    out = {}
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + ("XXX" if kind == "timestamp" else ""))
        out[f.name] = c.cast("string") if kind == "binary" else c
    return out


def csv_rows(df: DataFrame) -> DataFrame:
    """A line of CSV for each row; null and empty text are empty."""
    plain = {f.name: f.dataType.typeName() == "decimal" for f in df.schema.fields}  # whose scale stays
    cells = [(c.cast("string") if plain[n] else c).alias(f"v{k}") for k, (n, c) in enumerate(_texts(df).items())]
    return df.select(F.to_csv(F.struct(*cells), {"nullValue": "", "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("row_text"))


def json_rows(df: DataFrame) -> DataFrame:
    """An indented JSON object for each row, fields in column order, nulls too."""
    value = lambda c: F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    field = lambda name, c: F.concat(F.lit(f"    {json.dumps(name, ensure_ascii=False)}: "), F.regexp_replace(value(c), r'(?s)^\{"v":(.*)\}$', "$1"))
    return df.select(F.concat(F.lit("  {\n"), F.concat_ws(",\n", *[field(n, c) for n, c in _texts(df).items()]), F.lit("\n  }")).alias("row_text"))


#: bytes that are copied at a time where a file system cannot join files
COPIED = 1 << 20


def single_file(rows: DataFrame, path: str, head: str, separator: str, foot: str, empty: str | None = None) -> None:
    """One file of the rows of a text column, between ``head`` and ``foot``.

    Tasks write parts, in which every row begins with ``separator``; the first
    one's is left out.  The parts are then joined in the target's own file
    system (where it can: HDFS joins without moving bytes; elsewhere they are
    copied a block at a time), so that no row comes to the driver.  Without
    rows the file is ``empty``, or head and foot.
    """
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    jpath = jvm.org.apache.hadoop.fs.Path
    target, folder = jpath(path), jpath(f"{path}.parts")
    fs = target.getFileSystem(conf)
    fs.delete(folder, True)
    text = rows.columns[0]
    rows.select(F.concat(F.lit(separator), F.col(text)).alias("value")).write.option("compression", "none").text(folder.toString())
    parts = sorted((s.getPath().toString() for s in fs.listStatus(folder) if s.getLen() > 0 and s.getPath().getName().startswith("part-")))
    write = lambda to, piece: to.write(bytearray(piece.encode("utf-8")))
    first = fs.create(target, True)
    try:
        if parts:
            write(first, head)
            _copy(jvm, fs, jpath(parts[0]), first, len(separator.encode("utf-8")))
        else:
            write(first, head + foot if empty is None else empty)
    finally:
        first.close()
    if parts:
        end = jpath(f"{path}.parts/end")
        last = fs.create(end, True)
        write(last, foot)
        last.close()
        rest = [*map(jpath, parts[1:]), end]
        if not _joined(spark, fs, target, rest):
            # a file system that cannot join may not be able to append either: all again into one file
            out = fs.create(target, True)
            try:
                write(out, head)
                _copy(jvm, fs, jpath(parts[0]), out, len(separator.encode("utf-8")))
                for part in rest:
                    _copy(jvm, fs, part, out, 0)
            finally:
                out.close()
    fs.delete(folder, True)


def _joined(spark: SparkSession, fs, target, rest: list) -> bool:
    listed = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(rest))
    for k, part in enumerate(rest):
        listed[k] = part
    try:
        fs.concat(target, listed)
        return True
    except Exception as error:
        if "UnsupportedOperation" not in f"{type(error).__name__} {error}":
            raise
        return False


def _copy(jvm, fs, part, out, skip: int) -> None:
    source = fs.open(part)
    try:
        source.seek(skip)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, COPIED, False)
    finally:
        source.close()


def dump(tables: dict[str, DataFrame], order: list[str], folder: str, fmt: str, dialect: str = "postgres") -> list[str]:
    """One file a table in Spark's file system, numbered in load order; none appear if one fails.

    ``fmt``: csv (with a header), json (an array) or sql (one INSERT).
    """
    frames = [(name, tables[name]) for name in order]
    spark = frames[0][1].sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    target = folder.rstrip("/")
    staging, fs = f"{target}.partial", jpath(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jpath(staging), True)
    names = []
    fs.setWriteChecksum(False)  # on a local disk, no further file beside each
    try:
        for k, (name, df) in enumerate(frames, 1):
            names.append(f"{k:02d}_{name}.{fmt}")
            _FORMATS[fmt](df, name, f"{staging}/{names[-1]}", dialect)
        fs.mkdirs(jpath(target))
        for name in names:
            fs.delete(jpath(f"{target}/{name}"), False)
            fs.rename(jpath(f"{staging}/{name}"), jpath(f"{target}/{name}"))
    finally:
        fs.setWriteChecksum(True)
        fs.delete(jpath(staging), True)
    return [f"{target}/{n}" for n in names]


def _csv(df: DataFrame, name: str, path: str, dialect: str) -> None:
    quoted = ['"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c for c in df.columns]
    single_file(csv_rows(df), path, ",".join(quoted) + "\n", "", "")


def _json(df: DataFrame, name: str, path: str, dialect: str) -> None:
    single_file(json_rows(df), path, "[\n", ",\n", "]\n", "[]\n")


def _sql(df: DataFrame, name: str, path: str, dialect: str) -> None:
    head = f"INSERT INTO {quote(name, dialect)} ({', '.join(quote(c, dialect) for c in df.columns)}) VALUES\n"
    single_file(sql_rows(df), path, head, ",", ";\n", f"-- {name}: no rows\n")


_FORMATS = {"csv": _csv, "json": _json, "sql": _sql}
