"""Generated tables into a database, all of them or none.

Rows are made once, as files (whose commit is Spark's).  From there they go to
staging tables over JDBC, each with the place of its row in the files, so that
a task that ran twice, or a load that is taken up again, leaves the same rows
under the same places.  One transaction then empties what is to be emptied,
children first, and moves each place once, parents first.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.operators.generate import GenerationError, Result, write_tables
from rowforge.sources.catalog import guard

#: the columns of a staging table that say where a row comes from, and which copy of it this is
PLACE, COPY = "rowforge_place", "rowforge_copy"


class LoadError(RuntimeError):
    pass


class Database:
    """Statements of the driver, in transactions; rows never pass through it."""

    def __init__(self, spark: SparkSession, url: str, options: dict[str, str]):
        self.spark, self.url, self.options = spark, url, dict(options)
        jvm = spark._jvm
        facts = jvm.java.util.HashMap()
        for k, v in ({"url": url, "dbtable": "rowforge"} | self.options).items():
            facts.put(k, str(v))
        read = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(jvm.org.apache.spark.api.python.PythonUtils.toScalaMap(facts))
        self.dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
        self.connection = self.dialect.createConnectionFactory(read).apply(-1)

    def quote(self, name: str) -> str:
        return self.dialect.quoteIdentifier(name)

    def run(self, statements: list[str]) -> list[int]:
        """Carry out statements in one transaction; rows that each has changed."""
        self.connection.setAutoCommit(False)
        try:
            statement, counts = self.connection.createStatement(), []
            for text in statements:
                counts.append(statement.executeUpdate(text))
            statement.close()
            self.connection.commit()
            return counts
        except Exception:
            self.connection.rollback()
            raise
        finally:
            self.connection.setAutoCommit(True)

    def number(self, query: str) -> int | None:
        """The one number that a query gives; None if its table is not there."""
        try:
            statement = self.connection.createStatement()
            rows = statement.executeQuery(query)
            rows.next()
            found = rows.getLong(1)
            statement.close()
            return found
        except Exception as error:  # a missing table has no class of its own over all drivers
            if "java.sql.SQL" not in str(error):
                raise
            return None

    def close(self) -> None:
        self.connection.close()


@dataclass
class Load:
    rows: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    staged: list[str] = field(default_factory=list)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """A written table with the place of each row, which is the same however often it is read."""
    place = F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))
    df = spark.read.parquet(path)
    # another word for every time that a task runs
    return df.select(place.alias(PLACE), F.call_function("reflect", F.lit("java.util.UUID"), F.lit("randomUUID")).alias(COPY), *df.columns)


def _stage(df: DataFrame, url: str, table: str, batch: int, options: dict) -> None:
    own = {"createTableColumnTypes": f"{PLACE} VARCHAR(300), {COPY} VARCHAR(40)"} if PLACE in df.columns else {}
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **own, **options).mode("append").save()


def staging_name(table: str, run: str) -> str:
    return f"{re.sub(r'[^A-Za-z0-9_]', '_', table)}_{run}"[:60]


def load_tables(
    result: Result,
    url: str,
    path: str,
    run: str = "rowforge",
    names: dict[str, str] | None = None,
    batch: int = 10_000,
    consent: bool = False,
    progress: Callable[[str, int, float], None] | None = None,
    **options,
) -> Load:
    """Load all tables of ``result`` through files in ``path`` and staging tables of the run ``run``.

    ``names``: what tables are called in the database, where that differs.
    A target that holds rows is an error unless the result appends or
    truncates; a guarded address is refused without ``consent``.  A target
    that is not there is made, with the types that Spark gives it and no
    constraints.  What fails leaves the targets as they were.  Called again
    with the run and path of a load that failed, tables whose files are
    complete are not made again, and staging tables are filled anew.
    """
    if (why := guard(url)) and not consent:
        raise PermissionError(f"refusing to write: {why}")
    spark = next(iter(result.tables.values())).sparkSession
    database, done, target = Database(spark, url, options), Load(), lambda name: (names or {}).get(name, name)
    try:
        held = {name: database.number(f"SELECT count(*) FROM {target(name)}") for name in result.order}
        if taken := [n for n in result.order if held[n] and n not in result.truncated and not result.options.append]:
            raise GenerationError(f"{target(taken[0])} holds rows")
        _files(spark, result, path)
        moves = []
        for name in result.order:
            began, stage = time.time(), staging_name(name, run)
            df = _placed(spark, f"{path}/{name}")
            if database.number(f"SELECT count(*) FROM {stage}") is not None:  # of a load that failed
                database.run([f"DROP TABLE {stage}"])
            _stage(df, url, stage, batch, options)
            done.staged.append(stage)
            rows, places = df.count(), database.number(f"SELECT count(DISTINCT {database.quote(PLACE)}) FROM {stage}")
            if rows != places:
                raise LoadError(f"{name}: {places} of {rows} rows have come to {stage}")
            if held[name] is None:
                _stage(df.drop(PLACE, COPY).limit(0), url, target(name), batch, options)
            columns, place, copy = [c for c in df.columns if c not in (PLACE, COPY)], database.quote(PLACE), database.quote(COPY)
            listed = ", ".join(map(database.quote, columns))
            # a place that came twice holds the same row twice: the copy with the first word stays
            first = f"NOT EXISTS (SELECT 1 FROM {stage} t WHERE t.{place} = s.{place} AND t.{copy} < s.{copy})"
            moves.append(f"INSERT INTO {target(name)} ({listed}) SELECT {listed} FROM {stage} s WHERE {first}")
            done.seconds[name] = time.time() - began
        emptied = [f"DELETE FROM {target(name)}" for name in reversed(result.order) if name in result.truncated]
        counts = database.run(emptied + moves)[len(emptied) :]
        for name, n in zip(result.order, counts, strict=True):
            done.rows[name] = n
            if progress:
                progress(name, n, done.seconds[name])
        database.run([f"DROP TABLE {stage}" for stage in done.staged])
    finally:
        database.close()
    return done


def _files(spark: SparkSession, result: Result, path: str) -> None:
    """Write the tables whose files are not complete in ``path``."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = {name for name in result.order if fs.exists(jpath(f"{path}/{name}/_SUCCESS"))}
    left = [name for name in result.order if name not in whole]
    if left:
        write_tables(Result({n: result.tables[n] for n in left}, result.seed, left, truncated=frozenset(left)), path)
