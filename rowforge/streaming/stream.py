"""Streaming generation from the rate source, and windowed checks over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.operators.generate import ID, Options, generate, make_table
from rowforge.plans.model import Schema
from rowforge.plans.plan import Plan


def generate_stream(spark: SparkSession, schema: Schema, plan: Plan, table: str, rows_per_second: int, options: Options | None = None) -> DataFrame:
    """A table as a stream that ends with the plan's rows of it: row n has the values that it has in a batch."""
    source = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return stream_columns(source.select(F.col("value").alias(ID)), schema, plan, table, options)


def stream_columns(rows: DataFrame, schema: Schema, plan: Plan, table: str, options: Options | None = None) -> DataFrame:
    """The row ids ``rows`` (a column ID, a stream or not) with all columns of ``table``, as in the batch.

    Both use the same functions of the row.  Foreign keys are those of the
    plan's parents, or of ``options.existing``: a key that is a function of
    the parent's row is computed, others come from a finished parent by a
    stream-static join.  Text whose uniqueness rests on the rows before
    (``uniqueness="repair"``) is kept in keyed state, for one column; numbers of that
    kind and unique values beside existing ones are refused.  Ids beyond the plan's rows
    of the table are left out.
    """
    made = generate(rows.sparkSession, schema, plan, options)
    return make_table(rows.sparkSession, schema, plan, table, made.tables, made.options, made.seed, rows=rows)


def late_duplicates(events: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """The stream without repeats of a key within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select("window.start", "window.end", by, "n")
