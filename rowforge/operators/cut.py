"""Cutting a plan where rounds or several readers would repeat it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's own folder within that of ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a folder of its own; on a
    cluster it is an error.
    """
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rowforge-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in the checkpoint folder: a lost executor costs a read."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _new_folder(spark: SparkSession, name: str) -> str:
    """A new folder within the checkpoint folder; it goes when the application ends."""
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` from files in the checkpoint folder, for rounds that join what earlier rounds gave.

    A checkpoint keeps the size that Spark guesses from the plan.  A join's
    guess is the product of both sides, a number of twice as many digits in
    each round, which fills the driver.  Files have the size that they have.
    """
    folder = _new_folder(df.sparkSession, "rows")
    df.write.mode("append").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`stored` that is no longer read."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def finished(stream: DataFrame) -> DataFrame:
    """All rows of a stream that ends, written by tasks to files in the checkpoint folder: none comes to the driver.

    The files are removed when the application ends.
    """
    spark = stream.sparkSession
    folder = _new_folder(spark, "stream")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    query.start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
