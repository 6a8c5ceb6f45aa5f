"""Byte-bounded shards by extendible hashing.  DataFrame functions only.

A shard is a prefix of the rows' hashes.  The directory grows only where a
bucket is over the limit: that bucket alone splits on its next bit.  Sums are
taken once at a depth somewhat below the expected one and rolled up from
there; only rows of buckets that are still too large go deeper.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm.storage import stored

#: bits of the id's hash, and further bits that tell rows with equal ids apart
ID_BITS, ROW_BITS = 40, 23
BITS = ID_BITS + ROW_BITS
#: depth of the first sums beyond that of an even spread
MARGIN = 5
#: bytes of text of a shard: what a training worker maps at once
LIMIT_BYTES = 1 << 20


def _id_hash(column: Column) -> Column:
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, ID_BITS // 4), 16, 10).cast("long")


def _depths(active: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """(leaf, depth): how deep each hash prefix of ``depth`` bits lies; one more than ``depth`` if it is itself too large."""
    leaves = active.groupBy("leaf").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    at = F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("at")
    up = leaves.select("leaf", "bytes", "n", at).withColumn("prefix", F.expr(f"shiftright(leaf, {depth} - at)"))
    over = up.groupBy("at", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).where((F.col("bytes") > limit) & (F.col("n") > 1)).select("at", "prefix")
    # every bucket above an oversized one is oversized
    split = up.select("leaf", "at", "prefix").join(over, ["at", "prefix"]).groupBy("leaf").agg(F.count("*").alias("splits"))
    return leaves.select("leaf").join(split, "leaf", "left").select("leaf", (start + F.coalesce("splits", F.lit(0))).cast("int").alias("depth"))


def assign_shards(
    docs: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, depth, shard (``depth`` bits), and the columns named in ``keep``.

    The bytes of a shard's texts sum to at most ``limit``, unless it holds a
    single row, which cannot be split.  Rows are placed by their id; rows that
    repeat an id part only if their bucket would not fit otherwise.  Null
    texts have 0 bytes; null ids hash like an empty text; all rows in one
    shard (depth 0, shard '') if they fit; other columns are ignored, whatever
    their names.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)])
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << ROW_BITS))
    rows = stored(source.withColumn("h", F.shiftleft(_id_hash(F.col("id")), ROW_BITS) + own), "hashed")
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    start, depth = 0, min(BITS, MARGIN + max(0, math.ceil(math.log2(max(1, total) / limit))))
    active, parts = rows, []
    while True:
        at = active.withColumn("leaf", F.shiftright("h", BITS - depth))
        found = stored(_depths(at.select("leaf", "bytes"), start, depth, limit), "directory")
        placed = at.join(found, "leaf")
        deeper = found.where(F.col("depth") > depth)
        if depth == BITS or deeper.isEmpty():
            parts.append(placed.withColumn("depth", F.least("depth", F.lit(depth))))
            break
        parts.append(placed.where(F.col("depth") <= depth))
        active = stored(placed.where(F.col("depth") > depth).drop("leaf", "depth"), "deeper")
        start, depth = depth, min(BITS, depth + 8)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    bits = F.lpad(F.bin(F.expr(f"shiftright(h, {BITS} - depth)")), F.col("depth"), F.lit("0"))
    return out.select(
        F.col("id").alias(id_col), F.col("bytes").alias("n_bytes"), "depth", F.when(F.col("depth") == 0, F.lit("")).otherwise(bits).alias("shard"),
        *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)],
    )


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet, a folder for each shard; columns ``shard`` and ``depth`` of the input are replaced."""
    names = tuple(c for c in docs.columns if c not in ("shard", "depth", "n_bytes", id_col))
    assign_shards(docs, limit, id_col, text_col, names).repartition("shard").write.partitionBy("shard").parquet(path)


#: the same by DuckDB for tables without repeated ids, in buckets of up to ID_BITS bits
ORACLE = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {ID_BITS // 4})) AS BIGINT) AS h
  FROM documents),
l AS (SELECT doc_id, n_bytes, h, CAST(k AS INTEGER) AS depth, h >> CAST({ID_BITS} - k AS INTEGER) AS prefix FROM d, range(0, {ID_BITS + 1}) t(k)),
b AS (SELECT depth, prefix FROM l GROUP BY 1, 2 HAVING NOT (sum(n_bytes) > {LIMIT_BYTES} AND count(*) > 1)),
f AS (SELECT l.doc_id, l.n_bytes, min(l.depth) AS depth, any_value(l.h) AS h FROM l JOIN b USING (depth, prefix) GROUP BY 1, 2)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> CAST({ID_BITS} - depth AS INTEGER)), depth, '0') END AS shard FROM f
"""
