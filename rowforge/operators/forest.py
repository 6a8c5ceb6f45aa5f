"""Checks of references within one table: roots, orphans, depth and cycles, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from rowforge.operators.cut import drop_stored, stored


def _ahead(rows: DataFrame, inner: DataFrame) -> DataFrame:
    """``rows`` moved to where the rows that they lead to have come."""
    to = inner.select(F.col("key").alias("of"), F.col("at").alias("to"), F.col("depth").alias("more"), F.col("end").alias("found"))
    met = rows.join(to, F.col("at") == F.col("of"))
    return met.select("key", F.col("to").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("found").alias("end"))


def jump(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, depth, state) of each row with a key: state is "root", "under" (a root), "orphan", "under orphan" or "cycle".

    ``depth`` counts the references to the root, or to the row whose parent
    is missing.  "cycle" rows stand in a cycle or lead to one and have no
    depth; a row that refers to itself is a root.  Keys are taken as unique:
    of rows that share one the largest parent counts.  Rounds are for the rows
    that others refer to; the others look their parent up in the end.  Every
    round doubles the references that a row has followed, so that there are as
    many rounds as the depth has binary digits, and one more if there are
    cycles.
    """
    untyped = isinstance(df.schema[parent].dataType, NullType)
    up = F.col(parent).cast(df.schema[key].dataType) if untyped else F.col(parent)
    # from files, so that Spark can split a parent of many rows (or none at all): it splits no join that an aggregate feeds
    own = stored(df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(up).alias("parent")))
    keys = own.select(F.col("key").alias("known"))
    met = own.join(keys, F.col("parent") == F.col("known"), "left")
    end = F.col("parent").isNull() | (F.col("parent") == F.col("key"))
    state = F.when(end, "root").when(F.col("known").isNull(), "orphan")
    # at: the row that the references followed so far lead to; its own end, if it has come to one
    rows = stored(met.select("key", F.when(state.isNull(), F.col("parent")).otherwise(F.col("key")).alias("at"), F.when(state.isNull(), 1).otherwise(0).cast("long").alias("depth"), state.alias("end")))
    drop_stored(own)
    wanted = rows.where("end IS NULL").select(F.col("at").alias("wanted")).distinct()
    inner = stored(rows.join(wanted, F.col("key") == F.col("wanted"), "left_semi"))
    left = inner.where("end IS NULL").count()
    while left:
        # rows that have come to an end are not joined again; a hot row is one row of ``inner`` and the other side can be split
        last, inner = inner, stored(inner.where("end IS NOT NULL").unionAll(_ahead(inner.where("end IS NULL"), inner)))
        drop_stored(last)
        # the n-th round ends the rows 2^(n-1) to 2^n - 1 references deep; above a deeper row there is one of each depth, so that after a round without any only cycles are left
        before, left = left, inner.where("end IS NULL").count()
        if left == before:
            break
    rows = rows.where("end IS NOT NULL").unionAll(_ahead(rows.where("end IS NULL"), inner))
    state = F.when(F.col("end").isNull(), "cycle").when(F.col("depth") == 0, F.col("end")).when(F.col("end") == "orphan", "under orphan").otherwise("under")
    none = F.col("end").isNull()
    return rows.select("key", F.when(~none, F.col("at")).alias("root"), F.when(~none, F.col("depth")).alias("depth"), state.alias("state"))


def forest_report(df: DataFrame, key: str, parent: str) -> DataFrame:
    """One row: rows, roots, orphans, in_cycles (rows that stand in cycles or lead to one) and depth (the most references to a root)."""
    found = jump(df, key, parent)
    return found.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("state") == "root").alias("roots"),
        F.count_if(F.col("state") == "orphan").alias("orphans"),
        F.count_if(F.col("state") == "cycle").alias("in_cycles"),
        F.max(F.when(F.col("state").isin("root", "under"), F.col("depth"))).alias("depth"),
    )
