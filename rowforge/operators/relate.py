"""Foreign keys: random draws, one-to-one assignment, mixed-radix composites."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.functions.draw import below

#: rows up to which a pool goes to every executor; larger ones are joined by shuffle
BROADCAST_ROWS = 200_000


class CapacityError(ValueError):
    pass


#: ranges into which a pool is numbered, and keys from which their limits are read
RANGES, LIMIT_KEYS = 256, 16_384


def indexed(keys: DataFrame, column: str) -> DataFrame:
    """(i, key) of the distinct non-null keys in order.

    Keys are numbered within ranges whose limits, read from a bounded choice
    of keys by their hash, stand in the plan: the order is global, the work is
    not, and every evaluation gives a key the same number.  Ranges meet only
    as one count each.
    """
    distinct = keys.select(F.col(column).alias("key")).where("key IS NOT NULL").distinct()
    chosen = sorted(r.key for r in distinct.orderBy(F.xxhash64("key"), "key").limit(LIMIT_KEYS).collect())
    limits = sorted(set(chosen[:: max(1, len(chosen) // RANGES)][1:]))
    place = F.lit(0)
    if limits:
        found = F.array(*[F.lit(x) for x in limits]).cast(f"array<{distinct.schema['key'].dataType.simpleString()}>")
        place = F.size(F.filter(found, lambda x: x <= F.col("key")))
    placed = distinct.withColumn("part", place)
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # at most RANGES + 1 rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1)
    return numbered.join(F.broadcast(counts.select("part", before.alias("before"))), "part").select((F.col("before") + F.col("at")).alias("i"), "key")


def attach(rows: DataFrame, index: Column, pool: DataFrame, name: str, size: int) -> DataFrame:
    side = pool.select(F.col("i").alias("_i"), F.col("key").alias(name))
    side = F.broadcast(side) if size <= BROADCAST_ROWS else side
    return rows.withColumn("_k", index).join(side, F.col("_k") == F.col("_i"), "left").drop("_k", "_i")


def draw_keys(rows: DataFrame, id_col: str, name: str, pool: DataFrame, size: int, salt: int) -> DataFrame:
    """``rows`` with a random key of the pool (i, key) in the column ``name``; null if the pool is empty."""
    if size == 0:
        return rows.withColumn(name, F.lit(None).cast(pool.schema["key"].dataType))
    return attach(rows, drawn(F.col(id_col), salt, size), pool, name, size)


def drawn(row: Column, salt: int, size: int) -> Column:
    """The place in a pool of ``size`` keys that a row draws."""
    return below(row, salt, F.lit(size).cast("long"))


def own_place(row: Column, size: int, offset: int) -> Column:
    """The place that no other of up to ``size`` rows has."""
    return F.pmod(row + offset, F.lit(size).cast("long"))


def assign_one_to_one(rows: DataFrame, id_col: str, name: str, pool: DataFrame, size: int, n_rows: int, offset: int = 0) -> DataFrame:
    """Each row its own parent."""
    if n_rows > size:
        raise CapacityError(f"{name}: {n_rows} rows for {size} parents")
    return attach(rows, own_place(F.col(id_col), size, offset), pool, name, size)


#: children that the rows of a level have on average, and rows of a chain of references
FANOUT, CHAIN = 8, 8


def levels(n_rows: int) -> list[int]:
    """The first rows of a forest's levels; each level is FANOUT times the one before."""
    out, size = [0], FANOUT
    while out[-1] + size < n_rows:
        out.append(out[-1] + size)
        size *= FANOUT
    return out


def forest_parent(row: Column, n_rows: int, salt: int) -> Column:
    """The parent's row: one of the level before, drawn; null for roots.

    No row is its own ancestor, and trees are as deep as there are levels:
    seven for a million rows.
    """
    first = levels(n_rows)
    parent = F.lit(None).cast("long")
    for k in range(1, len(first)):
        drawn_row = F.lit(first[k - 1]).cast("long") + below(row, salt, F.lit(first[k] - first[k - 1]).cast("long"))
        parent = F.when(row >= first[k], drawn_row).otherwise(parent) if k == 1 else F.when(row < first[k], parent).otherwise(drawn_row)
    return parent


def chain_parent(row: Column) -> Column:
    """The row before, for references that no two rows may share; null at the head of each chain of CHAIN rows."""
    return F.when(F.pmod(row, F.lit(CHAIN)) > 0, row - 1)


def stride_for(space: int, seed: int) -> int:
    """A step coprime to the space, so that steps visit every combination once."""
    step = seed % space or 1
    while math.gcd(step, space) != 1:
        step += 1
    return step


def composite_places(row: Column, sizes: list[int], n_rows: int, seed: int) -> list[Column]:
    """A place in each pool, no combination twice: digits of a mixed-radix number that steps through all combinations, the last pool's first."""
    if n_rows > math.prod(sizes):
        raise CapacityError(f"{n_rows} rows for {' x '.join(map(str, sizes))} = {math.prod(sizes)} combinations")
    space, step, start = _walk(sizes, seed)  # of very many combinations the number of a row does not need all
    n = F.pmod(F.lit(start).cast("long") + F.pmod(row, F.lit(space).cast("long")) * step, F.lit(space).cast("long"))
    out, divisor = [], 1
    for size in reversed(sizes):
        quotient = F.call_function("div", n, F.lit(divisor).cast("long")) if divisor > 1 else n
        out.insert(0, F.pmod(quotient, F.lit(size).cast("long")) if divisor < 2**62 else F.lit(0).cast("long"))
        divisor = min(divisor * size, 2**62)
    return out


#: numbers that are looked up together when free ones are sought
LOOKED_UP = 1 << 16


def _walk(sizes: list[int], seed: int) -> tuple[int, int, int]:
    """(space, step, start) of the way through all combinations that :func:`composite_places` takes."""
    space = math.prod(sizes)
    if space >= 2**63:
        space = 2**62
    step = stride_for(space, seed)
    return space, step if space * step < 2**63 else 1, seed % space


def free_turns(rows: DataFrame, id_col: str, taken: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` with ``turn``: row k gets the k-th number, from 0, that is not in ``taken`` (a column ``turn``, distinct).

    The i-th taken number t has t - i free ones before it, so that row k's
    number is k and as many as there are taken ones whose count of free
    numbers before is k or less.  These counts are looked up in ranges of
    LOOKED_UP rows; what a range starts with is one row of a small table.
    """
    spark = rows.sparkSession
    gaps = indexed(taken, "turn").select((F.col("key") - F.col("i")).alias("at"), (F.col("i") + 1).alias("passed")).where(F.col("at") < n_rows)
    gaps = gaps.groupBy("at").agg(F.max("passed").alias("passed"))
    part = lambda c: F.floor(F.col(c) / LOOKED_UP)
    tops = gaps.groupBy(part("at").alias("part")).agg(F.max("passed").alias("top"))
    parts = spark.range(n_rows // LOOKED_UP + 1).withColumnRenamed("id", "part").join(tops, "part", "left")
    before = parts.select("part", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    met = rows.select(F.col(id_col).alias("at"), F.lit(None).cast("long").alias("passed")).unionAll(gaps).withColumn("part", part("at"))
    seen = F.max("passed").over(Window.partitionBy("part").orderBy("at", F.col("passed").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    found = met.withColumn("seen", seen).where("passed IS NULL").join(before, "part", "left")
    return found.select(F.col("at").alias(id_col), (F.col("at") + F.coalesce("seen", "before", F.lit(0))).alias("turn"))


def append_composite(rows: DataFrame, id_col: str, pools: list[tuple[str, DataFrame, int]], existing: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """Combinations of the pools' keys that neither ``existing`` nor another row has: ``rows`` (ids from 0) with a column for each pool.

    Combinations are numbers in mixed radix, in the order in which
    :func:`assign_composite` goes through them with this seed; new rows take
    the first free ones.  Existing combinations with a null or with a key that
    is in no pool take nothing.
    """
    names, sizes = [name for name, *_ in pools], [size for *_, size in pools]
    space, step, start = _walk(sizes, seed)
    held = existing.select(*names).distinct()
    for k, (name, pool, _) in enumerate(pools):
        side = pool.select(F.col("key").alias(f"key_{k}"), F.col("i").alias(f"place_{k}"))
        held = held.join(side, F.col(name) == F.col(f"key_{k}"))
    wide = lambda c: c.cast("decimal(38,0)")
    number, divisor = wide(F.lit(0)), 1
    for k in range(len(pools) - 1, -1, -1):
        number = wide(number + wide(F.col(f"place_{k}")) * F.lit(divisor).cast("decimal(20,0)"))
        divisor *= sizes[k]
    held = held.select(number.alias("number")).where(F.col("number") < F.lit(space).cast("decimal(20,0)"))
    # the way back along the walk
    back = (F.col("number").cast("long") - start) % space
    turn = (wide(F.pmod(back, F.lit(space).cast("long"))) * F.lit(pow(step, -1, space) if space > 1 else 0).cast("decimal(20,0)")) % F.lit(space).cast("decimal(20,0)")
    taken = held.select(turn.cast("long").alias("turn"))
    n_taken = taken.count()
    if n_rows > space - n_taken:
        raise CapacityError(f"{n_rows} rows for {' x '.join(map(str, sizes))} = {space} combinations, of which {n_taken} are taken")
    turns = free_turns(rows, id_col, taken, n_rows)
    places = composite_places(F.col("turn"), sizes, n_rows, seed)
    out = turns.select(id_col, *[place.alias(f"_place_{k}") for k, place in enumerate(places)])
    for k, (name, pool, size) in enumerate(pools):
        out = attach(out, F.col(f"_place_{k}"), pool, name, size)
    return out.drop(*[f"_place_{k}" for k in range(len(pools))])


def assign_composite(rows: DataFrame, id_col: str, pools: list[tuple[str, DataFrame, int]], n_rows: int, seed: int) -> DataFrame:
    """Distinct combinations of the pools' keys, spread over all of them."""
    places = composite_places(F.col(id_col), [size for *_, size in pools], n_rows, seed)
    out = rows.withColumns({f"_place_{k}": place for k, place in enumerate(places)})
    for k, (name, pool, size) in enumerate(pools):
        out = attach(out, F.col(f"_place_{k}"), pool, name, size)
    return out.drop(*[f"_place_{k}" for k in range(len(pools))])
