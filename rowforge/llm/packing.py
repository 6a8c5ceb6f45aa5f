"""Best-fit packing of tokenised documents into fixed-capacity sequences.

Only lengths decide where a piece can go, and there are at most ``capacity``
of them: the plan is made on the histogram of lengths, whose size does not
grow with the data, and treats all pieces of a length as one class.  Pieces
are then numbered within their class and look their place up in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm.storage import stored
from rowforge.llm.tokenizers import shared_encoder

CAPACITY = 2048

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str, end_id: int = 0) -> DataFrame:
    """Tokenise and cut: a row per piece, numbered by task and length (part, length, nth)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = shared_encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in (whole.slice(at, 1_000) for whole in batches for at in range(0, whole.num_rows, 1_000)):
            rows, piece, start, length, crc, nth = [], [], [], [], [], []
            texts = [value.as_py() or "" for value in batch.column(1)]
            for row, text in enumerate(texts):
                ids = memoryview(encoder.encode(text) + end)
                for k, at in enumerate(range(0, len(ids), width)):
                    own = ids[at : at + width]
                    n = len(own) // 4
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([part] * len(rows), pa.int32()),
                    pa.array(nth, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return source.mapInArrow(run, PIECES.format(id=source.schema["id"].dataType.simpleString()))


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first, last + 1, bin, per_bin, offset) that place every piece.

    The pieces number first.. of a length go, per_bin to a bin, from that bin
    on, side by side from the offset.  Pieces above a third of the capacity
    meet at most in twos: each of the longest takes the longest that still
    fits.  Shorter ones then go, longest first, to the bin with the smallest
    gap that holds them.  Bins that look alike stand as one group, so that the
    work depends on the number of distinct lengths only.
    """
    left = dict(counts)
    used: dict[int, int] = defaultdict(int)
    segments: list[tuple[int, int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first bin, number of bins)
    gaps: list[int] = []
    bins = 0

    def put(length: int, n: int, first_bin: int, per_bin: int, offset: int) -> None:
        segments.append((length, used[length], used[length] + n, first_bin, per_bin, offset))
        used[length] += n
        left[length] -= n

    def add_group(gap: int, first_bin: int, n: int) -> None:
        if n:
            if gap not in groups:
                bisect.insort(gaps, gap)
            groups[gap].append((first_bin, n))

    large = sorted(n for n in counts if counts[n] and 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - a) - 1
        while k >= 0 and (not left[large[k]] or large[k] == a and left[a] < 2):
            k -= 1
        if k < 0:
            n = left[a]
            put(a, n, bins, 1, 0)
            add_group(capacity - a, bins, n)
        else:
            b = large[k]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if a == b:
                put(a, 2 * n, bins, 2, 0)
            else:
                put(a, n, bins, 1, 0)
                put(b, n, bins, 1, a)
            add_group(capacity - a - b, bins, n)
        bins += n

    for length in sorted((n for n in counts if counts[n] and 3 * n <= capacity), reverse=True):
        while left[length]:
            k = bisect.bisect_left(gaps, length)
            if k == len(gaps):
                # no gap holds it: as many new bins as it fills
                per_bin = capacity // length
                full, rest = divmod(left[length], per_bin)
                if full:
                    put(length, full * per_bin, bins, per_bin, 0)
                    add_group(capacity - per_bin * length, bins, full)
                if rest:
                    put(length, rest, bins + full, rest, 0)
                    add_group(capacity - rest * length, bins + full, 1)
                bins += full + bool(rest)
                continue
            gap = gaps[k]
            first_bin, n = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(k)
            per_bin = gap // length
            full = min(n, left[length] // per_bin)
            if full:
                put(length, full * per_bin, first_bin, per_bin, capacity - gap)
                add_group(gap - per_bin * length, first_bin, full)
            rest = min(left[length], per_bin) if full < n else 0
            if rest:
                put(length, rest, first_bin + full, rest, capacity - gap)
                add_group(gap - rest * length, first_bin + full, 1)
            add_group(gap, first_bin + full + bool(rest), n - full - bool(rest))
    return segments


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give every row of ``pieces`` (part, length, nth; stored) its sequence_id and offset."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # at most `capacity` rows
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        plan_bins(counts, capacity) or [(0, 0, 0, 0, 1, 0)],
        "length long, lo long, hi long, bin long, per_bin long, place long",
    )
    nth = F.col("rank") - F.col("lo")
    return (
        pieces.join(firsts, ["length", "part"])
        .withColumn("rank", F.col("first") + F.col("nth"))
        .join(F.broadcast(plan), (pieces["length"] == plan["length"]) & F.col("rank").between(F.col("lo"), F.col("hi") - 1))
        .select(
            "doc_id",
            "piece",
            "start",
            pieces["length"],
            "ids_crc32",
            (F.col("bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
            (F.col("place") + nth % F.col("per_bin") * pieces["length"]).alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and a closing id 0; null and empty texts are that
    one id.  Documents over ``capacity`` are cut, the last piece may be
    shorter.  Null and repeated ids and repeated texts are packed like any
    other row, each row on its own; an empty table gives an empty result;
    other columns are ignored, whatever their names.  The tokenised pieces
    are written to the shared folder once; no task gathers a length class.
    """
    pieces = stored(cut_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    return place(pieces, capacity).withColumnRenamed("doc_id", id_col)
