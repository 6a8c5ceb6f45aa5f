"""Exact top-k by inner product over KD-trees, one for each shard.

Shards are the cells of a coarse KD split, so that a shard's tight box can
keep a query away from it altogether.  Every query first searches its own
shard; the k-th score found there then decides which other shards it goes to,
and goes with it to prune their trees from the start.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm.storage import drop_stored, stored

#: bytes of a shard's vectors; rows of a shard, of a leaf; tables of fewer shards than cores get smaller ones, down to LEAST_ROWS
SHARD_BYTES = 32 << 20
SHARD_ROWS, LEAST_ROWS, LEAF_ROWS = 65_536, 64, 256
#: rows on which the coarse split is found; it decides where a vector lies and how evenly, not what is found
SPLIT_ROWS = 8_192
SCALE = 1024.0
LONG = 2**63


def _exact(values: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers held as doubles, as ``kind``; objects are Python's unbounded integers."""
    if kind is object:
        return np.array([int(x) for x in values.ravel().tolist()] + [None], object)[:-1].reshape(values.shape)
    return values.astype(kind, copy=False)


def _kind(size: int, a: float, b: float) -> type:
    """What sums of ``size`` products of numbers up to a and b are exact in."""
    most = size * a * b
    return np.float64 if most < 2.0**52 else np.int64 if most < 2.0**62 and max(a, b) < 2.0**62 else object


def _bits(score: np.ndarray) -> np.ndarray:
    """Scores beyond 64 bits become the nearest number of 64 bits."""
    return np.clip(score, -LONG, LONG - 1) if score.dtype == object else score


def _read(packed: list[bytes], size: int) -> np.ndarray:
    """Packed vectors of one length as rows."""
    joined = b"".join(packed)
    return np.frombuffer(joined, "<f8").reshape(len(packed), size) if joined else np.zeros((len(packed), size))


class BoxTree:
    """Median splits of whole vectors along the widest side, with tight boxes."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.children: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        order = np.arange(len(rows))
        lows, highs = [], []
        todo = [(0, len(rows), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.span)
            if parent >= 0:
                pair = self.children[parent]
                self.children[parent] = (node, pair[1]) if pair[0] < 0 else (pair[0], node)
            own = vectors[order[a:b]]
            low, high = own.min(0), own.max(0)
            lows.append(low)
            highs.append(high)
            self.span.append((a, b))
            if b - a > LEAF_ROWS and (high > low).any():
                side, mid = int(np.argmax(high - low)), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, side], mid)]
                self.children.append((-1, -1))
                todo += [(a + mid, b, node), (a, a + mid, node)]
            else:
                self.children.append(None)
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.low, self.high = np.array(lows), np.array(highs)
        self.most = float(np.abs(vectors).max()) if vectors.size else 0.0
        self.searched = 0
        self._as: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def search(self, query: np.ndarray, own_row: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to smaller ids; none below ``least``, the k-th score known from elsewhere."""
        kind = _kind(len(query), float(np.abs(query).max(initial=0)), self.most)
        if kind not in self._as:
            self._as[kind] = tuple(_exact(x, kind) for x in (self.vectors, self.low, self.high))
        vectors, low, high = self._as[kind]
        q = _exact(query, kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bound = lambda node: _bits(high[node : node + 1] @ up + low[node : node + 1] @ down)[0]
        heap = [(-bound(0), 0)]
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
        while heap:
            limit, node = heapq.heappop(heap)
            kth = best[0][0] if len(best) == k else least
            if kth is not None and -limit < kth:
                break
            pair = self.children[node]
            if pair is not None:
                for child in pair:
                    limit = bound(child)
                    if kth is None or limit >= kth:
                        heapq.heappush(heap, (-limit, child))
                continue
            self.searched += 1
            a, b = self.span[node]
            scores = _bits(vectors[a:b] @ q)
            good = self.rows[a:b] != own_row
            if kth is not None:
                good &= (scores >= kth).astype(bool)
            place = np.flatnonzero(good)
            if len(place) > k:
                place = place[np.lexsort((self.ids[a:b][place], -scores[place]))[:k]]
            for p in place:
                item = (int(scores[p]), -int(self.ids[a + p]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(score, -minus) for score, minus in sorted(best, reverse=True)]


class Cells:
    """A coarse KD split of vectors of one length: medians of a sample along its widest side."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple[int, float, int, int] | int] = []
        self.cells = 0
        self._split(sample, cells)

    def _split(self, sample: np.ndarray, cells: int) -> int:
        node = len(self.nodes)
        self.nodes.append(0)
        spread = sample.max(0) - sample.min(0) if sample.size else np.zeros(1)
        if cells < 2 or not spread.max() > 0:
            self.nodes[node] = self.cells
            self.cells += 1
            return node
        side, left = int(np.argmax(spread)), cells // 2
        values = np.sort(sample[:, side])
        at = values[len(values) * left // cells]
        cut = at if at > values[0] else values[np.searchsorted(values, at, "right")]  # both sides get some
        below = sample[:, side] < cut
        self.nodes[node] = (side, float(cut), self._split(sample[below], left), self._split(sample[~below], cells - left))
        return node

    def of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            what = self.nodes[node]
            if isinstance(what, int):
                out[rows] = what
            elif len(rows):
                side, cut, left, right = what
                below = vectors[rows, side] < cut
                todo += [(left, rows[below]), (right, rows[~below])]
        return out


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(v.as_py()) // 8 for v in column], np.int64)
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def _whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part; v: floor(SCALE * x) as little-endian doubles, which hold it exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for row, value in enumerate(batch.column(1)):
                v = value.values
                if v is not None and not v.null_count:
                    x = np.floor(SCALE * v.to_numpy(zero_copy_only=False).astype(np.float64))
                    if np.isfinite(x).all():
                        keep.append(row)
                        out.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], ["vec_id", "v"])

    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return source.mapInArrow(run, "vec_id long, v binary")


def _placed(whole: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """``whole`` (stored) with the shard of each row, and the number of shards."""
    spark = whole.sparkSession
    size = F.floor(F.octet_length("v") / 8).cast("int")
    counts = {r.size: r.n for r in whole.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}  # lengths of vectors
    total, cores = sum(counts.values()), spark.sparkContext.defaultParallelism
    sample: dict[int, list[np.ndarray]] = {}
    for r in whole.select("v", F.xxhash64("row").alias("hash")).orderBy("hash").limit(SPLIT_ROWS).collect():
        sample.setdefault(len(r.v) // 8, []).append(bytes(r.v))
    cells, first, n_cells, most = {}, {}, 0, []
    for length, n in sorted(counts.items()):
        few = min(-(-n * cores // max(1, total)), -(-n // min(LEAST_ROWS, shard_rows)))
        rows = max(1, min(shard_rows, SHARD_BYTES // (8 * max(1, length))))
        cells[length] = Cells(_read(sample.get(length, []), length), max(-(-n // rows), few))
        first[length] = n_cells
        n_cells += cells[length].cells
        most += [rows] * cells[length].cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for length, rows in _by_size(batch.column(2)):
                cell[rows] = first[length] + (cells[length].of(_read([batch.column(2)[int(r)].as_py() for r in rows], length)) if length else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["row", "vec_id", "v", "cell"])

    placed = whole.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, v binary, cell long")
    # cells that hold many equal vectors, or that the sample cut too large, are dealt over several shards
    rows_of = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # about a row for each shard
    shard, dealt = 0, []
    for cell in range(n_cells):
        parts = max(1, -(-rows_of.get(cell, 0) // (2 * most[cell])))
        dealt.append((cell, shard, parts))
        shard += parts
    table = spark.createDataFrame(dealt or [(0, 0, 1)], "cell long, first long, parts long")
    # one row a cell, and cells of SHARD_BYTES or SHARD_ROWS: small beside the vectors at any size
    placed = placed.join(table.hint("broadcast"), "cell")
    return placed.select((F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).alias("shard"), "row", "vec_id", "v"), max(1, shard)


_FOUND = "row long, query_id long, score long, vec_id long, shard long, low binary, high binary"


def _search(rows: DataFrame, shards: int, k: int, boxes: bool) -> DataFrame:
    """Search the queries (kind 1) of each shard in the trees of its vectors (kind 0).

    With ``boxes`` also a row (shard, low, high) for each tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trees = None, [], {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            out: list[tuple] = []

            def build() -> None:
                by_size: dict[int, list] = {}
                for item in held:
                    by_size.setdefault(len(item[2]), []).append(item)
                for size, items in by_size.items():
                    matrix = _read([i[2] for i in items], size // 8)
                    tree = trees[size] = BoxTree(np.array([i[0] for i in items]), np.array([i[1] for i in items]), matrix)
                    if boxes:
                        out.append((None, None, None, None, shard, tree.low[0].tobytes(), tree.high[0].tobytes()))  # noqa: B023
                held.clear()

            for s, kind, row, vec_id, v, least in zip(*columns, strict=True):
                if s != shard:
                    if held:
                        build()
                    shard, held, trees = s, [], {}
                if kind == 0:
                    held.append((row, vec_id, v))
                    continue
                if held:
                    build()
                if len(v) in trees:
                    found = trees[len(v)].search(_read([v], len(v) // 8)[0], row, k, least)
                    out += [(row, vec_id, score, other, None, None, None) for score, other in found]
            yield _found(out)
        if held:  # the last shard had no queries
            out = []
            build()
            yield _found(out)

    def _found(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], ["row", "query_id", "score", "vec_id", "shard", "low", "high"])

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return dealt.select("shard", "kind", "row", "vec_id", "v", "least").mapInArrow(run, _FOUND)


def _sent(queries: DataFrame, boxes: list, k: int) -> DataFrame:
    """Each query (with its own shard and the k-th score found there) for every other shard whose box can hold as much."""
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for length in {len(b.low) // 8 for b in boxes}:
        own = [b for b in boxes if len(b.low) // 8 == length]
        by_size[length] = (np.array([b.shard for b in own]), _read([bytes(b.low) for b in own], length), _read([bytes(b.high) for b in own], length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, to = [], []
            home, n, least = (batch.column(c).to_pylist() for c in (0, 3, 4))
            for i, value in enumerate(batch.column(2)):
                packed = value.as_py()
                q = _read([packed], len(packed) // 8)[0]
                if len(q) not in by_size:
                    continue
                shards, low, high = by_size[len(q)]
                kind = _kind(len(q), float(np.abs(q).max(initial=0)), max(float(np.abs(low).max(initial=0)), float(np.abs(high).max(initial=0))))
                p = _exact(q, kind)
                bound = _bits(_exact(high, kind) @ np.maximum(p, 0) + _exact(low, kind) @ np.minimum(p, 0))
                good = shards != home[i]
                if n[i] == k:
                    good &= (bound >= least[i]).astype(bool)
                rows += [i] * int(good.sum())
                to += shards[good].tolist()
            at = pa.array(rows, pa.int64())
            known = [least[i] if n[i] == k else None for i in rows]
            columns = [pa.array(to, pa.int64()), batch.column(1).take(at), batch.column(5).take(at), batch.column(2).take(at), pa.array(known, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "row", "vec_id", "v", "least"])

    sent = queries.select("shard", "row", "v", "n", "least", "vec_id").mapInArrow(run, "shard long, row long, vec_id long, v binary, least long")
    return sent.select("shard", F.lit(1).alias("kind"), "row", "vec_id", "v", "least")


def exact_topk(
    vectors: DataFrame,
    every: int,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best by inner product of floor(1024 * x).

    Queries: rows whose id is divisible by ``every``; candidates: all rows but
    the query's own.  Ties go to the smaller id; all candidates if fewer than
    k.  Rows with a null id, a null vector or one with null or non-finite
    components (or whose 1024-fold is no finite double) take no part; vectors are compared with those of their length.
    Numbers are exact however large; a score beyond 64 bits counts as the
    nearest number of 64 bits.  Rows that repeat an id are queries and
    candidates each on their own; an empty table gives no rows; other columns
    are ignored, whatever their names.  What reaches the driver: SPLIT_ROWS
    vectors, and a box for each shard of about ``shard_rows`` rows or
    SHARD_BYTES, whichever is less.
    """
    whole = stored(_whole_vectors(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    placed, shards = _placed(whole, shard_rows)
    placed = stored(placed, "placed")
    drop_stored(whole)
    base = placed.select("shard", F.lit(0).alias("kind"), "row", "vec_id", "v", F.lit(None).cast("long").alias("least"))
    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0)
    first = _search(base.union(queries.select("shard", F.lit(1), "row", "vec_id", "v", F.lit(None).cast("long"))), shards, k, shards > 1)
    if shards > 1:
        first = stored(first, "first")
        boxes = first.where("low IS NOT NULL").select("shard", "low", "high").collect()
        own = first.where("row IS NOT NULL").select("row", "query_id", "score", "vec_id")
        kth = own.groupBy("row").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        sent = stored(_sent(queries.join(kth, "row", "left"), boxes, k), "sent")
        reached = base.join(sent.select("shard").distinct(), "shard", "left_semi").select(*base.columns)
        found = own.union(_search(reached.union(sent), shards, k, False).select("row", "query_id", "score", "vec_id"))
    else:
        found = first.select("row", "query_id", "score", "vec_id")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
