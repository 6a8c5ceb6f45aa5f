"""Quality scores by compression against dictionaries of good and of bad text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm.tokenizers import held

#: rows of each label that the fit reads at most
SAMPLE_ROWS = 2_000
#: characters of the blocks in which their whole texts go to a dictionary
SAMPLE_CHARS = 1_024
#: rows handled together in a worker
BATCH_ROWS = 1_000
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 112_640, 1_024, 3


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries by label, and the slope and offset that turn a size difference into a score."""

    bad: bytes
    good: bytes
    weights: tuple[float, float] = (1.0, 0.0)

    def score(self, difference: float) -> float:
        line = self.weights[0] * difference + self.weights[1]
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, line))))


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False)


def size_difference(model: CompressionModel, text: str) -> float:
    """(bad - good) / (bad + good) of the compressed sizes of all blocks of the text.

    Blocks are compressed apart: in one long frame the text itself would soon
    take the dictionary's place.
    """
    raw = text.encode("utf-8")
    bad, good = _compressor(model.bad).compress, _compressor(model.good).compress
    b = g = 0
    for at in range(0, max(1, len(raw)), BLOCK_BYTES):
        block = raw[at : at + BLOCK_BYTES]
        b += len(bad(block))
        g += len(good(block))
    return (b - g) / (b + g)


def _dictionary(blocks: list[str]) -> bytes:
    import zstandard

    raw = [b.encode("utf-8") for b in blocks]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, raw, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples: their text itself
        return b"".join(raw)[:DICTIONARY_BYTES] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weights of a weighted logistic regression by Newton steps, with a slight pull to 0."""
    scale = np.abs(x).mean(0)
    scale[scale == 0] = 1.0
    a, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (weight * (y - p)) - 1e-2 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w / scale))


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> CompressionModel | None:
    """Fit on at most SAMPLE_ROWS rows of each label, those with the smallest hash of their id.

    ``labels``: rows to learn from only.  Ids with both labels teach nothing.
    The bound is on rows only: dictionaries and calibration are of their whole
    texts.  None if a label has less than two texts.
    """
    spark = docs.sparkSession
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("top"))
        .where(F.col("label") == F.col("top"))
        .select("id", "label")
    )
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("id"), F.col("id")]
    picked = [known.where(F.col("label") == y).orderBy(*order).limit(SAMPLE_ROWS) for y in (0, 1)]
    ids = [(r.id, r.label) for p in picked for r in p.collect()]
    if len(shares) < 2:
        return None
    kind = docs.schema[id_col].dataType.simpleString()
    # every second row by the order of ids: each half is calibrated on dictionaries of the other half
    halves = [(i, y, k % 2) for y in (0, 1) for k, (i, _) in enumerate(sorted((x for x in ids if x[1] == y), key=lambda x: x[0]))]
    sample = spark.createDataFrame(halves, f"id {kind}, label int, half int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").where(F.length("text") > 0)
    # rows that repeat an id are one: that with the smallest text
    rows = texts.groupBy("id", "label", "half").agg(F.min("text").alias("text")).orderBy("id").collect()
    by_label = {y: [r for r in rows if r.label == y] for y in (0, 1)}
    if min(len({r.half for r in own}) for own in by_label.values()) < 2:
        return None
    blocks_of = lambda y, halves: [r.text[at : at + SAMPLE_CHARS] for r in by_label[y] if r.half in halves for at in range(0, len(r.text), SAMPLE_CHARS)]
    apart = [CompressionModel(*(_dictionary(blocks_of(y, {1 - half})) for y in (0, 1))) for half in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [size_difference(apart[h], t) for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.float64())], ["id", "label", "difference"])

    # differences of whole texts, found where the texts lie
    found = texts.select("id", "label", "half", "text").mapInArrow(run, f"id {kind}, label int, difference double")
    found = found.groupBy("id", "label").agg(F.min("difference").alias("difference")).orderBy("id").collect()
    n_of = {y: len(by_label[y]) for y in (0, 1)}
    x, y = np.array([[r.difference, 1.0] for r in found]), np.array([r.label for r in found], float)
    weight = np.array([shares[r.label] / sum(shares.values()) / n_of[r.label] for r in found]) * len(found)
    return CompressionModel(*(_dictionary(blocks_of(label, {0, 1})) for label in (0, 1)), _logistic(x, y, weight))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, and the columns named in ``keep``.

    Labels of ids with crc32(id as text) mod 5 = 0 are held out.  The score
    comes from the text alone, all of it; null and empty texts score like an
    empty text.  Without texts of both labels every score is 1.0 if only label
    1 occurs, 0.0 if only label 0 does, else 0.5.  A null id is hashed as an
    empty text; repeated rows are scored each; an empty table gives no rows;
    other columns are ignored, whatever their names.  Two passes fetch the
    sample's texts and differences, one scores; no other text is shuffled.
    """
    bucket = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5
    learn = labels.where(bucket(id_col) != 0)
    model = fit_model(docs, learn, id_col, text_col, label_col)
    if model is None:
        seen = {r[0] for r in learn.select(label_col).where(F.col(label_col).isin(0, 1)).distinct().collect()}
        flat = float(seen.pop()) if len(seen) == 1 else 0.5
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality", dict)
        for batch in (whole.slice(at, BATCH_ROWS) for whole in batches for at in range(0, whole.num_rows, BATCH_ROWS)):
            if model is None:
                scores = [flat] * batch.num_rows
            else:
                scores = [model.score(size_difference(model, v.as_py() or "")) for v in batch.column(1)]
            columns = [batch.column(0), pa.array(scores, pa.float64()), *(batch.column(2 + k) for k in range(n_keep))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "score", *(f"keep_{k}" for k in range(n_keep))])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    head, _, rest = kinds.partition(", ")
    scored = source.mapInArrow(run, f"{head}, score double" + (f", {rest}" if rest else ""))
    return scored.select(
        F.col("id").alias(id_col),
        (bucket("id") == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
        *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)],
    )
