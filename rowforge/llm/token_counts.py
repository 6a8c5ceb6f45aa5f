"""Token counts of whole texts by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm.tokenizers import PieceLibrary, shared_library

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 128


class _Window:
    """The ids of one chunk with the text offset at which each token starts."""

    def __init__(self, library: PieceLibrary, text: str, start: int, end: int):
        self.start, self.end = start, end
        self.ids = library.ids(text[start:end])
        # the word mark that the library puts in front is not part of the text
        self.at = np.concatenate(([0], np.cumsum(library.chars[self.ids])[:-1])) - 1 + start


def _splice(library: PieceLibrary, left: _Window, right: _Window) -> tuple[int, int] | None:
    """Indices (in left, in right) of a token that proves a common boundary.

    The token that follows the boundary is the same in both windows and so is
    the token before it in ``left``'s eyes: in a byte-pair encoding a sequence
    is the encoding of its text if each neighbouring pair is, and every pair
    of the spliced sequence stands in one of the two windows.  Tokens amid a
    character's bytes and runs of word marks (equal ranks) prove nothing.
    """
    first = np.searchsorted(left.at, right.start + 1)
    places, in_left, in_right = np.intersect1d(left.at[first:], right.at[1:], return_indices=True)
    in_left, in_right = in_left + first, in_right + 1
    a, b = left.ids[in_left], right.ids[in_right]
    before = left.ids[np.maximum(in_left - 1, 0)]
    good = (a == b) & (in_left > 0) & ~library.follows[a] & ~library.marks[a] & ~library.marks[before]
    # a byte's lead and its followers share an offset; intersect1d keeps the first only
    if not good.any():
        return None
    k = np.flatnonzero(good)
    k = k[len(k) // 2]
    return int(in_left[k]), int(in_right[k])


def count_long(library: PieceLibrary, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``, holding two chunks at a time.

    Where two windows share no provable boundary the overlap doubles; an
    overlap that has reached the left window's start makes both one window.
    """
    total, skip = 0, 0
    left = _Window(library, text, 0, min(chunk_chars, len(text)))
    while left.end < len(text):
        overlap, found = overlap_chars, None
        while found is None and overlap < left.end - left.start:
            right = _Window(library, text, left.end - overlap, min(left.end - overlap + max(chunk_chars, 2 * overlap), len(text)))
            found = _splice(library, left, right)
            if found is not None and found[0] < skip:
                found = None
            overlap *= 2
        if found is None:
            # one window over both; the token of its last splice has to stand in it again
            wide = _Window(library, text, left.start, min(left.end + max(chunk_chars, left.end - left.start), len(text)))
            if skip:
                again = np.flatnonzero((wide.at == left.at[skip]) & (wide.ids == left.ids[skip]))
                if not len(again):
                    return len(library.ids(text))
                skip = int(again[0])
            left = wide
            continue
        total += found[0] - skip
        left, skip = right, found[1]
    return total + len(left.ids) - skip


def count_tokens(
    docs: DataFrame,
    model_path: str,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    No shuffle.  Null and empty texts count 0 bytes and 0 tokens; null and
    repeated ids are kept as they are; other columns are ignored, whatever
    their names.  Counts equal those of the library over the whole text.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = shared_library(model_path)
        for batch in (whole.slice(at, 1_000) for whole in batches for at in range(0, whole.num_rows, 1_000)):
            n_bytes, n_tokens = [], []
            texts = [value.as_py() or "" for value in batch.column(1)]
            library.learn([t for t in texts if len(t) <= chunk_chars])
            for text in texts:
                n_bytes.append(len(text.encode("utf-8")))
                if len(text) <= chunk_chars:
                    n_tokens.append(library.count(text))
                else:
                    n_tokens.append(count_long(library, text, chunk_chars, overlap_chars))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = source.schema["id"].dataType.simpleString()
    counted = source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)
