"""SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm.tokenizers import SPACE, _Memo, held, pack_ids

#: Spark stops handing rows to Python below this many, so that long texts stay few
BATCH_ROWS = 1_000


class PieceTable:
    """Pieces, ranks and bytes of a model file with byte fallback and no text normalisation.

    ``kind`` is ``"bpe"`` or ``"unigram"``; by default that of the file.
    """

    def __init__(self, path: str, kind: str | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError(f"{path}: only models that keep the text as it is, with a word mark in front, can be streamed")
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind or {1: "unigram", 2: "bpe"}.get(model.trainer_spec.model_type, "")
        if self.kind not in ("bpe", "unigram"):
            raise ValueError(f"{path}: neither byte-pair nor unigram pieces")
        self.ids, self.score, self.byte_ids = {}, {}, {}
        self.bytes: list[bytes] = []
        for i, piece in enumerate(model.pieces):
            if library.is_byte(i):
                value = int(piece.piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif library.is_control(i):
                self.bytes.append(b"")
            elif library.is_unknown(i):
                self.bytes.append(" ⁇ ".encode())
            else:
                self.ids[piece.piece], self.score[piece.piece] = i, piece.score
                self.bytes.append(piece.piece.replace(SPACE, " ").encode("utf-8"))
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(self.score.values()) - 10.0
        #: a space after another character always starts a piece: all paths meet there
        self.meets_at_space = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: lengths of the pieces that end in three given characters, or are the last two of them or the last one, longest first
        ends: dict[str, set[int]] = defaultdict(set)
        whole = [p for p in self.ids if len(p) > 1 and (self.kind == "unigram" or self.merge(p) == [p])]
        for piece in whole:
            ends[piece[-3:]].add(len(piece))
        pairs = {p for p in whole if len(p) == 2}
        self.ends = {end: (*sorted(lengths, reverse=True), *([2] if len(end) > 2 and end[1:] in pairs else []), 1) for end, lengths in ends.items()}
        #: neighbours within some piece; between any others all paths meet
        self.joins = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._pairs = _Memo(self._pair)

    def merge(self, symbols: str) -> list[str]:
        """Plain byte-pair merging of a short string: best score first, then leftmost."""
        parts = list(symbols)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, pair: tuple[str, str]) -> bool:
        return self.merge(pair[0] + pair[1]) == list(pair)

    def extend_pairs(self, text: str, pieces: list[str]) -> None:
        """Find the piece that ends at each further boundary of the window: the one that byte-pair merging leaves after its left neighbour."""
        ids, ends, pairs, one = self.ids, self.ends, self._pairs, (1,)
        for end in range(len(pieces), len(text) + 1):
            for length in (end > 2 and ends.get(text[end - 3 : end])) or (end > 1 and ends.get(text[end - 2 : end])) or one:
                if length > end:
                    continue
                piece = text[end - length : end]
                if length > 1 and piece not in ids:
                    continue
                before = pieces[end - length]
                if not before or pairs[before, piece]:
                    pieces.append(piece)
                    break
            else:
                raise ValueError(f"no piece can end after {text[max(0, end - self.longest) : end]!r}")

    def extend_best(self, text: str, pieces: list[str], best: list[float]) -> None:
        """Find the piece that ends at each further boundary of the window on the way of the best sum of scores."""
        score, ends, unknown, one = self.score, self.ends, self.unknown_score, (1,)
        for end in range(len(pieces), len(text) + 1):
            found, most = "", float("-inf")
            for length in (end > 2 and ends.get(text[end - 3 : end])) or (end > 1 and ends.get(text[end - 2 : end])) or one:
                start = end - length
                piece = text[max(0, start) : end]
                value = score.get(piece, unknown if length == 1 else None)
                if start >= 0 and value is not None and best[start] + value > most:
                    found, most = piece, best[start] + value
            pieces.append(found)
            best.append(most)

    def out(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode("utf-8")]


class ViterbiStream:
    """Feed text in portions of any size, take the ids that are certain, finish.

    Each boundary has one best way back.  For unigram pieces it is that of the
    best sum of scores.  For byte-pair pieces it is the one piece that can end
    there: a sequence is the encoding of its text if each neighbouring pair
    is, and a text's prefixes have one encoding each.  A later piece can only
    start at one of the last ``longest`` boundaries: the search sees no more
    than these and their characters (``text``, ``pieces``, ``best``).  Of the
    boundaries before them only the way back is held (``back``), and no
    longer than until the ways back from all of the window meet at one
    boundary: what lies before that is final.
    """

    def __init__(self, table: PieceTable, front: str = SPACE):
        self.table = table
        self.text = ""
        self.pieces = [""]  # the piece that ends at each boundary of self.text
        self.best = [0.0]
        self.back = [""]  # the same of every boundary since the last that was committed
        self.peak = 0
        self._next = 2 * table.longest
        self._extend(front)

    def _extend(self, text: str) -> None:
        longest, known = self.table.longest, len(self.pieces)
        self.text += text.replace(" ", SPACE)
        if self.table.kind == "bpe":
            self.table.extend_pairs(self.text, self.pieces)
        else:
            self.table.extend_best(self.text, self.pieces, self.best)
        self.back += self.pieces[known:]
        self.peak = max(self.peak, len(self.pieces), len(self.back))
        if (far := len(self.pieces) - longest) > 0:
            # the piece at the first boundary stays as the left neighbour of what follows
            self.text, self.pieces, self.best = self.text[far:], self.pieces[far:], self.best[far:]

    def _commit(self, to: int) -> list[int]:
        found, at = [], to
        while at:
            found.append(self.back[at])
            at -= len(self.back[at])
        del self.back[:to]
        return [i for piece in reversed(found) for i in self.table.out(piece)]

    def _meet(self) -> int:
        """The last boundary that every way back from the window passes."""
        open_ = set(range(max(0, len(self.back) - self.table.longest), len(self.back)))
        while len(open_) > 1:
            k = max(open_)
            open_.remove(k)
            open_.add(k - len(self.back[k]) if k else 0)
        return open_.pop()

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(text), self.table.longest):
            self._extend(text[at : at + self.table.longest])
            if len(self.back) > self._next:
                out += self._commit(self._meet())
                # ways that have not met yet are walked again when there are twice as many
                self._next = max(2 * self.table.longest, 2 * len(self.back))
        return out

    def finish(self) -> list[int]:
        return self._commit(len(self.back) - 1)


def shared_codec(path: str) -> PieceCodec:
    """One for all tasks of a worker."""
    return held(("codec", path), lambda: PieceCodec(path))


class PieceCodec:
    """Ids and texts of one model; one per worker."""

    def __init__(self, path: str, kind: str | None = None):
        self.table = PieceTable(path, kind)
        self.parts = _Memo(self._part)
        self.runs = _Memo(self._run)

    def _part(self, part: str) -> bytes:
        """Ids of a mark and ``part``: those of the runs between which all paths meet."""
        text, joins = SPACE + part, self.table.joins
        if all(map(joins.__contains__, map(add, text, text[1:]))):
            return self.runs[text]
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in joins]
        return b"".join([self.runs[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])

    def _run(self, run: str) -> bytes:
        table = self.table
        if len(run) <= table.longest:  # the window holds all of it, and nothing is committed before its end
            pieces, at, found = [""], len(run), []
            if table.kind == "bpe":
                table.extend_pairs(run, pieces)
            else:
                table.extend_best(run, pieces, [0.0])
            ids = table.ids
            while at:
                piece = pieces[at]
                at -= len(piece)
                i = ids.get(piece)
                found += (i,) if i is not None else [table.byte_ids[b] for b in reversed(piece.encode("utf-8"))]
            found.reverse()
            return pack_ids(found)
        stream = ViterbiStream(self.table, "")
        return pack_ids(stream.feed(run) + stream.finish())

    def _stream(self, text: str) -> list[int]:
        stream = ViterbiStream(self.table)
        return stream.feed(text) + stream.finish()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes; an empty text has none."""
        if not text:
            return b""
        if not self.table.meets_at_space or "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return pack_ids(self._stream(text))
        return b"".join(map(self.parts.__getitem__, text.split(" ")))

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that form no character become U+FFFD."""
        raw = b"".join(map(self.table.bytes.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (array<int>), decoded, round_trip.

    No shuffle.  A null or empty text has no ids and decodes to an empty text.
    ``round_trip`` tells whether the decoded text equals the input (null counts
    as empty); a text that holds the word mark U+2581 itself comes back with
    spaces in its place, as the model cannot tell them apart.  Null and
    repeated ids are kept; other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                texts = [v.as_py() or "" for v in batch.column(1)]
                raw = [codec.encode(t) for t in texts]
                flat = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
                ends = np.cumsum([0] + [len(r) // 4 for r in raw])
                back = [codec.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                        pa.array(back, pa.string()),
                        pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                    ],
                    ["id", "n_tokens", "ids", "decoded", "round_trip"],
                )

    kind = source.schema["id"].dataType.simpleString()
    coded = source.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, decoded string, round_trip boolean")
    return coded.withColumnRenamed("id", id_col)
