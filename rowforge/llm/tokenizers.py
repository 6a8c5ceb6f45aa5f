"""Exact, memoised use of the public tokenizers inside executors.

Both encoders split a text at places where the library provably never joins
two symbols, ask the library once for each distinct part and keep its answer.
The kept answers are bounded in number; a full memo starts again.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from array import array

import numpy as np
import pyarrow as pa

#: entries of each of a memo's two generations, and the length of the longest part that is kept
MEMO_ENTRIES = 250_000
MEMO_PART = 64
#: characters of the texts whose new parts are asked for together
LEARN_CHARS = 4_000_000
SPACE = "▁"
#: ASCII punctuation that may follow a word and is neither a letter, a digit nor part of a contraction or special string
TAIL = ".,;:!?)"
#: the characters by which byte-level tokenizers write bytes: printable ones as they are, the others from U+0100 on
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Memo(dict):
    """part -> answer; asks ``make`` for a missing part and keeps short ones.

    When the younger generation is full it becomes the older one; an answer
    that is used again moves back.
    """

    def __init__(self, make, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, part):
        answer = self.older.get(part)
        if answer is None:
            answer = self.make(part)
        self.keep(part, answer)
        return answer

    def keep(self, part, answer) -> None:
        if len(part) <= MEMO_PART:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[part] = answer

    def unknown(self, parts: set) -> list:
        return [p for p in parts if p not in self and p not in self.older and len(p) <= MEMO_PART]


def _slices(texts: list[str]):
    """Runs of texts of about LEARN_CHARS in all; longer ones are left out."""
    run, size = [], 0
    for text in texts:
        if len(text) < LEARN_CHARS:
            run.append(text)
            size += len(text)
            if size >= LEARN_CHARS:
                yield run
                run, size = [], 0
    yield run


class WordEncoder:
    """``tokenizers`` library ids as little-endian unsigned 32-bit bytes.

    For tokenizers that drop white space and lower-case (no token spans white
    space, so that words can be encoded one by one).  Words are lowered before
    the look-up only where the whole text is ASCII: the library composes
    characters first, and a capital may not compose with a mark that its small
    letter composes with.  Texts that hold ``<|`` stay as they are too, as
    special strings are matched before anything is lowered.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.words = _Memo(self._word)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        letters = text.rstrip(TAIL)
        if letters.isalpha() and letters.islower() and (letters.isascii() or self._latin(letters)):
            # letters form one part and what follows them another
            symbols = letters if letters.isascii() else letters.encode("utf-8").decode("latin-1").translate(BYTE_CHARS)
            found = [t.id for t in self.model.tokenize(symbols)]
            tail = text[len(letters) :]
            return pack_ids(found) + (self.words[tail.encode()] if tail else b"")
        return pack_ids(self.library.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _latin(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    @staticmethod
    def _raw(text: str) -> bytes:
        raw = text.encode("utf-8")
        return raw.lower() if len(raw) == len(text) and b"<|" not in raw else raw

    def encode(self, text: str) -> bytes:
        raw = self._raw(text)
        if len(raw) <= 1 << 20:
            return b"".join(map(self.words.__getitem__, raw.split()))
        parts, at = [], 0
        while at < len(raw):
            end = raw.find(b" ", at + (1 << 20))
            end = len(raw) if end < 0 else end
            parts.append(b"".join(map(self.words.__getitem__, raw[at:end].split())))
            at = end
        return b"".join(parts)


class PieceLibrary:
    """Counts and ids as the ``sentencepiece`` library gives them.

    If no piece holds a word mark after another character, and white space is
    kept as it is, a space after a non-space always starts a new piece: the
    parts between single spaces are then encoded apart.  Other texts go to the
    library whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.is_byte = np.array([self.library.is_byte(i) for i in range(size)])
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.pieces) and self.library.encode("  a  b ") == (
            self.library.encode("  a") + self.library.encode(" b") + [self.library.piece_to_id(SPACE)]
        )
        # characters that a piece stands for; a byte piece stands for one if it leads
        values = [int(p[1:-1], 16) if b else 0 for p, b in zip(self.pieces, self.is_byte, strict=True)]
        self.follows = np.array([bool(b) and 0x80 <= v < 0xC0 for v, b in zip(values, self.is_byte, strict=True)])
        self.chars = np.array([1 if b else len(p) for p, b in zip(self.pieces, self.is_byte, strict=True)])
        self.chars[self.follows] = 0
        self.marks = np.array([len(p) > 1 and not p.strip(SPACE) for p in self.pieces])
        self.counts = _Memo(lambda part: len(self.library.encode(part)))

    def _splits(self, text: str) -> bool:
        return self.apart and "  " not in text and SPACE not in text and text[:1] != " " and text[-1:] != " "

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text), np.int64)

    def learn(self, texts: list[str]) -> None:
        """Count the parts that are new in ``texts`` together."""
        for run in _slices(texts):
            new = set()
            for text in run:
                if self._splits(text):
                    new.update(text.split(" "))
            parts = self.counts.unknown(new)
            for part, ids in zip(parts, self.library.encode(parts, num_threads=1), strict=True):
                self.counts.keep(part, len(ids))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self._splits(text):
            return len(self.library.encode(text))
        return sum(map(self.counts.__getitem__, text.split(" ")))


_HELD: dict = {}


def held(key, make):
    """The one large thing that a worker keeps from task to task; another operator's goes first."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            _give_back()
        _HELD[key] = make()
    return _HELD[key]


def _give_back() -> None:
    """Return freed memory to the system, which counts it against the executor until then."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def shared_encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return held(("words", path), lambda: WordEncoder(path))


def shared_library(path: str) -> PieceLibrary:
    """One for all tasks of a worker."""
    return held(("pieces", path), lambda: PieceLibrary(path))
