"""Alignment of the tokens of two tokenizers over the bytes that they share.

Tasks encode texts both ways and turn every block of documents into postings:
one row for each linked pair of ids, with the block's documents that hold it
and how often.  Postings are shuffled by side A's id (and its partner, so that
no id is one task's), meet there the pair's count and its id's maximum, and
the documents' contributions are summed by document.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm.storage import stored
from rowforge.llm.tokenizers import BYTE_CHARS, MEMO_PART, SPACE, held

#: characters of a text, and parts of several, that are aligned together
PORTION_CHARS = 1 << 20
PORTION_PARTS = 200_000
#: documents and pairs with their documents that make a block of postings full
BLOCK_DOCS = 1 << 14
BLOCK_PAIRS = 2_000_000
#: parts and pairs of parts that a worker keeps; beyond them it starts again
KEPT_PARTS = 250_000
KEPT_PAIRS = 2_000_000
DOC_BITS = 20
#: where both tokenizers always start a token: a space after what is no white space, or one before what is none
_CUT = re.compile(r"(?<=[^\s]) |(?<=[^ ]) (?=\S)")
_RUN = re.compile(r"\s ")


def parts_of(text: str) -> list[str]:
    """``text`` cut at the spaces at which both tokenizers cut; each part goes without the space before it.

    The byte-level tokenizer leaves the last space of a run of white space to
    the word that follows, and looks at nothing before a run; pieces of the
    other hold word marks at their start only.  A space at the start runs on
    from the one before the text.
    """
    return _CUT.split(text) if text[:1] == " " or _RUN.search(text) else text.split(" ")


def portions(text: str, size: int = PORTION_CHARS) -> Iterator[list[str]]:
    """The parts of ``text``, those of about ``size`` characters at a time."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield parts_of(text[at : cut.start()])
        at = cut.end()
    yield parts_of(text[at:] if at else text)


def align(a: list[int], b: list[int], size_a: list[int], size_b: list[int], bits: int) -> tuple[list[int], list[str]]:
    """Links (A's id shifted by ``bits``, and B's) and groups of two encodings of the same bytes; ``size_*`` are the tokens' lengths by id."""
    if len(a) == 1 or len(b) == 1:
        return [x << bits | y for x in a for y in b], [f"{','.join(map(str, a))}|{','.join(map(str, b))}"]
    links, groups, last = [], [], len(a) - 1
    i = j = first_i = first_j = 0
    end_a, end_b = size_a[a[0]], size_b[b[0]]
    while True:
        x, y = a[i], b[j]
        links.append(x << bits | y)
        if end_a < end_b:
            i += 1
            end_a += size_a[a[i]]
        elif end_b < end_a:
            j += 1
            end_b += size_b[b[j]]
        else:
            if first_i == i and first_j == j:
                groups.append(f"{x}|{y}")
            else:
                groups.append(f"{','.join(map(str, a[first_i : i + 1]))}|{','.join(map(str, b[first_j : j + 1]))}")
            if i == last:
                return links, groups
            i, j = i + 1, j + 1
            first_i, first_j = i, j
            end_a, end_b = end_a + size_a[a[i]], end_b + size_b[b[j]]


class PartAligner:
    """Aligned parts by number: tokens, groups and links of each distinct part of a worker's texts.

    A part whose joined bytes differ from its own is marked as bad.
    """

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.lib_a = Tokenizer.from_file(path_a)
        self.lib_a.encode_special_tokens = True
        self.lib_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = {chr(BYTE_CHARS.get(b, b)): b for b in range(256)}
        vocab = self.lib_a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes_a[k] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        n = self.lib_b.get_piece_size()
        pieces = [self.lib_b.id_to_piece(k) for k in range(n)]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.lib_b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.mark = self.lib_b.piece_to_id(SPACE)
        self.bits = max(1, (n - 1).bit_length())
        if max(1, (len(self.bytes_a) - 1).bit_length()) + self.bits + DOC_BITS > 63:
            raise ValueError("the vocabularies are too large for 64-bit keys of pairs and documents")
        self.restart()

    def restart(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.bad = array("q"), array("q"), array("q"), array("b")
        self.codes, self.starts = array("q"), array("q", [0])

    def full(self) -> bool:
        return len(self.groups) >= KEPT_PARTS or len(self.codes) >= KEPT_PAIRS

    def _enter(self, part: str, a: list[int], b: list[int]) -> int:
        whole = (" " + part).encode()
        if b"".join([self.bytes_a[x] for x in a]) == whole and b"".join([self.bytes_b[x] for x in b]) == whole:
            links, groups = align(a, b, self.size_a, self.size_b, self.bits)
            self.bad.append(0)
        else:
            links, groups = [], []
            self.bad.append(1)
        self.groups.append(";".join(groups))
        self.n_a.append(len(a))
        self.n_b.append(len(b))
        self.n_groups.append(len(groups))
        self.codes.extend(links)
        self.starts.append(len(self.codes))
        return len(self.groups) - 1

    def numbers(self, parts: list[str]) -> list[int]:
        """The numbers of ``parts``; new ones are encoded together.  Long parts are not remembered."""
        known = self.number
        found = list(map(known.get, parts))
        missing = [at for at, k in enumerate(found) if k is None]
        if missing:
            new = list(dict.fromkeys([parts[at] for at in missing]))
            ids_a = self.lib_a.encode_batch_fast([" " + p for p in new], add_special_tokens=False)
            entered = {}
            for part, a, b in zip(new, ids_a, self.lib_b.encode(new, num_threads=1), strict=True):
                entered[part] = self._enter(part, a.ids, b if part else [self.mark])
            for at in missing:
                found[at] = entered[parts[at]]
            known.update((p, k) for p, k in entered.items() if len(p) <= MEMO_PART)
        return found


class _Doc:
    __slots__ = ("row", "id", "n_a", "n_b", "n_groups", "sha", "bad")

    def __init__(self, row, doc_id):
        self.row, self.id, self.n_a, self.n_b, self.n_groups, self.sha, self.bad = row, doc_id, 0, 0, 0, None, False

    def groups(self, more: str) -> None:
        if self.sha is None:
            self.sha = hashlib.sha256(more.encode())
        else:
            self.sha.update(b";" + more.encode())

    def close(self) -> None:
        if self.bad:
            self.n_a, self.n_b, self.n_groups, self.sha = 0, 0, 0, None


class _Block:
    """Documents and the pairs that they hold, until :meth:`batches` gives both out."""

    def __init__(self, aligner: PartAligner):
        self.aligner, self.docs, self.pending, self.n_parts = aligner, [], [], 0
        self.keys: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.held = 0

    def add(self, row, doc_id, text: str | None) -> None:
        doc = _Doc(row, doc_id)
        self.docs.append(doc)
        if not text:
            return
        if SPACE in text:  # side B would read it as a space
            doc.bad = True
            return
        for parts in portions(text):
            self.pending.append((len(self.docs) - 1, parts))
            self.n_parts += len(parts)
            if self.n_parts >= PORTION_PARTS:
                self.reduce()

    def reduce(self) -> None:
        """Align what is pending."""
        if not self.pending:
            return
        own = self.aligner
        flat = own.numbers([p for _, parts in self.pending for p in parts])
        at = 0
        for k, parts in self.pending:
            self.docs[k].groups(";".join([own.groups[i] for i in flat[at : at + len(parts)]]))
            at += len(parts)
        numbers = np.array(flat, np.int64)
        ends = np.cumsum([len(parts) for _, parts in self.pending])
        starts = ends - [len(parts) for _, parts in self.pending]
        sums = []
        for column in (own.n_a, own.n_b, own.n_groups, own.bad):
            total = np.concatenate(([0], np.cumsum(np.array(column, np.int64)[numbers])))
            sums.append(total[ends] - total[starts])
        for (k, _), n_a, n_b, n_groups, bad in zip(self.pending, *sums, strict=True):
            doc = self.docs[k]
            doc.n_a, doc.n_b, doc.n_groups, doc.bad = doc.n_a + int(n_a), doc.n_b + int(n_b), doc.n_groups + int(n_groups), doc.bad or bool(bad)
        first = np.array(own.starts, np.int64)
        begin, count = first[numbers], first[numbers + 1] - first[numbers]
        place = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        doc_of = np.repeat(np.repeat([k for k, _ in self.pending], ends - starts), count)
        keys, links = np.unique(np.array(own.codes, np.int64)[place] << DOC_BITS | doc_of, return_counts=True)
        self.keys.append(keys)
        self.links.append(links)
        self.held += len(keys)
        self.pending, self.n_parts = [], 0

    def full(self) -> bool:
        return len(self.docs) >= BLOCK_DOCS or self.held >= BLOCK_PAIRS or self.aligner.full()

    def batches(self, id_type: pa.DataType, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        self.reduce()
        for doc in self.docs:
            doc.close()
        n = len(self.docs)
        rows = np.array([d.row for d in self.docs], np.int64)
        columns = {
            "row": pa.array(rows, pa.int64()),
            "id": pa.array([d.id for d in self.docs], id_type),
            "n_a": pa.array([d.n_a for d in self.docs], pa.int64()),
            "n_b": pa.array([d.n_b for d in self.docs], pa.int64()),
            "n_groups": pa.array([d.n_groups for d in self.docs], pa.int64()),
            "groups_sha256": pa.array([d.sha.hexdigest() if d.sha and d.n_a else "" for d in self.docs], pa.string()),
        }
        yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)
        if self.held:
            keys, links = np.concatenate(self.keys), np.concatenate(self.links)
            self.keys, self.links = [], []
            good = ~np.array([d.bad for d in self.docs])[keys & ((1 << DOC_BITS) - 1)]
            keys, links = keys[good], links[good]
            order = np.argsort(keys, kind="stable")
            keys, links = keys[order], links[order]
            new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.array([], np.int64)
            links = np.add.reduceat(links, new) if len(new) else links
            keys = keys[new]
            codes = keys >> DOC_BITS
            at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.array([], np.int64)
            docs = rows[keys & ((1 << DOC_BITS) - 1)]
            ends = np.append(at[1:], len(codes)) if len(at) else at
            for lo in range(0, len(at), 50_000):
                some, until = at[lo : lo + 50_000], ends[lo : lo + 50_000]
                offsets = pa.array(np.append(some, until[-1]) - some[0], pa.int32())
                inside = slice(some[0], until[-1])
                columns = {
                    "a": pa.array((codes[some] >> self.aligner.bits).astype(np.int32)),
                    "b": pa.array((codes[some] & ((1 << self.aligner.bits) - 1)).astype(np.int32)),
                    "docs": pa.ListArray.from_arrays(offsets, pa.array(docs[inside], pa.int64())),
                    "links": pa.ListArray.from_arrays(offsets, pa.array(links[inside].astype(np.int64), pa.int64())),
                }
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(len(some), f.type) for f in schema], schema=schema)


def _schema(id_type: pa.DataType) -> pa.Schema:
    long, numbers = pa.int64(), pa.list_(pa.int64())
    kinds = {"row": long, "id": id_type, "n_a": long, "n_b": long, "n_groups": long, "groups_sha256": pa.string(), "a": pa.int32(), "b": pa.int32(), "docs": numbers, "links": numbers}
    return pa.schema(list(kinds.items()))


def align_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (row, id, n_a, n_b, n_groups, groups_sha256) and postings (a, b, docs, links), both stored.

    ``row`` numbers the rows of ``docs``; ``docs`` of a posting are such rows
    and ``links`` how often each holds the pair linked.  A pair has a posting
    for each block of documents that holds it.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(("alignment", path_a, path_b), lambda: PartAligner(path_a, path_b))
        block, schema = _Block(aligner), None
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            id_type = batch.column(1).type
            schema = schema or _schema(id_type)
            for row, doc_id, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                block.add(row.as_py(), doc_id.as_py(), text.as_py())
                if block.full():
                    yield from block.batches(id_type, schema)
                    if aligner.full():
                        aligner.restart()
                    block = _Block(aligner)
        if block.docs:
            yield from block.batches(id_type, schema)

    kind = source.schema["id"].dataType.simpleString()
    made = source.mapInArrow(run, f"row long, id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, a int, b int, docs array<long>, links array<long>")
    both = stored(made, "alignment")
    return (
        both.where(F.col("a").isNull()).select("row", "id", "n_a", "n_b", "n_groups", "groups_sha256"),
        both.where(F.col("a").isNotNull()).select("a", "b", "docs", "links"),
    )


def pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair) and best (the highest count of ``a``, ties included).

    A side's partners are at most the other vocabulary, so that the window is
    bounded whatever the corpus.
    """
    counted = postings.groupBy("a", "b").agg(F.sum(F.size("docs")).alias("count"))
    return counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that one of the tokenizers does not give
    back byte for byte, have no tokens: zeros and an empty digest.  Rows count
    as documents each, whatever their ids, null and repeated ones included;
    other columns are ignored, whatever their names.  An empty table gives no
    rows.
    """
    of_docs, postings = align_texts(docs, path_a, path_b, id_col, text_col)
    counts = pair_counts(postings).withColumnsRenamed({"a": "of_a", "b": "of_b"})
    met = postings.join(counts, (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b")))
    each = met.select("count", "best", F.explode(F.arrays_zip("docs", "links")).alias("in")).select("count", "best", F.col("in.docs").alias("of_row"), F.col("in.links").alias("n"))
    sums = each.groupBy("of_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    found = of_docs.join(sums, F.col("row") == F.col("of_row"), "left")
    none = F.lit(0).cast("long")
    return found.select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"),
        F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"),
        "groups_sha256",
    )
