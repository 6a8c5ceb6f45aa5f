"""Phrases whose words stand together, mined by Apriori level-wise passes.

The first pass counts words and leaves texts as runs of ids of frequent words.
Each further pass broadcasts a filter of bounded size that lets all frequent
(k-1)-grams pass, emits a k-gram only where both of the (k-1)-grams that it
overlaps pass, and adds up by code in Spark.  What else passes is rare and
falls out when it is counted.  Cuts are scored from the level tables by joins.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm.storage import stored
from rowforge.llm.tokenizers import held as kept_in_worker

LEAST = 30
LONGEST = 4
FIRST = 2000
#: fixed values: what ends a piece, besides U+000A to U+000D
STOPS = ".,;:!?"
NO_LANG = "und"
#: frequent words that are broadcast at most (the codes of three words stay under 2**63); with more, grams are counted by shuffles of phrases instead
BROADCAST_GRAMS = 2_000_000
#: a filter has so many bits a gram, within bounds (as powers of two); more grams than that only let more rare ones pass
FILTER_BITS, LEAST_BITS, MOST_BITS = 32, 10, 28
#: words that a task holds before it hands them on, bytes of text split together, ids in a row
HELD_WORDS = 1 << 18
PORTION_BYTES = 1 << 22
ROW_IDS = 1 << 18
#: buckets of a language in the first of the two rankings
BUCKETS = 64
_END = 0xFF
_ENDS = [*STOPS.encode(), *range(0x0A, 0x0E)]
_FOLD = bytes(_END if b in _ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text in UTF-8 and, as a byte that no text has, the ends of pieces; long texts in portions."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PORTION_BYTES)
        end = len(raw) if end < 0 else end
        # all white space that split() knows is a space, a tab or an end
        yield raw[at:end].translate(_FOLD).replace(b"\xff", b" \xff ").split()
        at = end


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("binary").alias("text")).where(F.length("text") > 0)


def count_words(source: DataFrame) -> DataFrame:
    """lang, word, f: all words, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, counts in held.items() for word, n in counts.items() if word != b"\xff"]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()).cast(pa.string()), pa.array(columns[2], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = held.setdefault(lang, Counter())
                for words in words_of(text.as_py()):
                    counts.update(words)
                if sum(map(len, held.values())) >= HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return source.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _counted(codes: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Codes of one or two numbers, each once, and how often they occur."""
    if len(codes) == 1:
        return np.unique(codes[0], return_counts=True)
    order = np.lexsort(codes[::-1])
    codes = tuple(c[order] for c in codes)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), np.any([c[1:] != c[:-1] for c in codes], axis=0))))
    return *(c[first] for c in codes), np.diff(first, append=len(order))


def _code_counts(encoded: DataFrame, k: int, size: int, shared) -> DataFrame:
    """code (and last), f of the k-grams in the runs of ids whose two overlapping grams pass the filter."""
    names = ["code", "last"] if k == LONGEST else ["code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each run of ids by itself, so that the rows follow the texts; Spark adds up what a task has before it shuffles
        for batch in batches:
            for ids in batch.column(0):
                counted = _counted(gram_codes(np.frombuffer(ids.as_py(), np.int32).astype(np.int64), k, size, shared and shared.value))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in counted], [*names, "n"])

    return encoded.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"])).groupBy(*names).agg(F.sum("n").alias("f"))


class Passing:
    """Bits of the grams of a level by their codes: all of them pass, and a few of the others."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def slots(codes: np.ndarray, bits: int) -> np.ndarray:
        mixed = codes.astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def has(self, codes: np.ndarray) -> np.ndarray:
        at = self.slots(codes, self.bits)
        return (self.words[at >> 6] >> (at & 63)) & 1 != 0


def _passing(level: DataFrame) -> Passing:
    """The filter of a level, put together by Spark: at most 2 ** MOST_BITS bits come to the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, (FILTER_BITS * level.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(Passing.slots(batch.column(0).to_numpy(), bits))
            word, start = np.unique(at >> 6, return_index=True)
            if len(word):
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(np.int64(1) << (at & 63), start))], ["word", "bits"])

    found = level.select("code").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return Passing(bits, words)


def gram_codes(ids: np.ndarray, k: int, size: int, passing: Passing | None) -> tuple[np.ndarray, ...]:
    """Codes of the k-grams in a run of ids whose two overlapping grams are of frequent words or pass ``passing``.

    A code is the number that the ids are as digits to the base ``size``; the
    last of LONGEST words stands apart.
    """
    if len(ids) < k:
        return (np.empty(0, np.int64),) * (2 if k == LONGEST else 1)
    # the grams before: their codes, and whether all of their words are frequent
    codes, open_ = ids, ids >= 0
    for j in range(1, k - 1):
        open_ = open_[:-1] & (ids[j:] >= 0)
        codes = codes[:-1] * size + ids[j:]
    if k > 2:
        at = np.flatnonzero(open_)
        open_ = np.zeros(len(codes), bool)
        open_[at] = passing.has(codes[at])
    both = np.flatnonzero(open_[:-1] & open_[1:])
    head, last = codes[both], ids[both + k - 1]
    return (head, last) if k == LONGEST else (head * size + last,)


class Words:
    """The frequent words by their ids."""

    def __init__(self, lang: pa.Array, word: pa.Array):
        self.lang, self.word = lang, word

    def by_lang(self) -> dict[str, dict[bytes, int]]:
        found: dict[str, dict[bytes, int]] = {}
        for k, (lang, word) in enumerate(zip(self.lang.to_pylist(), self.word, strict=True)):
            found.setdefault(lang, {})[word.as_py()] = k
        return found

    def phrases(self, codes: list[np.ndarray], k: int) -> tuple[pa.Array, pa.Array]:
        """Languages and phrases of codes of k-grams."""
        size, code, parts = len(self.word), codes[0], codes[1:]
        while len(parts) < k - 1:
            parts.append(code % size)
            code = code // size
        parts.append(code)
        words = [self.word.take(pa.array(p)) for p in reversed(parts)]
        return self.lang.take(pa.array(code)), pc.binary_join_element_wise(*words, b" ")


def _encode(source: DataFrame, shared) -> DataFrame:
    """ids: the texts as runs of little-endian 32-bit ids of frequent words, -1 where a run ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, row = kept_in_worker(("words", key), lambda: shared.value.by_lang()), array("i")
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                known = of.get(lang)
                if known is None:
                    continue
                for words in words_of(text.as_py()):
                    row.extend([known.get(w, -1) for w in words])
                row.append(-1)
                if len(row) >= ROW_IDS:
                    yield _row(row)
                    row = array("i")
        if row:
            yield _row(row)

    def _row(row: array) -> pa.RecordBatch:
        ids = np.frombuffer(row, np.int32)
        end = ids < 0
        # an end after an end, and a word between ends, hold no gram
        alone = ~end & np.concatenate(([True], end[:-1])) & np.concatenate((end[1:], [True]))
        ids = np.where(alone, -1, ids).astype(np.int32)
        kept = ids[~((ids < 0) & np.concatenate(([True], ids[:-1] < 0)))]
        return pa.RecordBatch.from_arrays([pa.array([kept.tobytes()], pa.binary())], ["ids"])

    key = uuid.uuid4().hex
    return source.mapInArrow(run, "ids binary")


def _named(counted: DataFrame, shared, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *codes, f = batch.columns
            langs, phrases = shared.value.phrases([c.to_numpy() for c in codes], k)
            columns = [langs, phrases.cast(pa.string()), pa.array([k] * len(langs), pa.int32()), f, codes[0]]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "k", "f", "code"])

    return counted.mapInArrow(run, "lang string, phrase string, k int, f long, code long")


def _levels_by_shuffle(source: DataFrame, least: int) -> DataFrame:
    """The level tables without broadcasts: every gram of a task is added up and shuffled as its phrase."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = source.select("lang", F.explode(F.split(lower, f"[{STOPS}\\x0A-\\x0D]")).alias("piece"))
    words = pieces.select("lang", F.filter(F.split("piece", "[\\x20\\x09]+"), lambda w: w != "").alias("words"))
    levels = None
    for k in range(1, LONGEST + 1):
        starts = F.sequence(F.lit(1), F.size("words") - F.lit(k - 1))
        own = words.where(F.size("words") >= k).select("lang", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, k), " "))).alias("phrase"))  # noqa: B023
        level = own.groupBy("lang", "phrase").agg(F.count("*").alias("f")).where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("k"), "f")
        levels = level if levels is None else levels.unionByName(level)
    return levels


def frequent_grams(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", broadcast_grams: int = BROADCAST_GRAMS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all grams of 1 to LONGEST words with f >= least, and (lang, n) of all words; both read stored tables."""
    spark, source = docs.sparkSession, _source(docs, text_col, lang_col)
    words = stored(count_words(source), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    table = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "f")
    if (size := frequent.count()) > min(broadcast_grams, BROADCAST_GRAMS):
        return stored(_levels_by_shuffle(source, least), "grams"), totals
    known = frequent.select("lang", F.col("word").cast("binary").alias("word")).toArrow().combine_chunks()
    column = lambda k, kind: pa.concat_arrays([pa.array([], kind), *(c.cast(kind) for c in known.column(k).chunks)])
    words_shared = spark.sparkContext.broadcast(Words(column(0, pa.string()), column(1, pa.binary())))
    encoded, shared = stored(_encode(source, words_shared), "encoded"), None
    for k in range(2, LONGEST + 1):
        counted = _code_counts(encoded, k, size, shared).where(F.col("f") >= least)
        level = stored(_named(counted, words_shared, k), f"grams-{k}")
        table = table.unionByName(level.select("lang", "phrase", "k", "f"))
        if k < LONGEST:
            shared = spark.sparkContext.broadcast(_passing(level))
    return table, totals


def _sub(words: Column, start: int, size: int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def mine_phrases(docs: DataFrame, least: int = LEAST, first: int = FIRST, text_col: str = "text", lang_col: str = "lang", broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """The ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to 4 words that stand ``least`` times or more, scored by
    their worst cut, without those that a longer one holds in four of five
    places.  Null and empty texts have no words; a null language is ``und``;
    repeated rows count each; other columns are ignored, whatever their names.
    An empty table gives no rows.
    """
    grams, totals = frequent_grams(docs, least, text_col, lang_col, broadcast_grams)
    phrases = grams.where("k > 1")
    words = F.split("phrase", " ", -1)
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = phrases.select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("words"), cut)
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    # repeated parts are joined as they are: Spark splits a hot one, and no language is one key
    part = lambda side, f: grams.select(F.col("lang").alias(f"lang_{f}"), F.col("phrase").alias(f"part_{f}"), F.col("f").alias(f))
    for side, f in (("left", "l"), ("right", "r")):
        table = part(side, f)
        cuts = cuts.join(table, (F.col("lang") == F.col(f"lang_{f}")) & (F.col(side) == F.col(f"part_{f}"))).drop(f"lang_{f}", f"part_{f}")
    score = F.expr("(CAST(a AS DECIMAL(19, 0)) * CAST(2000000 AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    longer = phrases.where("k > 2").select("lang", words.alias("words"), "k", "f")
    inside = None
    for k in range(3, LONGEST + 1):
        subs = F.array(*[_sub(F.col("words"), start, size) for size in range(2, k) for start in range(1, k - size + 2)])
        own = longer.where(F.col("k") == k).select("lang", F.explode(subs).alias("part"), "f")
        inside = own if inside is None else inside.unionByName(own)
    most = inside.groupBy("lang", "part").agg(F.max("f").alias("most")).withColumnRenamed("lang", "lang_most")
    met = worst.join(most, (F.col("lang") == F.col("lang_most")) & (F.col("phrase") == F.col("part")), "left")
    times = lambda n, c: F.col(c).cast("decimal(19,0)") * F.lit(n).cast("decimal(3,0)")
    left = met.where(F.col("most").isNull() | (times(100, "most") < times(80, "a"))).select("lang", "phrase", "a", F.col("worst.l").alias("l"), F.col("worst.r").alias("r"), F.col("worst.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each bucket, so that the last ranking of a language meets a bounded number of rows
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    some = left.withColumn("bucket", bucket).withColumn("at", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("at") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    named = ranked.join(totals.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of"))
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text <> ''
), runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM runs GROUP BY lang),
places AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM runs, (VALUES (1), (2), (3), (4)) AS v(k)),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY 1, 2, 3 HAVING count(*) >= 30
), cuts AS (
  SELECT g.lang, g.phrase, g.f AS a, c.cut, array_to_string(string_split(g.phrase, ' ')[1:c.cut], ' ') AS p, array_to_string(string_split(g.phrase, ' ')[c.cut + 1:g.k], ' ') AS q
  FROM grams g, (VALUES (1), (2), (3)) AS c(cut) WHERE c.cut < g.k
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, CAST((CAST(c.a AS HUGEINT) * 2000000) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.p JOIN grams y ON y.lang = c.lang AND y.phrase = c.q
), worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS w FROM scored),
subs AS (
  SELECT g.lang, array_to_string(string_split(g.phrase, ' ')[s.i:s.i + m.size - 1], ' ') AS part, max(g.f) AS most
  FROM grams g, (VALUES (2), (3)) AS m(size), (VALUES (1), (2), (3)) AS s(i) WHERE m.size < g.k AND s.i + m.size - 1 <= g.k GROUP BY 1, 2
), left_over AS (
  SELECT w.* FROM worst w LEFT JOIN subs s ON s.lang = w.lang AND s.part = w.phrase
  WHERE w.w = 1 AND (s.most IS NULL OR CAST(s.most AS HUGEINT) * 100 < CAST(w.a AS HUGEINT) * 80)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
