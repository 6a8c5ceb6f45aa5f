"""Phrases against a plain count."""

import random
import re
from collections import Counter

import pytest

from rowforge.llm import collocations
from rowforge.llm.collocations import mine_phrases


def plain(rows, least, first):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        found = []
        for p, a in frequent.items():
            if any(100 * n >= 80 * a for q, n in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "of", "new", "york", "city", "É", "é", "日本", "x y", "it's", "\x1c", "a", "A"]
    fixed = ["new york city", "United States of America", "Of The", "carte blanche"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed if rng.random() < 0.3 else words) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", "\v", "?!"]) for _ in range(rng.randrange(0, 60))]
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), "".join(parts)))
    return rows + [("en", None), (None, ""), ("fr", "only once here"), ("en", " \t\n")] + [("en", "copied text of several words here")] * 40 + [("ja", "一 二 三 " * 300)]


@pytest.mark.parametrize("bound", [10**6, 60, 5])
def test_phrases_against_plain_counts(spark, bound):
    """With few grams to broadcast the later levels, or all, are counted by shuffles."""
    rows = rows_of(1)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string").repartition(5)
    for least, first in ((5, 25), (30, 2000)):
        got = mine_phrases(docs, least, first, broadcast_grams=bound).collect()
        assert sorted(map(tuple, got)) == plain(rows, least, first)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert mine_phrases(empty).count() == 0
    assert mine_phrases(spark.createDataFrame([("en", None), ("en", "a b")], "lang string, text string")).count() == 0


def test_small_portions_and_held_counts(spark, monkeypatch):
    """Very long texts are split in portions; tasks hand counts on early."""
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "c", "New", "york", "é"]) + rng.choice([" ", " ", ", ", "\t"]) for _ in range(4000))
    whole = [w for words in collocations.words_of(text.encode()) for w in words]
    with monkeypatch.context() as m:
        m.setattr(collocations, "PORTION_BYTES", 7)
        assert [w for words in collocations.words_of(text.encode()) for w in words] == whole


def test_scores_are_exact_past_64_bits(spark):
    value = 9_000_000_000_000_000_000
    score = spark.range(1).selectExpr(f"(CAST({value}L AS DECIMAL(19,0)) * CAST(2000000 AS DECIMAL(7,0))) div (CAST({value}L AS DECIMAL(19,0)) + CAST({value - 7}L AS DECIMAL(19,0))) AS s").first().s
    assert score == 2_000_000 * value // (2 * value - 7)


def test_levels_past_their_bits_stay_exact_and_leave_the_texts_alone(spark, monkeypatch):
    """A filter of far fewer bits than a level has grams lets rare ones pass only; no level goes back to shuffles of phrases."""
    rows = rows_of(2)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = plain(rows, 5, 50)
    words = sum(1 for r in collocations.frequent_grams(docs, 5)[0].where("k = 1").collect())
    grams = collocations.frequent_grams(docs, 5)[0].where("k = 2").count()
    assert grams > words

    def refuse(*_):
        raise AssertionError("all levels counted again")

    monkeypatch.setattr(collocations, "_levels_by_shuffle", refuse)
    for bits in (6, 12):
        monkeypatch.setattr(collocations, "LEAST_BITS", bits)
        monkeypatch.setattr(collocations, "MOST_BITS", bits)
        assert sorted(map(tuple, mine_phrases(docs, 5, 50, broadcast_grams=words).collect())) == want


def test_codes_of_grams(spark):
    """Four words of many ids don't fit a number; what a filter lets pass holds all that it was made of."""
    rng = random.Random(4)
    size = collocations.BROADCAST_GRAMS
    assert size**3 < 2**63
    ids = collocations.np.array([rng.choice([-1, size - 1, size - 2, 0, 1]) for _ in range(3000)])
    grams = {k: Counter(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if min(ids[i : i + k]) >= 0) for k in (2, 3, 4)}
    everything = collocations.Passing(6, collocations.np.array([-1]))
    for k in (2, 3, 4):
        *codes, n = collocations._counted(collocations.gram_codes(ids, k, size, everything))
        found = {}
        for *code, times in zip(*(c.tolist() for c in codes), n.tolist()):
            parts, head = code[1:], code[0]
            while len(parts) < k - 1:
                head, part = divmod(head, size)
                parts.insert(0, part)
            found[(head, *parts)] = times
        assert found == dict(grams[k])


def test_rows_of_a_pass_follow_the_texts_not_the_tasks(spark):
    """Each run of ids gives its counts, whatever else the task holds; Spark adds them up."""
    np, pa = collocations.np, collocations.pa

    class Encoded:
        def mapInArrow(self, run, _):
            self.run = run
            return self

        def groupBy(self, *_):
            return self

        def agg(self, _):
            return self

    for k, shared in ((2, None), (4, type("Shared", (), {"value": collocations.Passing(6, np.array([-1]))}))):
        encoded = collocations._code_counts(Encoded(), k, 10, shared)
        portions = [np.array(ids, np.int32).tobytes() for ids in ([0, 1, 2, 3, 4, 0, 1, 2, 3, -1], [1, 2, 3, 4, -1, 0, 1], [0, -1])]
        rows = lambda own: sum(b.num_rows for b in encoded.run(iter([pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], ["ids"])])))  # noqa: B023, E731
        assert rows(portions * 5) == 5 * sum(rows([p]) for p in portions) > 0
