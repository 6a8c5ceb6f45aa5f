import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from rowforge.llm.packing import pack_documents, plan_bins

WORDS = public_tokenizers.path("word_bpe_49k.json")


def bins_of(counts, capacity):
    placed = {}
    seen = {n: set() for n in counts}
    for length, lo, hi, first, per_bin, offset in plan_bins(counts, capacity):
        for rank in range(lo, hi):
            assert rank not in seen[length]
            seen[length].add(rank)
            k = rank - lo
            placed.setdefault(first + k // per_bin, []).append((offset + k % per_bin * length, length))
    assert all(seen[n] == set(range(counts[n])) for n in counts)
    return placed


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plan_fills_bins_without_gaps_or_overlaps(counts):
    for items in bins_of(counts, 30).values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 30 and sum(3 * n > 30 for _, n in items) <= 2


def test_plan_is_close_to_the_least_number_of_bins():
    rng = random.Random(2)
    counts = {}
    for _ in range(5000):
        n = min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1)
        counts[n] = counts.get(n, 0) + 1
    total = sum(n * k for n, k in counts.items())
    assert len(bins_of(counts, 2048)) <= 1.01 * total / 2048 + 1


def test_pack_against_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    words = ["the", "Anhaer", "tion", "über", "x,y", "12", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))) for i in range(80)]
    rows += [(None, "a"), (5, None), (5, None), (6, ""), (7, "same text")] + [(8, "same text")] * 40
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, part int").repartition(5)
    out = pack_documents(docs, WORDS, 64).collect()
    library = Tokenizer.from_file(WORDS)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            own = ids[at : at + 64]
            want.append((i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert pack_documents(docs.limit(0), WORDS, 64).count() == 0
