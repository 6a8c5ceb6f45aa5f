"""Alignment against a plain count over the libraries' own ids."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from rowforge.llm import alignment
from rowforge.llm.alignment import align_tokens, parts_of, portions
from tests.llm.test_tokens import ODD, texts

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """By definition: every overlapping pair of token occurrences."""
    lib_a, lib_b = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    lib_a.encode_special_tokens = True
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    byte_of = {chr(b if b in printed else next(others)): b for b in range(256)}
    found = []
    for _, text in rows:
        text = text or ""
        a, b = lib_a.encode(" " + text, add_special_tokens=False), lib_b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in t) for t in a.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if lib_b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, lib_b.id_to_piece(k)) for k in b)]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            found.append(None)
            continue
        spans = []
        for ids, pieces in ((a.ids, bytes_a), (b, bytes_b)):
            at, own = 0, []
            for k, piece in zip(ids, pieces, strict=True):
                own.append((k, at, at + len(piece)))
                at += len(piece)
            spans.append(own)
        links, j = [], 0
        for k, lo, hi in spans[0]:
            while spans[1][j][2] <= lo:
                j += 1
            i = j
            while i < len(spans[1]) and spans[1][i][1] < hi:
                links.append((k, spans[1][i][0]))
                i += 1
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, begin = [], 0
        sides = [list(s) for s in spans]
        for e in ends:
            taken = []
            for side in sides:
                n = 0
                while n < len(side) and side[n][2] <= e:
                    n += 1
                taken.append(",".join(str(k) for k, *_ in side[:n]))
                del side[:n]
            groups.append("|".join(taken))
            begin = e
        assert begin == len((" " + text).encode())
        found.append((len(a.ids), len(b), groups, Counter(links)))
    count = Counter(p for x in found if x for p in x[3])
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (doc_id, _), x in zip(rows, found, strict=True):
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = x
            best = sum(m for (a, b), m in links.items() if count[a, b] == top[a])
            out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), best, sum(m * count[p] for p, m in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


def test_alignment_against_all_overlapping_pairs(spark):
    own = texts(40) + ODD + ["a\n \nb", "x \n y", "a　 b  c", " \t x", "foo \nbar\n baz \n", "a   b", "▁ x", "end ", " ", "<|endoftext|> y</s>"]
    rows = [(k, t) for k, t in enumerate(own)] + [(None, "the tion"), (3, None), (3, ""), (7, "the tion")] + [(100 + k, "copied words, all of them") for k in range(50)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_a int, count string").repartition(6)
    assert ordered(align_tokens(docs, PATH_A, PATH_B).collect()) == ordered(plain(rows))
    assert align_tokens(docs.limit(0), PATH_A, PATH_B).count() == 0


def test_random_white_space_is_cut_where_both_cut():
    own, rng = alignment.PartAligner(PATH_A, PATH_B), random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(" \n\t　 \x1c\x85'ab.,0é日 ") for _ in range(rng.randrange(1, 14)))
        ids_a, ids_b = [], []
        for part in parts_of(text):
            ids_a += own.lib_a.encode(" " + part, add_special_tokens=False).ids
            ids_b += own.lib_b.encode(part) if part else [own.mark]
        assert ids_a == own.lib_a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert ids_b == own.lib_b.encode(text), repr(text)
        assert [p for x in portions(text, 3) for p in x] == parts_of(text), repr(text)


def test_small_blocks_and_portions_change_nothing(spark, monkeypatch):
    """Very long texts are aligned in portions, blocks end early and the memo starts again."""
    rng = random.Random(1)
    words = ["the", "tion", "Anhaer,", "straße", "over\nthe", "日本", "  ", "x" * 80]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 400)))) for k in range(30)] + [(99, " ".join(rng.choice(words) for _ in range(5000)) + " ▁")]
    want = ordered(plain(rows))
    with monkeypatch.context() as m:
        m.setattr(alignment, "PORTION_PARTS", 50)
        m.setattr(alignment, "BLOCK_DOCS", 7)
        m.setattr(alignment, "KEPT_PARTS", 12)
        import pyarrow as pa

        own = alignment.PartAligner(PATH_A, PATH_B)
        schema, block, batches = alignment._schema(pa.int64()), alignment._Block(own), []
        for k, (doc_id, text) in enumerate(rows):
            block.add(k, doc_id, text)
            if block.full():
                batches += block.batches(pa.int64(), schema)
                own.restart()
                block = alignment._Block(own)
        batches += block.batches(pa.int64(), schema)
        out = pa.Table.from_batches(batches).to_pylist()
    stats = {r["row"]: r for r in out if r["a"] is None}
    assert len([r for r in out if r["a"] is not None]) > len({(r["a"], r["b"]) for r in out if r["a"] is not None})
    by_doc = Counter()
    for r in out:
        for doc, n in zip(r["docs"] or [], r["links"] or [], strict=True):
            by_doc[doc] += n
    got = [(rows[k][0], r["n_a"], r["n_b"], r["n_groups"], by_doc[k], r["groups_sha256"]) for k, r in stats.items()]
    assert sorted(got) == sorted((i, a, b, g, n, s) for i, a, b, g, n, _, _, s in want)
