"""Token operators against the libraries themselves."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from rowforge.llm.piece_codec import PieceCodec, PieceTable, ViterbiStream, encode_decode
from rowforge.llm.token_counts import count_long, count_tokens
from rowforge.llm.tokenizers import PieceLibrary, WordEncoder

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "   lead", "trail   ", "tab\tand\nline", "▁mark ▁ x▁ y", "<s> </s> <unk> <0x0A>",
    "日本語のテキスト", "naïve café Éa ẞ Σίσυφος ΟΔΟΣ İx", "é combining ́", "👩‍👩‍👧 zwj", "\x00\x01\x1c\x1d", "don't DON'T we'll",
    "<|startoftext|> <|ENDOFTEXT|> x<|endoftext|>y <|End", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1234567890 12,5", "   wide　space", "x" * 300,
]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    letters = "aeinrst hlodé,.\n ▁0#ß日👍 "
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(n)]
    return ODD + made + [" ".join(rng.choice(["the", "tion", "Anhaer,", "Église.", "straße!?", "œuvre", "ªº:", "ẞ.", "über", "12", "x.\ny"]) for _ in range(300))]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_word_encoder_equals_library():
    encoder = WordEncoder(WORDS)
    for text in texts():
        want = encoder.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, text


def test_word_encoder_with_capitals_and_marks():
    """Marks that compose with a small letter only: the library composes first and lowers then."""
    encoder, rng = WordEncoder(WORDS), random.Random(11)
    marks, letters = [chr(c) for c in range(0x300, 0x370)], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefgjhtwyzÄÖéßİıK"

    def word():
        out = []
        for _ in range(rng.randrange(1, 6)):
            out.append(rng.choice(letters) + rng.choice([rng.choice(marks), "", "", "", rng.choice(".,;:!?'-019 \x85日글ﬁ")]))
        return "".join(out)

    made = ["J\u030c", "T\u0308", "H\u0331 x", "W\u030a", "Y\u030a"] + [" ".join(word() for _ in range(rng.randrange(1, 5))) for _ in range(20_000)]
    for text, want in zip(made, encoder.library.encode_batch(made, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want.ids, text


def test_piece_counts_equal_library(library):
    counter = PieceLibrary(MODEL)
    counter.learn(texts()[::2])
    for text in texts():
        assert counter.count(text) == len(library.encode(text)), text


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 4), (64, 16), (200, 1)])
def test_resynchronised_counts_equal_library(library, chunk, overlap):
    counter = PieceLibrary(MODEL)
    for text in texts(40, 5):
        if len(text) > chunk:
            assert count_long(counter, text, chunk, overlap) == len(library.encode(text)), text


def test_streamed_pieces_equal_library(library):
    codec = PieceCodec(MODEL)
    for text in texts():
        ids = np.frombuffer(codec.encode(text), "<u4")
        assert ids.tolist() == library.encode(text), text
        assert codec.decode(ids) == text.replace("▁", " "), text


@pytest.mark.parametrize("portion", [1, 2, 7, 16, 777, 20_000])
def test_stream_keeps_a_short_window(library, portion):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    table = PieceTable(MODEL)
    stream, out, first = ViterbiStream(table), [], None
    for at in range(0, len(text), portion):
        out += stream.feed(text[at : at + portion])
        first = at if out and first is None else first
        assert len(stream.text) <= table.longest and len(stream.pieces) <= table.longest + 1
    assert out + stream.finish() == library.encode(text)
    assert stream.peak < 6 * table.longest and first < 6 * table.longest + portion


def test_stream_of_texts_whose_ways_meet_late(library):
    for text in ("a" * 5_000, "ab" * 3_000, " " * 4_000, "=" * 3_000 + "-" * 3_000):
        stream, out = ViterbiStream(PieceTable(MODEL)), []
        for c in text:
            out += stream.feed(c)
        assert out + stream.finish() == library.encode(text)


def test_unigram_stream_equals_library(library):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        if piece.type == 1:  # scores that favour long pieces, exact in single precision
            piece.score = -8.0 - (piece.score % 64) / 64
    unigram = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    table = PieceTable(MODEL, "unigram")
    table.score = {p.piece: p.score for p in model.pieces if p.type == 1}
    table.unknown_score = min(table.score.values()) - 10.0
    table.ends = PieceTable(MODEL, "unigram").ends
    for text in [t for t in texts(20, 9) if t and "▁" not in t]:
        stream = ViterbiStream(table)
        got = stream.feed(text) + stream.finish()
        length = lambda ids: sum(unigram.get_score(i) for i in ids if not unigram.is_byte(i))
        assert length(got) == pytest.approx(length(unigram.encode(text))), text


def test_queries_on_odd_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(5))] + [(None, "a b"), (3, None), (3, "a b")]
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t in rows], "doc_id long, text string, n_tokens string, id int")
    counted = count_tokens(docs, MODEL, 50, chunk_chars=64, overlap_chars=4).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 50) for i, t in rows]
    assert sorted(map(tuple, counted), key=key) == sorted(want, key=key)
    coded = encode_decode(docs, MODEL)
    assert coded.columns == ["doc_id", "n_tokens", "ids", "decoded", "round_trip"]
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in coded.collect()), key=key)
    assert got == sorted(((i, len(x := library.encode(t or "")), x, (t or "").replace("▁", " ")) for i, t in rows), key=key)
    for f in (lambda d: count_tokens(d, MODEL, 50), lambda d: encode_decode(d, MODEL)):
        assert f(docs.limit(0)).count() == 0
