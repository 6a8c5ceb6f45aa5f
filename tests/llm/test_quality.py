import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rowforge.llm import compression_quality
from rowforge.llm.compression_quality import fit_model, score_quality
from rowforge.llm import quality_rules
from rowforge.llm.quality_rules import BITS, CLASS, CLASSES, ORDER, grams, kneser_ney, repeated_words, score_rules, text_statistics


def brute_repeats(words):
    at = {}
    for k in range(len(words) - 4):
        at.setdefault(tuple(words[k : k + 5]), []).append(k)
    return len({k + i for ks in at.values() if len(ks) > 1 for k in ks for i in range(5)})


def test_repeated_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"][: rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 40))]
        assert repeated_words(words) == brute_repeats(words)


def test_statistics():
    assert text_statistics("a b\x0b#c d\n\n a b\n a b\r\n a b") == (9, 12, 1, 1, 0)
    assert text_statistics("") == (0, 0, 0, 0, 0)
    assert text_statistics("é é\né é\n#|") == (5, 6, 2, 1, 0)


class BruteModel:
    """Modified Kneser-Ney from its definition, over tuples of byte classes."""

    def __init__(self, texts):
        self.counts = [Counter() for _ in range(ORDER + 1)]
        for text in texts:
            c = classes_of(text)
            self.counts[ORDER].update(tuple(c[k : k + ORDER]) for k in range(len(c) - ORDER + 1))
        for n in range(ORDER - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.discounts = [None]
        for n in range(1, ORDER + 1):
            n1, n2, n3, n4 = (max(1, sum(c == k for c in self.counts[n].values())) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            self.discounts.append([0.0] + [min(max(x, low), high) for x, low, high in zip(d, (0.1, 0.1, 0.1), (0.9, 1.8, 2.7), strict=True)])
        self.after = [defaultdict(dict) for _ in range(ORDER + 1)]
        for n in range(1, ORDER + 1):
            for g, c in self.counts[n].items():
                self.after[n][g[:-1]][g[-1]] = c

    def p(self, gram):
        if not gram:
            return 1 / CLASSES
        n, own = len(gram), self.after[len(gram)].get(gram[:-1], {})
        if not own:
            return self.p(gram[1:])
        d, total = self.discounts[n], sum(own.values())
        kept = max(own.get(gram[-1], 0) - d[min(own.get(gram[-1], 0), 3)], 0) / total
        return kept + sum(min(d[min(c, 3)], c) for c in own.values()) / total * self.p(gram[1:])

    def score(self, text):
        c = classes_of(text)
        return -sum(math.log(self.p(tuple(c[k : k + ORDER]))) for k in range(len(c) - ORDER + 1)) / (len(c) - ORDER + 1)


def classes_of(text):
    return CLASS[np.frombuffer(b"\n" * (ORDER - 1) + text.encode() + b"\n" * (ORDER - 1), np.uint8)].tolist()


def test_model_against_brute_force():
    texts = ["the cat sat on the mat. " * 20 + "A dog, 12 birds & more!\n" * 7, "où est né l'été ? Übergröße 日本", "the the a"]
    n = Counter(g for t in texts for g in grams(b"\n" * (ORDER - 1) + t.encode() + b"\n" * (ORDER - 1)).tolist())
    model, brute = kneser_ney(np.array(list(n)), np.array(list(n.values()))), BruteModel(texts)
    assert all((np.diff(h.astype(np.int64)) > 0).all() for h in (*model.hashes, *model.contexts))
    rng = random.Random(6)
    some = list(n) + [rng.randrange(CLASSES**ORDER) for _ in range(300)] + [rng.choice(list(n)) ^ rng.randrange(CLASSES) for _ in range(300)]
    want = [brute.p(tuple(g >> BITS * k & CLASSES - 1 for k in range(ORDER - 1, -1, -1))) for g in some]
    assert np.exp(model.log_probabilities(np.array(some, np.uint32))) == pytest.approx(want, rel=1e-9)
    for context in rng.sample(list(n), 20):
        every = np.array([context >> BITS << BITS | c for c in range(CLASSES)], np.uint32)
        assert np.exp(model.log_probabilities(every)).sum() == pytest.approx(1.0)


def median(values):
    values = sorted(values)
    return values[(len(values) + 1) // 2 - 1]


def test_kept_against_brute_force(spark):
    """Models, scores, bands and verdicts of every row, found again row by row."""
    rng = random.Random(8)
    english = "the of and thing was river stone over light when people went home".split()
    german = "zwischen wurde nicht schon jahr straße küchen groß zeit ganz".split()
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(say(english, rng.choice([20, 25, 150])), "en") for _ in range(120)] + [(say(german, rng.choice([20, 150])), "de") for _ in range(100)]
    rows += [(say(english, 30), rng.choice(["de", None, "xx"])) for _ in range(8)] + [rows[0]] * 20 + [("", "en"), (None, "de"), ("too short", "en")]
    rows += [(" ".join("".join(rng.choice("qxzjk#&") for _ in range(5)) for _ in range(n)), rng.choice(["en", "de", None])) for n in (12, 20, 60, 200) * 3]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    models = {lang: BruteModel({t for t, own in rows if own == lang and t is not None}) for lang in ("en", "de")}
    facts = []
    for text, lang in rows:
        text = text or ""
        words = text.encode().split()
        failed = len(words) < 10 or 100 * brute_repeats(words) > 20 * len(words)
        facts.append((text, lang, failed, len(classes_of(text)) - ORDER + 1, {k: m.score(text) for k, m in models.items()}))
    steps, bands = quality_rules.STEPS, {}
    for lang in models:
        own = defaultdict(set)
        for text, tag, failed, n, scores in facts:
            if tag == lang and not failed:
                own[n.bit_length()].add((text, math.floor(scores[lang] * steps)))
        enough = [size for size, some in own.items() if len(some) >= quality_rules.BAND_TEXTS]
        assert enough
        for size in range(1, 65):
            some = [step for _, step in own[min(enough, key=lambda s: (abs(s - size), s))]]
            middle = median(some)
            least = quality_rules.LEAST_SPREAD * (1 + quality_rules.SHORT_GRAMS / 2 ** (size - 1)) ** 0.5
            reach = quality_rules.BAND_WIDTH * max(1.4826 * median([abs(x - middle) for x in some]) / steps, least)
            bands[lang, size] = ((middle + 0.5) / steps - reach, (middle + 0.5) / steps + reach)
    out = {r.doc_id: r for r in score_rules(docs).collect()}
    for i, (_, tag, failed, n, scores) in enumerate(facts):
        judges = {min(scores, key=scores.get), tag} & set(scores)
        inside = any(bands[j, n.bit_length()][0] <= scores[j] <= bands[j, n.bit_length()][1] for j in judges)
        assert out[i].base_failed == failed and out[i].kept == (not failed and inside), (i, rows[i])
        assert out[i].log_perplexity == pytest.approx(scores.get(tag, min(scores.values())))
    assert {r.kept for r in out.values() if not r.base_failed} == {True, False}


def prose(rng, n, tail=""):
    return " ".join(rng.choice("the of and thing was river stone over light and when people went home".split()) + tail for _ in range(n)) + "."


def test_rules_on_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 150), "en", 1) for i in range(120)]
    rows += [(200, prose(rng, 150, "&&&###"), "en", 1), (201, None, "en", 1), (202, "", None, 1), (None, prose(rng, 150), "en", 2), (203, "x " * 100, "en", 1)]
    rows += [(204, prose(rng, 2000), "en", 1)] * 2 + [(205, prose(rng, 400_000), "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int").repartition(3)
    out = {r.doc_id: r for r in score_rules(docs, keep=("n_words",)).select("*").toDF(*["doc_id", "words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat", "base_failed", "ppl", "kept", "extra"]).collect()}
    assert all(out[i].kept for i in range(120)) and out[None].kept and out[204].kept and out[None].extra == 2
    assert not out[200].kept and not out[200].base_failed
    assert out[201].base_failed and out[202].base_failed and out[203].base_failed and out[203].n_repeat == 100
    assert out[201].words == 0
    assert score_rules(docs.limit(0)).count() == 0


def test_classifier_tells_labels_apart(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60) if i % 2 else prose(rng, 60, rng.choice(["$$$", "!!", "###"])).upper()) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "text"), (5, rows[5][1])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    out = score_quality(docs, labels).collect()
    assert len(out) == 304
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 300:
            assert r.predicted == r.doc_id % 2
    assert score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in score_quality(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_score_against_brute_force(spark):
    """Dictionaries, calibration and scores found again row by row, with zstandard itself."""
    import zstandard

    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([12, 60, 400])) if i % 2 else prose(rng, rng.choice([12, 60, 400]), rng.choice(["$$", "!", "", ""]))) for i in range(160)]
    rows += [(500, prose(rng, 60_000)), (501, prose(rng, 30_000, "$$")), (502, ""), (503, None), (504, "é😀" * 700)]
    quality = {i: i % 2 for i, _ in rows}
    docs = spark.createDataFrame([(i, t, -1.0, "x", 7) for i, t in rows], "doc_id long, text string, score double, label string, half int").repartition(3)
    labels = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    texts = {i: t for i, t in rows if t and zlib.crc32(str(i).encode()) % 5}

    def blocks(text):
        size = compression_quality.SAMPLE_CHARS
        return [text[at : at + size] for at in range(0, len(text), size)]

    def train(ids):
        return zstandard.train_dictionary(compression_quality.DICTIONARY_BYTES, [b.encode() for i in ids for b in blocks(texts[i])], k=64, d=8).as_bytes()

    def difference(bad, good, text):
        sizes = []
        for dictionary in (bad, good):
            one = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False, write_checksum=False)
            raw = text.encode()
            sizes.append(sum(len(one.compress(raw[at : at + 1024])) for at in range(0, max(1, len(raw)), 1024)))
        return (sizes[0] - sizes[1]) / sum(sizes)

    known = {y: sorted(i for i, own in quality.items() if own == y and zlib.crc32(str(i).encode()) % 5) for y in (0, 1)}
    half = {i: k % 2 for own in known.values() for k, i in enumerate(own)}
    of = lambda y, h: [i for i in known[y] if i in texts and half[i] in h]
    apart = [(train(of(0, {1 - h})), train(of(1, {1 - h}))) for h in (0, 1)]
    x = {i: difference(*apart[half[i]], t) for i, t in texts.items()}
    final = train(of(0, {0, 1})), train(of(1, {0, 1}))
    model = fit_model(docs, labels.where("crc32(string(doc_id)) % 5 != 0"), "doc_id", "text", "quality")
    assert (model.bad, model.good) == final
    # the calibration is where the slope of the penalised likelihood is 0
    scale, share = np.mean(np.abs(list(x.values()))), {y: len(known[y]) / sum(map(len, known.values())) for y in (0, 1)}
    slope = np.zeros(2)
    for i, d in x.items():
        y = quality[i]
        p = 1 / (1 + math.exp(-(model.weights[0] * d + model.weights[1])))
        slope += share[y] / len(of(y, {0, 1})) * len(x) * (y - p) * np.array([d / scale, 1])
    assert slope - 1e-2 * np.array([model.weights[0] * scale, model.weights[1]]) == pytest.approx([0, 0], abs=1e-5)
    for r in score_quality(docs, labels).collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.weights[0] * difference(*final, text) + model.weights[1]))))


def test_copies_move_no_band(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 150), "fr") for i in range(120)]
    one = " ".join(rng.choice("went home people light".split()) for _ in range(150))
    docs = spark.createDataFrame(rows + [(1000 + i, one, "fr") for i in range(300)], "doc_id long, text string, lang string").repartition(3)
    out = score_rules(docs).collect()
    alone = {r.doc_id: r.log_perplexity for r in score_rules(docs.where("doc_id <= 1000")).collect()}
    assert len(out) == 420 and all(r.kept for r in out if r.doc_id < 1000)
    assert all(r.log_perplexity == pytest.approx(alone[min(r.doc_id, 1000)]) for r in out)


def test_unknown_tags_do_not_judge_themselves(spark):
    rng = random.Random(5)
    german = lambda: " ".join(rng.choice("zwischen wurde nicht schon jahr strasse kuchen gross zeit ganz".split()) for _ in range(150))
    junk = lambda: " ".join("".join(rng.choice("qxzjkvw#$%&") for _ in range(rng.randrange(2, 9))) for _ in range(150))
    rows = [(i, prose(rng, 150), "en") for i in range(60)] + [(100 + i, german(), "de") for i in range(60)]
    rows += [(200 + i, junk(), [None, "xx"][i % 2]) for i in range(60)] + [(300, junk(), "en"), (301, junk(), "de")]
    rows += [(400, prose(rng, 150), None), (401, german(), "xx"), (402, german(), "en"), (403, prose(rng, 150), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = {r.doc_id: r for r in score_rules(docs).collect()}
    assert all(not r.base_failed and r.log_perplexity is not None for r in out.values())
    assert {i for i, r in out.items() if not r.kept} == {i for i in out if 200 <= i < 400}
    assert score_rules(docs.where("lang IS NULL")).where("kept").count() > 0
