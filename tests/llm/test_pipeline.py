import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(5)
    words = "river stone light over people home went under bridge water slow green hill road north wind".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, prose(120), "en", "s", 0) for i in range(200)]
    junk = [(1000 + i, " ".join(w.upper() + "$$$" for w in prose(120).split()), "en", "s", 0) for i in range(200)]
    copies = [(2000 + i, rows[0][1], "en", "s", 0) for i in range(20)] + [(0, rows[0][1], "en", "s", 0)]
    mail = [(3000, prose(60) + " Write to jo@example.org " + prose(60), "en", "s", 0)]
    odd = [(4000, None, None, None, None), (4001, "", "en", None, 0), (None, prose(120), "en", "s", 0)]
    docs = spark.createDataFrame(rows + junk + copies + mail + odd, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1) for r in rows] + [(r[0], 0) for r in junk], "doc_id long, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at, left = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        left[name] = at.collect()
        if name != "packing":
            assert at.columns == docs.columns
    ids = lambda name: sorted(r.doc_id for r in left[name] if r.doc_id is not None)
    assert not [i for i in ids("quality_classifier") if 1000 <= i < 1200] and set(range(200)) <= set(ids("quality_classifier"))
    assert 4000 not in ids("quality_rules") and len(set(range(200)) & set(ids("quality_rules"))) > 190
    deduped = ids("near_dedup")
    assert not [i for i in deduped if 2000 <= i < 2020] and deduped.count(0) <= 1
    assert any(r.doc_id is None for r in left["near_dedup"]) == any(r.doc_id is None for r in left["quality_rules"])
    assert len(set(range(1, 200)) & set(deduped)) == len(set(range(1, 200)) & set(ids("quality_rules")))
    mail = next(r for r in left["pii"] if r.doc_id == 3000)
    assert "jo@example.org" not in mail.text and "[EMAIL]" in mail.text and mail.n_chars == len(mail.text)
    assert sorted({r.doc_id for r in left["packing"]}, key=str) == sorted({r.doc_id for r in left["pii"]}, key=str)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(
        map(str, at.drop("sequence_id", "offset").collect())
    )
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_near_dedup_keeps_unrelated_rows_of_one_id(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(rng.choice("river stone light over people home went under bridge water".split()) for _ in range(80)) for _ in range(4))
    rows = [(7, a, "en", "s", 1), (7, b, "en", "s", 1), (8, c, "en", "s", 1), (7, a, "en", "s", 1), (7, a, "en", "r", 1), (9, b, "en", "s", 1)]
    rows += [(None, a, "en", "s", 1), (None, d, "en", "s", 1), (None, d, "en", "s", 1), (10, "", "en", "s", 0), (11, None, None, None, None), (12, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, kept long")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)
    assert got == sorted([(7, a, "r"), (7, b, "s"), (8, c, "s"), (None, d, "s"), (10, "", "s"), (11, None, None), (12, "", "s")], key=str)


def test_stages_keep_further_columns(spark, tmp_path):
    rows = [(i, f"the river {i} went over the stone and people came home by the bridge at night {i}", "en", "s", 1, i, 0.5, "x", -1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, predicted long, score double, id string, n_words int")
    spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, str(tmp_path))
        assert docs_out.columns == docs.columns and all(r.predicted == r.doc_id for r in docs_out.collect()), name


def test_near_dedup_keeps_columns_of_any_type(spark):
    text = "the river went over the stone and people came home by the bridge at night"
    rows = [(1, text, {"a": 1}, [1]), (1, text, {"a": 0}, [2]), (1, text, None, None), (2, text + " x", {"b": 2}, None), (3, "another text of its own with other words in it", {}, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, meta map<string,int>, more array<int>")
    got = sorted((r.doc_id, str(r.meta)) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert [i for i, _ in got] == [1, 3] and got[1][1] == "{}"
    assert got == sorted((r.doc_id, str(r.meta)) for r in corpus_pipeline.near_dedup(spark, docs.repartition(3), "").collect())
