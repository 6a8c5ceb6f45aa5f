import random

import pytest

from rowforge.llm.near_dedup import components, near_groups, shingle_set


def brute(rows, words, similar):
    sets = {}
    for i, text in rows:
        own = [bytes(w) for w in (text or "").encode().lower().split()]
        own = [tuple(own)] if 0 < len(own) < words else [tuple(own[k : k + words]) for k in range(len(own) - words + 1)] if own else []
        sets.setdefault(i, []).append(frozenset(own))
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= similar * len(s | t) for s in sets[a] for t in sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "similar"), [(3, 85), (5, 80)])
def test_groups_against_brute_force(spark, words, similar):
    rng = random.Random(words)
    texts = []
    passage = " ".join(f"p{k}" for k in range(60))
    for size, copies, edits in ((200, 60, 8), (40, 40, 3), (120, 50, 12), (8, 20, 1), (600, 20, 30)):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += family(rng, base, copies, edits)
        texts += [passage + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(10)]
    texts += ["One two THREE four", "one  two\tthree four", "one two", "ONE two", "x", "", " \n", None] * 2
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n int, key string").repartition(5)
    out = {r.doc_id: r for r in near_groups(docs, words, similar).collect()}
    want = brute(rows, words, similar)
    assert {i: r.component_id for i, r in out.items()} == want
    assert all(r.kept == (i == r.component_id) and r.n_shingles == len(shingle_set(texts[i], words)) for i, r in out.items())


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "e f g h"), (3, "e f g h"), (9, "a b c d"), (9, "a b c d")]
    out = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in out)
    assert got == [(-1, None, True), (-1, None, True), (3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False), (9, 3, False)]
    assert near_groups(spark.createDataFrame([], "doc_id long, text string"), 3, 85).count() == 0


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (100, 102)]
    found = {r.id: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


def test_dense_group_without_its_original(spark):
    """Near copies of a text that is not there: many pairs lie about the threshold and no member is like all others."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = list(enumerate(family(rng, base, 260, 7) + family(rng, [f"v{rng.randrange(900)}" for _ in range(90)], 120, 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for words, similar in ((5, 80), (3, 85)):
        assert {r.doc_id: r.component_id for r in near_groups(docs, words, similar).collect()} == brute(rows, words, similar)


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(20_000)}" for _ in range(250_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:60_000], "other", *long[60_000:]])), (3, " ".join(long[::-1])), (4, " ".join(long[:120_000])), (5, "word " * 300_000)]
    out = {r.doc_id: (r.component_id, r.n_shingles) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, (c, _) in out.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5} and out[5][1] == 1 and out[1][1] > 249_000


def test_hubs_in_the_middle(spark):
    """A text and its copies with one edit each, which are not linked with one another: the text leads."""
    from rowforge.llm.near_dedup import _edge, _shared

    classes = spark.createDataFrame([(0, 100, 4, [1, 2, 3, 4]), (1, 7, 4, [1, 2, 3, 50]), (2, 8, 4, [1, 2, 4, 60]), (3, 9, 4, [2, 3, 4, 70])], "c long, id long, n long, sketch array<long>")
    ranked = _shared(classes).select("c", _edge()["away"].alias("away")).orderBy("away").collect()
    assert ranked[0].c == 0 and ranked[0].away < ranked[1].away


def test_wanted_ids_by_bitmap_and_by_join(spark, monkeypatch):
    from rowforge.llm import near_dedup

    docs = spark.createDataFrame([(i, f"a b c d e f g {i}") for i in range(5000)], "id long, text string").repartition(3)
    wanted = spark.createDataFrame([(i,) for i in range(0, 5000, 7)], "id long")
    need = {near_dedup._mark(shingle_set(f"a b c d e f g {i}", 5)) for i in range(0, 5000, 7)}
    found = {bytes(r.mark) for r in near_dedup._sets(docs, 5, wanted).collect()}
    assert need <= found and len(found) < len(need) + 30
    monkeypatch.setattr(near_dedup, "BITMAP_IDS", 10)
    assert {bytes(r.mark) for r in near_dedup._sets(docs, 5, wanted).collect()} == need


def test_a_turn_that_links_few_is_the_last(spark, monkeypatch):
    """Where one turn with other hubs links next to nothing, the search without loss follows at once and finds the rest."""
    from rowforge.llm import near_dedup

    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = list(enumerate([passage + " " + " ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(150)] + family(rng, [f"v{k}" for k in range(150)], 2, 1)))
    turns, stars, confirmed = [], near_dedup._stars, near_dedup._confirmed

    def watched(lists, similar, turn=0):
        turns.append(turn)
        return stars(lists, similar, turn)

    def all_but_the_first(likely, sets, similar):
        return confirmed(likely, sets, similar).where(str(max(turns) > 0))

    monkeypatch.setattr(near_dedup, "_stars", watched)
    monkeypatch.setattr(near_dedup, "_confirmed", all_but_the_first)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in near_groups(docs, 3, 85).collect()} == brute(rows, 3, 85)
    assert turns == [0, 1]


def test_sets_of_members_are_shuffled_by_their_marks_only(spark):
    from rowforge.llm import near_dedup

    spark.range(8).selectExpr("md5(cast(id as string)) AS mark", "id AS c").createOrReplaceTempView("few")
    sets = spark.sql("SELECT cast(mark AS binary) AS mark, array(c, c + 1) AS shingles FROM few UNION ALL SELECT cast(mark AS binary), array(c, c + 1) FROM few")
    classes = spark.sql("SELECT c, cast(mark AS binary) AS mark FROM few")
    found = near_dedup._member_sets(sets, classes, spark.sql("SELECT c, 0L AS label FROM few WHERE c < 5"))
    assert sorted((r.c, r.shingles) for r in found.collect()) == [(c, [c, c + 1]) for c in range(5)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(mark" in plan and not [x for x in plan.splitlines() if "hashpartitioning(mark" in x and ", c#" in x.split("hashpartitioning(")[1].split(")")[0]]
