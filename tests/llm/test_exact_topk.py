import math
import random

import numpy as np
import pytest

from rowforge.llm import exact_topk as module
from rowforge.llm.exact_topk import BoxTree, Cells, exact_topk


def brute(rows, every, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (qi, q) in enumerate(whole):
        if qi % every == 0:
            scored = sorted((-min(max(sum(x * y for x, y in zip(q, v)), -(2**63)), 2**63 - 1), i) for b, (i, v) in enumerate(whole) if b != a and len(v) == len(q))[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [100_000, 150, 20])
def test_against_brute_force(spark, shard_rows):
    rng = random.Random(1)
    point = lambda: [rng.choice([-1, 1]) * rng.randrange(64) / 64 for _ in range(6)]
    rows = [(i, point()) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(40, point()), (40, rows[40][1]), (None, point()), (2000, None), (2001, [1.0, None] * 3), (2020, [float("nan")] * 6), (2040, [1.0, 2.0]), (2041, [0.5, -1.0]), (2060, []), (2061, [])]
    docs = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<float>, row int").repartition(3)
    out = sorted(map(tuple, exact_topk(docs, 20, 10, shard_rows=shard_rows).collect()))
    assert out == brute(rows, 20, 10)


def test_large_components_and_empty(spark):
    rows = [(0, [3e4, -2e4]), (1, [3e5, 1e5]), (2, [-1e5, 3e5]), (3, [1e17, 1.0]), (4, [-1e17, 2.0]), (5, [1e9, 1e9]), (6, [1e300, -1e300]), (7, [1e6, 2e6]), (8, [1e308, 1.0])]
    got = sorted(map(tuple, exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1, 10).collect()))
    assert got == brute(rows[:-1], 1, 10)  # 1024 times the last is no finite double
    assert exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>"), 20).count() == 0


def test_shards_are_cells_that_bounds_keep_queries_from(spark, monkeypatch):
    """Vectors in far clusters: the boxes of most shards hold no score of a query's best."""
    rng = np.random.default_rng(3)
    centres = np.array([[a, b, c, 0.0] for a in (-40, 40) for b in (-40, 40) for c in (-40, 40)])
    rows = [(i, [float(x) for x in np.round(centres[i * 7 // 3 % 8] + rng.normal(size=4), 3)]) for i in range(4_000)]
    sent, real = [], module._sent
    monkeypatch.setattr(module, "_sent", lambda *a: sent.append(real(*a)) or sent[-1])
    out = sorted(map(tuple, exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100, 10, shard_rows=250).collect()))
    assert out == brute(rows, 100, 10)
    assert sent[0].count() < 0.3 * 40 * 15


def test_trees_are_searched_best_first_with_a_score_from_elsewhere():
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(size=(20_000, 4)) * 1000)
    tree = BoxTree(np.arange(20_000), np.arange(20_000), vectors)
    for q in vectors[:20]:
        tree.searched = 0
        best = tree.search(q, -1, 10, None)
        scores = vectors @ q
        assert best == [(int(scores[i]), int(i)) for i in np.lexsort((np.arange(20_000), -scores))[:10]]
        alone, tree.searched = tree.searched, 0
        assert tree.search(q, -1, 10, best[-1][0]) == best and tree.searched <= alone < len(tree.span) / 8
    cells = Cells(vectors, 7)
    assert cells.cells == 7 and np.bincount(cells.of(vectors)).min() > 2_000
    assert Cells(np.ones((50, 3)), 4).cells == 1


def test_small_tables_and_wide_vectors_have_several_shards(spark, monkeypatch):
    """Shards are bounded in bytes, and the k-th score travels between shards in small tables too."""
    rng = random.Random(8)
    rows = [(i, [rng.randrange(-64, 64) / 64 for _ in range(40)]) for i in range(300)]
    sent, real = [], module._sent
    monkeypatch.setattr(module, "_sent", lambda *a: sent.append(real(*a)) or sent[-1])
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, exact_topk(vectors, 100, 10).collect())) == brute(rows, 100, 10)
    assert sent.pop().where("least IS NOT NULL").count() > 0
    monkeypatch.setattr(module, "SHARD_BYTES", 40 * 8 * 20)
    assert sorted(map(tuple, exact_topk(vectors, 100, 10).collect())) == brute(rows, 100, 10)
    assert sent.pop().select("shard").distinct().count() > 10
