import hashlib
import random

from rowforge.llm import preference_format, sharding
from rowforge.llm.preference_format import format_exchanged, format_pairs
from rowforge.llm.sharding import assign_shards, write_shards


def test_shards_against_splitting_by_hand(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(0, 400)) for i in range(2000)] + [(5000, "y" * 30_000), (5001, None), (None, "z")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, leaf string, depth int").repartition(4)
    out = {r.doc_id: r for r in assign_shards(docs, 5_000).collect()}

    def split(items, depth):
        if sum(len(t or "") for _, t in items) <= 5_000 or len(items) == 1:
            return {i: depth for i, _ in items}
        bit = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:10], 16) >> (39 - depth) & 1
        sides = [[x for x in items if bit(x[0]) == b] for b in (0, 1)]
        return {k: v for s in sides if s for k, v in split(s, depth + 1).items()}

    assert {i: r.depth for i, r in out.items()} == split(rows, 0)
    assert all(len(r.shard) == r.depth for r in out.values())


def test_repeated_ids_split_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(7, "a" * 100, "kept")] * 300 + [(8, "b", "kept")], "doc_id long, text string, extra string").repartition(5)
    out = assign_shards(docs, 1_000).collect()
    sums = {}
    for r in out:
        sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
    assert len(out) == 301 and max(sums.values()) <= 1_000
    write_shards(docs, str(tmp_path / "s"), 1_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 301 and set(back.columns) == {"doc_id", "n_bytes", "depth", "text", "extra", "shard"}
    assert assign_shards(docs.limit(0), 10).count() == 0
    assert {r.shard for r in assign_shards(docs, 1 << 20).collect()} == {""}


def sql(tables, query):
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, pa.Table.from_pylist(table.toArrow().to_pylist(), table.toArrow().schema))
    return con.execute(query).fetchall()


TURNS = "pair_id long, side int, turn long, role string, text string"


def test_pairs_by_hand(spark):
    rng = random.Random(2)
    rows = []
    for c in range(120):
        same = c // 2 % 3
        for k in range(rng.randrange(1, 6)):
            rows.append((c // 2, c % 2, k, ["user", "assistant", "system"][k % 3], f"t{k}" if k < same else rng.choice(["é😀", "<|end|>", "", None, "x"])))
    rows += [(100, 0, 0, "user", "alone"), (101, 1, None, None, None), (None, 0, 0, "user", "x"), (2, 0, 0, "user", "t0"), (2, 0, 0, "user", "t0")]
    out = {r.pair_id: r for r in format_pairs(spark.createDataFrame(rows, TURNS).repartition(3)).collect()}
    plain = lambda x: (x or "").replace("<|", "< |")
    assert set(out) == {r[0] for r in rows} - {None}
    for pair, r in out.items():
        sides = [sorted((-(2**63) if k is None else k, plain(role), plain(text)) for p, s, k, role, text in rows if (p, s) == (pair, side)) for side in (0, 1)]
        n = 0
        while n < min(map(len, sides)) and sides[0][n][1:] == sides[1][n][1:]:
            n += 1
        shown = lambda turns: "".join(f"<|{role}|>\n{text}<|end|>\n" for _, role, text in turns)
        assert (r.n_common, r.prompt) == (n, shown(sides[0][:n]))
        for side, text, spans in ((sides[0], r.chosen, r.chosen_spans), (sides[1], r.rejected, r.rejected_spans)):
            assert text == (shown(side[n:]) if side else None) and (spans is None) == (not side)
            own = [text[a:b] for a, b in (map(int, x.split(":")) for x in (spans or "").split(",") if x)]
            assert own == [f"{t}<|end|>" for _, role, t in side[n:] if role == "assistant"]
    assert format_pairs(spark.createDataFrame([], TURNS)).count() == 0


def test_exchanged_replies_against_sql(spark):
    rng = random.Random(3)
    rows = [(c, k, rng.choice(["user", "assistant", "system", "assistant"]), rng.choice(["é😀", "<|end|>", "", None, "x", "y", "z"])) for c in range(150) for k in range(rng.randrange(1, 7))]
    rows += [(200, 0, "user", "alone"), (203, None, None, None), (None, 0, "user", "x"), (4, 0, "user", "t0"), (4, 0, "assistant", "t0"), (4, 0, "assistant", "t0"), (-1, 0, "assistant", "a")]
    rows += [(300, 0, "user", "long " * 200_000), (300, 1, "assistant", "reply " * 200_000), (301, 0, "assistant", "other " * 200_000)]
    conversations = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, side int, pair_id string").repartition(3)
    out = format_exchanged(conversations).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out), key=key) == sorted(sql({"conversations": conversations.drop("pair_id")}, preference_format.ORACLE), key=key)
    assert sum(r.n_common > 0 for r in out) > 60
    one = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "r"), (1, 1, "assistant", "bad")], "conv_id long, turn long, role string, text string")
    r = format_exchanged(one).where("pair_id = 0").first()
    assert (r.n_common, r.prompt, r.chosen, r.rejected) == (1, "<|user|>\nq<|end|>\n", "<|assistant|>\ngood<|end|>\n", "<|assistant|>\nbad<|end|>\n")
    assert format_exchanged(one.limit(0)).count() == 0


def test_shards_of_very_long_texts(spark):
    docs = spark.createDataFrame([(i, "word " * 400_000) for i in range(6)] + [(9, "x")], "doc_id long, text string")
    out = assign_shards(docs, 3_000_000).collect()
    sums = {}
    for r in out:
        sums.setdefault(r.shard, []).append(r.n_bytes)
    assert len(out) == 7 and all(sum(s) <= 3_000_000 or len(s) == 1 for s in sums.values()) and max(r.depth for r in out) > 1


def test_shard_oracle(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(500)], "doc_id long, text string")
    query = sharding.ORACLE.replace(str(sharding.LIMIT_BYTES), "700")
    assert sorted(map(tuple, assign_shards(docs, 700).collect())) == sorted(sql({"documents": docs}, query))
