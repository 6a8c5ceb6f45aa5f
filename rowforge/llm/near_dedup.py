"""Near-duplicate groups from bottom-k sketches, confirmed on whole shingle sets.

Texts with equal sets form a class.  A sketch keeps the KEEP smallest hashes of
a set.  Inverted lists lead from a retained value to the classes that hold it.
A list is linked through hubs, one for each run of RUN neighbouring values that
its members retain from there (a passage that many texts share seldom gives
whole runs); a hub is the member whose values are the most common, hence in
the middle of its group.  The lists that a class shares with a hub are their
overlap, the estimate on the union's sketch filters, whole sets confirm.  What
the hubs or their overlaps leave apart is then searched without loss: two sketches that overlap enough
meet in the list of one of their rarest values (prefix filtering), and of the
lists that still hold several components the members are compared by prefix
filtering on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm.storage import drop_stored, stored
from rowforge.llm.tokenizers import _Memo, held

KEEP, RUN = 48, 3
#: the share of common values among KEEP is that much under the similarity in 5e-11 of the pairs at 0.85, 1.1e-9 at 0.8
ESTIMATE_SLACK = 0.40
#: wanted ids up to which a bitmap of 16 to 32 places an id (16 MB at most) says whose sets are needed; more are joined
BITMAP_IDS = 1 << 22
#: lists that a class shares with a hub before their sketches are fetched, if both sets fill a sketch
LEAST_OVERLAP = 2
#: further turns with other hubs, and how many different hubs lists of the same members get in one
TURNS, HUBS = 2, 8
#: a further turn is worth its shuffles if the one before linked one in so many members; what it leaves, the search without loss finds
GAIN = 100
#: members of a list that meet in one place; larger lists are dealt over several
BLOCK = 1_000


def _word_hashes() -> _Memo:
    import xxhash

    return held("word hashes", lambda: _Memo(xxhash.xxh3_64_intdigest, 100_000))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words.

    A-Z are lowered, words end at ASCII white space; with fewer words the
    whole sequence is the one shingle; without words the set is empty.
    """
    own = (text or "").encode("utf-8").lower().split()
    if not own:
        return np.empty(0, np.int64)
    if len(own) < words:
        return np.array([int.from_bytes(hashlib.blake2b(b" ".join(own), digest_size=8).digest(), "little", signed=True)], np.int64)
    h = np.fromiter(map(_word_hashes().__getitem__, own), np.uint64, len(own))
    n = len(own) - words + 1
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def _mark(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes()).digest()


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                sets = [shingle_set(v.as_py(), words) for v in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_mark(s) for s in sets], pa.binary()),
                        _lists([s[:KEEP] for s in sets]),
                    ],
                    ["id", "n", "mark", "sketch"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, mark binary, sketch array<long>")


def _wanted_bits(ids: DataFrame, bits_log: int) -> np.ndarray:
    """A bitmap over hashed ids: all of ``ids`` are in it, few others."""
    one = (F.pmod(F.xxhash64("id"), F.lit(1 << bits_log)) + 1).alias("one")
    parts = ids.select(one).groupBy(F.bitmap_bucket_number("one").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("one")).alias("bits"))
    bits = np.zeros(1 << bits_log - 3, np.uint8)
    for r in parts.collect():  # the whole bitmap at most
        bits[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


def _sets(source: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(mark, shingles) of the rows whose id is in ``wanted`` (id; stored) and of few others, by the set's mark.

    Up to BITMAP_IDS ids the rows are picked where they lie and no text is
    shuffled; beyond, by a join.
    """
    n = wanted.count()
    by_bitmap = n <= BITMAP_IDS
    bits_log = max(20, (16 * n).bit_length())
    bits = _wanted_bits(wanted, bits_log) if by_bitmap else None
    if not by_bitmap:
        source = source.join(wanted.select("id").distinct().hint("merge"), "id", "left_semi")
    marked = source.select("text", F.pmod(F.xxhash64("id"), F.lit(1 << bits_log)).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # copies within the task
        for whole in batches:
            if by_bitmap:
                place = whole.column(1).to_numpy()
                whole = whole.filter(pa.array((bits[place >> 3] >> (place & 7) & 1).astype(np.bool_)))
            for at in range(0, whole.num_rows, 500):
                marks, sets = [], []
                for v in whole.column(0).slice(at, 500):
                    own = shingle_set(v.as_py(), words)
                    mark = _mark(own)
                    if len(own) and mark not in seen:
                        seen.add(mark)
                        marks.append(mark)
                        sets.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), _lists(sets)], ["mark", "shingles"])

    return marked.mapInArrow(run, "mark binary, shingles array<long>")


def _shared(classes: DataFrame) -> DataFrame:
    """(c, id, n, own): of each class the retained values that others retain too, each with its place and the length of its list."""
    values = classes.select("c", F.posexplode("sketch").alias("at", "v"))
    lists = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    own = values.join(lists.hint("merge"), "v").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("at", "v", "f"))).alias("own"))  # at most KEEP
    return classes.select("c", "id", "n").join(own.hint("merge"), "c")


def _runs(shared: DataFrame) -> DataFrame:
    """(key, c, n, label, rank): the lists by runs of RUN neighbouring retained values, each class under a label of its own."""
    size = F.size("own")
    unbroken = lambda i: F.get("own", i + (RUN - 1))["at"] - F.get("own", i)["at"] == RUN - 1
    key = lambda i: F.xxhash64(*[F.get("own", i + k)["v"] for k in range(RUN)])
    whole = F.array(F.xxhash64(F.transform("own", lambda x: x["v"])))
    runs = F.transform(F.filter(F.sequence(F.lit(0), size - RUN), unbroken), key)
    keys = F.when(F.col("n") < RUN, whole).when(size < RUN, F.array().cast("array<bigint>")).otherwise(runs)
    return shared.select(F.explode(keys).alias("key"), "c", "n", F.col("c").alias("label"), _edge().alias("rank"))


def _edge() -> Column:
    """How far a class stands from the middle of its group: the less common its retained values are, the farther."""
    away = F.round(-F.aggregate("own", F.lit(0.0), lambda a, x: a + F.log(x["f"].cast("double"))) / F.least("n", F.lit(KEEP)), 9)
    return F.struct(away.alias("away"), "id")


def _stars(lists: DataFrame, similar: int, turn: int = 0) -> DataFrame:
    """(a, b, overlap, least) of the pairs of a list's hub and another member that sizes allow and labels part; least: the smaller set's size.

    ``lists``: (key, c, n, label, rank).  The hub is the member of the
    smallest rank; from the first turn on that of one in HUBS, so that lists of
    the same members get different hubs.
    """
    passed = F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(HUBS)) != F.pmod("key", F.lit(HUBS)) if turn else F.lit(False)
    hubs = lists.groupBy("key").agg(F.min(F.struct(passed.alias("passed"), "rank", "c", "n", "label")).alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    pairs = lists.join(hubs.where("lo != hi").select("key", "hub").hint("merge"), "key").where(F.col("hub.label") != F.col("label"))
    pairs = pairs.where(100 * F.least("hub.n", "n") >= similar * F.greatest("hub.n", "n"))
    return pairs.groupBy(F.least("hub.c", "c").alias("a"), F.greatest("hub.c", "c").alias("b")).agg(F.count("*").alias("overlap"), F.min(F.least("hub.n", "n")).alias("least"))


def _rarest(shared: DataFrame, similar: int) -> DataFrame:
    """(key, c, n, rank): the lists of the rarest values of each class, as many as linked sets need to meet in one."""
    k = F.least("n", F.lit(KEEP))
    first = k - F.greatest(F.lit(1), F.ceil((similar / 100 - ESTIMATE_SLACK) * k - 1e-9)) + 1
    first = (first - (k - F.size("own"))).cast("int")  # values that no other class retains are the rarest
    rare = F.transform(F.sort_array(F.transform("own", lambda x: F.struct(x["f"], x["v"]))), lambda x: x["v"])
    return shared.where(first > 0).select(F.explode(F.slice(rare, F.lit(1), first)).alias("key"), "c", "n", _edge().alias("rank"))


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists (key, c, n, rank) with the component of each member."""
    own = labels.withColumnRenamed("id", "c").hint("merge")
    return lists.join(own, "c", "left").select("key", "c", "n", F.coalesce("label", "c").alias("label"), "rank")


def _parted(lists: DataFrame) -> DataFrame:
    """Those of the labelled lists that hold several components; stored."""
    several = lists.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    return stored(lists.join(several.hint("merge"), "key", "left_semi"), "lists")


def _likely(pairs: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """(a, b, mark_a, mark_b) of the pairs whose union's sketch allows the similarity; stored."""
    side = lambda c: classes.select(F.col("c").alias(c), F.col("mark").alias(f"mark_{c}"), F.col("sketch").alias(f"s_{c}")).hint("merge")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, KEEP)
    both = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    good = both >= (similar / 100 - ESTIMATE_SLACK) * F.size(union) - 1e-9
    return stored(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(good).select("a", "b", "mark_a", "mark_b"), "likely")


def _confirmed(likely: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    own = lambda c: sets.select(F.col("mark").alias(f"mark_{c}"), F.col("shingles").alias(f"w_{c}")).hint("merge")
    shared = F.size(F.array_intersect("w_a", "w_b"))
    return (
        likely.join(own("a"), "mark_a")
        .join(own("b"), "mark_b")
        .select("a", "b", shared.alias("shared"), (F.size("w_a") + F.size("w_b")).alias("total"))
        .where(100 * F.col("shared") >= similar * (F.col("total") - F.col("shared")))
        .select("a", "b")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in ``edges`` (a, b): the smallest id of its component; stored.

    Labels spread to neighbours and are then looked up at the label itself,
    until none changes.  The nodes of a large component share a label: those
    look-ups are dealt over several places.
    """
    places = 16
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        moved = labels.join(near.hint("merge"), "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        moved = moved.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(places)))
        # only what is looked up and leads on
        looked = moved.select("label").distinct()
        jump = labels.where("id != label").select(F.col("id").alias("label"), F.col("label").alias("beyond")).join(looked.hint("merge"), "label", "left_semi")
        jump = jump.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long"))))
        after = stored(
            moved.join(jump.hint("merge"), ["label", "place"], "left").select("id", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")), "labels"
        )
        done = after.where(F.col("was") != F.col("label")).isEmpty()
        drop_stored(labels)
        labels = after.select("id", "label")
        if done:
            drop_stored(both)
            return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links; the earlier ones go."""
    out = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(links))
    drop_stored(labels)
    return out


def _member_sets(sets: DataFrame, classes: DataFrame, lists: DataFrame) -> DataFrame:
    """(mark, c, shingles) of the classes in ``lists``, each once; sets are shuffled by their marks only."""
    named = classes.select("c", "mark").join(lists.select("c").distinct().hint("merge"), "c", "left_semi")
    return sets.join(named.hint("merge"), "mark").groupBy("mark", "c").agg(F.any_value("shingles").alias("shingles"))


def _prefixes(sets: DataFrame, labels: DataFrame, similar: int) -> DataFrame:
    """(shingle, c, label, place, n, leads) of the first shingles of each set, rarest first.

    ``sets``: (c, shingles); ``labels``: (c, label).  Linked sets share one of the first
    n - ceil(s * n) + 1, and it ``leads`` (is among the first
    n - ceil(2 * s / (1 + s) * n) + 1) in the smaller set.  Shingles of one set
    only come first; they meet nothing and take places alone.
    """
    flat = sets.select("c", F.explode("shingles").alias("v"))
    often = flat.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    own = flat.join(often.hint("merge"), "v").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("own"))
    n = F.size("shingles")
    sized = sets.select("c", n.alias("n"), (n - F.ceil(similar * n / 100 - 1e-9) + 1).cast("int").alias("first"), (n - F.ceil(2 * similar * n / (100 + similar) - 1e-9) + 1).alias("lead"))
    own = sized.join(own.hint("merge"), "c").join(labels.hint("merge"), "c").withColumn("alone", F.col("n") - F.size("own")).where("alone < first")
    found = own.select("c", "label", "n", "alone", "lead", F.posexplode(F.slice("own", F.lit(1), F.col("first") - F.col("alone"))).alias("k", "x"))
    place = F.col("alone") + F.col("k")
    return found.select(F.col("x.v").alias("shingle"), "c", "label", place.alias("place"), "n", (place < F.col("lead")).alias("leads"))


def _across(rare: DataFrame, similar: int) -> DataFrame:
    """(a, b) of all pairs of different components that prefix filtering leaves, from ``rare`` (stored); stored.

    Of each list: those that lead, with those of other labels whose sets are
    no smaller.  Long lists are cut into blocks on both sides, so that no
    place joins more than BLOCK by BLOCK.
    """
    lists = rare.groupBy("shingle").agg(F.count("*").alias("rows"), F.count_if("leads").alias("leading"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    lists = lists.where((F.col("lo") != F.col("hi")) & (F.col("leading") > 0))
    lists = lists.select("shingle", F.ceil(F.col("rows") / BLOCK).alias("down"), F.ceil(F.col("leading") / BLOCK).alias("along"))
    mixed = stored(rare.join(lists.hint("merge"), "shingle"), "mixed")
    by_label = mixed.groupBy("shingle", "label").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
    met = mixed
    mixed = stored(met.join(by_label.hint("merge"), "shingle").withColumn("inside", F.col("label") == F.col("main")), "mixed")
    drop_stored(met)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("c"), F.col(n))
    named = lambda t: [F.col(x).alias(f"{x}_{t}") for x in ("c", "label", "place", "n", "inside")]
    left = mixed.where("leads").select("shingle", block("along").alias("i"), every("down").alias("j"), *named("x"))
    right = mixed.select("shingle", every("along").alias("i"), block("down").alias("j"), *named("y"))
    least = F.ceil(similar * (F.col("n_x") + F.col("n_y")) / (100 + similar) - 1e-9)
    joined = [  # most lists have one main component, whose own pairs are not made
        left.where("not inside_x").join(right.hint("merge"), ["shingle", "i", "j"]),
        left.where("inside_x").join(right.where("not inside_y").hint("merge"), ["shingle", "i", "j"]),
    ]
    pairs = [
        one.where((F.col("label_x") != F.col("label_y")) & (F.struct("n_x", "c_x") < F.struct("n_y", "c_y")))
        # linked sets share at least so many shingles, hence meet first at places that leave as many
        .where((F.col("place_x") <= F.col("n_x") - least) & (F.col("place_y") <= F.col("n_y") - least))
        .select(F.least("c_x", "c_y").alias("a"), F.greatest("c_x", "c_y").alias("b"))
        for one in joined
    ]
    found = stored(pairs[0].union(pairs[1]).distinct(), "across")
    drop_stored(mixed)
    return found


def near_groups(docs: DataFrame, words: int = 5, similar: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= similar * |union| of their
    shingle sets; component_id is the smallest id that links lead to.  Null,
    empty and blank texts have no shingles and are linked with nothing; texts
    of any length are read whole.  Rows that share an id count as one document
    to the links, and each gets its row; rows with a null id are linked with
    nothing and kept (component_id null).  Ids may be structs.  An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(_signatures(source, words), "signed")
    shingled = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = shingled.groupBy("mark").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    rows = stored(signed.select("id", "n", "mark"), "rows")
    drop_stored(signed)

    shared = stored(_shared(classes), "shared")
    ids_of = lambda c: classes.select("c", "id").join(c.hint("merge"), "c", "left_semi").select("id")
    with_id = source.where(F.col("id").isNotNull())
    # the overlaps filter first: similar sets that fill a sketch have many runs in common, a shared passage has few
    met = _stars(_runs(shared), similar).where((F.col("overlap") >= LEAST_OVERLAP) | (F.col("least") < KEEP))
    likely = _likely(met, classes, similar)
    wanted = stored(ids_of(likely.select(F.col("a").alias("c")).union(likely.select("b")).distinct()), "wanted")
    sets = stored(_sets(with_id, words, wanted), "sets")

    # rows that share an id but not a text make one document of their classes
    several = rows.where("n > 0").groupBy("id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("id IS NOT NULL AND lo != hi").select("id")
    placed = rows.where("n > 0").join(several, "id").select("id", "mark").distinct().join(classes.select("mark", "c").hint("merge"), "mark").select("id", "c")
    same_id = placed.join(placed.groupBy("id").agg(F.min("c").alias("a")), "id").where("a != c").select("a", F.col("c").alias("b")).distinct()

    links = stored(_confirmed(likely, sets, similar).union(same_id), "links")
    for done in (likely, sets, wanted):
        drop_stored(done)
    labels = components(links)

    # lists that still hold several components: other hubs first
    lists = _parted(_labelled(_rarest(shared, similar), labels))
    wanted = stored(ids_of(lists.select("c").distinct()), "wanted")
    sets = stored(_sets(with_id, words, wanted), "sets")
    members = wanted.count()
    for done in (shared, links, wanted):
        drop_stored(done)
    of_members = stored(_member_sets(sets, classes, lists), "members")
    drop_stored(sets)
    for turn in range(1, TURNS + 1):
        likely = _likely(_stars(lists, similar, turn), classes, similar)
        links = stored(_confirmed(likely, of_members, similar), "links")
        if linked := links.count():
            labels = _joined(labels, links)
            before, lists = lists, stored(_labelled(lists.drop("label"), labels), "lists")
            drop_stored(before)
        for done in (likely, links):
            drop_stored(done)
        if not linked or linked * GAIN < members:
            break

    # then what any two members of different components may still have in common
    rare = stored(_prefixes(of_members, lists.select("c", "label").distinct(), similar), "prefixes")
    across = _across(rare, similar)
    likely = _likely(across, classes, similar)
    more = stored(_confirmed(likely, of_members, similar), "more")
    for done in (across, likely, of_members, rare, lists):
        drop_stored(done)
    if not more.isEmpty():
        labels = _joined(labels, more)

    named = classes.select("mark", "id", "c").join(labels.withColumnRenamed("id", "c").hint("merge"), "c", "left").select("mark", "id", F.coalesce("label", "c").alias("label"))
    first = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.select("mark", "label").join(first.hint("merge"), "label").select("mark", "component_id")
    # what has no shingles or no id stands for itself
    out = rows.join(named.hint("merge"), (rows["mark"] == named["mark"]) & rows["id"].isNotNull(), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    )
    out = stored(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), "groups")
    for done in (rows, classes, more, labels):
        drop_stored(done)
    return out
