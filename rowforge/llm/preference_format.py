"""Preference pairs as a shared prompt and two masked completions.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a turn is rendered as <|role|>, a line break, its text, <|end|>, a line break
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def _plain(column: str) -> Column:
    """Null as empty; what opens a marker is parted by a space, so that texts cannot forge turns."""
    return F.replace(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair: pair_id, n_common, prompt, and for each side its completion and the spans to train on.

    ``turns``: pair_id, side (0 chosen, 1 rejected), turn, role, text.  The
    prompt is the longest common prefix of both sides' turns (role and text),
    rendered once; a completion is the rest of a side.  Spans are
    ``start:end`` in code points of the completion, end exclusive,
    comma-joined: the text and closing marker of each assistant turn; all
    else, the prompt included, is masked.  Turns sort by turn (null first),
    role, text; null roles and texts count as empty; repeated rows are turns
    of their own.  A pair with one side has no common prefix and null for the
    other side.  Rows with a null pair_id belong to no pair.  One shuffle, by
    pair; a pair's turns have to fit a row, as its rendering does.
    """
    sided = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin(0, 1)).select("pair_id", "side", _turn().alias("t"))
    pairs = sided.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("side", "t"))).alias("all"))
    of = lambda side: F.transform(F.filter("all", lambda x: x["side"] == side), lambda x: x["t"])
    return _formatted(pairs.select("pair_id", of(0).alias("c"), of(1).alias("r")))


def _turn() -> Column:
    return F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), _plain("role").alias("role"), _plain("text").alias("text"))


def _formatted(both: DataFrame) -> DataFrame:
    """The result of :func:`format_pairs` from the sorted turns of both sides, c and r."""
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    common = F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int") - 1
    both = both.withColumn("n_common", F.when((F.size("c") == 0) | (F.size("r") == 0), 0).otherwise(common))
    rendered = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE))
    text = lambda ts: F.array_join(F.transform(ts, rendered), "")

    def spans(ts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, t: Column) -> Column:
            first = acc["at"] + F.length(t["role"]) + len(OPEN + AFTER_ROLE)
            end = first + F.length(t["text"]) + len(CLOSE)
            own = F.concat_ws(":", first.cast("string"), (end - 1).cast("string"))  # without the line break
            out = F.when(t["role"] == TRAINED_ROLE, F.concat(acc["out"], F.array(own))).otherwise(acc["out"])
            return F.struct(end.alias("at"), out.alias("out"))

        return F.array_join(F.aggregate(ts, start, step, lambda acc: acc["out"]), ",")

    rest = lambda side: F.slice(F.col(side), F.col("n_common") + 1, F.greatest(F.size(side), F.lit(1)))
    there = lambda side, value: F.when(F.size(side) > 0, value)
    return both.select(
        "pair_id",
        "n_common",
        text(F.slice("c", 1, F.col("n_common"))).alias("prompt"),
        there("c", text(rest("c"))).alias("chosen"),
        there("c", spans(rest("c"))).alias("chosen_spans"),
        there("r", text(rest("r"))).alias("rejected"),
        there("r", spans(rest("r"))).alias("rejected_spans"),
    )


def format_exchanged(conversations: DataFrame) -> DataFrame:
    """The result of :func:`format_pairs` for conversations (conv_id, turn, role, text) as pairs of their own.

    A conversation is chosen over itself with the text of its last assistant
    turn exchanged for that of the conversation numbered one higher; pair_id
    is its conv_id.  Where one of the two has no assistant turn there is no
    rejected side.  Turns sort and nulls count as there; rows with a null
    conv_id belong to no conversation; repeated rows are turns of their own;
    an empty table gives no pairs; other columns are ignored, whatever their
    names.  Conversations are shuffled once, and the last replies of each
    task.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("pair_id"), _turn().alias("t"))
    whole = turns.groupBy("pair_id").agg(F.array_sort(F.collect_list("t")).alias("c"))
    replies = turns.where(F.col("t.role") == TRAINED_ROLE).select((F.col("pair_id") - 1).alias("pair_id"), "t.turn", "t.text")
    last = replies.groupBy("pair_id").agg(F.max(F.struct("turn", "text"))["text"].alias("other"))
    both = whole.join(last, "pair_id", "left")
    place = F.array_max(F.transform("c", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i)))
    other = lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("other").alias("text"))
    exchanged = F.transform("c", lambda t, i: F.when(i == F.col("place"), other(t)).otherwise(t))
    none = F.filter("c", lambda t: F.lit(False))
    both = both.withColumn("place", place)
    return _formatted(both.select("pair_id", "c", F.when(F.col("place").isNotNull() & F.col("other").isNotNull(), exchanged).otherwise(none).alias("r")))


#: the same by DuckDB
ORACLE = """
WITH b AS (
  SELECT CAST(conv_id AS BIGINT) AS pair_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text) AS k FROM b),
l AS (SELECT pair_id, max(k) AS last, arg_max(text, k) AS reply FROM o WHERE role = 'assistant' GROUP BY 1),
n AS (
  SELECT pair_id, 0 AS side, k, role, text FROM o UNION ALL
  SELECT o.pair_id, 1, k, role, CASE WHEN k = l.last THEN x.reply ELSE text END FROM o JOIN l USING (pair_id) JOIN l x ON x.pair_id = o.pair_id + 1),
m AS (SELECT pair_id, max(k) AS last FROM n GROUP BY 1 HAVING bool_or(side = 1)),
d AS (
  SELECT c.pair_id, min(c.k) AS k
  FROM n c JOIN n r ON r.pair_id = c.pair_id AND r.k = c.k AND r.side = 1
  WHERE c.side = 0 AND (c.role <> r.role OR c.text <> r.text) GROUP BY 1),
s AS (SELECT p.pair_id, CAST(CASE WHEN m.pair_id IS NULL THEN 0 ELSE coalesce(d.k - 1, m.last) END AS INTEGER) AS n_common
      FROM (SELECT DISTINCT pair_id FROM n) p LEFT JOIN m USING (pair_id) LEFT JOIN d USING (pair_id)),
x AS (SELECT n.*, s.n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM n JOIN s USING (pair_id)),
y AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side, k > n_common ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM x),
z AS (SELECT *, CAST(ofs + length(role) + 5 AS VARCHAR) || ':' || CAST(ofs + length(shown) - 1 AS VARCHAR) AS span FROM y)
SELECT pair_id, n_common,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 0 AND k <= n_common), '') AS prompt,
  CASE WHEN bool_or(side = 0) THEN coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 0 AND k > n_common), '') END AS chosen,
  CASE WHEN bool_or(side = 0) THEN coalesce(string_agg(span, ',' ORDER BY k) FILTER (WHERE side = 0 AND k > n_common AND role = 'assistant'), '') END AS chosen_spans,
  CASE WHEN bool_or(side = 1) THEN coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 1 AND k > n_common), '') END AS rejected,
  CASE WHEN bool_or(side = 1) THEN coalesce(string_agg(span, ',' ORDER BY k) FILTER (WHERE side = 1 AND k > n_common AND role = 'assistant'), '') END AS rejected_spans
FROM z GROUP BY pair_id, n_common
"""
