"""The corpus pipeline: classify, apply rules, drop near duplicates, redact, pack.

Every stage but the last returns the columns of ``documents``; each works on
all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.llm.compression_quality import score_quality
from rowforge.llm.near_dedup import near_groups
from rowforge.llm.packing import pack_documents
from rowforge.llm.pii import redact
from rowforge.llm.quality_rules import score_rules
from rowforge.llm.storage import drop_stored, stored


def _named_apart(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], list]:
    """``docs`` with all columns but the id under names that no operator adds, these names, and the columns as they were."""
    rest = [c for c in docs.columns if c != "doc_id"]
    back = [F.col(c if c == "doc_id" else f"own_{c}").alias(c) for c in docs.columns]
    return docs.withColumnsRenamed({c: f"own_{c}" for c in rest}), tuple(f"own_{c}" for c in rest), back


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the compression classifier predicts to be good.

    Rows are judged each by their text, repeated ones and null ids too; null
    and empty texts score like an empty text.  An empty table stays empty.
    Like all stages but the last, this one returns the columns of ``docs``,
    further ones included.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own, rest, back = _named_apart(docs)
    return score_quality(own, labels, text_col="own_text", keep=rest).where("predicted = 1").select(*back)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the perplexity band of their language.

    Null and empty texts have no words and go.  Rows are judged each,
    repeated ones and null ids too; null languages are judged by the model
    that fits best.  An empty table stays empty.
    """
    own, rest, back = _named_apart(docs)
    return score_rules(own, text_col="own_text", lang_col="own_lang", keep=rest).where("kept").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (words of five, similarity 0.8): the one with the smallest id.

    A document here is an id with its text: rows that share both are one (the
    smallest by the text of its other columns stays), rows that share an id but not a
    text are judged apart.  A null id comes after all others, so that its row
    goes if another of its group has an id.  Texts without words are linked
    with nothing and stay.  An empty table stays empty.  Texts are shuffled
    once, copies of a row put together before.
    """
    by_row = F.struct(F.col("doc_id").isNull().alias("without_id"), F.col("doc_id"), F.xxhash64("text").alias("hash"))
    keyed = docs.select(by_row.alias("rowforge_row"), *docs.columns)
    groups = near_groups(keyed, id_col="rowforge_row")
    kept = groups.where("kept").select(F.col("rowforge_row").alias("key")).distinct()
    # as text, since columns of any type can be told apart so
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("rowforge_none")))
    single = keyed.groupBy("rowforge_row").agg(F.min_by(F.struct(*docs.columns), others).alias("row"))
    return single.join(kept.hint("merge"), F.col("rowforge_row") == F.col("key"), "left_semi").select("row.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind and counts the characters anew.

    Every row stays; null and empty texts as they are.
    """
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; every row, null ids and empty texts too, repeated ones each."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: packing by tokens and the classifier cannot be expressed in SQL; tests/llm/test_pipeline.py tests the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage wrote goes once the next one has written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), False
    for k, (name, stage) in enumerate(STAGES):
        before = docs
        docs = stage(spark, before, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
            if written:
                drop_stored(before)
            written = True
    return docs
