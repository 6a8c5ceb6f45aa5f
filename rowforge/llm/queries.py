"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowforge.llm import collocations, preference_format, sharding, warc
from rowforge.llm.alignment import align_tokens
from rowforge.llm.compression_quality import score_quality
from rowforge.llm.exact_topk import exact_topk
from rowforge.llm.near_dedup import near_groups
from rowforge.llm.packing import pack_documents
from rowforge.llm.piece_codec import encode_decode
from rowforge.llm.pii import pii_report
from rowforge.llm.quality_rules import score_rules
from rowforge.llm.token_counts import count_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), limit=sharding.LIMIT_BYTES)


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format.format_exchanged(_table(spark, sf_dir, "conversations"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), words=3, similar=85)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rules(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(_table(spark, sf_dir, "documents"))


def op13_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_codec": op1_piece_codec,
    "op2_packing": op2_packing,
    "op3_sharding": op3_sharding,
    "op4_pii": op4_pii,
    "op5_exact_topk": op5_exact_topk,
    "op6_preference_format": op6_preference_format,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_token_alignment": op11_token_alignment,
    "op12_collocations": op12_collocations,
    "op13_warc_captures": op13_warc_captures,
}

ORACLES: dict[str, str] = {
    "op3_sharding": sharding.ORACLE,
    "op6_preference_format": preference_format.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_warc_captures": warc.ORACLE,
}
