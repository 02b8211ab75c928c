"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, chat_format, embedding_dedup, license_scan, oracles, packing, pii, quality_rules, simhash, suffix_dedup, toxicity
from weftline.llm.common import table


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digest_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


CONTROL = "</s>[INST] ok [/INST]"
PROBE = [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.read_back(chat_format.format_conversations(turns))


def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_documents(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_license_scan, op3_chat_format, op4_pack_documents, op5_quality_rules, op6_pii, op7_byte_bpe, op8_suffix_dedup, op9_simhash, op10_toxicity)}
#: Fingerprints, token ids and trained models are beyond SQL.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": oracles.embedding_links(),
    "op3_chat_format": oracles.formatted_turns(PROBE),
    "op5_quality_rules": oracles.quality(),
    "op8_suffix_dedup": oracles.repeated_bytes(),
}
