"""Queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cashweave.llm import (
    byte_bpe, divergence, embed_dup, language_id, mixing, near_dup, pii, quality_model, quality_rules, secret_scan, spelling,
    token_store, warc)
from cashweave.llm.common import scratch, table

#: id that ends a document in the token store.
END_ID = 2
#: Key of the surrogates in these queries over synthetic data; a real corpus needs a secret one.
PII_KEY = b"synthetic corpus"


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path, END_ID)
    return token_store.read_documents(spark, path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    index = warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(index, path, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dup.similar_vectors(table(spark, sf_dir, "embeddings"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digests(byte_bpe.encode(docs, tokenizer("byte_bpe_50k.tiktoken"), pattern()))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.per_document(mixing.mix(table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.classify(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_quality_model, op2_quality_rules, op3_secret_scan, op4_near_dup, op5_token_store, op6_warc, op7_embedding_dup,
        op8_byte_bpe, op9_mixing, op10_pii, op11_language_id, op12_source_divergence, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.ORACLE_SQL, "op3_secret_scan": secret_scan.ORACLE_SQL,
            "op12_source_divergence": divergence.ORACLE_SQL}
