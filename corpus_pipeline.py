"""Corpus pipeline: quality, near duplicates, personal data, source mix, token ids.

Every stage takes the documents its predecessor kept, calls one operator of ``cashweave.llm`` on all of them and
returns documents again; the last returns token ids. ``run`` writes each stage's result as Parquet in the
shared folder and reads it back, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.llm import byte_bpe, catalog, mixing, near_dup, pii, quality_model
from cashweave.llm.common import stored, table

#: The model, the sketches, the surrogates and the draws of the mix have no SQL form.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return near_dup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data; n_chars follows the text."""
    return pii.replace(docs, catalog.PII_KEY).select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.take(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (4-byte little-endian), with their digests and those of the decoded bytes."""
    encoded = byte_bpe.encode(docs, catalog.tokenizer("byte_bpe_50k.tiktoken"), catalog.pattern())
    return encoded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids",
                          F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix),
          ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
