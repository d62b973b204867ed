"""Corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's ``docs``. All but
the last return the columns of ``documents``:

1. quality: documents that the factorisation machine rejects go;
2. near_duplicates: one document of each Jaccard component stays (the smallest key);
3. secrets: confirmed secrets are masked in the text (no document goes);
4. mixing: every document as often as its source's target takes it;
5. tokens: BPE ids of every text, with digests of the ids and of their decoding.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import bpe, jaccard, mix, quality, secret_scan
from tabsmith.llm import common as C

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, C.table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, length_col="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, TOKENIZER).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: A fitted classifier can't be expressed in SQL; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
