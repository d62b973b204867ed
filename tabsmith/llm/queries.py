"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, binrec, bpe, jaccard, license_scan, mix, periodic, quality, secret_scan, shards, tokencount, topk
from . import common as C

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FREE_ID = 50256  # the id that the rank file leaves free


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(C.table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(C.table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN, FREE_ID)


def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = C.shared_uri(spark, "records")
    return binrec.read(binrec.write(C.table(spark, sf_dir, "documents"), WORD_BPE, uri), uri)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.taken(C.table(spark, sf_dir, "documents"))


def op6_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(C.table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(C.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(C.table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(C.table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE, groups=False)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(C.table(spark, sf_dir, "documents"))


def op13_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.placed(C.table(spark, sf_dir, "documents"))


Q = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_topk": op2_exact_topk,
    "op3_token_counts": op3_token_counts,
    "op4_binary_records": op4_binary_records,
    "op5_source_mix": op5_source_mix,
    "op6_cross_polytope_ann": op6_cross_polytope_ann,
    "op7_bpe_encode_decode": op7_bpe_encode_decode,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_secret_scan": op10_secret_scan,
    "op11_token_alignment": op11_token_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_external_shuffle": op13_external_shuffle,
}
SQL: dict[str, str] = {"op5_source_mix": mix.ORACLE}
