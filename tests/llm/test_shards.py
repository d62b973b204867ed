"""The external shuffle against a plain rebuild of its order, and its laws on skewed tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import queries as Q
from tabsmith.llm import shards as S
from tabsmith.session import shared_path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, shard string, slot double, n long, bucket int, __shuffle_h int"


def table(spark, rows, parts=3):
    """A stored table (its rows keep their places) with columns whose names clash with the operator's."""
    path = shared_path(spark, "shard-test")
    spark.createDataFrame([(*r, "s", 0.5, 7, 1, 2) for r in rows], SCHEMA).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def check_law(rows, shard, slot, shards):
    sizes = Counter(r[shard] for r in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r[slot] for r in rows if r[shard] == s) == list(range(counts[s]))


ROWS = [(i, f"text {i} " + "x" * (i % 400)) for i in range(600)] + [(None, None), (None, "null key"), (5, None), (6, ""), (7, "é" * 50)]
HOT = ROWS + [(7, f"hot {i} " + "y" * 100) for i in range(400)] + [(8, "the same row")] * 400 + [(9, "z" * 300_000)]


@pytest.mark.parametrize("rows", [ROWS, HOT, ROWS[:5], []])
@pytest.mark.parametrize("bucket_bytes", [4_000, 16 << 20])
def test_law_and_whole_rows(spark, rows, bucket_bytes):
    docs = table(spark, rows)
    out = S.shard(docs, shared_path(spark, "shards"), 16, bucket_bytes=bucket_bytes)
    assert set(out.columns) == {*docs.columns, "shard_", "slot_"}
    got = out.collect()
    check_law(got, "shard_", "slot_", 16)
    assert Counter((r.doc_id, r.text, r.shard, r.slot, r.n, r.bucket) for r in got) == \
        Counter((*r, "s", 0.5, 7, 1) for r in rows)


def test_order_is_that_of_a_plain_shuffle_and_free_of_layout(spark):
    a, b = table(spark, ROWS, 1), table(spark, ROWS[::-1], 7)
    got = [{(r.doc_id, r.text): (r.shard_, r.slot_) for r in S.shard(d, shared_path(spark, "shards"), 16, bucket_bytes=4_000).collect()}
           for d in (a, b)]
    assert got[0] == got[1]
    bits, large = S.bucket_plan(a, S.SEED, "doc_id", "text", 4_000)
    assert large.isEmpty() and bits > 3
    keys = a.select("doc_id", "text", F.xxhash64(F.lit(S.SEED), "doc_id").alias("h"),
                    F.xxhash64(F.lit(S.SEED + 2), "doc_id", "text").alias("o")).collect()
    place = 0
    for bucket in range(1 << bits):
        rows = sorted((r for r in keys if (r.h % 2**64) >> (64 - bits) == bucket), key=lambda r: r.o)
        for j in np.random.Generator(np.random.PCG64([S.SEED, bucket])).permutation(len(rows)):
            shard = place * 16 // len(keys)
            assert got[0][rows[j].doc_id, rows[j].text] == (shard, place - -(-shard * len(keys) // 16))
            place += 1


def test_hot_rows_are_split_and_spread(spark):
    docs = table(spark, HOT)
    bits, large = S.bucket_plan(docs, S.SEED, "doc_id", "text", 4_000)
    assert not large.isEmpty()
    rows = S.dealt(docs, bits, large, S.SEED, "doc_id", "text", "__x_")
    most = rows.where("doc_id = 7").groupBy("__x_bucket").count().agg(F.max("count")).first()[0]
    assert most < 60
    got = S.shard(docs, shared_path(spark, "shards"), 4, bucket_bytes=4_000)
    same = Counter(r.shard_ for r in got.where("text = 'the same row'").collect())
    assert sum(same.values()) == 400


def test_counts_that_change_are_noticed(spark):
    key = F.udf(lambda: random.randrange(1000), "long").asNondeterministic()
    docs = table(spark, ROWS).withColumn("doc_id", key())
    with pytest.raises(Exception, match="same rows each time"):
        S.shard(docs, shared_path(spark, "shards"), 4, bucket_bytes=4_000).count()


def test_given_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = Q.op13_external_shuffle(spark, SMALL).collect()
    check_law(got, "shard", "slot", 16)
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == \
        {k: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for k, t in docs.items()}
