"""Exact top-k and cross-polytope search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import ann, queries as Q, topk

MEDIUM = "/root/testdata/sf0.01"

ODD = [(900, None), (901, [None, 1.0]), (902, [float("nan"), 1.0]), (903, [float("inf"), 0.0]), (None, [1.0, 1.0]), (950, [0.0, 0.0])]


def vectors(n=300, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 3:2 * n // 3] = x[0]  # a third of all rows is one vector
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, id string, v double")


def padded(rows):
    d = max(len(v) for _, v in rows)
    return np.array([v + [0.0] * (d - len(v)) for _, v in rows])


def brute(rows, every, k, quantise):
    x = padded(rows)
    x = np.floor(256 * x).astype(np.int64) if quantise else x
    ids = np.array([i for i, _ in rows])
    out = set()
    for a in np.flatnonzero(ids % every == 0):
        s = x @ x[a]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[a]][:k]
        out |= {(int(ids[a]), r + 1, int(ids[j]), int(s[j]) if quantise else round(float(s[j]), 9)) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("block,shard", [(4, 3), (64, 64)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SHARD_BLOCKS", shard)
    rows = [*vectors(), (950, [0.0, 0.0]), (951, [1.0]), (1000, [])]
    got = topk.top_k(frame(spark, rows + ODD[:5]), F.col("vec_id") % 10 == 0, 5).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows, 10, 5, True)


def test_repeated_query_rows_have_lists_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "SHARD_BLOCKS", 3)
    rows = [(i, v) for i, v in vectors(120) if i % 50 or not i]
    for second in (rows[0][1], rows[5][1]):  # the same vector again, another one
        got = topk.top_k(frame(spark, [*rows, (0, second)]), F.col("vec_id") == 0, 5).collect()
        want = [x for v in (rows[0][1], second) for x in brute([(0, v), *rows[1:]], 50, 5, True)]
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_small_tables(spark):
    assert topk.top_k(frame(spark, ODD[:5]), F.col("vec_id") % 10 == 0, 5).count() == 0
    assert topk.top_k(frame(spark, [(0, [1.0])]), F.col("vec_id") % 10 == 0, 5).count() == 0
    got = topk.top_k(frame(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])]), F.col("vec_id") % 10 == 0, 5).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 131072), (0, 2, 2, 131072)]


def test_large_integers_stay_exact(spark):
    rows = [(i, [2.0 ** 22 + i, 1.0]) for i in range(6)]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, 3).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows, 5, 3, True)


def test_neighbours_ties_and_edges(spark):
    rows = vectors()
    got = ann.neighbours(frame(spark, rows + ODD), F.col("vec_id") % 10 == 0, 20).collect()
    found = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got}
    want = brute(rows, 10, 20, False)
    assert len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    x = padded(rows)
    assert all(abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12 for r in got)
    for q in {r.query_id for r in got}:
        listed = sorted((r["rank"], -r.score, r.vec_id) for r in got if r.query_id == q)
        assert [x[1:] for x in listed] == sorted(x[1:] for x in listed)  # ties by id
        copies = [v for _, _, v in listed if 100 <= v < 200]
        assert copies == [v for v in range(100, 200) if v != q][:len(copies)]  # of equal vectors the smaller ids
    assert ann.neighbours(frame(spark, ODD), F.col("vec_id") % 10 == 0, 20).count() == 0


def hits(spark, rows, every=50, k=20):
    """(found, wanted, of those found) of the lists against brute force."""
    got = ann.neighbours(frame(spark, rows), F.col("vec_id") % every == 0, k).collect()
    want = brute(rows, every, k, False)
    return len(got), len(want), len({(r.query_id, r.vec_id) for r in got} & {(q, v) for q, _, v, _ in want})


@pytest.mark.parametrize("n", [2, 7, 20, 21])
def test_lists_of_small_tables_are_whole(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got, want, hit = hits(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)], every=1)
    assert got == want == hit == n * min(n - 1, 20)


@pytest.mark.parametrize("lengths", ["one", "lognormal"])
def test_recall_with_uneven_lengths(spark, lengths):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths == "one":
        x[7] *= 100
    else:
        x *= np.exp(rng.normal(size=2000))[:, None]
    got, want, hit = hits(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])
    assert got == want and hit >= 0.9 * want


def test_copies_of_rows_fill_no_list(spark):
    x = np.random.default_rng(6).normal(size=(40, 8))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = ann.neighbours(frame(spark, rows + rows[1:2] * 30), F.col("vec_id") % 40 == 0, 20).collect()
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got} == brute(rows, 40, 20, False)


def test_recall_on_the_given_table(spark):
    got = Q.op6_cross_polytope_ann(spark, MEDIUM).collect()
    e = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").orderBy("vec_id").collect()
    want = brute([(r.vec_id, [float(v) for v in r.embedding]) for r in e], 20, 20, False)
    hit = {(r.query_id, r.vec_id) for r in got} & {(q, v) for q, _, v, _ in want}
    assert len(got) == len(want) and len(hit) >= 0.9 * len(want)


def test_op2_on_the_given_table(spark):
    got = Q.op2_exact_topk(spark, MEDIUM).collect()
    e = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute([(r.vec_id, [float(v) for v in r.embedding]) for r in e], 50, 5, True)
