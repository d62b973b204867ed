"""Distributed helpers against plain pandas/numpy answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsmith.functions.aggregates import modes, student_t_sf2
from tabsmith.functions.cumulative import running_sums, top_k_per_group
from tabsmith.functions.quantiles import exact_quantiles, order_statistics


def _frame(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "v": rng.normal(size=n).round(3),
                        "w": rng.integers(0, 20, n).astype(float)})
    return spark.createDataFrame(pdf), pdf


def test_running_sums_match_cumsum(spark):
    df, pdf = _frame(spark)
    agg = pdf.groupby(["g", "v"], as_index=False).agg(n=("w", "size"))
    sdf = spark.createDataFrame(agg)
    out = running_sums(sdf, "v", ["n"], part_cols=["g"], buckets=7).toPandas().sort_values(["g", "v"])
    exp = agg.sort_values(["g", "v"]).groupby("g")["n"].cumsum().to_numpy()
    assert (out["cum_n"].to_numpy() == exp).all()


def test_running_sums_without_parts(spark):
    df, pdf = _frame(spark)
    agg = pdf.groupby("v", as_index=False).agg(n=("w", "sum"))
    out = running_sums(spark.createDataFrame(agg), "v", ["n"], buckets=5).toPandas().sort_values("v")
    assert np.allclose(out["cum_n"].to_numpy(), agg.sort_values("v")["n"].cumsum().to_numpy())


PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def test_exact_quantiles_equal_pandas(spark):
    df, pdf = _frame(spark)
    got = exact_quantiles(df, ["v", "w"], PROBS)
    for col in ["v", "w"]:
        assert np.allclose(got[col], pdf[col].quantile(PROBS).to_numpy())


def test_exact_quantiles_all_null(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "x double, y int")
    assert exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [None], "y": [1.5]}
    assert exact_quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}


def test_exact_quantiles_of_hard_values(spark):
    """Values that differ in their last bits, both signs, subnormal, huge and infinite ones, many columns of unlike size."""
    rng = np.random.default_rng(3)
    close = np.nextafter(1.0, 2.0) + np.arange(997) * np.finfo(float).eps
    wild = np.concatenate([rng.standard_normal(500) * 10.0 ** rng.integers(-300, 300, 500), [5e-324, -5e-324, 0.0, -0.0, 1e308, -1e308],
                           np.repeat(7.25, 491)])
    pdf = pd.DataFrame({"close": rng.permutation(close), "wild": rng.permutation(wild), "same": 3.0, "k": np.arange(997.0)})
    df = spark.createDataFrame(pdf).repartition(5)
    df = df.withColumn("gap", F.when(F.col("k") > 990, F.col("k"))).withColumn("edge", F.when(F.col("k") > 900, float("inf")).otherwise(F.col("k")))
    pdf["gap"] = pdf["k"].where(pdf["k"] > 990)
    got = exact_quantiles(df, ["close", "wild", "same", "k", "gap", "edge"], PROBS)
    for col in ["close", "wild", "same", "k", "gap"]:
        values = np.sort(pdf[col].dropna().to_numpy())
        want = []
        for p in PROBS:
            h = (len(values) - 1) * p
            lo, hi = values[int(np.floor(h))], values[int(np.ceil(h))]
            want.append(lo if lo == hi else lo + (h - np.floor(h)) * (hi - lo))
        assert got[col] == want, col
    assert got["edge"][3] == 498.0 and got["edge"][-1] == float("inf")


def test_exact_quantiles_whatever_the_levels(spark, monkeypatch):
    from tabsmith.functions import quantiles
    df, pdf = _frame(spark)
    want = exact_quantiles(df, ["v", "w"], PROBS)
    for digits in ((4, 12, 16, 16, 16), (64,), (30, 34)):
        monkeypatch.setattr(quantiles, "DIGITS", digits)
        assert exact_quantiles(df, ["v", "w"], PROBS) == want


def test_order_statistics(spark):
    df, pdf = _frame(spark)
    got = order_statistics(df, "v", "g", [(0, 0), (1, 5), (2, 10)])
    for g, k in [(0, 0), (1, 5), (2, 10)]:
        assert got[(g, k)] == sorted(pdf[pdf.g == g]["v"])[k]


def test_top_k_per_group_matches_full_sort(spark):
    df, pdf = _frame(spark, 2000)
    out = top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("w").asc()], 5, spread=8).toPandas()
    for g, part in pdf.groupby("g"):
        exp = part.sort_values(["v", "w"], ascending=[False, True]).head(5)["v"].tolist()
        assert out[out.g == g].sort_values("rank")["v"].tolist() == exp


def test_modes_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "x string")
    assert modes(df, ["x"]).first()["mode"] == "a"


def test_level_counts_exact_near_limit(spark):
    from tabsmith.functions.aggregates import level_counts
    rows = [(i % 14, i % 16, str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, big string")
    got = level_counts(df, ["a", "b", "big"], 15)
    assert got["a"] == 14 and got["b"] == 16  # decided exactly on both sides of the limit
    assert got["big"] > 15


def test_distinct_counts_and_estimates(spark):
    from tabsmith.operators import profile as P
    rows = [(i % 2, i % 15, i, str(i % 997)) for i in range(2000)]
    df = spark.createDataFrame(rows, "two int, fifteen int, ident long, text string")
    exact = {r["column"]: r["n_unique"] for r in P.distinct_counts(df).collect()}
    assert exact == {"two": 2, "fifteen": 15, "ident": 2000, "text": 997}
    close = {r["column"]: r["n_unique_estimate"] for r in P.approx_distinct_counts(df).collect()}
    assert all(abs(close[k] - v) <= 0.1 * v + 1 for k, v in exact.items())


def test_student_t_matches_known_values():
    # two-sided p for t=2.0 with 10 dof is 0.0734; t=1.09, 3 dof -> about 0.355
    assert abs(student_t_sf2(2.0, 10) - 0.07339) < 1e-4
    assert abs(student_t_sf2(1.09, 3) - 0.3555) < 2e-3


def test_overlap_keys_keep_nulls_and_zeros_apart(spark):
    from tabsmith.operators import audit as H
    train = spark.createDataFrame([("a", None, 0.0), (None, "a", 1.0), ("b", "b", float("nan"))], "x string, y string, z double")
    test = spark.createDataFrame([(None, "a", 0.0), ("a", None, -0.0), ("b", "b", float("nan")), ("b", "b", None)], "x string, y string, z double")
    out = {r["gate"]: r["observed"] for r in H.audit_overlap(train, test, ["x", "y", "z"]).collect()}
    assert out["test_rows_seen_in_train"] == 2


def test_dense_ranks_follow_the_order_whatever_the_partitions(spark):
    from tabsmith.functions.cumulative import dense_ranks
    words = [f"é{i * 7919 % 5000}" for i in range(5000)] + ["", "Z", "a", "zz"]
    ranked, n = dense_ranks(spark.createDataFrame([(w,) for w in words], "_k string").repartition(7), ["_k"])
    assert n == len(words) and {r["_k"]: r["_code"] for r in ranked.collect()} == {w: i for i, w in enumerate(sorted(words))}
    empty, n = dense_ranks(spark.createDataFrame([], "_k string"), ["_k"])
    assert n == 0 and empty.count() == 0


def test_codes_of_many_levels(spark):
    from tabsmith.operators import clean as C
    from tabsmith.operators import profile as P
    df = spark.range(24_000).selectExpr("id", "concat('v', lpad(id % 12000, 6, '0')) as t").unionByName(
        spark.createDataFrame([(24_000, None)], "id long, t string"))
    got = P.target_codes(df, "t").where("id in (0, 11999, 12005, 24000)").orderBy("id").collect()
    assert [r["t"] for r in got] == [0.0, 11999.0, 5.0, None]
    first = P.target_codes(df.where("id < 12000"), "t", order="first", order_col="id").where("id <> t")
    assert first.count() == 0
    enc = C.LabelEncoder(cols=["t"]).fit(df).transform(df).where("id in (3, 24000)").orderBy("id").collect()
    assert [r["t"] for r in enc] == [3, 12000]


def test_term_counts_of_batches_equal_a_count():
    import pyarrow as pa
    from collections import Counter
    from tabsmith.functions.terms import batch_term_counts
    texts = [["a", "b", "a"], [], ["b"], ["c", "a", "c", "c"], []]
    column = pa.array([["x", "y"], *texts], pa.list_(pa.string()))
    whole = pa.record_batch([column.slice(1)], names=["tokens"])  # a slice: offsets don't start at 0
    none = pa.record_batch([pa.array([[], []], pa.list_(pa.string()))], names=["tokens"])
    total, df = Counter(w for t in texts for w in t), Counter(w for t in texts for w in set(t))
    (got,) = batch_term_counts(iter([whole, none]))
    assert {r["term"]: (r["total"], r["df"]) for r in got.to_pylist()} == {w: (total[w], df[w]) for w in total}


def test_tfidf_fit_without_terms(spark):
    from tabsmith.operators.features import TfidfFeatures
    for rows in ([], [(None,), ("",), ("a . b",)]):
        tf = TfidfFeatures(col="text", min_df=1).fit(spark.createDataFrame(rows, "text string"))
        assert tf.vocab == []
