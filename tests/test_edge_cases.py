"""Hand-written frames for edge cases: all-null, constant, one class, ties, NaN vs NULL, sentinels."""

import math

import pytest
from pyspark.sql import functions as F

from tabsmith.functions.exprs import nan_to_null
from tabsmith.operators import clean as C
from tabsmith.operators import features as FE
from tabsmith.operators import metrics as G
from tabsmith.operators import profile as P
from tabsmith.plans import rules as R


def test_null_counts_treat_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    got = {r["column"]: r["n_missing"] for r in P.null_counts(df).collect()}
    assert got == {"x": 2, "s": 1}


def test_nan_to_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert df.where(F.col("x").isNull()).count() == 1


def test_distinct_counts_all_null_and_constant(spark):
    df = spark.createDataFrame([(None, 1), (None, 1)], "a string, b int")
    got = {r["column"]: r["n_unique"] for r in P.distinct_counts(df).collect()}
    assert got == {"a": 0, "b": 1}


def test_skew_needs_three_values_and_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    got = {r["column"]: r["skew"] for r in P.skewness_table(df).collect()}
    assert got == {"a": None, "b": None}


def test_skew_is_bias_corrected(spark):
    vals = [1.0, 2.0, 3.0, 10.0, 50.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    import pandas as pd
    assert math.isclose(P.skewness_table(df).first()["skew"], pd.Series(vals).skew(), rel_tol=1e-9)


def test_one_class_target_is_an_error(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7), (1, 0.1)], "y int, x double")
    with pytest.raises(ValueError):
        R.build_plan(df, "y")


def test_imbalance_rounds_before_the_ladder(spark):
    # 51 : 348 -> 0.1466 -> rounded 0.15 -> class weights (not SMOTE), as the reference does
    rows = [(1,)] * 51 + [(0,)] * 348
    df = spark.createDataFrame(rows, "y int")
    r = R.imbalance_strategy(df, "y").first()
    assert r["ratio"] == 0.15 and r["strategy"] == "class_weight_balanced"


def test_numeric_sentinel_needs_share_and_non_negative_rest(spark):
    rows = [(999,)] * 10 + [(v,) for v in range(90)]
    df = spark.createDataFrame(rows, "x int")
    out = C.null_sentinels(df)
    assert out.where(F.col("x").isNull()).count() == 10
    neg = spark.createDataFrame([(999,)] * 10 + [(-5,)] + [(v,) for v in range(89)], "x int")
    assert C.null_sentinels(neg).where(F.col("x").isNull()).count() == 0


def test_string_sentinels_exact_match(spark):
    df = spark.createDataFrame([(" ?",), ("?",), (" ? ",), ("ok",)], "s string")
    out = [r["s"] for r in C.null_sentinels(df).collect()]
    assert out == [None, None, " ? ", "ok"]


def test_mode_imputer_unknown_when_all_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    assert {r["s"] for r in C.ModeImputer().fit(df).transform(df).collect()} == {"unknown"}


def test_imputer_bands(spark):
    rows = [(float(i) if i % 10 else None, float(i) if i % 50 else None, float(i) if i % 3 else None)
            for i in range(1, 101)]
    df = spark.createDataFrame(rows, "flag double, med double, gone double")
    fit = C.NumericImputer().fit(df)
    assert (fit.action("flag"), fit.action("med"), fit.action("gone")) == ("flag_median", "median", "drop")
    out = fit.transform(df)
    assert set(out.columns) == {"flag", "flag_was_missing", "med"}
    assert out.where(F.col("flag").isNull() | F.col("med").isNull()).count() == 0


def test_onehot_null_is_all_zero_and_refuses_many_levels(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    out = C.OneHot(cols=["s"], drop_first=False).fit(df).transform(df).collect()
    assert [(r["s_a"], r["s_b"]) for r in out] == [(1, 0), (0, 1), (0, 0)]
    many = spark.createDataFrame([(str(i),) for i in range(20)], "s string")
    with pytest.raises(ValueError):
        C.OneHot(cols=["s"]).fit(many)


def test_ordinal_unknown_is_minus_one(spark):
    df = spark.createDataFrame([("low",), ("high",), ("odd",), (None,)], "s string")
    out = [r["s"] for r in C.ordinal_encode(df, {"s": ["low", "high"]}).collect()]
    assert out == [0, 1, -1, -1]


def test_winsorizer_keeps_nulls(spark):
    df = spark.createDataFrame([(float(v),) for v in range(100)] + [(None,)], "x double")
    out = C.Winsorizer().fit(df).transform(df)
    assert out.where(F.col("x").isNull()).count() == 1
    assert out.agg(F.max("x")).first()[0] == pytest.approx(98.01)


def test_quantile_bins_merge_duplicate_edges(spark):
    vals = [0.0] * 60 + [1.0, 2.0, 3.0, 50.0, 100.0] * 8
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    qb = FE.QuantileBins(cols=["x"], min_skew=None).fit(df)
    assert qb.edges["x"][0] == 0.0 and len(qb.edges["x"]) == len(set(qb.edges["x"]))
    out = qb.transform(df)
    assert out.where(F.col("x") == 0.0).select("x_bin").distinct().collect()[0][0] == 0


def test_ratio_by_minus_one_is_null(spark):
    df = spark.createDataFrame([(1.0, -1.0), (4.0, 1.0)], "a double, b double")
    assert [r["r"] for r in FE.ratio_feature(df, "a", "b", "r").collect()] == [None, 2.0]


def test_sanitize_inf_and_strings(spark):
    df = spark.createDataFrame([(float("inf"), None), (1.0, "a"), (3.0, "b")], "x double, s string")
    out = FE.sanitize(df).collect()
    assert [r["x"] for r in out] == [2.0, 1.0, 3.0] and out[0]["s"] == "unknown"


def test_metrics_zero_division_and_ties(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (0, 0.5, 1), (1, 0.9, 1), (0, 0.1, 1)],
                               "label int, score double, prediction int")
    assert G.roc_auc(df).first()["value"] == pytest.approx(0.875)
    m = {r["metric"]: r["value"] for r in G.classification_metrics(df).collect()}
    assert m["precision_weighted"] == pytest.approx(0.25)  # class 0 is never predicted: precision 0


def test_drop_duplicates_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, s string")
    r = C.duplicate_count(df).first()
    assert (r["n_rows"], r["n_distinct"], r["n_duplicates"]) == (3, 2, 1)


def test_target_copies_of_many_values_are_flagged(spark):
    from tabsmith.operators import audit as H
    rows = [(i % 51, f"k{i % 51}", f"k{i % 50}", i % 102, i, f"k{i % 51}" if i % 51 else None, None) for i in range(510)]
    df = spark.createDataFrame(rows, "t int, copy string, merged string, finer int, unique int, gaps string, empty string")
    got = {r["column"]: (r["one_to_one"], r["flagged"]) for r in H.audit_target_copy(df, "t").collect()}
    assert got == {"copy": (True, True), "merged": (False, False), "finer": (False, False), "unique": (False, False),
                   "gaps": (False, False), "empty": (False, False)}
    many = spark.range(6000).selectExpr("id % 3000 as t", "concat('v', id % 3000) as copy", "id % 2999 as other")
    assert {r["column"]: r["flagged"] for r in H.audit_target_copy(many, "t").collect()} == {"copy": True, "other": False}
    alone = spark.range(20).selectExpr("id as t", "uuid() as x")
    assert not H.audit_target_copy(alone, "t").first()["one_to_one"]
    assert H.audit_target_copy(df.limit(0), "t").where("flagged").count() == 0
