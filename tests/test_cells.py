"""Boosted fits on cells give what fits on their rows give, from fewer rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tabsmith.operators import cells as CE
from tabsmith.operators import models as M
from tabsmith.session import shared_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(3000):
        a, b, x = int(rng.integers(0, 6)), int(rng.integers(0, 4)), float(rng.normal())
        out.append((i, float(a), float(b), round(x, 1), "pqr"[i % 3], int(a * b + x + rng.normal() > 6), a * b + 2 * x + rng.normal(), 1.0 + i % 2))
    return spark.createDataFrame(out, "id int, a double, b double, x double, s string, yes int, y double, w double").repartition(3).persist()


def plain(df, t, learner, weight=None):
    """The same pipeline with MLlib's learner on the rows."""
    return Pipeline(stages=M.build_preprocessor(["a", "b", "x"], ["s"]) + [learner]).fit(df)


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("t,name,ptype", [("yes", "GBTClassifier", "binary_classification"), ("y", "GBTRegressor", "regression")])
def test_fits_on_cells_equal_fits_on_rows(rows, monkeypatch, t, name, ptype, weight):
    df = rows.select("id", "a", "b", "x", "s", t, "w") if weight else rows.select("id", "a", "b", "x", "s", t)
    taken, real = [], CE.cells_of
    monkeypatch.setattr(CE, "cells_of", lambda *a, **k: taken.append(real(*a, **k)) or taken[-1])
    counted, unpersist = [], CE.weighted
    monkeypatch.setattr(CE, "weighted", lambda x: counted.append(taken[-1].count()) or unpersist(x))
    params = {"maxIter": 6, "maxDepth": 4, "stepSize": 0.2}
    got = M.model_pipeline(df, t, name, ptype, params, weight=weight, exclude="id").fit(df)
    kind = GBTRegressor if ptype == "regression" else GBTClassifier
    learner = kind(labelCol=t, seed=42, **params, **({"weightCol": weight} if weight else {}))
    want = plain(df, t, learner)
    both = got.transform(df).select("id", F.col("prediction").alias("p")).join(want.transform(df).select("id", "prediction"), "id")
    assert both.where("abs(p - prediction) > 1e-9").count() == 0
    assert counted and counted[0] < 2000 < df.count()


def test_cells_keep_all_weight_and_the_mean(rows):
    df = rows.select(M.F.lit(1).alias("one"), "a", "b", "y", "w")
    made = Pipeline(stages=M.build_preprocessor(["a", "b"], [], intervals="features")).fit(df).transform(df)
    cells = CE.cells_of(made, "y", True, "w")
    assert cells.count() == 24
    got, want = cells.agg(F.sum(CE.WEIGHT), F.sum(F.col("y") * F.col(CE.WEIGHT))).first(), df.agg(F.sum("w"), F.sum(F.col("y") * F.col("w"))).first()
    assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-6


def test_cuts_of_many_values_part_the_rows_evenly(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("x"), F.lit(2.0).alias("same"), F.lit(1.0).alias(CE.WEIGHT),
                                  F.when(F.col("id") == 3, None).otherwise(1.0 * F.col("id")).alias("open"))
    exact = CE.candidate_cuts(df, ["x", "same", "open"])
    assert exact["same"] == exact["open"] == [] and len(exact["x"]) == 31
    monkeypatch.setattr(CE, "VALUES", 100)
    ranged = CE.candidate_cuts(df, ["x"])["x"]
    assert len(ranged) == 31 and max(abs(a - b) for a, b in zip(exact["x"], ranged)) < 10


def test_stride_cuts_follow_the_rule():
    assert CE.stride_cuts([(0.0, 0.0, 5.0), (2.0, 2.0, 1.0)]) == [1.0]
    assert CE.stride_cuts([(float(i), float(i), 1.0) for i in range(8)], bins=4) == [1.5, 3.5, 5.5]


def test_null_labels_are_refused_as_before(rows):
    df = rows.select("a", F.when(F.col("id") > 5, F.col("y")).alias("y"))
    with pytest.raises(Exception, match="(?i)label"):
        M.model_pipeline(df, "y", "GBTRegressor", "regression", {"maxIter": 2}).fit(df)


def test_numbers_that_are_missing_are_refused_as_before(rows):
    df = rows.select("a", F.when(F.col("id") > 5, F.col("b")).alias("b"), "y")
    with pytest.raises(Exception, match="NaN or Infinity"):
        M.model_pipeline(df, "y", "GBTRegressor", "regression", {"maxIter": 2}).fit(df)


def test_saved_boosted_pipelines_score_alike(rows):
    df = rows.select("id", "a", "b", "x", "s", "yes")
    model = M.model_pipeline(df, "yes", "XGBClassifier", "binary_classification", {"maxIter": 3, "maxDepth": 3}, exclude="id").fit(df)
    path = shared_path(df.sparkSession, "boosted")
    M.save_pipeline(model, path)
    scored = M.score(df, path).select("id", "score").join(model.transform(df).select("id", M.vector_to_array("probability")[1].alias("p")), "id")
    assert scored.where("abs(score - p) > 1e-12 OR p IS NULL").count() == 0
    assert {r["feature"] for r in M.feature_importance(model).collect()} == {"a", "b", "x", "s_p", "s_q", "s_r"}


def test_learners_that_are_one_estimator_share_fits(rows, monkeypatch):
    df = rows.select("id", "a", "b", "x", "yes")
    fits, real = [], M.make_model
    monkeypatch.setattr(M, "make_model", lambda name, *a, **k: fits.append(name) or real(name, *a, **k))
    grid = {"maxIter": [2, 3], "maxDepth": [2], "stepSize": [0.1]}
    names = ["XGBClassifier", "LGBMClassifier"]
    both = M.tune_many(df, "yes", names, "binary_classification", folds=2, grids=dict.fromkeys(names, grid), key="id")
    assert len(fits) == 2  # one for each fold
    alone = M.tune(df, "yes", "LGBMClassifier", "binary_classification", folds=2, grid=grid, key="id")
    assert [x[0] for x in both] == [alone[0]] * 2
    assert all({tuple(r) for r in x[1].collect()} == {tuple(r) for r in alone[1].collect()} for x in both)
