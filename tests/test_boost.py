"""Boosted fits on shared passes give MLlib's trees, in one job for all fits of a level."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import boost as B
from tabsmith.operators import models as M
from tabsmith.operators import split as E


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(2500):
        a, b, x = int(rng.integers(0, 6)), int(rng.integers(0, 4)), float(rng.normal())
        out.append((i, float(a), float(b), round(x, 1), 5.0, "pqr"[i % 3], int(a * b + x + rng.normal() > 6), a * b + 2 * x + float(rng.normal())))
    return spark.createDataFrame(out, "id int, a double, b double, x double, same double, s string, yes int, y double").repartition(3).persist()


CASES = [("yes", "GBTClassifier", "binary_classification", "roc_auc"), ("yes", "LGBMClassifier", "binary_classification", "f1_binary"),
         ("y", "GBTRegressor", "regression", "rmse")]


@pytest.mark.parametrize("t,name,ptype,metric", CASES)
def test_shared_fits_score_as_mllibs(rows, monkeypatch, t, name, ptype, metric):
    df = rows.select("id", "a", "b", "x", "same", "s", t)
    draws = [{"maxIter": n, "maxDepth": d, "stepSize": r} for n, d, r in ((2, 3, 0.2), (6, 3, 0.2), (4, 5, 0.1), (1, 1, 0.3))]
    got = M.fold_scores(df, t, [(name, draws)], ptype, 3, metric, key="id")[0]
    monkeypatch.setattr(B, "can_share", lambda learner: False)
    want = M.fold_scores(df, t, [(name, draws)], ptype, 3, metric, key="id")[0]
    for a, b in zip(got, want):
        assert a.keys() == b.keys() == {0, 1, 2} and all(abs(a[f] - b[f]) < 1e-9 for f in a), (got, want)


def test_predictions_are_mllibs_however_cells_are_dealt(rows, monkeypatch):
    monkeypatch.setattr(B, "KEEP_EVERY", 2)
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    monkeypatch.setattr(B, "FEW_TASKS", 2)
    for t, name, ptype in (("yes", "GBTClassifier", "binary_classification"), ("y", "GBTRegressor", "regression")):
        df = E.add_fold(rows.select("id", "a", "b", "x", "s", t), 2, None, 42, "id").persist()
        fold = M.encoded_folds(df, t, 2, "id", None, ptype)[0]
        learner = M.make_model(name, ptype, t, fold.n, {"maxIter": 7, "maxDepth": 4, "stepSize": 0.2})
        fit = B.fit_of(learner, 0)
        B.fit_all([(fold.cells, ptype != "regression")], t, [fit], [1 << 20], 1 << 18)  # dealt as a larger table would be
        model = M.CE.weighted(learner).fit(fold.cells)
        test = M.interval_rows(fold.test)
        got = sorted(r["p0"] for r in B.staged_predictions(test, t, fit, [7]).collect())
        column = F.col("prediction") if ptype == "regression" else M.vector_to_array("rawPrediction")[1]
        want = sorted(r["p"] for r in model.transform(test).select(column.alias("p")).collect())
        assert len(got) == len(want) > 1000
        # added up in another order than MLlib's one part, a near tie may fall otherwise; it moves few rows
        assert (np.abs(np.array(got) - np.array(want)) < 1e-9).mean() > 0.9


def test_fits_share_their_passes(rows, monkeypatch):
    passes, real = [], B._level_sums
    monkeypatch.setattr(B, "_level_sums", lambda state, open_, *a: passes.append(len(open_)) or real(state, open_, *a))
    monkeypatch.setattr(M, "ROWS_AT_SCALE", 200)  # as a larger table would be dealt
    df = rows.select("id", "a", "b", "x", "yes")
    draws = [{"maxIter": 3, "maxDepth": d, "stepSize": r} for d in (2, 3) for r in (0.1, 0.2)]
    M.fold_scores(df, "yes", [("GBTClassifier", draws)], "binary_classification", 3, key="id")
    assert len(passes) <= 3 * 2 + 3 * 3 and max(passes) == 6  # 3 rounds of 2 and of 3 levels, for 2 settings each in 3 folds


def test_what_mllib_refuses_is_refused_as_before(rows):
    df = rows.select("id", "a", F.when(F.col("id") > 5, F.col("b")).alias("b"), "y")
    with pytest.raises(Exception, match="NaN or Infinity"):
        M.cross_validate(df, "y", "GBTRegressor", "regression", 2, params={"maxIter": 2}, key="id")
