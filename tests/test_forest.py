"""Forests grown on sums of draws: MLlib's trees on equal draws, every row drawn for every tree, MLlib's own fit on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tabsmith.operators import forest as FO
from tabsmith.operators import models as M
from tabsmith.session import shared_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(3000):
        a, b, x = float(rng.integers(0, 6)), float(rng.integers(0, 4)), round(float(rng.normal()), 2)
        y = a * b + 2 * x + float(rng.normal()) / 4
        out.append((i, a, b, x, 5.0, "pq"[i % 2], int(y > 5), y))
    return spark.createDataFrame(out, "id int, a double, b double, x double, same double, s string, yes int, y double").repartition(3).persist()


@pytest.fixture
def fitted_rows(monkeypatch):
    """Tables of more than 100 rows are grown here; says how many rows MLlib's forests are fitted on."""
    monkeypatch.setattr(FO, "ROWS_ALONE", 100)
    seen = []
    for kind in FO.FORESTS:
        monkeypatch.setattr(kind, "_fit", lambda self, df, real=kind._fit: seen.append(df.count()) or real(self, df))
    return seen


CASES = [("y", "RandomForestRegressor", "regression", "r2"), ("yes", "RandomForestClassifier", "binary_classification", "roc_auc")]


@pytest.mark.parametrize("t,name,ptype,metric", CASES)
def test_large_forests_are_not_fitted_on_rows_and_score_alike(rows, fitted_rows, monkeypatch, t, name, ptype, metric):
    monkeypatch.setattr(FO, "ROWS_A_PART", 700)
    monkeypatch.setattr(FO, "HEAVY", 3)
    df, params = rows.select("id", "a", "b", "x", "same", "s", t), {"numTrees": 30, "maxDepth": 6}
    model = M.model_pipeline(df, t, name, ptype, params, exclude="id").fit(df)
    assert fitted_rows == [2]
    got = M.score_of(model, df, t, ptype, metric)
    monkeypatch.setattr(FO, "ROWS_ALONE", 1 << 40)
    want = M.model_pipeline(df, t, name, ptype, params, exclude="id").fit(df)
    assert abs(got - M.score_of(want, df, t, ptype, metric)) < 0.1  # eight seeds of MLlib lay between 0.78 and 0.89 (r2)
    trees = model.stages[-1].trees
    assert len(trees) == 30 and all(0 < x.depth <= 6 for x in trees)
    drawn = [_root_count(x) for x in trees]
    assert len(set(drawn)) > 5 and abs(np.mean(drawn) / 3000 - 1) < 0.02
    path = shared_path(df.sparkSession, "forest-test")
    M.save_pipeline(model, path)
    assert {r["feature"] for r in M.feature_importance(model).collect()} == {"a", "b", "x", "same", "s_p", "s_q"}
    assert M.PipelineModel.load(path).transform(df).select(F.sum("prediction")).first() == model.transform(df).select(F.sum("prediction")).first()


def _root_count(tree) -> int:
    return tree._java_obj.rootNode().impurityStats().rawCount()


@pytest.mark.parametrize("t,tree,forest", [("y", DecisionTreeRegressor, RandomForestRegressor), ("yes", DecisionTreeClassifier, RandomForestClassifier)])
def test_a_tree_of_all_slots_and_rows_is_mllibs(rows, t, tree, forest):
    """Each row drawn once and all slots offered: one decision tree."""
    classes = t == "yes"
    own = rows.select("id", array_to_vector(F.array("a", "b", F.round("x", 0))).alias("features"), F.col(t).cast("double").alias(t)).coalesce(1).persist()
    got = own.collect()
    x, y = np.array([r["features"].toArray() for r in got]), np.array([r[t] for r in got])
    values = [np.unique(x[:, s]) for s in range(3)]
    cuts = [(v[1:] + v[:-1]) / 2 for v in values]
    codes = np.column_stack([np.searchsorted(k, x[:, s], "left").astype(np.uint8) for s, k in enumerate(cuts)])
    grown = FO._tree(codes, np.stack([np.ones(len(y)), y, y * y]), 5, 3, np.random.default_rng(0))
    learner = forest(labelCol=t, numTrees=2, maxDepth=5, seed=1)
    model = FO._model(learner, rows.sparkSession, [grown, grown], cuts, 3, classes)
    want = tree(labelCol=t, maxDepth=5).fit(own)
    column = (lambda m: m.transform(own).select("id", M.vector_to_array("probability")[1].alias("p"))) if classes else \
        (lambda m: m.transform(own).select("id", F.col("prediction").alias("p")))
    a, b = ({r["id"]: r["p"] for r in column(m).collect()} for m in (model, want))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in b)
    assert model.trees[0].numNodes == want.numNodes
    assert np.allclose(model.featureImportances.toArray(), want.featureImportances.toArray())


def test_small_tables_odd_numbers_and_other_settings_stay_with_mllib(rows, fitted_rows):
    df = rows.select("a", "b", "x", "y")
    fit = lambda d, **p: M.model_pipeline(d, "y", "RandomForestRegressor", "regression", {"numTrees": 3, "maxDepth": 3, **p}).fit(d)
    small = df.limit(90).persist()
    fit(small)
    assert fitted_rows.pop() == 90
    fit(df, maxDepth=12)
    assert fitted_rows.pop() == 3000
    with pytest.raises(Exception, match="(?i)label"):
        fit(rows.select("a", F.when(F.col("id") > 5, F.col("y")).alias("y")))
    with pytest.raises(Exception):
        fit(rows.select(F.when(F.col("id") > 5, F.col("a")).alias("a"), "b", "y"))


def test_more_cells_than_a_task_takes_stay_with_mllib(rows, fitted_rows, monkeypatch):
    monkeypatch.setattr(FO, "MAX_CELLS", 10)
    df = rows.select("a", "b", "x", "y")
    M.model_pipeline(df, "y", "RandomForestRegressor", "regression", {"numTrees": 3, "maxDepth": 3}).fit(df)
    assert fitted_rows == [3000]


def test_forests_of_train_and_select_are_not_fitted_on_rows(rows, fitted_rows):
    df = rows.select("id", "a", "b", "x", "y")
    train, test = M.E.train_test_split(df, None, key="id", stratify=False)
    params = {"RandomForestRegressor": {"numTrees": 8, "maxDepth": 4}}
    best, table = M.train_and_select(train, test, "y", ["LinearRegression", "RandomForestRegressor"], "regression", params=params, exclude="id")
    assert fitted_rows == [2]
    assert {(r["model"], r["metric"]) for r in table.collect()} == {(m, x) for m in ("LinearRegression", "RandomForestRegressor") for x in ("rmse", "mae", "r2", "mape")}
