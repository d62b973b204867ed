"""Folds kept as cells score as folds of rows do, without storing or shuffling a row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import boost as B
from tabsmith.operators import fold_cells as FC
from tabsmith.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    out = []
    for i in range(2500):
        a, b, x = int(rng.integers(0, 6)), int(rng.integers(0, 4)), float(rng.normal())
        out.append((i, float(a), b, round(x, 1), float(rng.normal()) * 1e6, 5.0, 1e3 + a * b + 2 * x + float(rng.normal())))
    return spark.createDataFrame(out, "id int, a double, b int, x double, wide double, same double, y double").repartition(3).persist()


@pytest.fixture(autouse=True)
def all_sizes(monkeypatch):
    monkeypatch.setattr(FC, "ROWS_ALONE", 0)


DRAWS = [{"maxIter": n, "maxDepth": d, "stepSize": r} for n, d, r in ((2, 3, 0.2), (6, 3, 0.2), (4, 5, 0.1), (1, 1, 0.3))]


@pytest.mark.parametrize("metric", ["rmse", "r2"])
@pytest.mark.parametrize("more", [0, 14])
def test_scores_are_those_of_rows(rows, monkeypatch, metric, more):
    df = rows.withColumns({f"c{i}": F.pmod(F.col("id") * (i + 3), F.lit(17)).cast("double") for i in range(more)})
    with monkeypatch.context() as m:
        m.setattr(M.FC, "of_folds", lambda *a: None)
        want = M.fold_scores(df, "y", [("GBTRegressor", DRAWS)], "regression", 3, metric, key="id")[0]
    monkeypatch.setattr(FC, "CHUNK", 300)
    monkeypatch.setattr(FC, "HELD", 100)
    monkeypatch.setattr(M, "compact", lambda *a: pytest.fail("rows were stored"))
    monkeypatch.setattr(M, "encoded_folds", lambda *a: pytest.fail("rows were encoded"))
    got = M.fold_scores(df, "y", [("GBTRegressor", DRAWS)], "regression", 3, metric, key="id")[0]
    for a, b in zip(got, want):
        assert a.keys() == b.keys() == {0, 1, 2} and all(abs(a[f] - b[f]) < 1e-9 for f in a), (got, want)


def test_cells_hold_all_rows_once(rows):
    folded = M.E.add_fold(rows.select("id", "a", "b", "y"), 4, None, 42, "id")
    n = folded.count()
    for i, size, std, cells, held in FC.of_folds(folded, "y", ["a", "b"], 4, 1000):
        own = folded.where(F.col("fold") != i)
        assert cells.count() == 24 and cells.agg(F.sum(M.CE.WEIGHT)).first()[0] == size == own.count()
        assert held.agg(F.sum("n")).first()[0] == n - size
        assert std == pytest.approx(own.agg(F.stddev_pop("y")).first()[0])
        got, want = (x.agg(F.sum(e)).first()[0] for x, e in ((cells, F.col("y") * F.col(M.CE.WEIGHT)), (own, F.col("y"))))
        assert got == pytest.approx(want)


def test_many_values_are_cut_into_ranges_by_every_fold(rows, monkeypatch):
    df = rows.select("id", "wide", "a", "y")
    exact = M.fold_scores(df, "y", [("GBTRegressor", DRAWS[1:2])], "regression", 3, "rmse", key="id")[0][0]
    monkeypatch.setattr(M.CE, "VALUES", 100)
    ranged = M.fold_scores(df, "y", [("GBTRegressor", DRAWS[1:2])], "regression", 3, "rmse", key="id")[0][0]
    assert all(abs(ranged[f] / exact[f] - 1) < 0.02 for f in exact)


def test_what_cells_do_not_serve_is_scored_on_rows(rows):
    mae = M.fold_scores(rows.select("id", "a", "b", "y"), "y", [("GBTRegressor", DRAWS[:1])], "regression", 2, "mae", key="id")[0][0]
    assert set(mae) == {0, 1} and all(v > 0 for v in mae.values())
    assert M.kept_as_cells(rows.withColumn("fold", F.col("id") % 2), "y", [("GBTRegressor", [{"maxDepth": B.MAX_DEPTH + 1}])], "regression", 2, "rmse", ["id", "fold", "y"]) is None
    holes = rows.withColumn("fold", F.col("id") % 2).select("fold", "y", F.when(F.col("id") > 5, F.col("a")).alias("a"))
    assert FC.of_folds(holes, "y", ["a"], 2, 1000) is None


def test_small_tables_keep_their_rows(rows, monkeypatch):
    folded = rows.withColumn("fold", F.col("id") % 2).select("fold", "y", "a")
    assert FC.of_folds(folded, "y", ["a"], 2, 1000) is not None
    monkeypatch.setattr(FC, "ROWS_ALONE", 2500)
    assert FC.of_folds(folded, "y", ["a"], 2, 1000) is None
