"""MLlib operators: rows plus tolerance on targets with known signal; save/load round trip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import metrics as G
from tabsmith.operators import models as M
from tabsmith.operators import split as E
from tabsmith.plans import frames as FR
from tabsmith.plans import stages as S
from tabsmith.plans.rules import build_plan
from tabsmith.session import shared_path

from conftest import SMALL

SMALL_RF = {"numTrees": 10, "maxDepth": 4}


def test_regression_learns_net_price(spark):
    df = FR.priced_lineitem(spark, SMALL).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount",
                                                 "l_tax", "net")
    train, test = E.train_test_split(df, None, stratify=False, key=["l_orderkey", "l_linenumber"])
    model = M.model_pipeline(train, "net", "LinearRegression", "regression",
                             exclude=["l_orderkey", "l_linenumber"]).fit(train)
    r2 = M.metric_value(M.evaluate(model, test, "net", "regression"), "r2")
    assert r2 > 0.95


def test_classifier_learns_signal_and_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    li = FR.table(spark, SMALL, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    df = li.select((net > 35000).cast("int").alias("big"), "l_extendedprice", "l_discount", "l_quantity")
    train, test = E.train_test_split(df, "big")
    model = M.model_pipeline(train, "big", "RandomForestClassifier", "binary_classification", SMALL_RF).fit(train)
    auc = M.metric_value(M.evaluate(model, test, "big", "binary_classification"), "roc_auc")
    assert auc > 0.9
    assert auc == pytest.approx(BinaryClassificationEvaluator(labelCol="big").evaluate(model.transform(test)))


def test_save_and_score_round_trip(spark):
    df = FR.doc_features(spark, SMALL).select("doc_id", "quality", "n_chars", "n_words", "n_periods")
    model = M.model_pipeline(df, "quality", "LogisticRegression", "binary_classification", {"maxIter": 50, "C": 1.0},
                             exclude=["doc_id"]).fit(df)
    path = shared_path(spark, "test-model")
    M.save_pipeline(model, path, threshold=0.3)
    scored = M.score(df, path)
    direct = M.predictions(model, df, "quality", threshold=0.3)
    assert sorted(r["score"] for r in scored.collect()) == pytest.approx(sorted(r["score"] for r in direct.collect()))


def test_feature_importance_names(spark):
    df = FR.doc_features(spark, SMALL).select("quality", "lang", "n_chars", "n_words")
    model = M.model_pipeline(df, "quality", "RandomForestClassifier", "binary_classification", SMALL_RF).fit(df)
    names = [r["feature"] for r in M.feature_importance(model, 10).collect()]
    assert set(names) <= {"n_chars", "n_words"} | {f"lang_{x}" for x in ["de", "en", "es", "fr"]}


def test_tune_draws_are_seeded():
    a = M.draw_params("GBTClassifier", 5, seed=42)
    assert a == M.draw_params("GBTClassifier", 5, seed=42) and len(a) == 5


def test_cleaner_output_passes_gate(spark):
    df = FR.dirty_lineitem(spark, SMALL)
    plan = build_plan(df, "l_returnflag")
    fitted, cleaned = S.Cleaner(plan).fit(df)
    from tabsmith.operators import audit as H
    gates = {r["gate"]: r["passed"] for r in H.gate_cleaned(cleaned, "l_returnflag").collect()}
    assert gates["no_missing_values"] and gates["target_is_numeric"]
    # the fitted cleaner replays on new rows with the same columns
    assert set(fitted.transform(df).columns) == set(cleaned.columns)
    # and keeps the training class codes on a frame that lacks other classes (A=0, N=1, R=2)
    only_r = fitted.transform(df.where(F.col("l_returnflag") == "R")).select("l_returnflag").distinct().collect()
    assert [r[0] for r in only_r] == [2]


def test_threshold_sweep_and_pr_curve_consistent(spark):
    sd = FR.scored_docs(spark, SMALL)
    sweep = G.threshold_sweep(sd)
    assert sweep.count() == 9
    curve = G.pr_curve(sd, points=None).toPandas().sort_values("idx")
    assert curve["recall"].is_monotonic_decreasing and curve.iloc[-1]["precision"] == 1.0


def test_failed_and_missing_scores_rank_last_either_way():
    scores = {"a": 2.0, "b": None, "c": 1.0, "d": float("nan")}
    assert [n for n, _ in M.rank_scores(scores, higher=False)] == ["c", "a", "b", "d"]
    assert [n for n, _ in M.rank_scores(scores, higher=True)] == ["a", "c", "b", "d"]


def test_scout_puts_a_throwing_learner_last_and_marks_two(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 7) * 2 + (i % 3)) for i in range(120)], "id long, x double, y double")
    ranking = M.scout(df, "y", "regression", "rmse", candidates=["NoSuchLearner", "LinearRegression", "Ridge"], key="id")
    rows = ranking.orderBy("rank").collect()
    assert rows[-1]["model"] == "NoSuchLearner" and rows[-1]["score"] is None and not rows[-1]["chosen"]
    assert set(M.top_two(ranking)) == {"LinearRegression", "Ridge"}


def test_split_key_is_no_feature(spark):
    df = spark.createDataFrame([(i, float(i % 5), i % 2) for i in range(60)], "id long, x double, y int")
    model = M.model_pipeline(df, "y", "LogisticRegression", "binary_classification", exclude="id").fit(df)
    assert M.feature_names(model) == ["x"]


def test_ols_equals_normal_equations(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = 3 + x @ [1.5, -2.0] + rng.normal(size=80) / 10
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    pred = np.array([r.prediction for r in M.predictions(M.model_pipeline(df, "y", "LinearRegression", "regression").fit(df), df, "y").collect()])
    full = np.column_stack([np.ones(80), x])
    want = full @ np.linalg.lstsq(full, y, rcond=None)[0]
    assert np.abs(np.sort(pred) - np.sort(want)).max() < 1e-6


@pytest.fixture
def fits(monkeypatch):
    """(learner, rounds, depth, rate) of every boosted learner asked for; quick linear fits stand in for them."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression
    seen, real = [], M.make_model

    def quick(name, problem_type, label, n_rows, params=None, weight=None, **more):
        model = real(name, problem_type, label, n_rows, params, weight, **more)
        if M.canonical(name).startswith("GBT"):
            seen.append((name, model.getMaxIter(), model.getMaxDepth(), model.getStepSize()))
        learner = LinearRegression if problem_type == "regression" else LogisticRegression
        return learner(labelCol=label, featuresCol="features", maxIter=1, regParam=0.1)

    monkeypatch.setattr(M, "make_model", quick)
    return seen


LGBM = (200, 6, 0.05)


@pytest.mark.parametrize("name,want", [
    ("f02_08_learners", [("XGBClassifier", 100, 6, 0.3), ("LGBMRegressor", *LGBM)]), ("f17_balanced_retry", [("LGBMClassifier", *LGBM)]),
    ("f20_baseline_run", [("GBTClassifier", 100, 5, 0.1)]), ("f22_ablation", [("LGBMClassifier", *LGBM)] * 15),
    ("f24_evaluate_many", [("GBTClassifier", *LGBM)] * 2), ("f24_calibration", [("GBTClassifier", *LGBM)])])
def test_registered_runs_have_full_sizes(spark, fits, name, want):
    from tabsmith.plans import catalog_models
    catalog_models.Q[name](spark, SMALL)
    assert [f for f in fits] == want


def test_regression_run_has_full_sizes(spark, fits, monkeypatch):
    from tabsmith.plans import catalog_models
    folds, real = [], M.cross_validate
    monkeypatch.setattr(M, "cross_validate", lambda *a, **b: folds.append(a[4]) or real(*a, **b))
    catalog_models.Q["f23_regression_run"](spark, SMALL)
    assert fits[0] == ("GBTRegressor", 100, 5, 0.1) and len(set(fits)) == 1 and folds == [5, 5]


def test_settings_go_by_the_given_name_first(spark, fits):
    df = FR.doc_features(spark, SMALL).select("quality", "n_chars", "n_words")
    own = {"GBTClassifier": {"maxIter": 3}, "XGBClassifier": {"maxIter": 7}}
    M.train_and_select(df, df, "quality", ["XGBClassifier", "LGBMClassifier"], "binary_classification", params=own)
    assert sorted(f[:2] for f in fits) == [("LGBMClassifier", 3), ("XGBClassifier", 7)]  # fits run side by side, in no order


@pytest.fixture
def scored(spark, monkeypatch):
    """(learner, folds) of every cross-validation asked for; boosted learners score best."""
    seen = []

    def constant(df, t, jobs, problem_type, k, *more, **named):
        seen.extend((name, k) for name, draws in jobs for _ in draws)
        return [[{0: {"XGBClassifier": 0.9, "LGBMClassifier": 0.8}.get(name, 0.5)} for _ in draws] for name, draws in jobs]

    monkeypatch.setattr(M, "fold_scores", constant)
    return seen


FIVE = {"LogisticRegression", "RandomForestClassifier", "GBTClassifier", "XGBClassifier", "LGBMClassifier"}


@pytest.mark.parametrize("name,screened,searched", [
    ("f09_scout", {(n, 2) for n in FIVE}, {}), ("f12_tune", set(), {("GBTRegressor", 5): 20}),
    ("f14_fixed_search", set(), {("RandomForestClassifier", 3): 3}),
    ("f21_full_run", {(n, 3) for n in FIVE}, {("XGBClassifier", 5): 25, ("LGBMClassifier", 5): 25})])
def test_registered_searches_have_full_sizes(spark, fits, scored, name, screened, searched):
    from collections import Counter

    from tabsmith.plans import catalog_models
    catalog_models.Q[name](spark, SMALL)
    assert Counter(scored) == Counter({**dict.fromkeys(screened, 1), **searched})
    if name == "f14_fixed_search":
        assert fits == [("GBTClassifier", 50, 3, 0.1)]


def test_run_all_has_full_sizes(spark, monkeypatch):
    from tabsmith.plans import catalog_models
    asked = {}
    monkeypatch.setattr(S, "run_all", lambda df, t, **named: asked.update(named) or {"metrics": None})
    catalog_models.Q["z_run_all"](spark, SMALL)
    assert asked == {"key": "doc_id"}  # all else as the operator has it


def test_staged_rounds_equal_shorter_fits(spark):
    """A search over rounds gives what a fit per setting gives, for both kinds of boosted learners, in fewer fits."""
    df = FR.doc_features(spark, SMALL).select("doc_id", "quality", "n_chars", "n_words", "lang")
    draws = [{"maxIter": n, "maxDepth": d, "stepSize": 0.2} for n in (2, 6, 4) for d in (2, 3)]
    assert M.setting_groups("GBTClassifier", draws, "binary_classification") == [[2, 4, 0], [3, 5, 1]]
    for name, ptype, t in (("GBTClassifier", "binary_classification", "quality"), ("GBTRegressor", "regression", "n_words")):
        whole = M.fold_scores(df, t, [(name, draws)], ptype, 2, key="doc_id")[0]
        for p, got in zip(draws[:3], whole):
            alone = M.fold_scores(df, t, [(name, [p])], ptype, 2, key="doc_id")[0][0]
            assert got.keys() == alone.keys() and all(abs(got[f] - alone[f]) < 1e-12 for f in got)


@pytest.mark.parametrize("name,params", [("LinearRegression", None), ("Ridge", {"alpha": 0.01}), ("Ridge", {"alpha": 50.0}), ("Lasso", {"alpha": 0.3})])
@pytest.mark.parametrize("metric", ["rmse", "r2"])
def test_linear_folds_from_gramians_equal_refits(spark, monkeypatch, name, params, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1, 20, 0.1] + [5, 1000, 0]
    kinds = rng.choice(["a", "b", "c"], 300)
    y = 4 + x @ [1.0, -0.5, 30.0] + np.where(kinds == "a", 6.0, 0.0) + rng.normal(size=300)
    rows = [(i, *map(float, v), 7.0, k, float(z)) for i, (v, k, z) in enumerate(zip(x, kinds, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, same double, kind string, y double")
    got = M.fold_scores(df, "y", [(name, [params])], "regression", 4, metric, key="id")[0][0]
    monkeypatch.setattr(M.linear, "LINEAR", ())
    refit = M.fold_scores(df, "y", [(name, [params])], "regression", 4, metric, key="id")[0][0]
    limit = {"LinearRegression": 1e-6, "Ridge": 1e-5, "Lasso": 1e-4}[name]  # MLlib's iterations (it iterates, as a column is constant) stop earlier
    assert got.keys() == refit.keys() and all(abs(got[f] - refit[f]) < limit for f in got), (got, refit)


def test_ridge_from_moments_equals_normal_equations():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 3)) * [1, 5, 9] + 3, rng.normal(size=50)
    full = np.column_stack([np.ones(50), x, np.full(50, 4.0), y])
    intercept, coef = M.linear.solve(full.T @ full, 4, "Ridge", 7.0)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.linalg.solve(z.T @ z + 7.0 * np.eye(3), z.T @ (y - y.mean()))
    assert np.abs(coef[:3] * x.std(0, ddof=1) - want).max() < 1e-9 and coef[3] == 0
    assert abs(intercept + x.mean(0) @ coef[:3] - y.mean()) < 1e-9


def test_incomplete_rows_have_no_closed_form(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 3 else 1.0 * i, i % 3) for i in range(20)], "id int, y double, x double, fold int")
    assert M.linear.moments(df, "y", ["x"], []) is None
    assert M.linear.moments(df.where("id <> 3"), "y", ["x"], []) is not None
