"""Evaluation presets (F20-F24): fixed recipes composed from the operators.

Learner sizes are parameters (the reference's full sizes are the defaults in
``operators.models``); folds come from the hash fold operator and are shared
by every configuration, so paired comparisons are fair.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import c, numeric_cols, string_cols
from ..operators import clean as C
from ..operators import features as FE
from ..operators import metrics as G
from ..operators import models as M
from ..operators import split as E
from ..session import cut_lineage


class Recipe:
    """Steps fitted on training rows and replayed, as they are, on any others. ``aside`` (target and split key) is never touched."""

    def __init__(self, train: DataFrame, t: str, key: M.Key = None):
        self.train, self.t, self.aside, self.steps = train, t, [t, *M.key_columns(key)], []

    def numeric(self) -> list[str]:
        return [x for x in numeric_cols(self.train) if x not in self.aside]

    def add(self, step: Callable[[DataFrame], DataFrame]) -> Recipe:
        self.steps.append(step)
        self.train = step(self.train)
        return self

    def label_encode(self) -> Recipe:
        strs = [x for x in string_cols(self.train) if x not in self.aside]
        return self.add(C.LabelEncoder(cols=strs).fit(self.train).transform) if strs else self

    def fill(self, **settings) -> Recipe:
        return self.add(C.NumericImputer(drop_above=None, exclude=self.aside, **settings).fit(self.train).transform)

    def clip(self) -> Recipe:
        return self.add(C.Winsorizer(exclude=self.aside).fit(self.train).transform)

    def products(self, pairs: str) -> Recipe:
        found = FE.interaction_pairs(self.train, self.t, self.numeric(), min_r=0.0, pairs=pairs)
        return self.add(lambda d: FE.apply_products(d, found))

    def logs(self) -> Recipe:
        _, made = FE.log_features(self.train, self.numeric(), self.t, strict=True)
        return self.add(lambda d: d.withColumns({f"log_{x}": F.log1p(c(x).cast("double")) for x in made}) if made else d)

    def prune(self, limit: float) -> Recipe:
        _, self.dropped = FE.prune_correlated(self.train, self.t, self.numeric(), limit=limit, mode="upper_half")
        return self.add(lambda d: d.drop(*self.dropped))

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df


def encode_and_fill(train: DataFrame, t: str, key: M.Key = None) -> Recipe:
    """C22 + C7: label-encode string features, then median-fill every numeric feature."""
    return Recipe(train, t, key).label_encode().fill(flag_min=2.0, flag_max=2.0)


def _best_f1(rows: list[tuple]) -> str:
    return M.rank_scores({r[0]: r[1] for r in rows}, True)[0][0]


def baseline_run(df: DataFrame, t: str, key: M.Key = None, sizes: dict | None = None) -> tuple[str, DataFrame]:
    """label-encode, median fill (fitted on train), scale, three default learners; best binary F1."""
    sizes = sizes or {}
    raw, held = E.train_test_split(df, t, key=key)
    recipe = encode_and_fill(raw, t, key)
    train, test = (M.compact(x).persist() for x in (recipe.train, recipe.apply(held)))
    n = train.count()

    def fit(learner: tuple) -> tuple:
        name, params = learner
        pipe = M.model_pipeline(train, t, name, "binary_classification", params, n_rows=n, exclude=key)
        model, secs = M.fit_timed(pipe, train)
        return name, M.score_of(model, test, t, "binary_classification", "f1_binary"), secs

    learners = [("LogisticRegression", {"maxIter": 1000, "C": 1.0}),
                ("RandomForestClassifier", sizes.get("rf", {"numTrees": 100, "maxDepth": 10})),
                ("GBTClassifier", sizes.get("gbt", {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1}))]
    with ThreadPool(len(learners)) as pool:  # times are those of fits side by side
        rows = pool.map(fit, learners, chunksize=1)
    table = df.sparkSession.createDataFrame(rows, "model string, f1_binary double, fit_seconds double")
    return _best_f1(rows), table


def full_run(df: DataFrame, t: str, key: M.Key = None, folds: int = 3, n_iter: int = 25,
             scout_candidates: Sequence[str] | None = None, grids: dict | None = None, search_folds: int = K.TUNE_FOLDS) -> dict:
    """split; impute (+ flag above 30 %), clip, top-3 interactions, logs, collinearity prune (0.92), all fitted on
    train; 3-fold binary-F1 pre-screen; randomised 5-fold search of the best two, the better one on test kept with the
    settings its search found; balanced retry."""
    raw, held = E.train_test_split(df, t, key=key)
    recipe = Recipe(raw, t, key).label_encode().fill(flag_min=0.30, flag_min_inclusive=False, flag_max=1.0) \
        .clip().products("all").logs().prune(0.92)
    train, test = (M.compact(x).persist() for x in (recipe.train, recipe.apply(held)))
    ranking = M.scout(train, t, "binary_classification", "f1_binary", folds=folds, candidates=scout_candidates, key=key)
    rows, search = [], {}
    names = M.top_two(ranking)
    found = M.tune_many(train, t, names, "binary_classification", n_iter=n_iter, folds=search_folds, metric="f1_binary", grids=grids, key=key)
    own = {name: (M.canonical(name), M.settings(name, params)) for name, (params, _) in zip(names, found)}
    distinct = [name for n, name in enumerate(names) if own[name] not in [own[x] for x in names[:n]]]  # one estimator is fitted once

    def fitted(name: str) -> float | None:
        model = M.model_pipeline(train, t, name, "binary_classification", dict(own[name][1]), exclude=key).fit(train)
        return M.score_of(model, test, t, "binary_classification", "f1_binary")

    with ThreadPool(max(1, len(distinct))) as pool:
        f1s = dict(zip(distinct, pool.map(fitted, distinct, chunksize=1)))
    for name, (params, search[name]) in zip(names, found):
        rows.append((name, next(f1s[x] for x in distinct if own[x] == own[name]), params))
    best = _best_f1(rows)
    f1, params = next((f, p) for n, f, p in rows if n == best)
    winner, f1_final = M.balanced_retry(train, test, t, f1 or 0.0, exclude=key)
    return {"dropped": recipe.dropped, "ranking": ranking, "search": search, "model": best, "params": params, "f1": f1,
            "retry": winner, "f1_final": f1_final}


def fixed_search(df: DataFrame, t: str, key: M.Key = None, draws: int = 3, folds: int = 3,
                 boosted_rounds: int = 50, forest_grid: dict | None = None) -> DataFrame:
    """a fixed small forest search (``draws`` x ``folds`` over trees x depth) and a fixed boosted
    baseline (``boosted_rounds`` rounds); rows (model, params, f1_binary, fit_seconds) on a stratified split."""
    import json
    import time as _time
    raw, held = E.train_test_split(df, t, key=key)
    recipe = encode_and_fill(raw, t, key)
    train, test = (M.compact(x).persist() for x in (recipe.train, recipe.apply(held)))
    grid = forest_grid or {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 30]}
    t0 = _time.time()
    best, _ = M.tune(train, t, "RandomForestClassifier", "binary_classification", n_iter=draws, folds=folds,
                     metric="f1_binary", grid=grid, key=key)
    rf = M.model_pipeline(train, t, "RandomForestClassifier", "binary_classification", best, exclude=key).fit(train)
    rf_secs = _time.time() - t0
    gbt_params = {"maxIter": boosted_rounds, "maxDepth": 3, "stepSize": 0.1}
    gbt, gbt_secs = M.fit_timed(M.model_pipeline(train, t, "GBTClassifier", "binary_classification", gbt_params, exclude=key), train)
    rows = [("RandomForestClassifier", json.dumps(best, sort_keys=True),
             M.score_of(rf, test, t, "binary_classification", "f1_binary"), rf_secs),
            ("GBTClassifier", json.dumps(gbt_params, sort_keys=True),
             M.score_of(gbt, test, t, "binary_classification", "f1_binary"), gbt_secs)]
    return df.sparkSession.createDataFrame(rows, "model string, params string, f1_binary double, fit_seconds double")


def ablation(df: DataFrame, t: str, configs: dict[str, tuple[Callable[[DataFrame], DataFrame], str, dict | None]], k: int = 5,
             key: M.Key = None) -> tuple[DataFrame, DataFrame]:
    """every named configuration, (frame transform, learner, settings), scored on the same stratified folds.
    Returns ((config, fold, f1) rows, a G19 summary per configuration with ``step`` and the paired t against the one
    before: delta, t, p)."""
    folded = M.compact(E.add_fold(df, k, t, key=key)).persist()

    frames = [(make(folded), [(learner, [params])]) for make, learner, params in configs.values()]
    rows = []
    for name, ((got,),) in zip(configs, M.scores_on_folds(frames, t, "binary_classification", k, "f1_binary", key)):
        if isinstance(got, Exception):
            raise got
        rows += [(name, i, got[i]) for i in sorted(got)]
    folded.unpersist()
    spark = df.sparkSession
    scores = spark.createDataFrame(rows, "config string, fold int, f1 double")
    steps, before = [], None
    for i, name in enumerate(configs):
        own = scores.where(F.col("config") == name).select("fold", F.col("f1").alias("score"))
        test = G.paired_t(own, before, "fold").first() if before is not None else None
        steps.append((name, i, *((test["mean_diff"], test["t"], test["p_two_sided"]) if test else (None, None, None))))
        before = own
    against = spark.createDataFrame(steps, "config string, step int, delta double, t double, p double")
    return scores, G.fold_summary(scores, "f1", ["config"]).join(against, "config")


def regression_run(df: DataFrame, t: str, key: M.Key = None, k: int = 5, params: dict | None = None) -> dict:
    """logs (all values > 0) and star interactions of the top 3, fitted on train; two boosted/forest learners,
    best by R2; k-fold R2 of the winner against plain linear regression."""
    raw, held = E.train_test_split(df, None, key=key, stratify=False)
    recipe = Recipe(raw, t, key).logs().products("star")
    best, table = M.train_and_select(recipe.train, recipe.apply(held), t, ["GBTRegressor", "RandomForestRegressor"], "regression",
                                     "r2", params=params, exclude=key)
    cv_best = M.cross_validate(recipe.apply(df), t, best.name, "regression", k, "r2", params=(params or {}).get(best.name), key=key)
    cv_lin = M.cross_validate(df, t, "LinearRegression", "regression", k, "r2", key=key)
    return {"comparison": table, "best": best.name, "cv_best": cv_best, "cv_linear": cv_lin,
            "paired_t": G.paired_t(cv_best, cv_lin, "fold")}


# Settings of the probability runs (F24) and of the second boosted family.
PROBABILITY_BOOST = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05}


def evaluate_many(tables: dict[str, tuple[DataFrame, str, Sequence[str]]], params: dict | None = None,
                  key: M.Key = None, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """per table: drop listed columns, stratified 80/20, label-encode + median fill fitted on train, one boosted
    learner. Returns rows (dataset, metric, value) for F1, PR-AUC, AP, Brier and positive rate, and the G13
    calibration rows (dataset, bin, n, frac_pos, mean_pred)."""
    def fit(name: str) -> DataFrame:
        df, t, drop = tables[name]
        # the split, the encoders, the fit and the scores read these rows, not what they are made of; every metric reads written scores
        rows = df.drop(*drop).persist()
        dealt = M.compact(rows).persist()
        raw, held = E.train_test_split(dealt, t, key=key)
        recipe = encode_and_fill(raw, t, key)
        train, test = M.compact(recipe.train).persist(), recipe.apply(held)
        model = M.model_pipeline(train, t, "GBTClassifier", "binary_classification", params or PROBABILITY_BOOST, exclude=key).fit(train)
        pred = cut_lineage(M.predictions(model, test, t))
        for x in (train, dealt, rows):
            x.unpersist()
        return pred

    with ThreadPool(max(1, min(len(tables), M.FITS_AT_ONCE))) as pool:
        preds = pool.map(fit, tables, chunksize=1)
    out = curves = None
    for name, pred in zip(tables, preds):
        parts = [G.classification_metrics(pred, positive=1.0).where("metric = 'f1_binary'"),
                 G.pr_auc(pred, positive=1.0), G.average_precision(pred, positive=1.0), G.brier(pred),
                 G.positive_rate(pred, positive=1.0)]
        label = F.lit(name).alias("dataset")
        for p in parts:
            p = p.select(label, "metric", "value")
            out = p if out is None else out.unionByName(p)
        cal = G.calibration(pred, bins=bins).select(label, "bin", "n", "frac_pos", "mean_pred")
        curves = cal if curves is None else curves.unionByName(cal)
    return out, curves
