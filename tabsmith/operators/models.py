"""Modelling on MLlib.

Fits are MLlib's, but for boosted ones of cross-validations and searches (``operators.boost``); evaluation reuses the metric operators
on the prediction frame (label, prediction, score). Folds and samples come
from the hash operators, so a run is repeatable and partition-independent.
Learners of other boosting libraries map to MLlib GBT and are reported under the name asked for.
"""

from __future__ import annotations

import itertools
import json
import math
import random
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.aggregates import level_counts
from ..functions.exprs import c, numeric_cols, safe_name, string_cols
from . import boost as B
from . import cells as CE
from . import fold_cells as FC
from . import forest as FO
from . import linear
from . import metrics as G
from . import split as E
from .frequency import FrequencyCoder, frequency_column

# Boosted learners of other libraries are served by MLlib GBT.
ALIASES = {"XGBClassifier": "GBTClassifier", "LGBMClassifier": "GBTClassifier",
           "GradientBoostingClassifier": "GBTClassifier", "XGBRegressor": "GBTRegressor",
           "LGBMRegressor": "GBTRegressor", "GradientBoostingRegressor": "GBTRegressor"}

# Default learner settings (full run; the scout uses the smaller set).
DEFAULTS = {
    "LogisticRegression": {"maxIter": 500, "C": 1.0},
    "RandomForestClassifier": {"numTrees": 100, "maxDepth": 10},
    "GBTClassifier": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1},
    "RandomForestRegressor": {"numTrees": 100, "maxDepth": 10},
    "GBTRegressor": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1},
    "LinearRegression": {},
    "Ridge": {"alpha": 1.0},
    "Lasso": {"alpha": 1.0},
}
SCOUT = {
    "LogisticRegression": {"maxIter": 200, "C": 1.0},
    "RandomForestClassifier": {"numTrees": 20, "maxDepth": 6},
    "GBTClassifier": {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1},
    "XGBClassifier": {"maxIter": 20, "maxDepth": 4, "stepSize": 0.3},
    "LGBMClassifier": {"maxIter": 20, "maxDepth": 4, "stepSize": 0.05},
    "RandomForestRegressor": {"numTrees": 20, "maxDepth": 6},
    "GBTRegressor": {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1},
    "XGBRegressor": {"maxIter": 20, "maxDepth": 4, "stepSize": 0.3},
    "LGBMRegressor": {"maxIter": 20, "maxDepth": 4, "stepSize": 0.05},
    "Ridge": {"alpha": 1.0},
}
# Search grids per family.
GRIDS = {
    "RandomForestClassifier": {"numTrees": [100, 200, 300], "maxDepth": [3, 5, 7, 30]},
    "RandomForestRegressor": {"numTrees": [100, 200, 300], "maxDepth": [3, 5, 7, 30]},
    "GBTClassifier": {"maxIter": [100, 200, 300], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.2]},
    "GBTRegressor": {"maxIter": [100, 200, 300], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.2]},
    "LogisticRegression": {"C": [0.01, 0.1, 1.0, 10.0]},
    "Ridge": {"alpha": [0.01, 0.1, 1.0, 10.0]},
    "Lasso": {"alpha": [0.01, 0.1, 1.0, 10.0]},
}


FITS_AT_ONCE = 16       # independent fits whose jobs run side by side
ROWS_PER_PART = 50_000  # rows that are worth a partition in a small table, ...
FEW_PARTS = 12          # ... up to so many partitions, ...
ROWS_AT_SCALE = 250_000  # ... and rows of a partition in a large one
Key = Sequence[str] | str | None  # column or columns that name a row


def compact(df: DataFrame, n: int | None = None) -> DataFrame:
    """``df`` dealt evenly to as many partitions as its rows are worth: a boosted fit runs jobs by the thousand, each with a task per
    partition. A shuffle, as the rows may be few of a large input (a sample), whose reading a coalesce would put into as few tasks."""
    return df.repartition(parts_of(df.count() if n is None else n))


def parts_of(n: int, rows_a_part: int = ROWS_PER_PART) -> int:
    """Partitions that ``n`` rows are worth."""
    return max(1, min(-(-n // rows_a_part), FEW_PARTS), -(-n // ROWS_AT_SCALE))


def canonical(name: str) -> str:
    return ALIASES.get(name, name)


# ----------------------------------------------------------------------------- F1

def wide_strings(df: DataFrame, cat: Sequence[str], limit: int = K.INDEX_MAX_LEVELS) -> list[str]:
    """String columns with more than ``limit`` levels. One pass of sketches tells those far above; only columns near the limit are
    counted exactly, so no index of a column's levels is built to find out."""
    levels = level_counts(df, cat, limit)
    return [x for x in cat if levels[x] > limit]


def build_preprocessor(num: Sequence[str], cat: Sequence[str], out: str = "features", scale: bool = True,
                       wide: Sequence[str] = (), intervals: str | None = None, weight: str | None = None) -> list:
    """standardised numerics + one-hot categoricals (unseen levels -> all zeros); others dropped. Columns of ``wide`` become
    the share of the fitted rows that hold their value, treated as one more numeric each: an index of their levels would gather
    them all on the driver. ``intervals`` names a second vector, in which numbers are replaced by the intervals that boosted trees see."""
    stages = [FrequencyCoder(inputCol=x, outputCol=frequency_column(x)) for x in wide]
    num, cat, parts = [*num, *map(frequency_column, wide)], [x for x in cat if x not in wide], []
    coded = []
    if num:
        stages.append(VectorAssembler(inputCols=list(num), outputCol="__num", handleInvalid="keep"))
        if scale:
            stages.append(StandardScaler(inputCol="__num", outputCol="__num_s", withMean=True, withStd=True))
            parts.append("__num_s")
        else:
            parts.append("__num")
        if intervals:
            stages.append(CE.IntervalCoder(inputCol=parts[0], outputCol="__num_at", **({"weightCol": weight} if weight else {})))
            coded.append("__num_at")
    for x in cat:
        idx, vec = f"__{safe_name(x)}_idx", f"__{safe_name(x)}_ohe"
        stages.append(StringIndexer(inputCol=x, outputCol=idx, handleInvalid="keep", stringOrderType="alphabetAsc"))
        # the last index is the unseen-level bucket; dropLast removes it, so unseen -> zeros
        stages.append(OneHotEncoder(inputCols=[idx], outputCols=[vec], dropLast=True))
        parts.append(vec)
        coded.append(vec)
    if intervals != out:
        stages.append(VectorAssembler(inputCols=parts, outputCol=out))
    if intervals:
        stages.append(VectorAssembler(inputCols=coded, outputCol=intervals))
    return stages


# ----------------------------------------------------------------------------- F2-F8

# Settings that the other libraries' learners bring along when served by GBT.
FAMILY = {
    "XGBClassifier": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3},
    "XGBRegressor": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3},
    "LGBMClassifier": {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05},
    "LGBMRegressor": {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05},
}


def settings(name: str, params: dict | None = None) -> dict:
    """A learner's settings: its family's defaults, its own, then ``params``."""
    return {**DEFAULTS.get(canonical(name), {}), **FAMILY.get(name, {}), **(params or {})}


def make_model(name: str, problem_type: str, label: str, n_rows: int, params: dict | None = None,
               weight: str | None = None, features: str = "features", seed: int = K.SEED, label_std: float = 1.0):
    """F2-F8: an MLlib estimator with reference defaults; ``C`` and ``alpha`` are converted to
    MLlib's per-row regularisation (regParam = 1/(C n) for logistic, alpha/n ridge, alpha lasso). MLlib scales the label
    to unit deviation and divides regParam by that deviation, which is right for the L1 penalty only; the L2 one is
    multiplied by ``label_std`` to make up for it."""
    p, name = settings(name, params), canonical(name)
    n = max(n_rows, 1)
    common = {"labelCol": label, "featuresCol": features}
    w = {"weightCol": weight} if weight else {}
    if name == "LogisticRegression":
        return LogisticRegression(maxIter=p["maxIter"], regParam=1.0 / (p["C"] * n), elasticNetParam=0.0, **common, **w)
    if name == "RandomForestClassifier":
        return RandomForestClassifier(numTrees=p["numTrees"], maxDepth=min(p["maxDepth"], 30), seed=seed, **common, **w)
    if name == "GBTClassifier":
        gbt = GBTClassifier(maxIter=p["maxIter"], maxDepth=p["maxDepth"], stepSize=p["stepSize"], seed=seed,
                            **common, **w)
        return gbt if problem_type != "multiclass_classification" else OneVsRest(classifier=gbt, **common, **w)
    if name == "RandomForestRegressor":
        return RandomForestRegressor(numTrees=p["numTrees"], maxDepth=min(p["maxDepth"], 30), seed=seed, **common, **w)
    if name == "GBTRegressor":
        return GBTRegressor(maxIter=p["maxIter"], maxDepth=p["maxDepth"], stepSize=p["stepSize"], seed=seed,
                            **common, **w)
    if name == "LinearRegression":
        return LinearRegression(regParam=0.0, **common, **w)
    if name == "Ridge":
        return LinearRegression(regParam=p["alpha"] / n * label_std, elasticNetParam=0.0, standardization=False, **common, **w)
    if name == "Lasso":
        return LinearRegression(regParam=p["alpha"], elasticNetParam=1.0, standardization=False, **common, **w)
    raise ValueError(f"unknown learner {name!r}")


def key_columns(key: Sequence[str] | str | None) -> list[str]:
    """The split key's columns; they name rows and are never features."""
    return [key] if isinstance(key, str) else list(key or ())


def model_pipeline(df: DataFrame, t: str, name: str, problem_type: str, params: dict | None = None,
                   weight: str | None = None, n_rows: int | None = None, exclude: Sequence[str] | str | None = ()) -> Pipeline:
    """F1 + F2-F8 as one pipeline over every column but the target, the weight and ``exclude`` (the split key)."""
    ex = set(key_columns(exclude)) | {t} | ({weight} if weight else set())
    num = [x for x in numeric_cols(df) if x not in ex]
    cat = [x for x in string_cols(df) if x not in ex]
    std = 1.0
    if canonical(name) == "Ridge":
        n_rows, std = df.agg(F.count(c(t)), F.coalesce(F.stddev_pop(c(t)), F.lit(1.0))).first()
    n = n_rows if n_rows is not None else df.count()
    learner = make_model(name, problem_type, t, n, params, weight, label_std=std)
    boosted = CE.is_boosted(learner)
    return Pipeline(stages=build_preprocessor(num, cat, wide=wide_strings(df, cat), intervals="features" if boosted else None, weight=weight)
                    + [CE.OnCells(learner, weight) if boosted else FO.OnDraws(learner) if FO.can_grow(learner) else learner])


# ----------------------------------------------------------------------------- predictions and scores

def predictions(model: PipelineModel, df: DataFrame, t: str, threshold: float | None = None) -> DataFrame:
    """(label, prediction, score) where score = P(class 1) when the model gives probabilities."""
    out = model.transform(df)
    score = (vector_to_array("probability")[1] if "probability" in out.columns else F.lit(None).cast("double"))
    pred = F.col("prediction")
    if threshold is not None and "probability" in out.columns:
        pred = (score >= F.lit(threshold)).cast("double")
    return out.select(c(t).cast("double").alias("label"), pred.alias("prediction"), score.alias("score"))


def evaluate(model: PipelineModel, df: DataFrame, t: str, problem_type: str,
             threshold: float | None = None, curves: bool = True) -> DataFrame:
    """Metric table (metric, value) for the problem type; ``curves`` adds ROC-AUC and AP (binary)."""
    return metrics_of(predictions(model, df, t, threshold), problem_type, curves)


CURVES = ("roc_auc", "average_precision")


def metrics_of(pred: DataFrame, problem_type: str, curves: bool) -> DataFrame:
    """Metric table of (label, prediction, score)."""
    if problem_type == "regression":
        return G.regression_metrics(pred)
    m = G.classification_metrics(pred, positive=1.0)
    if curves and problem_type == "binary_classification":
        m = m.unionByName(G.roc_auc(pred, positive=1.0)).unionByName(G.average_precision(pred, positive=1.0))
    return m


def score_of(model: PipelineModel, df: DataFrame, t: str, problem_type: str, metric: str) -> float | None:
    """One metric value, computing curve metrics only when that metric needs them."""
    return metric_value(evaluate(model, df, t, problem_type, curves=metric in CURVES), metric)


def metric_value(metrics: DataFrame, metric: str) -> float | None:
    r = metrics.where(F.col("metric") == metric).first()
    return None if r is None else r["value"]


def primary(problem_type: str, metric: str | None = None) -> tuple[str, bool]:
    """(metric name in the metric table, higher is better)."""
    if problem_type == "regression":
        m = metric or "rmse"
        return m, m in ("r2",)
    m = {"f1": "f1_weighted", "recall": "recall_weighted", "precision": "precision_weighted"}.get(metric or "f1",
                                                                                                 metric or "f1_weighted")
    return m, True


# ----------------------------------------------------------------------------- F15, F9, F10, F11

def staged(model, rounds: int):
    """A boosted model's first ``rounds`` rounds, as a shorter fit would have given them (MLlib's rounds don't look ahead)."""
    sc = SparkContext._active_spark_context
    trees, weights = model._java_obj.trees(), model.treeWeights
    kept = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    own = sc._gateway.new_array(sc._jvm.double, rounds)
    for i in range(rounds):
        kept[i], own[i] = trees[i], weights[i]
    kind = "classification.GBTClassificationModel" if isinstance(model, GBTClassificationModel) else "regression.GBTRegressionModel"
    java = sc._jvm
    for part in f"org.apache.spark.ml.{kind}".split("."):
        java = getattr(java, part)
    return type(model)(java(f"{model.uid}-{rounds}", kept, own))


@dataclass
class Fold:
    """One fold's training and held-out rows, encoded once for every learner and setting."""
    number: int
    train: DataFrame | None
    test: DataFrame | None
    n: int
    label_std: float
    cells: DataFrame | None = None  # the training rows as boosted fits take them
    held: DataFrame | None = None   # the held-out rows as cells, where no rows are kept


def encoded_folds(folded: DataFrame, t: str, k: int, exclude: Sequence[str] | str | None, weight: str | None,
                  boosted: str | None = None) -> list[Fold]:
    """Fit the preprocessor on each fold's training rows and keep both parts encoded (persisted); with cells for ``boosted`` learners of
    that problem type."""
    ex = {*key_columns(exclude), t, "fold", *([weight] if weight else [])}
    num, cat = ([x for x in f(folded) if x not in ex] for f in (numeric_cols, string_cols))
    intervals = "intervals" if boosted else None
    keep = [c(t), F.col("features"), *([c(weight)] if weight else []), *([F.col(intervals)] if boosted else [])]
    wide = wide_strings(folded, cat)

    def encode(i: int) -> Fold:
        train, test = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
        pre = Pipeline(stages=build_preprocessor(num, cat, wide=wide, intervals=intervals, weight=weight)).fit(train)
        held = [pre.transform(x).select(*keep).persist() for x in (train, test)]
        n, std = held[0].agg(F.count(F.lit(1)), F.coalesce(F.stddev_pop(c(t).cast("double")), F.lit(1.0))).first()
        cells = CE.cells_of(interval_rows(held[0]), t, boosted == "regression", weight, ROWS_AT_SCALE) if boosted else None
        return Fold(i, *held, n, std, cells)

    with ThreadPool(min(k, FITS_AT_ONCE)) as pool:
        return pool.map(encode, range(k))


def kept_as_cells(folded: DataFrame, t: str, jobs: Sequence[tuple[str, Sequence[dict | None]]], problem_type: str, k: int, metric: str,
                  exclude: Sequence[str]) -> list[Fold] | None:
    """The folds without their rows, where all jobs are boosted regressions that are grown from cells and scored on them; None otherwise."""
    if problem_type != "regression" or metric not in FC.METRICS or string_cols(folded.drop(*exclude)):
        return None
    if not all(canonical(name).startswith("GBT") and settings(name, p)["maxDepth"] <= B.MAX_DEPTH for name, draws in jobs for p in draws):
        return None
    num = [x for x in numeric_cols(folded) if x not in exclude]
    found = FC.of_folds(folded, t, num, k, ROWS_AT_SCALE)
    return None if found is None else [Fold(i, None, None, n, std, cells, held) for i, n, std, cells, held in found]


def interval_rows(df: DataFrame) -> DataFrame:
    """A fold's rows as boosted models see them."""
    return df.drop("features").withColumnRenamed("intervals", "features")


def setting_groups(name: str, draws: Sequence[dict | None], problem_type: str) -> list[list[int]]:
    """Draws that one fit serves: boosted ones that differ in their number of rounds alone (longest first); any other by itself."""
    if not canonical(name).startswith("GBT") or problem_type == "multiclass_classification":
        return [[i] for i in range(len(draws))]
    groups: dict[str, list[int]] = {}
    for i, p in enumerate(draws):
        groups.setdefault(json.dumps({x: v for x, v in (p or {}).items() if x != "maxIter"}, sort_keys=True), []).append(i)
    rounds = lambda i: settings(name, draws[i])["maxIter"]
    return [sorted(g, key=rounds, reverse=True) for g in groups.values()]


def fold_scores(df: DataFrame, t: str, jobs: Sequence[tuple[str, Sequence[dict | None]]], problem_type: str, k: int, metric: str | None = None,
                seed: int = K.SEED, key: Key = None, stratify: bool = True, weight: str | None = None
                ) -> list[list[dict[int, float | None] | Exception]]:
    """For every (learner, settings) of ``jobs`` and each of its settings: {fold: score}, or what the learner raised.

    Folds are cut and encoded once. Linear regressions come from one Gramian per fold (``operators.linear``); of boosted
    settings that differ in their number of rounds only the longest is fitted and scored at each; learners that come down to the same
    estimator share its fits; boosted ones are fitted on cells (``operators.cells``); all fits run side by side.
    """
    m, _ = primary(problem_type, metric)
    folded = E.add_fold(df, k, t if (stratify and problem_type != "regression") else None, seed, key)
    ex = {*key_columns(key), t, "fold"}
    num, cat = ([x for x in f(folded) if x not in ex] for f in (numeric_cols, string_cols))
    kept: list[DataFrame] = []

    def rows() -> DataFrame:
        """The rows of several passes, stored once."""
        if not kept:
            kept.append(compact(folded, df.count()).persist())
        return kept[0]

    out: list[list] = [[{} for _ in draws] for _, draws in jobs]
    todo = list(range(len(jobs)))
    if problem_type == "regression" and m in linear.SCORES and weight is None:
        closed = [j for j in todo if jobs[j][0] in linear.LINEAR]
        flat = [(j, i, (jobs[j][0], settings(jobs[j][0], p).get("alpha", 0.0))) for j in closed for i, p in enumerate(jobs[j][1])]
        got = linear.fold_scores(rows() if cat or len(closed) < len(jobs) else folded, t, num, cat, [x for _, _, x in flat], m) if flat else None
        if got is not None:
            for (j, i, _), scores in zip(flat, got):
                out[j][i] = dict(sorted(scores.items()))
            todo = [j for j in todo if j not in closed]
    if todo:
        left = [jobs[j] for j in todo]
        ready = kept_as_cells(folded, t, left, problem_type, k, m, list(ex)) if weight is None else None
        frames = [(folded if ready else rows(), left)]
        for j, scores in zip(todo, scores_on_folds(frames, t, problem_type, k, m, key, weight, [ready] if ready else None)[0]):
            out[j] = scores
    for x in kept:
        x.unpersist()
    return out


def scores_on_folds(frames: Sequence[tuple[DataFrame, Sequence[tuple[str, Sequence[dict | None]]]]], t: str, problem_type: str, k: int, metric: str,
                    key: Key = None, weight: str | None = None, ready: list[list[Fold]] | None = None
                    ) -> list[list[list[dict[int, float | None] | Exception]]]:
    """For every (frame with ``fold``, jobs): what ``fold_scores`` gives for its jobs. Boosted fits of all frames share their passes
    (``operators.boost``), other fits run side by side. ``ready``: the frames' folds, if they are made already."""
    def encode(frame):
        folded, jobs = frame
        return encoded_folds(folded, t, k, key, weight, problem_type if any(canonical(x).startswith("GBT") for x, _ in jobs) else None)

    with ThreadPool(min(len(frames), FITS_AT_ONCE)) as pool:
        folds = ready or pool.map(encode, frames, chunksize=1)
    tasks, shared = [], {}
    for at, (_, jobs) in enumerate(frames):
        groups: dict[str, list[tuple[int, list[int]]]] = {}
        for j in range(len(jobs)):
            for g in setting_groups(*jobs[j], problem_type):
                same = [canonical(jobs[j][0]), [settings(jobs[j][0], jobs[j][1][i]) for i in g]]
                groups.setdefault(json.dumps(same, sort_keys=True), []).append((j, g))
        tasks += [(at, *served[0], fold, served) for served in groups.values() for fold in folds[at]]

    def made(task):
        at, j, group, fold, _ = task
        name, draws = frames[at][1][j]
        try:
            return make_model(name, problem_type, t, fold.n, draws[group[0]], weight, label_std=fold.label_std)
        except LEARNER_ERRORS as error:
            return error

    learners = [made(task) for task in tasks]
    usable = _plain_folds([x for own in folds for x in own], t, problem_type)
    for i, (task, learner) in enumerate(zip(tasks, learners)):
        if id(task[3]) in usable and B.can_share(learner):
            shared[i] = B.fit_of(learner, usable[id(task[3])])

    def run(i):
        at, j, group, fold, _ = tasks[i]
        name, draws = frames[at][1][j]
        rounds = [settings(name, draws[x]).get("maxIter") for x in group]
        learner = learners[i]
        if isinstance(learner, Exception):
            return learner
        try:
            if i in shared and fold.held is not None:
                return [x[metric] for x in B.staged_errors(fold.held, shared[i], rounds)]
            if i in shared:
                staged_rows = B.staged_predictions(interval_rows(fold.test), t, shared[i], rounds).persist()
                scores = [metric_value(metrics_of(B.as_scored(staged_rows, f"p{x}", shared[i].logistic), problem_type, metric in CURVES), metric)
                          for x in range(len(group))]
                staged_rows.unpersist()
                return scores
            on_cells = CE.is_boosted(learner)
            model = CE.weighted(learner).fit(fold.cells) if on_cells else FO.fit(learner, fold.train)
            test = interval_rows(fold.test) if on_cells else fold.test
            return [score_of(model if n == rounds[0] else staged(model, n), test, t, problem_type, metric) for n in rounds]
        except LEARNER_ERRORS as error:
            return error

    results: dict = {}
    with ThreadPool(max(1, min(len(tasks), FITS_AT_ONCE))) as pool:
        alone = [i for i in range(len(tasks)) if i not in shared]
        others = pool.map_async(run, alone, chunksize=1)
        if shared:
            units = [x for own in folds for x in own if id(x) in usable]
            B.fit_all([(x.cells, problem_type != "regression") for x in units], t, list(shared.values()), [x.cells.count() for x in units], ROWS_AT_SCALE)
            results.update(zip(shared, pool.map(run, shared, chunksize=1)))
        results.update(zip(alone, others.get()))
    out: list[list[list]] = [[[{} for _ in draws] for _, draws in jobs] for _, jobs in frames]
    for i, (at, _, _, fold, served) in enumerate(tasks):
        scores = results[i]
        for j, n, x in ((j, n, x) for j, group in served for n, x in enumerate(group)):
            own = out[at][j]
            if isinstance(scores, Exception) or isinstance(own[x], Exception):
                own[x] = scores if isinstance(scores, Exception) else own[x]
            else:
                own[x][fold.number] = scores[n]
    for fold in (x for own in folds for x in own):
        for x in (fold.train, fold.test, fold.cells, fold.held):
            if x is not None:
                x.unpersist()
    return out


def _plain_folds(folds: Sequence[Fold], t: str, problem_type: str) -> dict[int, int]:
    """{identity of a fold: its number among them} of the folds whose boosted fits can share passes."""
    if problem_type == "multiclass_classification":
        return {}
    boosted = [x for x in folds if x.cells is not None]
    if not boosted:
        return {}
    with ThreadPool(min(len(boosted), FITS_AT_ONCE)) as pool:
        plain = pool.map(lambda x: B.plain_cells(x.cells, t, problem_type != "regression"), boosted)
    return {id(x): n for n, x in enumerate(x for x, good in zip(boosted, plain) if good)}


def mean_score(scores: dict[int, float | None]) -> float | None:
    """Mean over the folds that have a score."""
    known = [s for s in scores.values() if s is not None]
    return sum(known) / len(known) if known else None


def cross_validate(df: DataFrame, t: str, name: str, problem_type: str, k: int = 5, metric: str | None = None,
                   params: dict | None = None, seed: int = K.SEED, key: Sequence[str] | str | None = None,
                   stratify: bool = True, weight: str | None = None) -> DataFrame:
    """(fold, score) — fit on the other folds, score the held-out fold."""
    scores = fold_scores(df, t, [(name, [params])], problem_type, k, metric, seed, key, stratify, weight)[0][0]
    if isinstance(scores, Exception):
        raise scores
    return df.sparkSession.createDataFrame(sorted(scores.items()), "fold int, score double")


#: What a learner may raise on data it can't take (a JVM requirement that fails is an illegal argument).
LEARNER_ERRORS = (ValueError, TypeError, IllegalArgumentException)


def rank_scores(scores: dict[str, float | None], higher: bool) -> list[tuple[str, float | None]]:
    """Best first; learners without a score come last, whichever way the metric points."""
    def place(item):
        name, s = item
        missing = s is None or math.isnan(s)
        return missing, 0.0 if missing else -s if higher else s, name
    return sorted(scores.items(), key=place)


def scout(df: DataFrame, t: str, problem_type: str, metric: str | None = None, folds: int = 2,
          candidates: Sequence[str] | None = None, seed: int = K.SEED, key: Sequence[str] | str | None = None
          ) -> DataFrame:
    """every candidate with its scout settings, k-fold CV on the E2 sample, scored by R2 for regression.
    Rows (rank, model, score, chosen), best first; a learner that fails has no score and ranks last; ``chosen`` marks
    the top two of those that have one."""
    sample = E.scout_sample(df, t, problem_type, seed, key)
    from .features import sanitize
    sample = sanitize(sample, t)
    metric = metric or ("r2" if problem_type == "regression" else None)
    names = list(candidates or ([x for x in SCOUT if "Regressor" in x or x == "Ridge"] if problem_type == "regression"
                                else [x for x in SCOUT if "Classifier" in x or x == "LogisticRegression"]))
    got = fold_scores(sample, t, [(n, [SCOUT.get(n, SCOUT.get(canonical(n)))]) for n in names], problem_type, folds, metric, seed, key)
    means = {n: None if isinstance(x[0], Exception) else mean_score(x[0]) for n, x in zip(names, got)}
    scores = {n: None if s is None else round(s, 4) for n, s in means.items()}
    _, higher = primary(problem_type, metric)
    ranked = rank_scores(scores, higher)
    return df.sparkSession.createDataFrame([(i + 1, n, s, i < 2 and s is not None) for i, (n, s) in enumerate(ranked)],
                                           "rank int, model string, score double, chosen boolean")


def top_two(ranking: DataFrame) -> list[str]:
    """The chosen learners of a scout ranking, best first."""
    return [r["model"] for r in ranking.where("chosen").orderBy("rank").collect()]


@dataclass
class Trained:
    name: str
    model: PipelineModel
    metrics: DataFrame
    fit_seconds: float
    params: dict = field(default_factory=dict)


def fit_timed(pipe: Pipeline, df: DataFrame) -> tuple[PipelineModel, float]:
    """Fit with a driver-clock timer."""
    t0 = time.time()
    m = pipe.fit(df)
    return m, time.time() - t0


def train_and_select(train: DataFrame, test: DataFrame, t: str, names: Sequence[str], problem_type: str,
                     metric: str | None = None, weight: str | None = None, params: dict | None = None,
                     exclude: Sequence[str] | str | None = ()) -> tuple[Trained, DataFrame]:
    """fit each model on train, evaluate on test, select the best by the metric.
    ``params`` maps a learner name, as given or else as served, to settings. Returns (best, rows (model, metric, value, fit_seconds))."""
    m, higher = primary(problem_type, metric)
    n = train.count()
    train, test = (compact(x, n).persist() for x in (train, test))

    def fit(name: str) -> Trained:
        own = (params or {}).get(name, (params or {}).get(canonical(name)))
        pipe = model_pipeline(train, t, name, problem_type, own, weight=weight, n_rows=n, exclude=exclude)
        model, secs = fit_timed(pipe, train)
        return Trained(name, model, evaluate(model, test, t, problem_type), secs)

    with ThreadPool(max(1, min(len(names), FITS_AT_ONCE))) as pool:  # times are those of fits side by side
        results = pool.map(fit, names, chunksize=1)
    rows = []
    for r in results:
        for row in r.metrics.collect():
            rows.append((r.name, row["metric"], row["value"], r.fit_seconds))
    table = train.sparkSession.createDataFrame(rows, "model string, metric string, value double, fit_seconds double")
    order = [n for n, _ in rank_scores({r.name: metric_value(r.metrics, m) for r in results}, higher)]
    return next(r for r in results if r.name == order[0]), table


# ----------------------------------------------------------------------------- F12-F14

def draw_params(name: str, n_iter: int, seed: int = K.SEED, grid: dict | None = None) -> list[dict]:
    """Seeded draw of ``n_iter`` distinct combinations from the family grid (all when fewer)."""
    grid = grid or GRIDS.get(canonical(name), {})
    keys = sorted(grid)
    combos = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    if len(combos) <= n_iter:
        return combos
    return random.Random(seed).sample(combos, n_iter)


def small_data_params(name: str) -> dict:
    """the fixed settings for small data."""
    fam = canonical(name)
    if "RandomForest" in fam:
        return {"numTrees": 150, "maxDepth": 8}
    if "GBT" in fam:
        return {"maxIter": 150, "maxDepth": 8}
    return {"LogisticRegression": {"C": 1.0}, "Ridge": {"alpha": 1.0}, "Lasso": {"alpha": 1.0}}.get(fam, {})


def tune(df: DataFrame, t: str, name: str, problem_type: str, n_iter: int = K.TUNE_DRAWS, folds: int = K.TUNE_FOLDS,
         metric: str | None = None, seed: int = K.SEED, mode: str = "search",
         grid: dict | None = None, key: Sequence[str] | str | None = None) -> tuple[dict, DataFrame]:
    """F12 (``mode="search"``): randomised search by k-fold CV (mean score). F13 (``mode="small_data"``): the same
    evaluation of the one fixed small-data setting. The caller picks the mode; K.TUNE_SMALL_ROWS is what the
    reference goes by. Returns (best params, (params, score) table)."""
    if mode not in ("search", "small_data"):
        raise ValueError(f"unknown mode {mode!r}")
    draws = [small_data_params(name)] if mode == "small_data" else draw_params(name, n_iter, seed, grid)
    return _searched(df, t, [(name, draws)], problem_type, folds, metric, seed, key)[0]


def tune_many(df: DataFrame, t: str, names: Sequence[str], problem_type: str, n_iter: int = K.TUNE_DRAWS, folds: int = K.TUNE_FOLDS,
              metric: str | None = None, seed: int = K.SEED, grids: dict | None = None, key: Key = None) -> list[tuple[dict, DataFrame]]:
    """F12 for several learners at once, on the same folds: what ``tune`` gives for each."""
    jobs = [(name, draw_params(name, n_iter, seed, (grids or {}).get(name))) for name in names]
    return _searched(df, t, jobs, problem_type, folds, metric, seed, key)


def _searched(df: DataFrame, t: str, jobs: list, problem_type: str, folds: int, metric: str | None, seed: int, key: Key) -> list[tuple[dict, DataFrame]]:
    _, higher = primary(problem_type, metric)
    out = []
    for (_, draws), got in zip(jobs, fold_scores(df, t, jobs, problem_type, folds, metric, seed, key)):
        for x in got:
            if isinstance(x, Exception):
                raise x
        ranked = rank_scores({json.dumps(p, sort_keys=True): mean_score(x) for p, x in zip(draws, got)}, higher)
        out.append((json.loads(ranked[0][0]), df.sparkSession.createDataFrame(ranked, "params string, score double")))
    return out


# ----------------------------------------------------------------------------- F16-F19

def feature_names(model: PipelineModel) -> list[str]:
    """Names of the assembled vector slots: numerics (in order), then ``<col>_<level>`` per one-hot
    level (dropLast removes only the unseen-level bucket)."""
    out: list[str] = []
    levels: list[str] = []
    for st in model.stages:
        kind = type(st).__name__
        if kind == "VectorAssembler" and st.getOutputCol() == "__num":
            out = list(st.getInputCols())
        elif kind == "StringIndexerModel":
            levels += [f"{st.getInputCol()}_{lv}" for lv in st.labels]
    return out + levels


def feature_importance(model: PipelineModel, k: int = 10) -> DataFrame:
    """top-k (feature, importance): tree importances, or mean |coefficient| over classes."""
    import numpy as np
    est = model.stages[-1]
    names = feature_names(model)
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray()
    elif hasattr(est, "coefficientMatrix"):
        vals = np.abs(est.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(est, "coefficients"):
        vals = np.abs(est.coefficients.toArray())
    elif hasattr(est, "models"):  # one-vs-rest over GBT
        vals = np.mean([m.featureImportances.toArray() for m in est.models], axis=0)
    else:
        vals = np.zeros(len(names))
    pairs = sorted(zip(names, [float(v) for v in vals]), key=lambda p: (-p[1], p[0]))[:k]
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession().createDataFrame(pairs, "feature string, importance double")


def save_pipeline(model: PipelineModel, path: str, threshold: float = 0.5) -> str:
    """Model directory plus a one-row threshold table next to it."""
    from pyspark.sql import SparkSession
    model.write().overwrite().save(path)
    SparkSession.getActiveSession().createDataFrame([(float(threshold),)], "threshold double") \
        .write.mode("overwrite").parquet(path.rstrip("/") + "_threshold")
    return path


def score(df: DataFrame, path: str, t: str | None = None) -> DataFrame:
    """load the saved pipeline and threshold; add ``score`` and ``prediction`` at the threshold."""
    model = PipelineModel.load(path)
    th = df.sparkSession.read.parquet(path.rstrip("/") + "_threshold").first()["threshold"]
    out = model.transform(df)
    if "probability" in out.columns:
        s = vector_to_array("probability")[1]
        out = out.withColumn("score", s).withColumn("prediction", (s >= F.lit(th)).cast("double"))
    keep = [x for x in df.columns] + [x for x in ("score", "prediction") if x in out.columns]
    return out.select(*keep)


def balanced_retry(train: DataFrame, test: DataFrame, t: str, current_f1: float, limit: float = 0.75,
                   params: dict | None = None, exclude: Sequence[str] | str | None = ()) -> tuple[str, float]:
    """when F1 < limit, train a class-weighted boosted model and keep the better one.
    Returns (winner, f1)."""
    if current_f1 >= limit:
        return "current", current_f1
    weighted = compact(E.class_weights(train, t)).persist()
    pipe = model_pipeline(weighted, t, "LGBMClassifier", "binary_classification", params, weight="weight", exclude=exclude)
    model = pipe.fit(weighted)
    weighted.unpersist()
    f1 = score_of(model, test, t, "binary_classification", "f1_binary")
    return ("balanced_gbt", f1) if f1 is not None and f1 > current_f1 else ("current", current_f1)


# ----------------------------------------------------------------------------- G18

def learning_curve(df: DataFrame, t: str, name: str, problem_type: str, folds: int = 3, steps: int = 6,
                   params: dict | None = None, seed: int = K.SEED, key: Sequence[str] | str | None = None) -> DataFrame:
    """(size, train_mean, train_std, val_mean, val_std) for nested training subsets x folds."""
    m, _ = primary(problem_type)
    folded = E.add_fold(df, folds, t if problem_type != "regression" else None, seed, key)
    # subsets use another seed: with the fold seed, low hashes would be both fold 0 and subset 0
    folded = E.learning_subsets(folded, E.learning_sizes(steps), seed + 1, key).persist()
    rows = []
    for s in range(steps):
        tr_scores, va_scores, size = [], [], 0
        for f in range(folds):
            train = folded.where((F.col("fold") != f) & (F.col("subset") <= s)).drop("fold", "subset")
            val = folded.where(F.col("fold") == f).drop("fold", "subset")
            model = model_pipeline(train, t, name, problem_type, params, exclude=key).fit(train)
            tr_scores.append(score_of(model, train, t, problem_type, m))
            va_scores.append(score_of(model, val, t, problem_type, m))
            size = train.count()
        import statistics as st
        rows.append((int(size), st.fmean(tr_scores), st.pstdev(tr_scores), st.fmean(va_scores), st.pstdev(va_scores)))
    folded.unpersist()
    return df.sparkSession.createDataFrame(rows, "size int, train_mean double, train_std double, val_mean double, "
                                                 "val_std double")
