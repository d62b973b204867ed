"""Gates and audits (H1-H15). Every gate returns rows (gate, passed, observed, limit).

Data gates are one aggregate over the frame; audits over features reuse the
profile correlations; the overlap audit is a distinct + left-semi join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import hash128
from ..functions.exprs import c, dtype_of, is_fractional, is_numeric, numeric_cols
from . import profile as P

GATE_SCHEMA = "gate string, passed boolean, observed double, limit double"
AUDIT_SCHEMA = "column string, observed double, flagged boolean"


def _rows(spark, rows) -> DataFrame:
    return spark.createDataFrame(
        [(g, p if p is None else bool(p), None if o is None else float(o), None if lim is None else float(lim))
         for g, p, o, lim in rows], GATE_SCHEMA)


def _null_and_inf(df: DataFrame, cols: Sequence[str]):
    any_null = F.lit(False)
    any_inf = F.lit(False)
    for x in cols:
        any_null = any_null | c(x).isNull() | (F.isnan(c(x)) if is_fractional(df.schema[x].dataType) else F.lit(False))
        if is_fractional(df.schema[x].dataType):
            any_inf = any_inf | (F.abs(c(x)) == F.lit(float("inf")))
    return any_null, any_inf


# ----------------------------------------------------------------------------- H1, H2

def gate_cleaned(df: DataFrame, t: str) -> DataFrame:
    """H1: no nulls, unique names, target present and numeric; duplicate % and rows are information."""
    any_null, _ = _null_and_inf(df, df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(any_null).alias("null_rows")).first()
    # rows are told apart by 128-bit hashes, so no whole row is shuffled
    n_distinct = df.select(*hash128(*[c(x) for x in df.columns])).distinct().count() if df.columns else 0
    present = t in df.columns
    dup_pct = round((row["n"] - n_distinct) / row["n"] * 100, 1) if row["n"] else 0.0
    return _rows(df.sparkSession, [
        ("no_missing_values", row["null_rows"] == 0, row["null_rows"], 0),
        ("no_duplicate_columns", len(set(df.columns)) == len(df.columns), len(df.columns) - len(set(df.columns)), 0),
        ("target_column_present", present, 1.0 if present else 0.0, 1),
        ("target_is_numeric", present and is_numeric(df.schema[t].dataType), None, None),
        ("duplicate_row_pct", None, dup_pct, None),
        ("row_count", None, row["n"], None),
    ])


def gate_features(df: DataFrame, t: str, n_before: int) -> DataFrame:
    """H2: no nulls, no infinities, unique names, target present; column growth reported."""
    any_null, any_inf = _null_and_inf(df, df.columns)
    row = df.agg(F.count_if(any_null).alias("nulls"), F.count_if(any_inf).alias("infs")).first()
    return _rows(df.sparkSession, [
        ("no_missing_values", row["nulls"] == 0, row["nulls"], 0),
        ("no_infinite_values", row["infs"] == 0, row["infs"], 0),
        ("no_duplicate_columns", len(set(df.columns)) == len(df.columns), len(df.columns) - len(set(df.columns)), 0),
        ("target_column_present", t in df.columns, 1.0 if t in df.columns else 0.0, 1),
        ("feature_count_grew", None, len(df.columns), n_before),
    ])


# ----------------------------------------------------------------------------- H3-H7

def gate_model(spark, metrics: DataFrame, problem_type: str, model_path: str | None = None,
               preprocessor_path: str | None = None) -> DataFrame:
    """H3: artifacts load; the headline metric is in range (R2 in (-1, 1); class metric in (0, 0.999))."""
    def loads(path):
        if not path:
            return False
        try:
            from pyspark.ml import PipelineModel
            PipelineModel.load(path)
            return True
        except Exception:  # noqa: BLE001 - any load failure fails the gate
            return False
    key = "r2" if problem_type == "regression" else "f1_weighted"
    r = metrics.where(F.col("metric") == key).first()
    v = None if r is None else r["value"]
    ok = v is not None and ((-1 < v < 1) if problem_type == "regression" else (0 < v < 0.999))
    return _rows(spark, [("model_artifact_exists", loads(model_path), None, None),
                         ("preprocessor_artifact_exists", loads(preprocessor_path), None, None),
                         ("metric_reasonable", ok, v, None)])


def gate_retention(before: DataFrame, after: DataFrame, tol: float = 0.10, duplicates_removed: int = 0) -> DataFrame:
    """H4: rows kept within ``tol`` of the input; rows lost to duplicate removal are reported apart."""
    nb, na = before.count(), after.count()
    lost_other = nb - na - duplicates_removed
    share = lost_other / nb if nb else 0.0
    return _rows(before.sparkSession, [("row_retention", share <= tol, share, tol),
                                       ("rows_lost_to_duplicates", None, duplicates_removed, None)])


def gate_stability(folds: DataFrame, value: str = "score", max_std: float = 0.10) -> DataFrame:
    """H5: std (population) < max_std and no fold beyond 2 std of the mean."""
    row = folds.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
    m, s = row["m"], row["s"] or 0.0
    worst = folds.agg(F.max(F.abs(F.col(value) - F.lit(m))).alias("d")).first()["d"] if m is not None else None
    return _rows(folds.sparkSession, [("cv_std", s < max_std, s, max_std),
                                      ("no_fold_beyond_2_sigma", worst is not None and worst <= 2 * s, worst, 2 * s)])


def gate_lift(spark, metric: float, baseline: float, min_lift: float = 0.02) -> DataFrame:
    """H6: metric >= baseline; relative lift >= min_lift for the quality bar."""
    lift = (metric - baseline) / abs(baseline) if baseline else None
    return _rows(spark, [("beats_baseline", metric >= baseline, metric, baseline),
                         ("lift_at_least", lift is not None and lift >= min_lift, lift, min_lift)])


def gate_repeatable(make: Callable[[], DataFrame]) -> DataFrame:
    """H7: two runs give the same multiset of rows (exceptAll both ways empty)."""
    a, b = make(), make()
    diff = a.exceptAll(b).count() + b.exceptAll(a).count()
    return _rows(a.sparkSession, [("identical_reruns", diff == 0, diff, 0)])


# ----------------------------------------------------------------------------- H8-H11

def audit_proxy(df: DataFrame, t: str, limit: float = 0.9, cols: Sequence[str] | None = None) -> DataFrame:
    """H8: features with |r| to the target above ``limit``."""
    tr = P.target_correlations(df, t, cols, digits=None)
    return tr.select("column", F.col("abs_r").alias("observed"), (F.col("abs_r") > limit).alias("flagged"))


def audit_overlap(train: DataFrame, test: DataFrame, features: Sequence[str]) -> DataFrame:
    """H9: test rows whose feature tuple also occurs in train (null-safe), by a semi join on 128-bit hashes of the tuple.

    The train side is de-duplicated first, so a hot tuple is one row there; AQE splits a skewed
    test side."""
    def keys(df: DataFrame) -> DataFrame:
        # zero has one sign and NaN one form, as in a comparison of the values
        plain = [c(x) + F.lit(0.0) if is_fractional(dtype_of(df, x)) else c(x) for x in features]
        return df.select(*hash128(*plain))
    hit = keys(test).join(keys(train).distinct(), ["_h1", "_h2"], "left_semi")
    n_test = test.count()
    n_hit = hit.count()
    return _rows(train.sparkSession, [("test_rows_seen_in_train", n_hit == 0, n_hit, 0),
                                      ("test_rows", None, n_test, None)])


def audit_target_copy(df: DataFrame, t: str, cols: Sequence[str] | None = None, r_limit: float = 0.999) -> DataFrame:
    """A feature that is (a scaled copy of) the target: |r| >= r_limit, or a 1:1 mapping with the target, at any number
    of values: each value of the one goes with a single value of the other, in both directions, and some value repeats (between
    columns without repeats every mapping is 1:1, which says nothing). A null goes with no value."""
    cols = [x for x in (cols or df.columns) if x != t]
    num = [x for x in cols if is_numeric(df.schema[x].dataType)]
    tr = {r["column"]: r["abs_r"] for r in P.target_correlations(df, t, num, digits=None).collect()} if num else {}
    # target -> feature for all columns in one grouped aggregate; few columns pass
    sides = df.where(c(t).isNotNull()).groupBy(c(t).alias("_t")).agg(
        *[F.coalesce(F.min(c(x)) == F.max(c(x)), F.lit(False)).alias(f"_f{i}") for i, x in enumerate(cols)])
    row = sides.agg(*[F.bool_and(f"_f{i}").alias(f"_f{i}") for i in range(len(cols))]).first() if cols else {}
    pairs = set()
    for i, x in enumerate(cols):
        if row[f"_f{i}"]:
            back = df.where(c(x).isNotNull()).groupBy(c(x).alias("_x")).agg(
                F.coalesce(F.min(c(t)) == F.max(c(t)), F.lit(False)).alias("_f"), (F.count(c(t)) > 1).alias("_more"))
            found = back.agg(F.bool_and("_f").alias("f"), F.bool_or("_more").alias("more")).first()
            if found["f"] and found["more"]:
                pairs.add(x)
    rows = [(x, None if tr.get(x) is None else float(tr[x]), x in pairs, x in pairs or (tr.get(x) is not None and tr[x] >= r_limit))
            for x in cols]
    return df.sparkSession.createDataFrame(rows, "column string, abs_r double, one_to_one boolean, flagged boolean")


def audit_redundant(df: DataFrame, limit: float = 0.95, cols: Sequence[str] | None = None) -> DataFrame:
    """Feature pairs with |r| above ``limit``."""
    return P.correlation_matrix(df, cols or numeric_cols(df)).where(F.abs("r") > limit)


# ----------------------------------------------------------------------------- H12-H15

def audit_fit(spark, train_metric: float, test_metric: float, max_gap: float = 0.10,
              too_good: float = 0.999) -> DataFrame:
    """Large train-test gap or a suspiciously perfect test metric."""
    gap = train_metric - test_metric
    return _rows(spark, [("overfit_gap", gap <= max_gap, gap, max_gap),
                         ("not_too_good", test_metric < too_good, test_metric, too_good)])


def audit_imbalance(spark, ratio: float | None, threshold: float, has_pr_auc: bool, limit: float = 0.3) -> DataFrame:
    """Below ``limit`` the threshold must be tuned below 0.5 and PR-AUC reported."""
    need = ratio is not None and ratio < limit
    return _rows(spark, [("threshold_tuned", (not need) or threshold < 0.5, threshold, 0.5),
                         ("pr_auc_reported", (not need) or has_pr_auc, ratio, limit)])


ALLOWED = {
    "regression": ["rmse", "mae", "mape", "r2"],
    "classification": ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "precision_binary",
                       "recall_binary", "f1_binary", "roc_auc", "average_precision", "pr_auc", "brier",
                       "positive_rate"],
}


def audit_metrics(metrics: DataFrame, problem_type: str) -> DataFrame:
    """Metrics not allowed for the problem type (left-anti join on the allowed list), and
    classification runs must report something besides accuracy."""
    kind = "regression" if problem_type == "regression" else "classification"
    allowed = metrics.sparkSession.createDataFrame([(m,) for m in ALLOWED[kind]], "metric string")
    bad = metrics.select("metric").distinct().join(F.broadcast(allowed), "metric", "left_anti")
    n_bad = bad.count()
    names = {r["metric"] for r in metrics.select("metric").distinct().collect()}  # a handful of names
    only_acc = kind == "classification" and names <= {"accuracy"}
    return _rows(metrics.sparkSession, [("metrics_match_problem", n_bad == 0, n_bad, 0),
                                        ("not_accuracy_alone", not only_acc, len(names), None)])


def severity(gates: DataFrame, category: str = "category") -> DataFrame:
    """score = 10 x passed share per category; overall = mean. Overall < 6 or any category < 5
    is critical; < 7.5 moderate; else minor. Rows: (category, score) plus ('overall', score, level)."""
    scored = gates.where(F.col("passed").isNotNull()).groupBy(category).agg(
        (10 * F.avg(F.col("passed").cast("double"))).alias("score"))
    rows = scored.collect()  # one row per category
    overall = sum(r["score"] for r in rows) / len(rows) if rows else 0.0
    worst = min((r["score"] for r in rows), default=0.0)
    level = "critical" if overall < 6 or worst < 5 else ("moderate" if overall < 7.5 else "minor")
    out = [(r[category], float(r["score"]), None) for r in rows] + [("overall", float(overall), level)]
    return gates.sparkSession.createDataFrame(out, "category string, score double, level string")
