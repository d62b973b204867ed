"""Planning rules (B17-B26) as Column expressions over profile tables, plus a driver-side Plan.

The rules read only the per-column profile (one row per column), so the
DataFrame forms stay tiny whatever the data size; ``build_plan`` collects
that bounded profile once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import c, dtype_of, is_fractional, is_integral
from ..operators import profile as P


# ----------------------------------------------------------------------------- B17, B18

def problem_type_expr(n_unique: Column, is_float: Column, is_int: Column, t_min: Column, t_max: Column) -> Column:
    """B17 + B18 on target statistics (n_unique excludes nulls)."""
    base = (F.when(n_unique == 2, F.lit("binary_classification"))
            .when((n_unique > 2) & (n_unique <= K.MULTICLASS_MAX), F.lit("multiclass_classification"))
            .when(is_float | (n_unique > K.MULTICLASS_MAX), F.lit("regression"))
            .otherwise(F.lit("binary_classification")))
    ambiguous = is_int & (((t_min >= 1900) & (t_max <= 2100)) | ((t_max - t_min) > 50))
    return F.when((base == "multiclass_classification") & ambiguous, F.lit("regression")).otherwise(base)


def detect_problem_type(df: DataFrame, t: str) -> DataFrame:
    """One row (target, n_unique, problem_type)."""
    dt = dtype_of(df, t)
    numeric = is_integral(dt) or is_fractional(dt)
    stats = df.agg(
        F.count_distinct(c(t)).alias("n_unique"),
        (F.min(c(t)).cast("double") if numeric else F.lit(None).cast("double")).alias("t_min"),
        (F.max(c(t)).cast("double") if numeric else F.lit(None).cast("double")).alias("t_max"),
    )
    pt = problem_type_expr(F.col("n_unique"), F.lit(is_fractional(dt)), F.lit(is_integral(dt)),
                           F.col("t_min"), F.col("t_max"))
    return stats.select(F.lit(t).alias("target"), "n_unique", pt.alias("problem_type"))


# ----------------------------------------------------------------------------- B19, B20, B21

def imbalance_strategy_expr(ratio: Column) -> Column:
    """B19 ladder on the (rounded) imbalance ratio; NULL ratio (continuous) -> none."""
    return (F.when(ratio.isNull(), F.lit("none"))
            .when(ratio >= K.IMBALANCE_NONE, F.lit("none"))
            .when(ratio >= K.IMBALANCE_WEIGHTS, F.lit("class_weight_balanced"))
            .when(ratio >= K.IMBALANCE_SMOTE, F.lit("smote_plus_class_weight"))
            .otherwise(F.lit("threshold_tuning_plus_pr_auc")))


def imbalance_strategy(df: DataFrame, t: str, max_classes: int = 10) -> DataFrame:
    """B16 + B19: (n_classes, ratio, strategy)."""
    return P.imbalance_ratio(df, t, max_classes).withColumn("strategy", imbalance_strategy_expr(F.col("ratio")))


# Model shortlists by problem type and band.
SHORTLIST = {
    "regression": {"small": ["LinearRegression", "Ridge", "Lasso"],
                   "medium": ["Ridge", "RandomForestRegressor", "GBTRegressor"],
                   "large": ["GBTRegressor", "Ridge"]},
    "classification": {"small": ["LogisticRegression", "RandomForestClassifier"],
                       "medium": ["LogisticRegression", "RandomForestClassifier", "GBTClassifier"],
                       "large": ["GBTClassifier", "LogisticRegression"]},
}


def suggested_band(n_rows: int) -> str:
    """The band that the row count suggests; a plan reports it, the caller chooses."""
    return "small" if n_rows < K.ROWS_SMALL else "medium" if n_rows < K.ROWS_MEDIUM else "large"


def shortlist_models(problem_type: str, band: str = "medium") -> list[str]:
    """Candidate learners of a band. Boosted learners of the other libraries map to MLlib GBT (no alias names kept)."""
    return list(SHORTLIST["regression" if problem_type == "regression" else "classification"][band])


def default_metric(problem_type: str) -> str:
    """B21."""
    return "rmse" if problem_type == "regression" else "f1"


# ----------------------------------------------------------------------------- B22-B26 over the profile table

def null_pattern_expr(null_pct: Column) -> Column:
    """B22."""
    return (F.when(null_pct == 0, F.lit("none"))
            .when(null_pct > 0.5, F.lit("high_missing_consider_drop"))
            .otherwise(F.lit("mcar_impute")))


def is_id_name_expr(column: Column, patterns: list[str] = K.ID_PATTERNS) -> Column:
    low = F.lower(column)
    conds = [(low == F.lit(p)) | low.startswith(p + "_") | low.endswith("_" + p) for p in patterns]
    out = conds[0]
    for x in conds[1:]:
        out = out | x
    return out


def encoding_plan_expr(column: Column, n_unique: Column, max_levels: int = K.ONEHOT_MAX_LEVELS,
                       ordinals: dict[str, list[str]] | None = None) -> Column:
    """Ordinal (known order by lower-case name) / frequency (> max_levels) / onehot."""
    ordinals = K.ORDERED_ORDINALS if ordinals is None else ordinals
    names = [F.lit(k) for k in ordinals] or [F.lit("")]
    return (F.when(F.lower(column).isin(*names), F.lit("ordinal"))
            .when(n_unique > max_levels, F.lit("frequency"))
            .otherwise(F.lit("onehot")))


def plan_table(df: DataFrame, t: str) -> DataFrame:
    """Profile plus rule columns: null_pattern, is_id_like, is_constant, encoding (strings only)."""
    prof = P.profile(df, t)
    n = F.col("n_rows").cast("double")
    id_name = is_id_name_expr(F.col("column"))
    is_str = F.col("dtype") == "string"
    id_like = (F.col("role") != "target") & (
        ((F.col("n_unique") > K.ID_SHARE_STRICT * n) & (id_name | is_str))
        | (id_name & (F.col("n_unique") > K.ID_SHARE_NAMED * n)))
    return prof.select(
        "*",
        F.when(F.col("role") != "target", null_pattern_expr(F.col("null_pct"))).alias("null_pattern"),
        id_like.alias("is_id_like"),
        ((F.col("role") != "target") & (F.col("n_unique") <= 1)).alias("is_constant"),
        F.when(is_str & (F.col("role") != "target"),
               encoding_plan_expr(F.col("column"), F.col("n_unique"))).alias("encoding"),
    )


def id_like_columns(df: DataFrame, t: str) -> DataFrame:
    """(column, n_unique, n_rows) of ID-like columns."""
    return plan_table(df, t).where("is_id_like").select("column", "n_unique", "n_rows")


def constant_columns(df: DataFrame, t: str) -> DataFrame:
    """(column, n_unique) with at most one distinct value."""
    return plan_table(df, t).where("is_constant").select("column", "n_unique")


def encoding_plan(df: DataFrame, t: str) -> DataFrame:
    """(column, n_unique, encoding) for string columns."""
    return plan_table(df, t).where(F.col("encoding").isNotNull()).select("column", "n_unique", "encoding")


def null_patterns(df: DataFrame, t: str) -> DataFrame:
    """(column, null_pct, null_pattern)."""
    return plan_table(df, t).where(F.col("null_pattern").isNotNull()).select("column", "null_pct", "null_pattern")


# ----------------------------------------------------------------------------- driver-side plan

@dataclass
class Plan:
    target: str
    problem_type: str
    metric: str
    n_rows: int
    n_cols: int
    imbalance_ratio: float | None
    imbalance_strategy: str
    models: list[str]
    null_patterns: dict[str, str] = field(default_factory=dict)
    encoding: dict[str, dict] = field(default_factory=dict)
    id_columns: list[str] = field(default_factory=list)
    constant_columns: list[str] = field(default_factory=list)
    datetime_columns: list[str] = field(default_factory=list)
    text_columns: list[str] = field(default_factory=list)
    skewed_columns: list[str] = field(default_factory=list)
    top_correlations: dict[str, float] = field(default_factory=dict)
    log_transform: bool = False
    missing_flags: bool = False
    prune_correlated: bool = False
    interactions: bool = True
    polynomial: bool = False
    bins: bool = True
    suggested_band: str = "medium"


def feature_plan(n_cols: int, skewed: list[str], strategy: str) -> dict[str, bool]:
    """B24 as typed flags (the reference's string list cannot be matched as written; see README)."""
    return {
        "log_transform": bool(skewed),
        "missing_flags": strategy in ("smote_plus_class_weight", "threshold_tuning_plus_pr_auc"),
        "prune_correlated": n_cols > 50,
        "interactions": True,
        "polynomial": False,
        "bins": True,
    }


def build_plan(df: DataFrame, t: str, ordinals: dict[str, list[str]] | None = None, band: str = "medium") -> Plan:
    """Collect the bounded profile (one row per column) and apply every rule once. ``band`` picks the shortlist."""
    ordinals = K.ORDERED_ORDINALS if ordinals is None else ordinals
    table = {r["column"]: r.asDict() for r in plan_table(df, t).collect()}
    pt_row = detect_problem_type(df, t).first()
    if pt_row["n_unique"] <= 1:
        raise ValueError(f"target {t!r} has {pt_row['n_unique']} distinct value(s); nothing to learn")
    ptype = pt_row["problem_type"]
    imb = imbalance_strategy(df, t).first()
    n_rows = next(iter(table.values()))["n_rows"] if table else 0
    id_cols = [k for k, v in table.items() if v["is_id_like"]]
    dt = P.datetime_columns(df, exclude=[t] + id_cols)
    dt_cols = [r["column"] for r in dt.where("is_datetime").collect()]
    tx = P.text_columns(df, exclude=[t] + id_cols + dt_cols)
    tx_cols = [r["column"] for r in tx.where("is_text").collect()]
    skewed = [k for k, v in table.items() if v["skew"] is not None and abs(v["skew"]) > K.LOG_SKEW]
    top = {r["column"]: r["r"] for r in P.target_correlations(df, t, k=5).orderBy("rank").collect()}
    enc = {}
    for k, v in table.items():
        if v["encoding"] == "ordinal":
            enc[k] = {"kind": "ordinal", "order": ordinals[k.lower()]}
        elif v["encoding"] is not None:
            enc[k] = {"kind": v["encoding"]}
    flags = feature_plan(len(df.columns), skewed, imb["strategy"])
    return Plan(
        target=t, problem_type=ptype, metric=default_metric(ptype), n_rows=n_rows, n_cols=len(df.columns),
        imbalance_ratio=imb["ratio"], imbalance_strategy=imb["strategy"], models=shortlist_models(ptype, band), suggested_band=suggested_band(n_rows),
        null_patterns={k: v["null_pattern"] for k, v in table.items() if v["null_pattern"]},
        encoding=enc, id_columns=id_cols,
        constant_columns=[k for k, v in table.items() if v["is_constant"]],
        datetime_columns=dt_cols, text_columns=tx_cols, skewed_columns=skewed, top_correlations=top, **flags,
    )
