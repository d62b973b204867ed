"""Registered queries for sources/sinks (A), modelling (F), composed stages and presets.

Model fits have no SQL oracle (rows-only check); learners have the operators'
full sizes and every fit reads the whole frame. Source round trips are checked
against the original tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import split as E
from ..session import shared_path
from ..sources import tables as A
from . import catalog_eval as EV
from . import frames as FR
from . import presets as PR
from . import stages as S
from .rules import build_plan

Q: dict = {}
SQL: dict = {}


def reg(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


DOCS = FR.LABELLED_DOCS_SQL
SIZES = {"RandomForestClassifier": {"numTrees": 100, "maxDepth": 10},
         "LogisticRegression": {"maxIter": 500, "C": 1.0}}
_FEATS = ["n_chars", "text_len", "n_words", "n_lines", "n_periods"]


def _docs_model_frame(spark, d):
    return FR.doc_features(spark, d).select("doc_id", "quality", "lang", *_FEATS)


# ----------------------------------------------------------------------------- A1-A12

@reg("a01_csv_roundtrip", "SELECT * FROM customer")
def a01(spark, d):
    cu = FR.table(spark, d, "customer")
    path = shared_path(spark, "customer-csv")
    A.write_table(cu, path, fmt="csv")
    return A.read_table(spark, path, fmt="csv", schema=cu.schema)


@reg("a02_headerless_csv", "SELECT n_nationkey AS nation, n_name AS name, n_regionkey AS region FROM nation")
def a02(spark, d):
    na = FR.table(spark, d, "nation")
    path = shared_path(spark, "nation-csv")
    A.write_table(na, path, fmt="csv", header=False)
    schema = "nation int, name string, region int"
    return A.read_table(spark, path, fmt="csv", schema=schema, header=False)


#: Spark's names of DuckDB's column types, for schema-only results.
SPARK_TYPE = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE column_type END"""


@reg("a03_table_columns", f"""
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS "column", {SPARK_TYPE} AS dtype
FROM (DESCRIBE SELECT * FROM lineitem)
""")
def a03(spark, d):
    return A.table_columns(FR.table(spark, d, "lineitem"))


@reg("a04_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def a04(spark, d):
    return A.preview(FR.table(spark, d, "orders"), 5, order=["o_orderkey"])


@reg("a05_row_count", "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM lineitem")
def a05(spark, d):
    return spark.createDataFrame([(A.row_count(FR.table(spark, d, "lineitem")),)], "n_rows bigint")


_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
_NUMBERS = [x for x, kind in _CUSTOMER.items() if kind != "string"]
_STATS = {"count": "count({0})", "mean": "avg({0})", "std": "stddev_samp({0})", "min": "min({0})", "p25": "quantile_cont({0}, 0.25)",
          "p50": "quantile_cont({0}, 0.5)", "p75": "quantile_cont({0}, 0.75)", "max": "max({0})"}
_CELLS = [f"SELECT 'shape' AS section, NULL AS \"column\", '{item}' AS item, NULL AS text, {value} AS value {source}"
          for item, value, source in (("n_rows", "count(*)", "FROM customer"), ("n_cols", len(_CUSTOMER), ""))]
_CELLS += [f"SELECT 'columns', '{x}', 'dtype', '{kind}', NULL" for x, kind in _CUSTOMER.items()]
_CELLS += [f"SELECT 'head', '{x}', 'row ' || rk, {'NULL' if x in _NUMBERS else x}, {x if x in _NUMBERS else 'NULL'} FROM h" for x in _CUSTOMER]
_CELLS += [f"SELECT 'nulls', '{x}', 'n_missing', NULL, count(*) - count({x}) FROM customer" for x in _CUSTOMER]
_CELLS += [f"SELECT 'describe', '{x}', '{k}', NULL, {f.format(x)} FROM customer" for x in _NUMBERS for k, f in _STATS.items()]


@reg("a06_preview_report", f"""
WITH h AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS rk FROM customer QUALIFY rk <= 5)
SELECT section, "column", item, text, ROUND(CAST(value AS DOUBLE), 6) AS value FROM ({" UNION ALL ".join(_CELLS)})
""")
def a06(spark, d):
    """All five parts of the report, one row per cell."""
    report = A.preview_report(FR.table(spark, d, "customer"), 5, order=["c_custkey"])
    return A.report_rows(report).withColumn("value", F.round("value", 6))


@reg("a07_admission_check", """
SELECT 'min_rows' AS "check", count(*) >= 50 AS passed, CAST(count(*) AS DOUBLE) AS observed, 50.0 AS "limit" FROM customer
UNION ALL SELECT 'min_columns', true, 5.0, 2.0
UNION ALL SELECT 'max_columns', true, 5.0, 500.0
UNION ALL SELECT 'has_numeric_column', true, 3.0, 1.0
""")
def a07(spark, d):
    return A.admission_check(FR.table(spark, d, "customer"))


@reg("a08_select_columns", "SELECT c_custkey AS id, c_acctbal AS balance, c_nationkey FROM customer")
def a08(spark, d):
    cu = FR.table(spark, d, "customer")
    return A.select_columns(cu, rename={"c_custkey": "id", "c_acctbal": "balance"}, numeric_only=True)


@reg("a10_materialize", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def a10(spark, d):
    return A.materialize(FR.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "lines")


@reg("a10_stage_store", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, ROUND(sum(l_quantity), 4) AS quantity, true AS restored
FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag
""")
def a10s(spark, d):
    """Two stages run twice over one store: the rows of the second run, whose stages are restored."""
    from ..sources import store as ST
    path = f"{d.rstrip('/')}/lineitem.parquet"
    store = ST.StageStore(spark, shared_path(spark, "stage-store"))
    steps = [("discounted", lambda x: x.where(F.col("l_discount") > 0.05).select("l_returnflag", "l_quantity"), {"above": 0.05}),
             ("by_flag", lambda x: x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity")), {})]
    for _ in range(2):
        last = ST.run_stages(store, FR.table(spark, d, "lineitem"), ST.source_key(spark, path), steps)[-1]
    return last.rows.withColumn("restored", F.lit(last.restored))


_DOC_METRICS = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "precision_binary", "recall_binary", "f1_binary"]


@reg("a12_write_metrics", f"""
SELECT 'run' AS run, {", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in _DOC_METRICS)} FROM ({EV.SQL["g01_03_classification_metrics"]})
""")
def a12(spark, d):
    """The written document, read back: its run and the entries of its nested object."""
    from ..operators import metrics as G
    m = G.classification_metrics(FR.scored_docs(spark, d))
    path = shared_path(spark, "metrics-json")
    A.write_metrics(m, path)
    return spark.read.json(path).select("run", *[F.round(f"metrics.{x}", 6).alias(x) for x in _DOC_METRICS])


# ----------------------------------------------------------------------------- F1-F8, F11, F15, F18, F19, G28

_SLOTS = " UNION ALL ".join(f"SELECT f.doc_id, CAST({i} AS INTEGER) AS slot, (f.{x} - m.{x}) / s.{x} AS value FROM f, m, s WHERE f.is_test"
                            for i, x in enumerate(_FEATS))


@reg("f01_preprocessor", f"""
WITH f AS (SELECT df.*, t.is_test FROM ({FR.DOC_FEATURES_SQL}) df JOIN ({EV.SQL["e01_split_stratified"]}) t USING (doc_id)),
     m AS (SELECT {", ".join(f"avg({x}) AS {x}" for x in _FEATS)} FROM f WHERE NOT is_test),
     s AS (SELECT {", ".join(f"stddev_samp({x}) AS {x}" for x in _FEATS)} FROM f WHERE NOT is_test),
     lv AS (SELECT lang, {len(_FEATS)} - 1 + row_number() OVER (ORDER BY lang) AS slot FROM (SELECT DISTINCT lang FROM f WHERE NOT is_test))
SELECT doc_id, slot, ROUND(value, 6) + 0.0 AS value FROM ({_SLOTS}
  UNION ALL SELECT f.doc_id, CAST(lv.slot AS INTEGER), CAST(f.lang = lv.lang AS DOUBLE) FROM f CROSS JOIN lv WHERE f.is_test)
""")
def f01(spark, d):
    """The encoded test rows, one row per slot of the vector."""
    from pyspark.ml import Pipeline
    df = _docs_model_frame(spark, d)
    train, test = E.train_test_split(df, "quality", key="doc_id")
    pipe = Pipeline(stages=M.build_preprocessor(_FEATS, ["lang"]))
    out = pipe.fit(train).transform(test)
    from pyspark.ml.functions import vector_to_array
    return out.select("doc_id", F.posexplode(vector_to_array("features")).alias("slot", "value")) \
        .withColumn("value", F.round("value", 6) + 0.0)


@reg("f02_08_learners")
def f02(spark, d):
    df = _docs_model_frame(spark, d).drop("doc_id")
    train, test = E.train_test_split(df, "quality")
    _, table = M.train_and_select(train, test, "quality", ["LogisticRegression", "RandomForestClassifier",
                                                          "XGBClassifier"], "binary_classification")
    reg_df = FR.priced_lineitem(spark, d).select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "net")
    rtrain, rtest = E.train_test_split(reg_df, None, stratify=False)
    _, rtable = M.train_and_select(rtrain, rtest, "net", ["LinearRegression", "Ridge", "Lasso", "RandomForestRegressor",
                                                         "LGBMRegressor"], "regression")
    return table.unionByName(rtable).select("model", "metric", "value")


def _line_sql(model: str, slope: str) -> str:
    return f"""SELECT '{model}' AS model, ROUND(my - ({slope}) * mx, 3) AS at_zero, ROUND({slope}, 5) AS slope FROM s"""


@reg("f07_08_linear_closed_form", f"""
WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS mx, avg(net) AS my, stddev_samp(l_extendedprice) AS sd,
                  regr_sxx(net, l_extendedprice) AS sxx, regr_sxy(net, l_extendedprice) AS sxy FROM ({FR.PRICED_LINEITEM_SQL}))
{_line_sql("LinearRegression", "sxy / sxx")}
UNION ALL {_line_sql("Ridge", "sxy / sd / (sxx / sd / sd + 1000.0) / sd")}
UNION ALL {_line_sql("Lasso", "greatest(sxy / sd / n - 100.0, 0) / (sxx / sd / sd / n) / sd")}
""")
def f07(spark, d):
    """OLS, ridge and lasso on one standardised feature have closed forms: slope and value at zero of the fitted pipeline."""
    df = FR.priced_lineitem(spark, d).select("l_extendedprice", "net")
    probe = spark.createDataFrame([(0.0, 0.0), (1000.0, 0.0)], "l_extendedprice double, net double")
    out = None
    for name, params in (("LinearRegression", None), ("Ridge", {"alpha": 1000.0}), ("Lasso", {"alpha": 100.0})):
        model = M.model_pipeline(df, "net", name, "regression", params).fit(df)
        line = model.transform(probe).agg(F.min_by("prediction", "l_extendedprice").alias("at_zero"),
                                          F.max_by("prediction", "l_extendedprice").alias("far"))
        row = line.select(F.lit(name).alias("model"), F.round("at_zero", 3).alias("at_zero"),
                          F.round((F.col("far") - F.col("at_zero")) / 1000, 5).alias("slope"))
        out = row if out is None else out.unionByName(row)
    return out


@reg("f09_scout")
def f09(spark, d):
    return M.scout(_docs_model_frame(spark, d), "quality", "binary_classification", "f1", key="doc_id")


@reg("f12_tune")
def f12(spark, d):
    df = FR.priced_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                             "l_discount", "l_tax", "net")
    _, search = M.tune(df, "net", "GBTRegressor", "regression", key=["l_orderkey", "l_linenumber"])
    return search


@reg("f15_cross_validate")
def f15(spark, d):
    return M.cross_validate(_docs_model_frame(spark, d), "quality", "LogisticRegression", "binary_classification",
                            params=SIZES["LogisticRegression"], key="doc_id")


@reg("f18_feature_importance")
def f18(spark, d):
    df = _docs_model_frame(spark, d)
    model = M.model_pipeline(df, "quality", "RandomForestClassifier", "binary_classification",
                             SIZES["RandomForestClassifier"], exclude=["doc_id"]).fit(df)
    return M.feature_importance(model, 10)


@reg("f19_save_and_score")
def f19(spark, d):
    df = _docs_model_frame(spark, d)
    model = M.model_pipeline(df, "quality", "LogisticRegression", "binary_classification",
                             SIZES["LogisticRegression"], exclude=["doc_id"]).fit(df)
    path = shared_path(spark, "model")
    M.save_pipeline(model, path, threshold=0.4)
    return M.score(df, path).select("doc_id", "score", "prediction")


@reg("f17_balanced_retry")
def f17(spark, d):
    df = _docs_model_frame(spark, d).drop("doc_id", "lang")
    train, test = E.train_test_split(df, "quality")
    winner, f1 = M.balanced_retry(train, test, "quality", current_f1=0.0)
    return spark.createDataFrame([(winner, f1)], "winner string, f1 double")


@reg("g18_learning_curve")
def g18(spark, d):
    df = _docs_model_frame(spark, d).drop("lang")
    return M.learning_curve(df, "quality", "LogisticRegression", "binary_classification", folds=3, steps=6,
                            params=SIZES["LogisticRegression"], key="doc_id")


# ----------------------------------------------------------------------------- composed stages and presets

@reg("c34_cleaning_log")
def c34(spark, d):
    df = FR.dirty_lineitem(spark, d)
    plan = build_plan(df, "l_returnflag")
    fitted, _ = S.Cleaner(plan).fit(df)
    return fitted.log(spark)


@reg("h01_gate_after_cleaner")
def h01c(spark, d):
    from ..operators import audit as H
    df = FR.dirty_lineitem(spark, d)
    plan = build_plan(df, "l_returnflag")
    _, cleaned = S.Cleaner(plan).fit(df)
    return H.gate_cleaned(cleaned, "l_returnflag")


@reg("d20_featurizer_gate")
def d20g(spark, d):
    df = FR.doc_features(spark, d).drop("doc_id", "toxic")
    plan = build_plan(df, "quality")
    _, cleaned = S.Cleaner(plan).fit(df)
    _, _, report, gate = S.Featurizer(plan).fit(cleaned)
    return gate


@reg("f20_baseline_run")
def f20(spark, d):
    _, table = PR.baseline_run(_docs_model_frame(spark, d), "quality", key="doc_id")
    return table.select("model", "f1_binary")


@reg("f22_ablation")
def f22(spark, d):
    df = _docs_model_frame(spark, d)
    base = ["doc_id", "quality", "fold", "n_chars"]

    def counts(x):
        return x.drop("lang")

    def engineered(x):
        return x.withColumns({"words_per_line": F.col("n_words") / (1 + F.col("n_lines")), "log_len": F.log1p("text_len"),
                              "len_squared": F.col("text_len") ** 2})

    logistic, boosted = ("LogisticRegression", SIZES["LogisticRegression"]), ("LGBMClassifier", None)
    configs = {"baseline": (lambda x: x.select(*base), *logistic), "cleaned": (counts, *logistic),
               "engineered": (engineered, *logistic), "prescreened": (engineered, *boosted),
               "critic": (lambda x: engineered(x).drop("n_periods"), *boosted),
               "feedback": (lambda x: engineered(x).withColumn("words_x_lines", F.col("n_words") * F.col("n_lines")), *boosted)}
    scores, summary = PR.ablation(df, "quality", configs, key="doc_id")
    return summary


@reg("f23_regression_run")
def f23(spark, d):
    df = FR.priced_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                             "l_discount", "l_tax", "net")
    out = PR.regression_run(df, "net", key=["l_orderkey", "l_linenumber"])
    return out["comparison"].select("model", "metric", "value")


@reg("f24_evaluate_many")
def f24(spark, d):
    docs = _docs_model_frame(spark, d)
    tables = {"quality": (docs, "quality", ["doc_id"]),
              "toxic": (FR.doc_features(spark, d).select("toxic", *_FEATS), "toxic", [])}
    return PR.evaluate_many(tables)[0]


@reg("f24_calibration")
def f24c(spark, d):
    return PR.evaluate_many({"quality": (_docs_model_frame(spark, d), "quality", ["doc_id"])})[1]


@reg("f21_full_run")
def f21(spark, d):
    df = _docs_model_frame(spark, d).drop("lang")
    out = PR.full_run(df, "quality", key="doc_id")
    return out["ranking"]


@reg("f13_tune_small_data")
def f13(spark, d):
    df = _docs_model_frame(spark, d).drop("lang")
    best, table = M.tune(df, "quality", "RandomForestClassifier", "binary_classification", mode="small_data", key="doc_id")
    return table


@reg("f14_fixed_search")
def f14(spark, d):
    out = PR.fixed_search(_docs_model_frame(spark, d).drop("lang"), "quality", key="doc_id")
    return out.select("model", "params", "f1_binary")


@reg("g28_fit_seconds")
def g28(spark, d):
    df = _docs_model_frame(spark, d).drop("doc_id")
    pipe = M.model_pipeline(df, "quality", "LogisticRegression", "binary_classification", SIZES["LogisticRegression"])
    _, secs = M.fit_timed(pipe, df)
    return spark.createDataFrame([("LogisticRegression", secs > 0)], "model string, timed boolean")


@reg("b20_24_plan_rules")
def b20(spark, d):
    plan = build_plan(FR.labelled_docs(spark, d), "quality")
    rows = [("problem_type", plan.problem_type), ("metric", plan.metric),
            ("imbalance_strategy", plan.imbalance_strategy), ("models", ",".join(plan.models)),
            ("id_columns", ",".join(plan.id_columns)), ("text_columns", ",".join(plan.text_columns)),
            ("skewed_columns", ",".join(plan.skewed_columns)),
            ("feature_flags", ",".join(k for k in ["log_transform", "missing_flags", "prune_correlated",
                                                   "interactions", "polynomial", "bins"] if getattr(plan, k)))]
    return spark.createDataFrame(rows, "rule string, value string")


@reg("h03_gate_model")
def h03(spark, d):
    from ..operators import audit as H
    df = _docs_model_frame(spark, d).drop("doc_id")
    train, test = E.train_test_split(df, "quality")
    model = M.model_pipeline(train, "quality", "LogisticRegression", "binary_classification",
                             SIZES["LogisticRegression"]).fit(train)
    path = shared_path(spark, "gated-model")
    M.save_pipeline(model, path)
    metrics = M.evaluate(model, test, "quality", "binary_classification", curves=False)
    return H.gate_model(spark, metrics, "binary_classification", path, path)


@reg("s01_stream_scoring")
def s01(spark, d):
    from ..streaming.apply import score_stream
    docs = FR.table(spark, d, "documents")
    feats = docs.select("doc_id", "lang", F.length("text").cast("double").alias("text_len"),
                        F.col("n_chars").cast("double").alias("n_chars"))
    labelled = feats.join(FR.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    model = M.model_pipeline(labelled, "quality", "LogisticRegression", "binary_classification",
                             SIZES["LogisticRegression"], exclude=["doc_id"]).fit(labelled)
    path = shared_path(spark, "stream-model")
    M.save_pipeline(model, path, threshold=0.5)

    def prepare(stream):
        return stream.select("doc_id", "lang", F.length("text").cast("double").alias("text_len"),
                             F.col("n_chars").cast("double").alias("n_chars"))
    # a file source needs a directory or a glob; the one-character class matches exactly this file
    return score_stream(spark, f"{d.rstrip('/')}/documents.parque[t]", docs.schema, path, prepare)


@reg("z_run_all")
def z_run_all(spark, d):
    df = FR.doc_features(spark, d).drop("toxic")
    out = S.run_all(df, "quality", key="doc_id")
    return out["metrics"]
