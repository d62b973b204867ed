"""Registered queries for splits (E), metrics (G), threshold sweep (F16) and gates (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import hex_cut
from ..functions.neighbours import nearest
from ..operators import audit as H
from ..operators import features as FE
from ..operators import metrics as G
from ..operators import profile as P
from ..operators import split as E
from . import frames as FR

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
DF = FR.DOC_FEATURES_SQL
SD = FR.SCORED_DOCS_SQL
SL = FR.SCORED_LINEITEM_SQL
CUT20 = hex_cut(0.2)


def _round_metrics(df):
    return df.withColumn("value", F.round("value", 6))


def _hv(key: str, digits: int = 15) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {key}, '42')), 1, {digits}))::BIGINT"


# ----------------------------------------------------------------------------- E1

@reg("e01_split_plain", f"""
SELECT l_orderkey, l_linenumber,
       substr(md5(concat_ws(':', l_orderkey, l_linenumber, '42')), 1, 8) < '{CUT20}' AS is_test
FROM lineitem
""")
def e01p(spark, d):
    li = FR.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return E.test_flag(li, key=["l_orderkey", "l_linenumber"])


@reg("e01_split_stratified", f"""
WITH h AS (SELECT doc_id, quality, {_hv('doc_id')} AS hv FROM ({DOCS})),
     r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY hv) - 1 AS rk,
                  count(*) OVER (PARTITION BY quality) AS nc FROM h)
SELECT doc_id, quality, rk < floor(0.2 * nc) AS is_test FROM r
""")
def e01s(spark, d):
    docs = FR.labelled_docs(spark, d).select("doc_id", "quality")
    return E.test_flag(docs, "quality", stratify=True, key="doc_id")


@reg("e01_split_counts", f"""
WITH h AS (SELECT quality, {_hv('doc_id')} AS hv FROM ({DOCS})),
     r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY hv) - 1 AS rk,
                  count(*) OVER (PARTITION BY quality) AS nc FROM h)
SELECT quality, CAST(count_if(rk < floor(0.2 * nc)) AS BIGINT) AS n_test,
       CAST(count_if(rk >= floor(0.2 * nc)) AS BIGINT) AS n_train FROM r GROUP BY quality
""")
def e01c(spark, d):
    docs = FR.labelled_docs(spark, d).select("doc_id", "quality")
    train, test = E.train_test_split(docs, "quality", key="doc_id")
    a = test.groupBy("quality").agg(F.count(F.lit(1)).alias("n_test"))
    b = train.groupBy("quality").agg(F.count(F.lit(1)).alias("n_train"))
    return a.join(b, "quality", "full").fillna(0)


# ----------------------------------------------------------------------------- E2, E3

@reg("e02_scout_sample", f"""
WITH base AS (SELECT doc_id, quality, {_hv('doc_id')} AS hv FROM ({DOCS})),
     cnt AS (SELECT quality, count(*) AS n FROM base GROUP BY quality),
     tot AS (SELECT sum(n) AS total FROM cnt),
     sz AS (SELECT least(total, greatest(200, least(2000, CAST(floor(total * 0.1) AS BIGINT)))) AS size FROM tot),
     q AS (SELECT quality, (SELECT size FROM sz) * n / (SELECT total FROM tot) AS quota FROM cnt),
     a AS (SELECT quality, floor(quota) AS base, quota - floor(quota) AS frac FROM q),
     rem AS (SELECT (SELECT size FROM sz) - sum(base) AS r FROM a),
     alloc AS (SELECT quality, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, quality) <= (SELECT r FROM rem)
                                         THEN 1 ELSE 0 END AS alloc FROM a),
     rk AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY hv) AS rn FROM base)
SELECT doc_id, quality FROM rk JOIN alloc USING (quality) WHERE rn <= alloc
""")
def e02(spark, d):
    docs = FR.labelled_docs(spark, d).select("doc_id", "quality")
    return E.scout_sample(docs, "quality", key="doc_id")


@reg("e03_sample_n", "SELECT doc_id FROM documents ORDER BY md5(concat_ws(':', doc_id, '42')) LIMIT 200")
def e03(spark, d):
    return E.sample_n(FR.table(spark, d, "documents").select("doc_id"), 200, key="doc_id")


# ----------------------------------------------------------------------------- E4, E5

@reg("e04_kfold_plain", f"""
SELECT l_orderkey, l_linenumber,
       CAST(floor({_hv("l_orderkey, l_linenumber", 8)} / 4294967296.0 * 5) AS INTEGER) AS fold
FROM lineitem
""")
def e04p(spark, d):
    li = FR.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return E.add_fold(li, 5, key=["l_orderkey", "l_linenumber"])


@reg("e04_kfold_stratified", f"""
WITH h AS (SELECT doc_id, quality, {_hv('doc_id')} AS hv FROM ({DOCS})),
     r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY hv) - 1 AS rk,
                  count(*) OVER (PARTITION BY quality) AS nc FROM h)
SELECT doc_id, quality,
       CAST((rk >= floor(1 * nc / 5))::INT + (rk >= floor(2 * nc / 5))::INT + (rk >= floor(3 * nc / 5))::INT
            + (rk >= floor(4 * nc / 5))::INT AS INTEGER) AS fold
FROM r
""")
def e04s(spark, d):
    docs = FR.labelled_docs(spark, d).select("doc_id", "quality")
    return E.add_fold(docs, 5, t="quality", key="doc_id")


@reg("e05_safe_folds", f"""
SELECT 'lineitem' AS "table", CAST(least(5, greatest(2, count(*) // 20)) AS INTEGER) AS folds FROM lineitem
UNION ALL SELECT 'labelled_docs', CAST(least(5, greatest(2, count(*) // 20)) AS INTEGER) FROM ({DOCS})
UNION ALL SELECT 'benchmark', CAST(least(5, greatest(2, count(*) // 20)) AS INTEGER) FROM benchmark
""")
def e05(spark, d):
    frames = {"lineitem": FR.table(spark, d, "lineitem"), "labelled_docs": FR.labelled_docs(spark, d),
              "benchmark": FR.table(spark, d, "benchmark")}
    rows = [(k, E.safe_folds(v.count())) for k, v in frames.items()]
    return spark.createDataFrame(rows, "table string, folds int")


# ----------------------------------------------------------------------------- E6-E9

_SMOTE_FEATS = ["n_chars", "text_len", "n_words", "n_lines", "n_periods"]


@reg("e06_smote_class_counts", f"""
WITH c AS (SELECT quality, count(*) AS n FROM ({DOCS}) GROUP BY quality)
SELECT quality, CAST((SELECT max(n) FROM c) AS BIGINT) AS n FROM c
""")
def e06(spark, d):
    df = FR.doc_features(spark, d).select("quality", *_SMOTE_FEATS)
    out = E.smote(df, "quality", _SMOTE_FEATS)
    return out.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@reg("e06_smote_projected_counts", f"""
WITH c AS (SELECT quality, count(*) AS n FROM ({DOCS}) GROUP BY quality)
SELECT quality, CAST((SELECT max(n) FROM c) AS BIGINT) AS n FROM c
""")
def e06p(spark, d):
    df = FR.doc_features(spark, d).select("quality", *_SMOTE_FEATS)
    out = E.smote(df, "quality", _SMOTE_FEATS, k=3)
    return out.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@reg("e06_smote_neighbours", f"""
WITH p AS (SELECT quality, n_chars, text_len, n_words, n_lines, n_periods, count(*) AS copies FROM ({DF}) GROUP BY ALL),
     q AS (SELECT a.quality, a.n_chars, a.n_words, a.n_lines, a.n_periods, a.text_len, a.copies,
                  sqrt((a.n_chars - b.n_chars) ** 2 + (a.text_len - b.text_len) ** 2 + (a.n_words - b.n_words) ** 2
                       + (a.n_lines - b.n_lines) ** 2 + (a.n_periods - b.n_periods) ** 2) AS d
           FROM p a JOIN p b ON a.quality = b.quality AND (a.n_chars, a.text_len, a.n_words, a.n_lines, a.n_periods)
                                                          IS DISTINCT FROM (b.n_chars, b.text_len, b.n_words, b.n_lines, b.n_periods)),
     r AS (SELECT *, row_number() OVER (PARTITION BY quality, n_chars, text_len, n_words, n_lines, n_periods ORDER BY d) AS rank FROM q)
SELECT quality, n_chars, n_words, n_lines, n_periods, CAST(copies AS BIGINT) AS copies, CAST(rank AS INTEGER) AS rank, ROUND(d, 6) AS distance
FROM r WHERE rank <= 5
""")
def e06n(spark, d):
    """Neighbours that SMOTE draws from: the five nearest other points of each point's class."""
    df = FR.doc_features(spark, d).select("quality", *_SMOTE_FEATS)
    classes = [r["quality"] for r in df.select("quality").distinct().where("quality is not null").orderBy("quality").collect()]
    points = E.class_points(df, "quality", _SMOTE_FEATS, classes)
    near = nearest(points, 5).select("_k", "_id", F.posexplode("_near").alias("_i", "_s"))
    x = {n: F.col("_x")[i].alias(n) for i, n in enumerate(_SMOTE_FEATS)}
    names = F.array(*[F.lit(v) for v in classes])
    return points.join(near, ["_k", "_id"]).select(names[F.col("_k")].alias("quality"), x["n_chars"], x["n_words"], x["n_lines"], x["n_periods"],
                                                   F.col("_m").alias("copies"), (F.col("_i") + 1).alias("rank"), F.round("_s.d", 6).alias("distance"))


@reg("e07_class_weights", f"""
SELECT doc_id, ROUND((SELECT count(*) FROM ({DOCS})) / (2.0 * count(*) OVER (PARTITION BY quality)), 6) AS weight
FROM ({DOCS})
""")
def e07(spark, d):
    docs = FR.labelled_docs(spark, d).select("doc_id", "quality")
    return E.class_weights(docs, "quality").select("doc_id", F.round("weight", 6).alias("weight"))


@reg("e08_scale_pos_weight", f"""
SELECT doc_id, ROUND(CASE WHEN quality = 1 THEN (SELECT count_if(quality <> 1) / count_if(quality = 1) FROM ({DOCS}))
                          ELSE 1.0 END, 6) AS weight
FROM ({DOCS})
""")
def e08(spark, d):
    docs = FR.labelled_docs(spark, d).select("doc_id", "quality")
    return E.class_weights(docs, "quality", mode="scale_pos").select("doc_id", F.round("weight", 6).alias("weight"))


def _subset_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i} AS subset, CAST(count_if(substr(md5(concat_ws(':', l_orderkey, l_linenumber, '42')), 1, 8) "
        f"< '{hex_cut(s)}') AS BIGINT) AS n_rows FROM lineitem" for i, s in enumerate(E.learning_sizes()[:-1]))
    return parts + f" UNION ALL SELECT {len(E.learning_sizes()) - 1}, CAST(count(*) AS BIGINT) FROM lineitem"


@reg("e09_learning_subsets", _subset_sql())
def e09(spark, d):
    li = FR.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    sub = E.learning_subsets(li, key=["l_orderkey", "l_linenumber"])
    counts = sub.groupBy("subset").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    w = Window.orderBy("subset").rowsBetween(Window.unboundedPreceding, 0)  # six rows: bounded
    return counts.select(F.col("subset").cast("int"), F.sum("n").over(w).cast("bigint").alias("n_rows"))


# ----------------------------------------------------------------------------- G1-G3, G8, G9

def _class_sql(frame: str, label: str = "label", pred: str = "prediction", binary: bool = True) -> str:
    binary_rows = f"""
  UNION ALL SELECT 'precision_binary', prec FROM f WHERE k = 1
  UNION ALL SELECT 'recall_binary', rec FROM f WHERE k = 1
  UNION ALL SELECT 'f1_binary', f1 FROM f WHERE k = 1""" if binary else ""
    return f"""
WITH cm AS (SELECT {label} AS a, {pred} AS p, count(*) AS n FROM ({frame}) GROUP BY ALL),
     labels AS (SELECT a AS k FROM cm UNION SELECT p FROM cm),
     pc AS (SELECT k, coalesce((SELECT sum(n) FROM cm WHERE a = k AND p = k), 0) AS tp,
                   coalesce((SELECT sum(n) FROM cm WHERE a = k), 0) AS sup,
                   coalesce((SELECT sum(n) FROM cm WHERE p = k), 0) AS pr FROM labels),
     m AS (SELECT k, sup, CASE WHEN pr > 0 THEN tp / pr ELSE 0 END AS prec,
                  CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rec FROM pc),
     f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM m)
SELECT metric, ROUND(value, 6) AS value FROM (
  SELECT 'accuracy' AS metric, (SELECT sum(n) FROM cm WHERE a = p) / (SELECT sum(n) FROM cm) AS value
  UNION ALL SELECT 'precision_weighted', sum(prec * sup) / sum(sup) FROM f
  UNION ALL SELECT 'recall_weighted', sum(rec * sup) / sum(sup) FROM f
  UNION ALL SELECT 'f1_weighted', sum(f1 * sup) / sum(sup) FROM f{binary_rows})
"""


@reg("g01_03_classification_metrics", _class_sql(SD))
def g01(spark, d):
    return _round_metrics(G.classification_metrics(FR.scored_docs(spark, d)))


@reg("g02_multiclass_metrics", _class_sql(SL, binary=False))
def g02(spark, d):
    return _round_metrics(G.classification_metrics(FR.scored_lineitem(spark, d)))


@reg("g08_confusion_matrix", f"""
WITH cm AS (SELECT label AS a, prediction AS p, count(*) AS n FROM ({SL}) GROUP BY ALL),
     labels AS (SELECT a AS k FROM cm UNION SELECT p FROM cm)
SELECT x.k AS actual, y.k AS predicted, CAST(coalesce(cm.n, 0) AS BIGINT) AS n
FROM labels x CROSS JOIN labels y LEFT JOIN cm ON cm.a = x.k AND cm.p = y.k
""")
def g08(spark, d):
    return G.confusion_matrix(FR.scored_lineitem(spark, d))


@reg("g09_classification_report", f"""
WITH cm AS (SELECT label AS a, prediction AS p, count(*) AS n FROM ({SL}) GROUP BY ALL),
     labels AS (SELECT a AS k FROM cm UNION SELECT p FROM cm),
     pc AS (SELECT k, coalesce((SELECT sum(n) FROM cm WHERE a = k AND p = k), 0) AS tp,
                   coalesce((SELECT sum(n) FROM cm WHERE a = k), 0) AS sup,
                   coalesce((SELECT sum(n) FROM cm WHERE p = k), 0) AS pr FROM labels),
     m AS (SELECT k, sup, CASE WHEN pr > 0 THEN tp / pr ELSE 0 END AS prec,
                  CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rec FROM pc),
     f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM m)
SELECT class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM (
  SELECT CAST(k AS VARCHAR) AS class, prec AS precision, rec AS recall, f1, sup AS support FROM f
  UNION ALL SELECT 'macro avg', avg(prec), avg(rec), avg(f1), sum(sup) FROM f
  UNION ALL SELECT 'weighted avg', sum(prec * sup) / sum(sup), sum(rec * sup) / sum(sup), sum(f1 * sup) / sum(sup),
                   sum(sup) FROM f)
""")
def g09(spark, d):
    rep = G.classification_report(FR.scored_lineitem(spark, d))
    return rep.select("class", *[F.round(x, 6).alias(x) for x in ["precision", "recall", "f1"]], "support")


# ----------------------------------------------------------------------------- G4-G7

_SC = f"""SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                 sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM ({SD}) GROUP BY score"""
_DESC = f"""SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
                   sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
                   row_number() OVER (ORDER BY score DESC) AS rk FROM ({_SC})"""


@reg("g04_roc_auc", f"""
WITH c AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM ({_SC}))
SELECT 'roc_auc' AS metric,
       ROUND(sum(pos * (cum_neg - neg + 0.5 * neg)) / ((SELECT sum(pos) FROM ({_SC})) * (SELECT sum(neg) FROM ({_SC}))), 6)
         AS value FROM c
""")
def g04(spark, d):
    return _round_metrics(G.roc_auc(FR.scored_docs(spark, d)))


@reg("g05_average_precision", f"""
SELECT 'average_precision' AS metric,
       ROUND(sum(pos / (SELECT sum(pos) FROM ({_SC})) * tp / (tp + fp)), 6) AS value FROM ({_DESC})
""")
def g05(spark, d):
    return _round_metrics(G.average_precision(FR.scored_docs(spark, d)))


@reg("g06_pr_curve", f"""
WITH d AS ({_DESC}),
     m AS (SELECT min(rk) AS m FROM d WHERE tp >= (SELECT sum(pos) FROM ({_SC}))),
     pts AS (SELECT CAST((SELECT m FROM m) - rk AS BIGINT) AS idx, score AS threshold, tp / (tp + fp) AS precision,
                    tp / (SELECT sum(pos) FROM ({_SC})) AS recall FROM d WHERE rk <= (SELECT m FROM m)
             UNION ALL SELECT CAST((SELECT m FROM m) AS BIGINT), NULL, 1.0, 0.0)
SELECT idx, threshold, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall FROM pts
WHERE idx % greatest(1, ((SELECT m FROM m) + 1) // 100) = 0
""")
def g06(spark, d):
    cur = G.pr_curve(FR.scored_docs(spark, d))
    return cur.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@reg("g07_pr_auc", f"""
SELECT 'pr_auc' AS metric, ROUND(sum(pos / (SELECT sum(pos) FROM ({_SC})) * (tp / (tp + fp)
       + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1.0 END) / 2), 6) AS value
FROM ({_DESC})
""")
def g07(spark, d):
    return _round_metrics(G.pr_auc(FR.scored_docs(spark, d)))


# ----------------------------------------------------------------------------- G10-G14, G23-G25, G29

@reg("g10_11_regression_metrics", f"""
SELECT metric, ROUND(value, 6) AS value FROM (
  SELECT 'rmse' AS metric, sqrt(avg((predicted - actual) ^ 2)) AS value FROM ({SL})
  UNION ALL SELECT 'mae', avg(abs(predicted - actual)) FROM ({SL})
  UNION ALL SELECT 'r2', 1 - sum((predicted - actual) ^ 2) / (var_pop(actual) * count(actual)) FROM ({SL})
  UNION ALL SELECT 'mape', avg(abs(CASE WHEN actual = 0 THEN NULL ELSE (predicted - actual) / actual END)) FROM ({SL}))
""")
def g10(spark, d):
    return _round_metrics(G.regression_metrics(FR.scored_lineitem(spark, d), "actual", "predicted"))


@reg("g12_brier", f"SELECT 'brier' AS metric, ROUND(avg((score - label) ^ 2), 6) AS value FROM ({SD})")
def g12(spark, d):
    return _round_metrics(G.brier(FR.scored_docs(spark, d)))


def _cal_bin_sql() -> str:
    return " + ".join(f"CAST(score > {e!r} AS INTEGER)" for e in [i / 10 for i in range(1, 10)])


@reg("g13_calibration", f"""
SELECT {_cal_bin_sql()} AS bin, CAST(count(*) AS BIGINT) AS n, ROUND(avg(label), 6) AS frac_pos,
       ROUND(avg(score), 6) AS mean_pred
FROM ({SD}) GROUP BY 1
""")
def g13(spark, d):
    cal = G.calibration(FR.scored_docs(spark, d))
    return cal.withColumn("frac_pos", F.round("frac_pos", 6)).withColumn("mean_pred", F.round("mean_pred", 6))


@reg("g14_positive_rate", f"SELECT 'positive_rate' AS metric, ROUND(avg(CAST(label = 1 AS DOUBLE)), 6) AS value FROM ({SD})")
def g14(spark, d):
    return _round_metrics(G.positive_rate(FR.scored_docs(spark, d)))


@reg("g23_residuals", f"""
SELECT CAST(count(*) AS BIGINT) AS n, ROUND(avg(predicted - actual), 6) AS mean_residual,
       ROUND(max(abs(predicted - actual)), 6) AS max_abs_residual,
       abs(avg(predicted - actual)) < 0.05 * max(abs(predicted - actual)) AS unbiased
FROM ({SL})
""")
def g23(spark, d):
    _, summary = G.residuals(FR.scored_lineitem(spark, d), "actual", "predicted")
    return summary.withColumn("mean_residual", F.round("mean_residual", 6)) \
        .withColumn("max_abs_residual", F.round("max_abs_residual", 6))


@reg("g24_actual_vs_predicted", f"""
SELECT l_orderkey, l_linenumber, ROUND(actual, 6) AS actual, ROUND(predicted, 6) AS predicted FROM ({SL})
ORDER BY md5(concat_ws(':', l_orderkey, l_linenumber, '42')) LIMIT 200
""")
def g24(spark, d):
    s = E.sample_n(FR.scored_lineitem(spark, d), 200, key=["l_orderkey", "l_linenumber"])
    return s.select("l_orderkey", "l_linenumber", F.round("actual", 6).alias("actual"),
                    F.round("predicted", 6).alias("predicted"))


@reg("g25_ap_verdict", f"""
WITH ap AS (SELECT sum(pos / (SELECT sum(pos) FROM ({_SC})) * tp / (tp + fp)) AS ap FROM ({_DESC}))
SELECT ROUND(ap, 6) AS average_precision,
       CASE WHEN ap > 0.7 THEN 'strong' WHEN ap > 0.4 THEN 'moderate' ELSE 'low' END AS verdict,
       ROUND((SELECT avg(CAST(label = 1 AS DOUBLE)) FROM ({SD})), 6) AS baseline
FROM ap
""")
def g25(spark, d):
    sd = FR.scored_docs(spark, d)
    ap = G.average_precision(sd).first()["value"]
    base = G.positive_rate(sd).first()["value"]
    df = spark.createDataFrame([(ap, base)], "average_precision double, baseline double")
    return df.select(F.round("average_precision", 6).alias("average_precision"),
                     G.ap_verdict_expr(F.col("average_precision")).alias("verdict"), F.round("baseline", 6).alias("baseline"))


@reg("g29_r2_verdict", f"""
WITH r AS (SELECT 1 - sum((predicted - actual) ^ 2) / (var_pop(actual) * count(actual)) AS r2 FROM ({SL}))
SELECT ROUND(r2, 6) AS r2, CASE WHEN r2 > 0.6 THEN 'good' WHEN r2 > 0.3 THEN 'ok' ELSE 'weak' END AS verdict FROM r
""")
def g29(spark, d):
    m = G.regression_metrics(FR.scored_lineitem(spark, d), "actual", "predicted")
    r2 = m.where("metric = 'r2'").select(F.col("value").alias("r2"))
    return r2.select(F.round("r2", 6).alias("r2"), G.r2_verdict_expr(F.col("r2")).alias("verdict"))


# ----------------------------------------------------------------------------- F16, G15-G17

def _sweep_sql(frame: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT CAST({th!r} AS DOUBLE) AS threshold, count_if(score >= {th!r} AND label = 1) AS tp, "
        f"count_if(score >= {th!r} AND label <> 1) AS fp, count_if(score < {th!r} AND label = 1) AS fn FROM ({frame})"
        for th in K.THRESHOLDS)
    return f"SELECT threshold, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM ({parts})"


@reg("f16_threshold_sweep", f"SELECT threshold, ROUND(f1, 6) AS f1 FROM ({_sweep_sql(SD)})")
def f16(spark, d):
    return G.threshold_sweep(FR.scored_docs(spark, d)).withColumn("f1", F.round("f1", 6))


@reg("g16_17_tuning_delta", f"""
WITH s AS ({_sweep_sql(SD)}),
     best AS (SELECT threshold, f1 FROM s ORDER BY f1 DESC, threshold LIMIT 1),
     before AS (SELECT f1 FROM s WHERE threshold = 0.5)
SELECT ROUND((SELECT f1 FROM before), 6) AS before, ROUND(f1, 6) AS after, ROUND(f1 - (SELECT f1 FROM before), 6) AS delta,
       f1 - (SELECT f1 FROM before) > 0.02 AS meaningful, threshold,
       CASE WHEN threshold < 0.45 THEN 'lowered' WHEN threshold > 0.55 THEN 'raised' ELSE 'near_default' END AS verdict
FROM best
""")
def g16(spark, d):
    sweep = G.threshold_sweep(FR.scored_docs(spark, d))
    th = G.best_threshold(sweep)
    rows = {r["threshold"]: r["f1"] for r in sweep.collect()}
    before, after = rows[0.5], rows[th]
    df = spark.createDataFrame([(before, after, th)], "before double, after double, threshold double")
    delta, meaningful = G.tuning_delta_expr(F.col("before"), F.col("after"))
    return df.select(F.round("before", 6).alias("before"), F.round("after", 6).alias("after"),
                     F.round(delta, 6).alias("delta"), meaningful.alias("meaningful"), "threshold",
                     G.threshold_verdict_expr(F.col("threshold")).alias("verdict"))


def _weighted_f1_sql(frame: str) -> str:
    return f"""(WITH cm AS (SELECT label AS a, prediction AS p, count(*) AS n FROM ({frame}) GROUP BY ALL),
     labels AS (SELECT a AS k FROM cm UNION SELECT p FROM cm),
     pc AS (SELECT k, coalesce((SELECT sum(n) FROM cm WHERE a = k AND p = k), 0) AS tp,
                   coalesce((SELECT sum(n) FROM cm WHERE a = k), 0) AS sup,
                   coalesce((SELECT sum(n) FROM cm WHERE p = k), 0) AS pr FROM labels),
     m AS (SELECT k, sup, CASE WHEN pr > 0 THEN tp / pr ELSE 0 END AS prec,
                  CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rec FROM pc)
  SELECT sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END * sup) / sum(sup) FROM m)"""


_SD_TEST = f"SELECT * FROM ({SD}) WHERE substr(md5(concat_ws(':', doc_id, '42')), 1, 8) < '{CUT20}'"
_SD_TRAIN = f"SELECT * FROM ({SD}) WHERE substr(md5(concat_ws(':', doc_id, '42')), 1, 8) >= '{CUT20}'"


@reg("g15_overfit_gap", f"""
SELECT ROUND({_weighted_f1_sql(_SD_TRAIN)}, 6) AS train_f1, ROUND({_weighted_f1_sql(_SD_TEST)}, 6) AS test_f1,
       ROUND({_weighted_f1_sql(_SD_TRAIN)} - {_weighted_f1_sql(_SD_TEST)}, 6) AS gap
""")
def g15(spark, d):
    sd = FR.scored_docs(spark, d)
    train, test = E.train_test_split(sd, stratify=False, key="doc_id")
    a = G.classification_metrics(train).where("metric = 'f1_weighted'").first()["value"]
    b = G.classification_metrics(test).where("metric = 'f1_weighted'").first()["value"]
    return spark.createDataFrame([(round(a, 6), round(b, 6), round(G.overfit_gap(a, b), 6))],
                                 "train_f1 double, test_f1 double, gap double")


# ----------------------------------------------------------------------------- G19-G22, G27, H5

_FOLDED = f"""SELECT *, CAST(floor({_hv('doc_id', 8)} / 4294967296.0 * 5) AS INTEGER) AS fold FROM ({SD})"""


def _fold_f1_sql(th: float) -> str:
    return f"""SELECT fold, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS score FROM (
  SELECT fold, count_if(score >= {th} AND label = 1) AS tp, count_if(score >= {th} AND label <> 1) AS fp,
         count_if(score < {th} AND label = 1) AS fn FROM ({_FOLDED}) GROUP BY fold)"""


def _fold_f1(spark, d, th: float):
    sd = E.add_fold(FR.scored_docs(spark, d), 5, key="doc_id")
    y = F.col("label") == 1
    p = F.col("score") >= th
    agg = sd.groupBy("fold").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
                                 F.count_if(~p & y).alias("fn"))
    return agg.select("fold", F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
                      .otherwise(F.lit(0.0)).alias("score"))


@reg("g19_fold_summary", f"""
SELECT ROUND(avg(score), 6) AS mean, ROUND(stddev_pop(score), 6) AS std, CAST(count(*) AS BIGINT) AS k,
       ROUND(1.96 * stddev_pop(score) / sqrt(count(*)), 6) AS ci95
FROM ({_fold_f1_sql(0.5)})
""")
def g19(spark, d):
    s = G.fold_summary(_fold_f1(spark, d, 0.5))
    return s.select(*[F.round(x, 6).alias(x) for x in ["mean", "std"]], "k", F.round("ci95", 6).alias("ci95"))


@reg("g20_paired_t", f"""
WITH a AS ({_fold_f1_sql(0.5)}), b AS ({_fold_f1_sql(0.4)}),
     d AS (SELECT a.score - b.score AS diff FROM a JOIN b USING (fold))
SELECT CAST(count(*) AS BIGINT) AS n, ROUND(avg(diff), 6) AS mean_diff,
       ROUND(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS INTEGER) AS dof
FROM d
""")
def g20(spark, d):
    out = G.paired_t(_fold_f1(spark, d, 0.5), _fold_f1(spark, d, 0.4), "fold")
    return out.select("n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 6).alias("t"), "dof")


@reg("g20_paired_t_pvalue", f"""
WITH a AS ({_fold_f1_sql(0.5)}), b AS ({_fold_f1_sql(0.4)}),
     d AS (SELECT a.score - b.score AS diff FROM a JOIN b USING (fold)),
     t AS (SELECT count(*) AS n, avg(diff) AS mean_diff, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t FROM d)
SELECT CAST(n AS BIGINT) AS n, ROUND(mean_diff, 6) AS mean_diff, ROUND(t, 6) AS t, CAST(n - 1 AS INTEGER) AS dof,
       ROUND(1 - 0.75 * abs(t) / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4))), 6) AS p_two_sided FROM t
""")
def g20p(spark, d):
    """Five folds, so four degrees of freedom, where Student's distribution has a closed form."""
    out = G.paired_t(_fold_f1(spark, d, 0.5), _fold_f1(spark, d, 0.4), "fold")
    return out.select("n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 6).alias("t"), "dof",
                      F.round("p_two_sided", 6).alias("p_two_sided"))


@reg("g21_model_comparison", f"""
SELECT 'threshold_' || CAST(threshold AS VARCHAR) AS model, 'f1_binary' AS metric, ROUND(f1, 6) AS value,
       CAST(rank() OVER (ORDER BY ROUND(f1, 6) DESC) AS INTEGER) AS rank
FROM ({_sweep_sql(SD)})
""")
def g21(spark, d):
    sweep = G.threshold_sweep(FR.scored_docs(spark, d))
    metrics = sweep.select(F.concat(F.lit("threshold_"), F.col("threshold").cast("string")).alias("model"),
                           F.lit("f1_binary").alias("metric"), F.round("f1", 6).alias("value"))
    return G.model_comparison(metrics, "f1_binary").withColumn("rank", F.col("rank").cast("int"))


def _lang_f1_sql(th: float) -> str:
    return f"""SELECT lang AS dataset, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS value FROM (
  SELECT d.lang, count_if(s.score >= {th} AND s.label = 1) AS tp, count_if(s.score >= {th} AND s.label <> 1) AS fp,
         count_if(s.score < {th} AND s.label = 1) AS fn FROM ({SD}) s JOIN ({DOCS}) d USING (doc_id) GROUP BY d.lang)"""


@reg("g22_compare_runs", f"""
WITH a AS ({_lang_f1_sql(0.5)}), b AS ({_lang_f1_sql(0.4)}),
     j AS (SELECT dataset, a.value AS a, b.value AS b, b.value - a.value AS delta FROM a JOIN b USING (dataset))
SELECT dataset, ROUND(a, 6) AS a, ROUND(b, 6) AS b, ROUND(delta, 6) AS delta FROM j
UNION ALL SELECT 'mean', ROUND(avg(a), 6), ROUND(avg(b), 6), ROUND(avg(delta), 6) FROM j
""")
def g22(spark, d):
    sd = FR.scored_docs(spark, d).join(FR.labelled_docs(spark, d).select("doc_id", "lang"), "doc_id")

    def per_lang(th):
        y, p = F.col("label") == 1, F.col("score") >= th
        agg = sd.groupBy(F.col("lang").alias("dataset")).agg(
            F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
        return agg.select("dataset", F.when(F.col("tp") > 0, 2.0 * F.col("tp") /
                                            (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0).alias("value"))
    out = G.compare_runs(per_lang(0.5), per_lang(0.4), on="dataset")
    return out.select("dataset", *[F.round(x, 6).alias(x) for x in ["a", "b", "delta"]])


@reg("g27_run_history", f"""
SELECT fold AS run,
       ROUND(avg(CAST((score >= 0.5) = (label = 1) AS DOUBLE)), 6) AS accuracy,
       ROUND(avg(CAST(label = 1 AS DOUBLE)), 6) AS positive_rate
FROM ({_FOLDED}) GROUP BY fold
""")
def g27(spark, d):
    sd = E.add_fold(FR.scored_docs(spark, d), 5, key="doc_id")
    long = sd.groupBy(F.col("fold").alias("run")).agg(
        F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("accuracy"),
        F.avg((F.col("label") == 1).cast("double")).alias("positive_rate"))
    metrics = long.unpivot(["run"], ["accuracy", "positive_rate"], "metric", "value")
    wide = G.run_history(metrics, names=["accuracy", "positive_rate"])
    return wide.select("run", F.round("accuracy", 6).alias("accuracy"), F.round("positive_rate", 6).alias("positive_rate"))


_IMPACT_SQL = f"""
WITH d AS ({_DESC}),
     m AS (SELECT min(rk) AS m FROM d WHERE tp >= (SELECT sum(pos) FROM ({_SC}))),
     pts AS (SELECT CAST((SELECT m FROM m) - rk AS BIGINT) AS idx, tp / (tp + fp) AS precision,
                    tp / (SELECT sum(pos) FROM ({_SC})) AS recall FROM d WHERE rk <= (SELECT m FROM m)
             UNION ALL SELECT CAST((SELECT m FROM m) AS BIGINT), 1.0, 0.0),
     thin AS (SELECT * FROM pts WHERE idx % greatest(1, ((SELECT m FROM m) + 1) // 100) = 0),
     srt AS (SELECT recall, precision, row_number() OVER (ORDER BY recall, precision, idx) AS k FROM thin),
     cm AS (SELECT count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 1 AND prediction = 0) AS fn,
                   count_if(label = 0 AND prediction = 1) AS fp, count_if(label = 0 AND prediction = 0) AS tn
            FROM ({SD})),
     par AS (SELECT (tp + fn) / (tp + fn + fp + tn) AS prev,
                    least(0.99, greatest(0.01, tp / (tp + fn))) AS target FROM cm),
     br AS (SELECT a.recall AS r0, a.precision AS p0, b.recall AS r1, b.precision AS p1
            FROM srt a JOIN srt b ON b.k = a.k + 1
            WHERE a.recall <= (SELECT target FROM par) AND (SELECT target FROM par) <= b.recall ORDER BY a.k LIMIT 1),
     near AS (SELECT precision FROM srt ORDER BY abs(recall - (SELECT target FROM par)), k LIMIT 1),
     pr AS (SELECT greatest(0.001, least(1.0, coalesce(
              (SELECT CASE WHEN r1 = r0 THEN p0 ELSE p0 + (p1 - p0) * ((SELECT target FROM par) - r0) / (r1 - r0) END
               FROM br), (SELECT precision FROM near)))) AS p),
     v AS (SELECT target, p, 10000 * prev AS tot_pos, 10000 * (1 - prev) AS tot_neg,
                  round_even(target * (10000 * prev), 0) AS caught FROM par, pr),
     fa AS (SELECT *, greatest(0, least(round_even(caught * (1 - p) / p, 0), round_even(tot_neg, 0))) AS false_alarms
            FROM v)
SELECT CAST(10000 AS BIGINT) AS population, ROUND(target, 6) AS recall, ROUND(p, 6) AS precision,
       CAST(caught AS BIGINT) AS caught, CAST(round_even(tot_pos, 0) - caught AS BIGINT) AS missed,
       CAST(false_alarms AS BIGINT) AS false_alarms,
       CAST(greatest(0, round_even(tot_neg, 0) - false_alarms) AS BIGINT) AS cleared
FROM fa
"""


@reg("g26_impact", _IMPACT_SQL)
def g26(spark, d):
    sd = FR.scored_docs(spark, d)
    cm = {(r["actual"], r["predicted"]): r["n"] for r in G.confusion_matrix(sd).collect()}
    out = G.impact(G.pr_curve(sd), tp=cm.get((1, 1), 0), fn=cm.get((1, 0), 0), fp=cm.get((0, 1), 0),
                   tn=cm.get((0, 0), 0), population=10_000)
    return out.withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))


@reg("h05_gate_stability", f"""
WITH f AS ({_fold_f1_sql(0.5)})
SELECT gate, passed, ROUND(observed, 6) AS observed, ROUND("limit", 6) AS "limit" FROM (
  SELECT 'cv_std' AS gate, stddev_pop(score) < 0.1 AS passed, stddev_pop(score) AS observed, 0.1 AS "limit" FROM f
  UNION ALL SELECT 'no_fold_beyond_2_sigma', max(abs(score - (SELECT avg(score) FROM f))) <= 2 * stddev_pop(score),
                   max(abs(score - (SELECT avg(score) FROM f))), 2 * stddev_pop(score) FROM f)
""")
def h05(spark, d):
    g = H.gate_stability(_fold_f1(spark, d, 0.5))
    return g.withColumn("observed", F.round("observed", 6)).withColumn("limit", F.round("limit", 6))


# ----------------------------------------------------------------------------- H1, H2, H4, H6, H8-H11

@reg("h01_gate_cleaned", """
SELECT gate, passed, observed, "limit" FROM (
  SELECT 'no_missing_values' AS gate, true AS passed, 0.0 AS observed, 0.0 AS "limit"
  UNION ALL SELECT 'no_duplicate_columns', true, 0.0, 0.0
  UNION ALL SELECT 'target_column_present', true, 1.0, 1.0
  UNION ALL SELECT 'target_is_numeric', false, NULL, NULL
  UNION ALL SELECT 'duplicate_row_pct', NULL,
            ROUND((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))) / count(*) * 100, 1), NULL
            FROM lineitem
  UNION ALL SELECT 'row_count', NULL, CAST(count(*) AS DOUBLE), NULL FROM lineitem)
""")
def h01(spark, d):
    return H.gate_cleaned(FR.table(spark, d, "lineitem"), "l_returnflag")


_INF = """
SELECT event_id, CASE WHEN value > 20 THEN CAST('inf' AS DOUBLE) ELSE value END AS value,
       CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type, user_id
FROM events
"""


@reg("h02_gate_features", f"""
SELECT 'no_missing_values' AS gate, count_if(event_type IS NULL) = 0 AS passed,
       CAST(count_if(event_type IS NULL) AS DOUBLE) AS observed, 0.0 AS "limit" FROM ({_INF})
UNION ALL SELECT 'no_infinite_values', count_if(abs(value) = CAST('inf' AS DOUBLE)) = 0,
       CAST(count_if(abs(value) = CAST('inf' AS DOUBLE)) AS DOUBLE), 0.0 FROM ({_INF})
UNION ALL SELECT 'no_duplicate_columns', true, 0.0, 0.0
UNION ALL SELECT 'target_column_present', true, 1.0, 1.0
UNION ALL SELECT 'feature_count_grew', NULL, 4.0, 3.0
""")
def h02(spark, d):
    ev = FR.table(spark, d, "events")
    df = ev.select("event_id", F.when(F.col("value") > 20, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"),
                   F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
                   "user_id")
    return H.gate_features(df, "user_id", n_before=3)


@reg("h04_gate_retention", f"""
WITH b AS (SELECT count(*) AS n FROM ({FR.DIRTY_LINEITEM_SQL})),
     a AS (SELECT count(*) AS n FROM ({FR.DIRTY_LINEITEM_SQL}) WHERE l_discount IS NOT NULL)
SELECT 'row_retention' AS gate, ((SELECT n FROM b) - (SELECT n FROM a)) / (SELECT n FROM b) <= 0.1 AS passed,
       ROUND(((SELECT n FROM b) - (SELECT n FROM a)) / (SELECT n FROM b), 6) AS observed, 0.1 AS "limit"
UNION ALL SELECT 'rows_lost_to_duplicates', NULL, 0.0, NULL
""")
def h04(spark, d):
    before = FR.dirty_lineitem(spark, d)
    after = before.where(F.col("l_discount").isNotNull())
    return H.gate_retention(before, after).withColumn("observed", F.round("observed", 6))


@reg("h06_gate_lift", f"""
WITH s AS ({_sweep_sql(SD)}),
     m AS (SELECT (SELECT f1 FROM s WHERE threshold = 0.5) AS metric,
                  (SELECT 2.0 * count_if(label = 1) / (count(*) + count_if(label = 1)) FROM ({SD})) AS base)
SELECT 'beats_baseline' AS gate, metric >= base AS passed, ROUND(metric, 6) AS observed, ROUND(base, 6) AS "limit" FROM m
UNION ALL SELECT 'lift_at_least', (metric - base) / abs(base) >= 0.02, ROUND((metric - base) / abs(base), 6), 0.02 FROM m
""")
def h06(spark, d):
    sd = FR.scored_docs(spark, d)
    metric = {r["threshold"]: r["f1"] for r in G.threshold_sweep(sd).collect()}[0.5]
    base = G.threshold_sweep(sd, thresholds=[0.0]).first()["f1"]  # everyone flagged positive
    g = H.gate_lift(spark, metric, base)
    return g.withColumn("observed", F.round("observed", 6)).withColumn("limit", F.round("limit", 6))


_H_NUM = ["text_len", "n_words", "n_lines", "n_periods", "quality"]


@reg("h08_audit_proxy", " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", ROUND(abs(corr({x}, n_chars)), 6) AS observed, abs(corr({x}, n_chars)) > 0.9 AS flagged "
    f"FROM ({DF})" for x in _H_NUM))
def h08(spark, d):
    df = FR.doc_features(spark, d)
    return H.audit_proxy(df, "n_chars", cols=_H_NUM).withColumn("observed", F.round("observed", 6))


@reg("h09_audit_overlap", f"""
WITH tr AS (SELECT DISTINCT text, lang FROM documents WHERE substr(md5(concat_ws(':', doc_id, '42')), 1, 8) >= '{CUT20}'),
     te AS (SELECT text, lang FROM documents WHERE substr(md5(concat_ws(':', doc_id, '42')), 1, 8) < '{CUT20}'),
     hit AS (SELECT count(*) AS n FROM te WHERE EXISTS (SELECT 1 FROM tr WHERE tr.text IS NOT DISTINCT FROM te.text
                                                        AND tr.lang IS NOT DISTINCT FROM te.lang))
SELECT 'test_rows_seen_in_train' AS gate, (SELECT n FROM hit) = 0 AS passed, CAST((SELECT n FROM hit) AS DOUBLE) AS observed,
       0.0 AS "limit"
UNION ALL SELECT 'test_rows', NULL, CAST(count(*) AS DOUBLE), NULL FROM te
""")
def h09(spark, d):
    docs = FR.table(spark, d, "documents").select("doc_id", "text", "lang")
    train, test = E.train_test_split(docs, stratify=False, key="doc_id")
    return H.audit_overlap(train, test, ["text", "lang"])


def _one_to_one(x: str) -> str:
    return (f"(count(DISTINCT {x}) = count(DISTINCT ({x}, n_chars)) AND count(DISTINCT {x}) = count(DISTINCT n_chars) "
            f"AND count(*) > count(DISTINCT n_chars))")


@reg("h10_audit_target_copy", " UNION ALL ".join(
    f"""SELECT '{x}' AS "column", ROUND(abs(corr({x}, n_chars)), 6) AS abs_r, {_one_to_one(x)} AS one_to_one,
       {_one_to_one(x)} OR abs(corr({x}, n_chars)) >= 0.999 AS flagged FROM ({DF})""" for x in _H_NUM))
def h10(spark, d):
    df = FR.doc_features(spark, d)
    return H.audit_target_copy(df, "n_chars", cols=_H_NUM).withColumn("abs_r", F.round("abs_r", 6))


@reg("h11_audit_redundant", f"""
SELECT a, b, ROUND(r, 6) AS r FROM (
  {" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM ({DF})"
                      for i, a in enumerate(_H_NUM) for b in _H_NUM[i + 1:])})
WHERE abs(r) > 0.95
""")
def h11(spark, d):
    return H.audit_redundant(FR.doc_features(spark, d), cols=_H_NUM).withColumn("r", F.round("r", 6))


@reg("h14_audit_metrics", f"""
WITH m AS ({_class_sql(SD)})
SELECT 'metrics_match_problem' AS gate, count(DISTINCT metric) = 0 AS passed, CAST(count(DISTINCT metric) AS DOUBLE) AS observed,
       0.0 AS "limit" FROM m WHERE metric NOT IN ('rmse', 'mae', 'mape', 'r2')
UNION ALL SELECT 'not_accuracy_alone', true, CAST(count(DISTINCT metric) AS DOUBLE), NULL FROM m
""")
def h14(spark, d):
    m = G.classification_metrics(FR.scored_docs(spark, d))
    return H.audit_metrics(m, "regression")


@reg("h15_severity", f"""
WITH g AS (SELECT 'stability' AS category, passed FROM ({SQL["h05_gate_stability"]})
           UNION ALL SELECT 'data_integrity', passed FROM ({SQL["h01_gate_cleaned"]})),
     s AS (SELECT category, 10 * avg(CAST(passed AS DOUBLE)) AS score FROM g WHERE passed IS NOT NULL GROUP BY category)
SELECT category, ROUND(score, 6) AS score, NULL AS level FROM s
UNION ALL SELECT 'overall', ROUND(avg(score), 6), CASE WHEN avg(score) < 6 OR min(score) < 5 THEN 'critical'
                                                      WHEN avg(score) < 7.5 THEN 'moderate' ELSE 'minor' END FROM s
""")
def h15(spark, d):
    gates = H.gate_stability(_fold_f1(spark, d, 0.5)).withColumn("category", F.lit("stability")) \
        .unionByName(H.gate_cleaned(FR.table(spark, d, "lineitem"), "l_returnflag")
                     .withColumn("category", F.lit("data_integrity")))
    return H.severity(gates).withColumn("score", F.round("score", 6))


@reg("h12_13_audit_fit_imbalance", f"""
WITH f AS (SELECT {_weighted_f1_sql(_SD_TRAIN)} AS train, {_weighted_f1_sql(_SD_TEST)} AS test),
     b AS (SELECT threshold AS th FROM ({_sweep_sql(SD)}) ORDER BY f1 DESC, threshold LIMIT 1),
     i AS (SELECT CASE WHEN count(*) <= 10 THEN ROUND(min(n) / max(n), 2) END AS ratio
           FROM (SELECT quality, count(*) AS n FROM ({DOCS}) GROUP BY quality))
SELECT gate, passed, ROUND(observed, 6) AS observed, "limit" FROM (
  SELECT 'overfit_gap' AS gate, train - test <= 0.1 AS passed, train - test AS observed, 0.1 AS "limit" FROM f
  UNION ALL SELECT 'not_too_good', test < 0.999, test, 0.999 FROM f
  UNION ALL SELECT 'threshold_tuned', ratio IS NULL OR ratio >= 0.3 OR th < 0.5, th, 0.5 FROM b, i
  UNION ALL SELECT 'pr_auc_reported', true, ratio, 0.3 FROM i)
""")
def h12(spark, d):
    sd = FR.scored_docs(spark, d)
    train, test = E.train_test_split(sd, stratify=False, key="doc_id")
    f1 = [G.classification_metrics(x).where("metric = 'f1_weighted'").first()["value"] for x in (train, test)]
    fit = H.audit_fit(spark, train_metric=f1[0], test_metric=f1[1])
    th = G.best_threshold(G.threshold_sweep(sd))
    ratio = P.imbalance_ratio(FR.labelled_docs(spark, d), "quality").first()["ratio"]
    return fit.unionByName(H.audit_imbalance(spark, ratio, th, has_pr_auc=True)).withColumn("observed", F.round("observed", 6))


@reg("h07_gate_repeatable", f"""
WITH a AS ({SQL["e01_split_stratified"]}), b AS ({SQL["e01_split_stratified"]}),
     x AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)),
     y AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT 'identical_reruns' AS gate, x.n + y.n = 0 AS passed, CAST(x.n + y.n AS DOUBLE) AS observed, 0.0 AS "limit" FROM x, y
""")
def h07(spark, d):
    return H.gate_repeatable(lambda: E.test_flag(FR.labelled_docs(spark, d).select("doc_id", "quality"), "quality",
                                                 stratify=True, key="doc_id"))


@reg("d20b_tfidf_wide_columns")
def d20b(spark, d):
    docs = FR.table(spark, d, "documents").select("doc_id", "text")
    tf = FE.TfidfFeatures(col="text", key="doc_id").fit(docs)
    return tf.transform(docs)
