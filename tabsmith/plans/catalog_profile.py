"""Registered queries for profiling (B) and planning rules, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import profile as P
from . import frames as FR
from . import rules as R

Q: dict = {}
SQL: dict = {}


def reg(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


D = FR.DIRTY_LINEITEM_SQL
DOCS = FR.LABELLED_DOCS_SQL
DF = FR.DOC_FEATURES_SQL


def _r(x: str, d: int = 6) -> str:
    return f"ROUND(CAST({x} AS DOUBLE), {d})"


@reg("b01_shape", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(13 AS BIGINT) AS n_cols FROM ({D})")
def b01(spark, d):
    return P.shape(FR.dirty_lineitem(spark, d))


@reg("b03_null_counts", f"""
SELECT column_name AS "column", CAST(n_missing AS BIGINT) AS n_missing,
       ROUND(n_missing / n_rows, 6) AS null_pct, CAST(n_rows AS BIGINT) AS n_rows
FROM (SELECT count(*) AS n_rows,
             count(*) - count(l_quantity) AS l_quantity, count(*) - count(l_discount) AS l_discount,
             count(*) - count(l_tax) AS l_tax, count(*) - count(l_comment_len) AS l_comment_len,
             count(*) - count(l_linestatus) AS l_linestatus, count(*) - count(l_orderkey) AS l_orderkey,
             count(*) - count(l_returnflag) AS l_returnflag
      FROM ({D})) UNPIVOT (n_missing FOR column_name IN
        (l_quantity, l_discount, l_tax, l_comment_len, l_linestatus, l_orderkey, l_returnflag))
""")
def b03(spark, d):
    cols = ["l_quantity", "l_discount", "l_tax", "l_comment_len", "l_linestatus", "l_orderkey", "l_returnflag"]
    return P.null_counts(FR.dirty_lineitem(spark, d), cols).withColumn("null_pct", F.round("null_pct", 6))


@reg("b05_distinct_counts", f"""
SELECT column_name AS "column", CAST(n_unique AS BIGINT) AS n_unique
FROM (SELECT count(DISTINCT doc_id) AS doc_id, count(DISTINCT text) AS text, count(DISTINCT lang) AS lang,
             count(DISTINCT source) AS source, count(DISTINCT n_chars) AS n_chars,
             count(DISTINCT quality) AS quality, count(DISTINCT toxic) AS toxic FROM ({DOCS}))
UNPIVOT (n_unique FOR column_name IN (doc_id, text, lang, source, n_chars, quality, toxic))
""")
def b05(spark, d):
    return P.distinct_counts(FR.labelled_docs(spark, d))


@reg("b06_describe", f"""
SELECT column_name AS "column", CAST(cnt AS BIGINT) AS count, {_r('mean')} AS mean, {_r('std')} AS std,
       {_r('mn')} AS min, {_r('p25')} AS p25, {_r('p50')} AS p50, {_r('p75')} AS p75, {_r('mx')} AS max
FROM (
  SELECT 'l_quantity' AS column_name, count(l_quantity) AS cnt, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std,
         min(l_quantity) AS mn, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50,
         quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS mx FROM ({D})
  UNION ALL
  SELECT 'l_discount', count(l_discount), avg(l_discount), stddev_samp(l_discount), min(l_discount),
         quantile_cont(l_discount, 0.25), quantile_cont(l_discount, 0.5), quantile_cont(l_discount, 0.75),
         max(l_discount) FROM ({D})
  UNION ALL
  SELECT 'l_extendedprice', count(l_extendedprice), avg(l_extendedprice), stddev_samp(l_extendedprice),
         min(l_extendedprice), quantile_cont(l_extendedprice, 0.25), quantile_cont(l_extendedprice, 0.5),
         quantile_cont(l_extendedprice, 0.75), max(l_extendedprice) FROM ({D}))
""")
def b06(spark, d):
    out = P.describe_table(FR.dirty_lineitem(spark, d), ["l_quantity", "l_discount", "l_extendedprice"])
    return out.select("column", "count", *[F.round(x, 6).alias(x) for x in
                                            ["mean", "std", "min", "p25", "p50", "p75", "max"]])


@reg("b06_describe_distributed", f"""
SELECT 'l_extendedprice' AS "column", {_r('quantile_cont(l_extendedprice, 0.25)')} AS p25,
       {_r('quantile_cont(l_extendedprice, 0.5)')} AS p50, {_r('quantile_cont(l_extendedprice, 0.75)')} AS p75
FROM lineitem
""")
def b06d(spark, d):
    li = FR.table(spark, d, "lineitem")
    out = P.describe_table(li, ["l_extendedprice"])
    return out.select("column", *[F.round(x, 6).alias(x) for x in ["p25", "p50", "p75"]])


@reg("b07_target_distribution", f"""
SELECT quality AS value, CAST(count(*) AS BIGINT) AS n, ROUND(count(*) / sum(count(*)) OVER (), 6) AS pct
FROM ({DOCS}) GROUP BY quality
""")
def b07(spark, d):
    return P.target_distribution(FR.labelled_docs(spark, d), "quality").withColumn("pct", F.round("pct", 6))


@reg("b08_target_pct_with_null", f"""
SELECT l_linestatus AS value, CAST(count(*) AS BIGINT) AS n, ROUND(count(*) / sum(count(*)) OVER (), 6) AS pct
FROM (SELECT CASE WHEN l_linestatus = '?' THEN NULL ELSE l_linestatus END AS l_linestatus FROM ({D}))
GROUP BY l_linestatus
""")
def b08(spark, d):
    from ..operators.clean import null_sentinels
    df = null_sentinels(FR.dirty_lineitem(spark, d).select("l_linestatus"))
    return P.target_distribution(df, "l_linestatus", include_null=True).withColumn("pct", F.round("pct", 6))


@reg("b09_top_values", f"""
SELECT "column", value, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
  FROM (SELECT 'source' AS "column", source AS value, count(*) AS n FROM ({DOCS}) GROUP BY source
        UNION ALL SELECT 'lang', lang, count(*) FROM ({DOCS}) GROUP BY lang
        UNION ALL SELECT 'text', text, count(*) FROM ({DOCS}) GROUP BY text))
WHERE rank <= 10
""")
def b09(spark, d):
    return P.top_values(FR.labelled_docs(spark, d), ["source", "lang", "text"], k=10) \
        .withColumn("rank", F.col("rank").cast("int"))


@reg("b10_target_codes", f"""
SELECT l_orderkey, l_linenumber,
       CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS DOUBLE) AS code
FROM lineitem
""")
def b10(spark, d):
    li = FR.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return P.target_codes(li, "l_returnflag", out="code").drop("l_returnflag")


@reg("b10_target_codes_first", f"""
SELECT l_orderkey, l_linenumber,
       CAST(dense_rank() OVER (ORDER BY f.first_key, l.l_returnflag) - 1 AS DOUBLE) AS code
FROM lineitem l JOIN (SELECT l_returnflag, min(l_shipdate) AS first_key FROM lineitem GROUP BY 1) f
  USING (l_returnflag)
""")
def b10f(spark, d):
    li = FR.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return P.target_codes(li, "l_returnflag", order="first", order_col="l_shipdate", out="code") \
        .drop("l_returnflag", "l_shipdate")


_CORR_COLS = ["n_chars", "text_len", "n_words", "n_lines", "n_periods", "toxic"]


def _corr_sql(t: str, cols: list[str], frame: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{x}' AS \"column\", corr({x}, {t}) AS r FROM ({frame})" for x in cols)
    return (f"SELECT \"column\", ROUND(r, 3) + 0.0 AS r, abs(ROUND(r, 3)) + 0.0 AS abs_r FROM ({parts}) "
            f"WHERE r IS NOT NULL AND NOT isnan(r)")  # + 0.0 turns a rounded -0.0 into 0.0


@reg("b11_target_correlations", _corr_sql("quality", _CORR_COLS, DF))
def b11(spark, d):
    return P.target_correlations(FR.doc_features(spark, d).drop("doc_id"), "quality")


@reg("b12_top5_correlations", f"""
SELECT "column", r, abs_r, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY abs_r DESC, "column") AS rank FROM ({_corr_sql('quality', _CORR_COLS, DF)}))
WHERE rank <= 5
""")
def b12(spark, d):
    return P.target_correlations(FR.doc_features(spark, d).drop("doc_id"), "quality", k=5) \
        .withColumn("rank", F.col("rank").cast("int"))


_WIDE_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_orderkey", "l_partkey",
              "l_suppkey"]


@reg("b31_top12_correlations", f"""
SELECT "column", r, abs_r, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY abs_r DESC, "column") AS rank
  FROM ({_corr_sql('net', _WIDE_CORR, FR.PRICED_LINEITEM_SQL.replace('l_orderkey, l_linenumber,', 'l_orderkey, l_linenumber, l_partkey, l_suppkey,'))}))
WHERE rank <= 12
""")
def b31(spark, d):
    li = FR.table(spark, d, "lineitem")
    df = li.select(*_WIDE_CORR, (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("net"))
    return P.target_correlations(df, "net", k=12).withColumn("rank", F.col("rank").cast("int"))


@reg("b13_correlation_matrix", f"""
SELECT a, b, ROUND(r, 6) AS r FROM (
  SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem
  UNION ALL SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem)
""")
def b13(spark, d):
    li = FR.table(spark, d, "lineitem")
    return P.correlation_matrix(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], digits=6)


@reg("b15_skewness", """
SELECT "column", ROUND(skew, 6) AS skew, coalesce(abs(skew) > 1.0, false) AS is_skewed FROM (
  SELECT 'value' AS "column", skewness(value) AS skew FROM events
  UNION ALL SELECT 'user_id', skewness(user_id) FROM events
  UNION ALL SELECT 'event_id', skewness(event_id) FROM events)
""")
def b15(spark, d):
    ev = FR.table(spark, d, "events")
    return P.skewness_table(ev, ["value", "user_id", "event_id"]).withColumn("skew", F.round("skew", 6))


@reg("b16_imbalance_ratio", f"""
SELECT CAST(count(*) AS BIGINT) AS n_classes,
       CASE WHEN count(*) <= 10 THEN ROUND(min(n) / max(n), 2) END AS ratio
FROM (SELECT toxic, count(*) AS n FROM ({DOCS}) GROUP BY toxic)
""")
def b16(spark, d):
    return P.imbalance_ratio(FR.labelled_docs(spark, d), "toxic")


@reg("b17_problem_type", """
SELECT 'l_returnflag' AS target, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_unique,
       'multiclass_classification' AS problem_type FROM lineitem
""")
def b17(spark, d):
    return R.detect_problem_type(FR.table(spark, d, "lineitem"), "l_returnflag")


@reg("b18_problem_type_years", """
SELECT 'o_year' AS target, CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) AS n_unique,
       CASE WHEN count(DISTINCT year(o_orderdate)) = 2 THEN 'binary_classification'
            WHEN count(DISTINCT year(o_orderdate)) BETWEEN 3 AND 20 AND min(year(o_orderdate)) >= 1900
                 AND max(year(o_orderdate)) <= 2100 THEN 'regression'
            WHEN count(DISTINCT year(o_orderdate)) BETWEEN 3 AND 20 THEN 'multiclass_classification'
            ELSE 'regression' END AS problem_type
FROM orders
""")
def b18(spark, d):
    o = FR.table(spark, d, "orders").select(F.year("o_orderdate").alias("o_year"))
    return R.detect_problem_type(o, "o_year")


@reg("b19_imbalance_strategy", f"""
SELECT n_classes, ratio,
       CASE WHEN ratio IS NULL THEN 'none' WHEN ratio >= 0.4 THEN 'none'
            WHEN ratio >= 0.15 THEN 'class_weight_balanced' WHEN ratio >= 0.05 THEN 'smote_plus_class_weight'
            ELSE 'threshold_tuning_plus_pr_auc' END AS strategy
FROM (SELECT CAST(count(*) AS BIGINT) AS n_classes,
             CASE WHEN count(*) <= 10 THEN ROUND(min(n) / max(n), 2) END AS ratio
      FROM (SELECT toxic, count(*) AS n FROM ({DOCS}) GROUP BY toxic))
""")
def b19(spark, d):
    return R.imbalance_strategy(FR.labelled_docs(spark, d), "toxic")


def _id_name_sql() -> str:
    low = 'lower("column")'
    names = ", ".join(f"'{p}'" for p in K.ID_PATTERNS)
    tests = " OR ".join(f"starts_with({low}, '{p}_') OR ends_with({low}, '_{p}')" for p in K.ID_PATTERNS)
    return f"{low} IN ({names}) OR {tests}"


def _plan_sql(frame: str, cols: list[str], target: str, string_cols: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", count(DISTINCT {x}) AS n_unique, count(*) - count({x}) AS n_missing, "
        f"count(*) AS n_rows FROM ({frame})" for x in cols)
    strs = ", ".join(f"'{x}'" for x in string_cols)
    return f"""
SELECT "column", CAST(n_unique AS BIGINT) AS n_unique, CAST(n_rows AS BIGINT) AS n_rows,
       ROUND(n_missing / n_rows, 6) AS null_pct,
       "column" <> '{target}' AS not_target, "column" IN ({strs}) AS is_str,
       ({_id_name_sql()}) AS id_name
FROM ({parts})
"""


_DL_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_comment_len", "l_returnflag", "l_linestatus", "l_qty_text", "l_shipdate"]
_DL_STR = ["l_returnflag", "l_linestatus", "l_qty_text"]
_DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
_DOC_STR = ["text", "lang", "source"]


@reg("b22_null_patterns", f"""
SELECT "column", null_pct, CASE WHEN null_pct = 0 THEN 'none' WHEN null_pct > 0.5 THEN 'high_missing_consider_drop'
                               ELSE 'mcar_impute' END AS null_pattern
FROM ({_plan_sql(D, _DL_COLS, 'l_returnflag', _DL_STR)}) WHERE not_target
""")
def b22(spark, d):
    return R.null_patterns(FR.dirty_lineitem(spark, d), "l_returnflag").withColumn("null_pct", F.round("null_pct", 6))


@reg("b23_encoding_plan", f"""
SELECT "column", n_unique, CASE WHEN lower("column") = 'education' THEN 'ordinal'
                                WHEN n_unique > 15 THEN 'frequency' ELSE 'onehot' END AS encoding
FROM ({_plan_sql(DOCS, _DOC_COLS, 'quality', _DOC_STR)}) WHERE not_target AND is_str
""")
def b23(spark, d):
    return R.encoding_plan(FR.labelled_docs(spark, d), "quality")


@reg("b25_id_like_columns", f"""
SELECT "column", n_unique, n_rows FROM ({_plan_sql(DOCS, _DOC_COLS, 'quality', _DOC_STR)})
WHERE not_target AND ((n_unique > 0.95 * n_rows AND (id_name OR is_str)) OR (id_name AND n_unique > 0.8 * n_rows))
""")
def b25(spark, d):
    return R.id_like_columns(FR.labelled_docs(spark, d), "quality")


@reg("b26_constant_columns", f"""
SELECT "column", n_unique FROM ({_plan_sql('SELECT *, 1 AS one, CAST(NULL AS DOUBLE) AS nothing FROM events',
                                             ['event_id', 'ts', 'user_id', 'event_type', 'value', 'props', 'one', 'nothing'],
                                             'value', ['event_type', 'props'])})
WHERE not_target AND n_unique <= 1
""")
def b26(spark, d):
    ev = FR.table(spark, d, "events").withColumn("one", F.lit(1)).withColumn("nothing", F.lit(None).cast("double"))
    return R.constant_columns(ev, "value")


_DT_FRAME = "SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_date_text, o_orderpriority FROM orders"


def _dt_sql(col: str) -> str:
    sample = f"SELECT {col} AS v FROM ({_DT_FRAME}) WHERE {col} IS NOT NULL"
    return f"""
SELECT '{col}' AS "column", 'string' AS kind, ROUND(s.ok / s.n, 6) AS sample_share, ROUND(f.share, 6) AS full_share,
       s.n >= 5 AND s.ok / s.n > 0.8 AND f.share > 0.7 AS is_datetime
FROM (SELECT count(*) AS n, count(TRY_CAST(v AS TIMESTAMP)) AS ok FROM ({sample})) s,
     (SELECT count(TRY_CAST({col} AS TIMESTAMP)) / count(*) AS share FROM ({_DT_FRAME})) f
"""


@reg("b27_datetime_columns", f"""
SELECT 'o_orderdate' AS "column", 'native' AS kind, CAST(NULL AS DOUBLE) AS sample_share,
       CAST(NULL AS DOUBLE) AS full_share, true AS is_datetime
UNION ALL {_dt_sql('o_date_text')}
UNION ALL {_dt_sql('o_orderpriority')}
""")
def b27(spark, d):
    o = FR.table(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_date_text"),
        "o_orderpriority")
    return P.datetime_columns(o).withColumn("sample_share", F.round("sample_share", 6)) \
        .withColumn("full_share", F.round("full_share", 6))


@reg("b28_text_columns", f"""
SELECT "column", CAST(n_unique AS BIGINT) AS n_unique, ROUND(mean_len, 6) AS mean_len,
       n_unique > greatest(50.0, 0.3 * n_rows) AND coalesce(mean_len, 0) > 25 AS is_text
FROM (SELECT 'text' AS "column", count(DISTINCT text) AS n_unique, avg(length(text)) AS mean_len, count(*) AS n_rows
      FROM ({DOCS})
      UNION ALL SELECT 'lang', count(DISTINCT lang), avg(length(lang)), count(*) FROM ({DOCS})
      UNION ALL SELECT 'source', count(DISTINCT source), avg(length(source)), count(*) FROM ({DOCS}))
""")
def b28(spark, d):
    return P.text_columns(FR.labelled_docs(spark, d)).withColumn("mean_len", F.round("mean_len", 6))


@reg("b30_missing_table", f"""
SELECT "column", CAST(n_missing AS BIGINT) AS n_missing, ROUND(100.0 * n_missing / n_rows, 2) AS pct,
       CAST(sum(n_missing) OVER () AS BIGINT) AS total_missing
FROM ({_plan_sql(D, _DL_COLS, 'l_returnflag', _DL_STR)}) WHERE n_missing > 0
""".replace("CAST(n_unique AS BIGINT) AS n_unique, CAST(n_rows AS BIGINT) AS n_rows,",
            "CAST(n_unique AS BIGINT) AS n_unique, CAST(n_rows AS BIGINT) AS n_rows, n_missing,"))
def b30(spark, d):
    return P.missing_table(FR.dirty_lineitem(spark, d))


_HEAT = ["toxic", "n_chars", "text_len", "n_words", "n_lines", "n_periods"]
_HEAT_RANKS = " UNION ALL ".join(f"SELECT '{x}' AS col, {i} AS pos, abs(corr({x}, quality)) AS r FROM ({FR.DOC_FEATURES_SQL})"
                                 for i, x in enumerate(_HEAT))
_HEAT_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM ({FR.DOC_FEATURES_SQL})"
                                 for a in _HEAT for b in _HEAT if a != b)


@reg("b14_correlation_heatmap", f"""
WITH k AS (SELECT col, row_number() OVER (ORDER BY r DESC, pos) AS k FROM ({_HEAT_RANKS}))
SELECT p.x AS a, p.y AS b, ROUND(p.r, 3) AS r FROM ({_HEAT_PAIRS}) p JOIN k i ON p.x = i.col JOIN k j ON p.y = j.col WHERE i.k < j.k
""")
def b14(spark, d):
    return P.correlation_heatmap(FR.doc_features(spark, d).drop("doc_id"), "quality", k=20)


_INV_COLS = [(0, "doc_id", "bigint", "numeric"), (1, "text", "string", "categorical"),
             (2, "lang", "string", "categorical"), (3, "source", "string", "categorical"),
             (4, "n_chars", "bigint", "numeric"), (5, "quality", "int", "target"), (6, "toxic", "int", "numeric")]


def _inventory_sql() -> str:
    meta = ", ".join(f"({p}, '{n}', '{dt}', '{role}')" for p, n, dt, role in _INV_COLS)
    stats = " UNION ALL ".join(
        f"SELECT '{n}' AS col, count(*) AS n_rows, count(*) - count({n}) AS n_missing, count(DISTINCT {n}) AS n_unique, "
        + (f"skewness({n}) AS skew, " if dt != "string" else "CAST(NULL AS DOUBLE) AS skew, ")
        + (f"corr({n}, quality) AS r " if role == "numeric" else "CAST(NULL AS DOUBLE) AS r ")
        + f"FROM ({DOCS})" for _, n, dt, role in _INV_COLS)
    return f"""
WITH meta AS (SELECT * FROM (VALUES {meta}) AS m(position, col, dtype, role)),
     s AS ({stats}),
     j AS (SELECT meta.*, s.n_rows, s.n_missing, s.n_unique, s.skew, s.r, s.n_missing / s.n_rows AS null_pct
           FROM meta JOIN s ON meta.col = s.col)
SELECT CAST(position AS INTEGER) AS position, col AS "column", dtype, role, CAST(n_rows AS BIGINT) AS n_rows,
       CAST(n_missing AS BIGINT) AS n_missing, ROUND(null_pct, 6) AS null_pct, CAST(n_unique AS BIGINT) AS n_unique,
       ROUND(skew, 6) AS skew, CASE WHEN r IS NULL OR isnan(r) THEN NULL ELSE ROUND(r, 3) + 0.0 END AS r,
       CASE WHEN role = 'target' THEN 'target' WHEN n_unique <= 1 THEN 'constant'
            WHEN null_pct > 0.6 THEN 'mostly missing' WHEN n_missing > 0 THEN 'has missing values'
            WHEN abs(skew) > 1.0 THEN 'skewed' ELSE 'ok' END AS note
FROM j
"""


@reg("b29_column_inventory", _inventory_sql())
def b29(spark, d):
    return P.column_inventory(FR.labelled_docs(spark, d), "quality").withColumn("null_pct", F.round("null_pct", 6)) \
        .withColumn("skew", F.round("skew", 6))


_ISSUE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_comment_len"]
_ISSUES = [f"""SELECT '{x}' AS "column", 'possible_outliers' AS issue, CAST(count_if({x} < lo OR {x} > hi) AS DOUBLE) AS evidence FROM ({D}),
  (SELECT quantile_cont({x}, {K.CLIP_LOW}) AS lo, quantile_cont({x}, {K.CLIP_HIGH}) AS hi FROM ({D})) HAVING evidence > 0""" for x in _ISSUE_NUM]
_ISSUES += [f"SELECT '{x}', 'low_variance', coalesce(var_samp({x}), 0) AS v FROM ({D}) HAVING v < 1e-8" for x in _ISSUE_NUM]
for _x in ("l_linestatus", "l_qty_text"):
    _ISSUES.append(f"""SELECT '{_x}', 'inconsistent_values', CAST(count(*) AS DOUBLE) AS n FROM (SELECT lower(trim({_x})) FROM ({D})
  WHERE {_x} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_x}) > 1) HAVING n > 0""")
    _ISSUES.append(f"""SELECT '{_x}', 'type_mismatch', count(TRY_CAST({_x} AS DOUBLE)) / greatest(count({_x}), 1) AS p FROM ({D})
  HAVING p > {K.NUMERIC_PARSE_SHARE}""")


@reg("b32_data_issues", f"""
SELECT "column", issue, ROUND(evidence, 6) AS evidence FROM ({" UNION ALL ".join(f"({x})" for x in _ISSUES)})
""")
def b32(spark, d):
    return P.data_issues(FR.dirty_lineitem(spark, d), "l_returnflag").withColumn("evidence", F.round("evidence", 6))


@reg("b02_column_roles", f"""
SELECT *, CASE WHEN "column" = 'l_returnflag' THEN 'target' WHEN dtype IN ('bigint', 'int', 'double') THEN 'numeric'
               WHEN dtype = 'timestamp_ntz' THEN 'datetime' ELSE 'categorical' END AS role
FROM (SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS "column",
             CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                  WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE column_type END AS dtype
      FROM (DESCRIBE {FR.DIRTY_LINEITEM_SQL}))
""")
def b02(spark, d):
    return P.column_roles(FR.dirty_lineitem(spark, d), "l_returnflag")
