"""Registered queries for cleaning (C), with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import hash8, hex_cut
from ..operators import clean as C
from . import frames as FR
from .catalog_profile import _plan_sql

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
STR_NULLS = ", ".join("'" + s.replace("'", "''") + "'" for s in K.STRING_NULLS)
NUM_NULLS = ", ".join(str(v) for v in K.NUMERIC_NULLS)
TRAIN_CUT = hex_cut(0.2)


def _r(x: str, d: int = 6) -> str:
    return f"ROUND(CAST({x} AS DOUBLE), {d})"


def _sentinel_sql(col: str, frame: str) -> str:
    """Generic numeric-sentinel rule for one column, evaluated in SQL."""
    hits = " OR ".join(
        f"({col} = {v} AND (SELECT count_if({col} = {v}) / count(*) > 0.05 AND "
        f"min(CASE WHEN {col} NOT IN ({NUM_NULLS}) THEN {col} END) >= 0 FROM ({frame})))"
        for v in K.NUMERIC_NULLS)
    return f"CASE WHEN {hits} THEN NULL ELSE {col} END"


# ----------------------------------------------------------------------------- C1, C2, C3

@reg("c01_string_sentinels", f"""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linestatus IN ({STR_NULLS}) THEN NULL ELSE l_linestatus END AS l_linestatus,
       CASE WHEN l_qty_text IN ({STR_NULLS}) THEN NULL ELSE l_qty_text END AS l_qty_text
FROM ({D})
""")
def c01(spark, d):
    df = FR.dirty_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_linestatus", "l_qty_text")
    return C.null_sentinels(df)


@reg("c02_numeric_sentinels", f"""
SELECT l_orderkey, l_linenumber, CAST({_sentinel_sql('l_suppkey', D)} AS DOUBLE) AS l_suppkey,
       CAST({_sentinel_sql('l_partkey', D)} AS DOUBLE) AS l_partkey
FROM ({D})
""")
def c02(spark, d):
    df = FR.dirty_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    out = C.null_sentinels(df, exclude=["l_orderkey", "l_linenumber"])
    return out.withColumns({x: F.col(x).cast("double") for x in ["l_suppkey", "l_partkey"]})


@reg("c03_sentinel_counts", f"""
WITH x AS (
  SELECT 'l_linestatus' AS "column", CAST(count_if(l_linestatus IN ({STR_NULLS})) AS BIGINT) AS n_replaced FROM ({D})
  UNION ALL SELECT 'l_qty_text', CAST(count_if(l_qty_text IN ({STR_NULLS})) AS BIGINT) FROM ({D})
  UNION ALL SELECT 'l_suppkey', CAST(count_if(l_suppkey IS NOT NULL AND ({_sentinel_sql('l_suppkey', D)}) IS NULL) AS BIGINT)
            FROM ({D}))
SELECT * FROM x UNION ALL SELECT '__total__', CAST(sum(n_replaced) AS BIGINT) FROM x
""")
def c03(spark, d):
    df = FR.dirty_lineitem(spark, d).select("l_linestatus", "l_qty_text", "l_suppkey")
    fit = C.SentinelNulls().fit(df)
    return fit.counts(df)


# ----------------------------------------------------------------------------- C4-C6

_USELESS_FRAME = f"""
SELECT doc_id, text, lang, source, n_chars, quality, toxic, 'x' AS const_col,
       CASE WHEN n_chars > 300 THEN NULL ELSE n_chars END AS short_chars
FROM ({DOCS})
"""
_USELESS_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", "const_col", "short_chars"]


@reg("c04_drop_useless", f"""
SELECT "column", reason, CAST(evidence AS BIGINT) AS evidence FROM (
  SELECT "column",
         CASE WHEN (n_unique > 0.95 * n_rows AND (id_name OR is_str)) OR (id_name AND n_unique > 0.8 * n_rows)
                THEN 'id_like'
              WHEN null_pct > 0.6 THEN 'mostly_missing'
              WHEN n_unique <= 1 THEN 'constant' END AS reason,
         CASE WHEN (n_unique > 0.95 * n_rows AND (id_name OR is_str)) OR (id_name AND n_unique > 0.8 * n_rows)
                THEN n_unique
              WHEN null_pct > 0.6 THEN round(null_pct * n_rows)
              ELSE n_unique END AS evidence, not_target
  FROM ({_plan_sql(_USELESS_FRAME, _USELESS_COLS, 'quality', ['text', 'lang', 'source', 'const_col'])}))
WHERE reason IS NOT NULL AND not_target
""")
def c04(spark, d):
    df = FR.labelled_docs(spark, d).withColumn("const_col", F.lit("x")) \
        .withColumn("short_chars", F.when(F.col("n_chars") > 300, F.lit(None)).otherwise(F.col("n_chars")))
    return C.drop_useless(df, "quality")[1]


# ----------------------------------------------------------------------------- C7-C9, C32

def _share(col: str, frame: str) -> str:
    return f"(SELECT (count(*) - count({col})) / count(*) FROM ({frame}))"


def _med(col: str, frame: str) -> str:
    return f"(SELECT quantile_cont({col}, 0.5) FROM ({frame}))"


@reg("c07_numeric_imputer", f"""
SELECT l_orderkey, l_linenumber,
       {_r(f"CASE WHEN {_share('l_quantity', D)} > 0 THEN COALESCE(l_quantity, {_med('l_quantity', D)}) ELSE l_quantity END")}
         AS l_quantity,
       CAST(l_quantity IS NULL AS INTEGER) AS l_quantity_was_missing,
       {_r(f"COALESCE(l_discount, {_med('l_discount', D)})")} AS l_discount,
       l_extendedprice
FROM ({D})
""")
def c07(spark, d):
    df = FR.dirty_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                                            "l_comment_len", "l_extendedprice")
    fit = C.NumericImputer(exclude=["l_orderkey", "l_linenumber"]).fit(df)
    out = fit.transform(df)
    return out.withColumn("l_quantity", F.round("l_quantity", 6)).withColumn("l_discount", F.round("l_discount", 6))


@reg("c07_imputer_actions", f"""
SELECT "column", ROUND(share, 6) AS share,
       CASE WHEN share = 0 THEN 'none' WHEN share > 0.20 THEN 'drop'
            WHEN share >= 0.05 THEN 'flag_median' ELSE 'median' END AS action
FROM (SELECT 'l_quantity' AS "column", {_share('l_quantity', D)} AS share
      UNION ALL SELECT 'l_discount', {_share('l_discount', D)}
      UNION ALL SELECT 'l_tax', {_share('l_tax', D)}
      UNION ALL SELECT 'l_comment_len', {_share('l_comment_len', D)}
      UNION ALL SELECT 'l_extendedprice', {_share('l_extendedprice', D)})
""")
def c07a(spark, d):
    df = FR.dirty_lineitem(spark, d).select("l_quantity", "l_discount", "l_tax", "l_comment_len", "l_extendedprice")
    fit = C.NumericImputer().fit(df)
    rows = [(n, round(s, 6), fit.action(n)) for n, s in fit.shares.items()]
    return spark.createDataFrame(rows, "column string, share double, action string")


@reg("c32_imputer_variant", f"""
SELECT l_orderkey, l_linenumber,
       {_r(f"COALESCE(l_tax, {_med('l_tax', D)})")} AS l_tax,
       {_r(f"COALESCE(l_quantity, {_med('l_quantity', D)})")} AS l_quantity,
       CAST(l_comment_len IS NULL AS INTEGER) AS l_comment_len_was_missing,
       {_r(f"COALESCE(l_comment_len, {_med('l_comment_len', D)})")} AS l_comment_len
FROM ({D})
""")
def c32(spark, d):
    df = FR.dirty_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_tax", "l_quantity", "l_comment_len")
    fit = C.NumericImputer(flag_min=0.30, flag_min_inclusive=False, flag_max=1.0, drop_above=None,
                           exclude=["l_orderkey", "l_linenumber"]).fit(df)
    out = fit.transform(df)
    return out.select("l_orderkey", "l_linenumber", *[F.round(x, 6).alias(x) for x in
                                                      ["l_tax", "l_quantity", "l_comment_len"]],
                      "l_comment_len_was_missing")


# ----------------------------------------------------------------------------- C10

_LS = f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus IN ({STR_NULLS}) THEN NULL ELSE l_linestatus END AS l_linestatus FROM ({D})"


@reg("c10_mode_imputer", f"""
SELECT l_orderkey, l_linenumber,
       COALESCE(l_linestatus, (SELECT v FROM (SELECT l_linestatus AS v, count(*) AS n FROM ({_LS})
                                              WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)),
                'unknown') AS l_linestatus
FROM ({_LS})
""")
def c10(spark, d):
    df = C.null_sentinels(FR.dirty_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_linestatus"))
    return C.ModeImputer().fit(df).transform(df)


# ----------------------------------------------------------------------------- C11-C14

@reg("c11_numeric_string_shares", f"""
SELECT "column", ROUND(share, 6) AS share FROM (
  SELECT 'l_returnflag' AS "column", count(TRY_CAST(l_returnflag AS DOUBLE)) / count(*) AS share FROM ({D})
  UNION ALL SELECT 'l_linestatus', count(TRY_CAST(l_linestatus AS DOUBLE)) / count(*) FROM ({D})
  UNION ALL SELECT 'l_qty_text', count(TRY_CAST(l_qty_text AS DOUBLE)) / count(*) FROM ({D}))
""")
def c11s(spark, d):
    return C.numeric_string_shares(FR.dirty_lineitem(spark, d)).withColumn("share", F.round("share", 6))


@reg("c11_cast_numeric_strings", f"""
SELECT l_orderkey, l_linenumber, l_returnflag,
       CASE WHEN (SELECT count(TRY_CAST(l_qty_text AS DOUBLE)) / count(*) FROM ({D})) > 0.85
            THEN TRY_CAST(l_qty_text AS DOUBLE) END AS l_qty_text
FROM ({D})
""")
def c11(spark, d):
    df = FR.dirty_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag", "l_qty_text")
    return C.cast_numeric_strings(df)[0]


@reg("c12_coerce_numeric", f"SELECT l_orderkey, l_linenumber, TRY_CAST(l_linestatus AS DOUBLE) AS l_linestatus FROM ({D})")
def c12(spark, d):
    return C.coerce_numeric(FR.dirty_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_linestatus"),
                            "l_linestatus")


_BOOL_FRAME = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE 'No' END AS is_open,
       CASE WHEN l_returnflag = 'R' THEN 'TRUE' ELSE 'false' END AS returned,
       l_returnflag
FROM lineitem
"""


@reg("c13_boolean_text", f"""
SELECT l_orderkey, l_linenumber, l_returnflag,
       CASE WHEN lower(is_open) IN ('yes', 'true') THEN 1 WHEN lower(is_open) IN ('no', 'false') THEN 0 END AS is_open,
       CASE WHEN lower(returned) IN ('yes', 'true') THEN 1 WHEN lower(returned) IN ('no', 'false') THEN 0 END AS returned
FROM ({_BOOL_FRAME})
""")
def c13(spark, d):
    li = FR.table(spark, d, "lineitem")
    df = li.select("l_orderkey", "l_linenumber",
                   F.when(F.col("l_linestatus") == "O", "Yes").otherwise("No").alias("is_open"),
                   F.when(F.col("l_returnflag") == "R", "TRUE").otherwise("false").alias("returned"),
                   "l_returnflag")
    return C.map_boolean_text(df)


_SEGMENTS = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4}


@reg("c14_map_values", """
SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                                         WHEN 'HOUSEHOLD' THEN 4 END AS DOUBLE) AS c_mktsegment
FROM customer
""")
def c14(spark, d):
    cu = FR.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return C.map_values(cu, "c_mktsegment", {k: float(v) for k, v in _SEGMENTS.items()})


# ----------------------------------------------------------------------------- C15

def _dt_sql(col: str, key: str, table: str, with_hour: bool) -> str:
    hour = f", CAST(coalesce(hour({col}), 0) AS INTEGER) AS {col}_hour" if with_hour else ""
    return f"""
SELECT {key}, CAST(coalesce(year({col}), 0) AS INTEGER) AS {col}_year,
       CAST(coalesce(month({col}), 0) AS INTEGER) AS {col}_month,
       CAST(coalesce(day({col}), 0) AS INTEGER) AS {col}_day,
       CAST(coalesce(isodow({col}) - 1, 0) AS INTEGER) AS {col}_dayofweek,
       CAST(coalesce(isodow({col}) - 1 >= 5, false) AS INTEGER) AS {col}_is_weekend{hour}
FROM {table}
"""


@reg("c15_expand_datetime_events", _dt_sql("ts", "event_id", "events", True))
def c15e(spark, d):
    ev = FR.table(spark, d, "events").select("event_id", "ts")
    return C.expand_datetime(ev, ["ts"])


@reg("c15_expand_datetime_orders", _dt_sql("o_orderdate", "o_orderkey", "orders", False))
def c15o(spark, d):
    o = FR.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return C.expand_datetime(o, ["o_orderdate"])


# ----------------------------------------------------------------------------- C16-C22

_TRAIN_DOCS = f"SELECT * FROM documents WHERE substr(md5(concat_ws(':', doc_id, '42')), 1, 8) >= '{TRAIN_CUT}'"


def _freq_sql(inline: bool) -> str:
    return f"""
WITH f AS (SELECT text, count(*) / (SELECT count(*) FROM ({_TRAIN_DOCS})) AS freq FROM ({_TRAIN_DOCS}) GROUP BY text)
SELECT d.doc_id, ROUND(COALESCE(f.freq, 0.0), 6) AS text FROM documents d LEFT JOIN f ON d.text = f.text
"""


def _freq_query(spark, d, inline_limit):
    docs = FR.table(spark, d, "documents").select("doc_id", "text")
    train = docs.where(hash8(["doc_id"], K.SEED) >= F.lit(TRAIN_CUT))
    enc = C.FrequencyEncoder(cols=["text"], inline_limit=inline_limit).fit(train)
    return enc.transform(docs).withColumn("text", F.round("text", 6))


@reg("c16_frequency_encode_text", _freq_sql(True))
def c16(spark, d):
    return _freq_query(spark, d, C.INLINE_LEVELS)


@reg("c16_frequency_encode_join", _freq_sql(False))
def c16j(spark, d):
    return _freq_query(spark, d, 0)


@reg("c17_onehot_drop_first", """
SELECT c_custkey, CAST(coalesce(c_mktsegment = 'BUILDING', false) AS INTEGER) AS c_mktsegment_BUILDING,
       CAST(coalesce(c_mktsegment = 'FURNITURE', false) AS INTEGER) AS c_mktsegment_FURNITURE,
       CAST(coalesce(c_mktsegment = 'HOUSEHOLD', false) AS INTEGER) AS c_mktsegment_HOUSEHOLD,
       CAST(coalesce(c_mktsegment = 'MACHINERY', false) AS INTEGER) AS c_mktsegment_MACHINERY
FROM customer
""")
def c17(spark, d):
    cu = FR.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return C.OneHot(cols=["c_mktsegment"]).fit(cu).transform(cu)


@reg("c18_onehot_all_levels", """
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F,
       CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P
FROM orders
""")
def c18(spark, d):
    o = FR.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return C.OneHot(cols=["o_orderstatus"], drop_first=False).fit(o).transform(o)


@reg("c19_frequency_encode_levels", """
SELECT p_partkey, ROUND(count(*) OVER (PARTITION BY p_type) / count(*) OVER (), 6) AS p_type FROM part
""")
def c19(spark, d):
    p = FR.table(spark, d, "part").select("p_partkey", "p_type")
    return C.FrequencyEncoder(cols=["p_type"]).fit(p).transform(p).withColumn("p_type", F.round("p_type", 6))


_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]


@reg("c20_ordinal_encode", """
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
                                             WHEN '2-HIGH' THEN 3 ELSE -1 END AS INTEGER) AS o_orderpriority
FROM orders
""")
def c20(spark, d):
    o = FR.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return C.ordinal_encode(o, {"o_orderpriority": _ORDER})


@reg("c21_encode_all", """
SELECT c_custkey,
       ROUND(count(*) OVER (PARTITION BY CAST(c_nationkey AS VARCHAR)) / count(*) OVER (), 6) AS c_nation,
       CAST(coalesce(c_mktsegment = 'BUILDING', false) AS INTEGER) AS c_mktsegment_BUILDING,
       CAST(coalesce(c_mktsegment = 'FURNITURE', false) AS INTEGER) AS c_mktsegment_FURNITURE,
       CAST(coalesce(c_mktsegment = 'HOUSEHOLD', false) AS INTEGER) AS c_mktsegment_HOUSEHOLD,
       CAST(coalesce(c_mktsegment = 'MACHINERY', false) AS INTEGER) AS c_mktsegment_MACHINERY
FROM customer
""")
def c21(spark, d):
    cu = FR.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("c_nation"),
                                               "c_mktsegment")
    return C.encode_all(cu, ["c_nation", "c_mktsegment"]).withColumn("c_nation", F.round("c_nation", 6))


@reg("c22_label_encode", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand,
       CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type
FROM part
""")
def c22(spark, d):
    p = FR.table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return C.LabelEncoder(cols=["p_brand", "p_type"]).fit(p).transform(p)


@reg("c22_label_encode_distributed", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS p_name FROM part
""")
def c22d(spark, d):
    p = FR.table(spark, d, "part").select("p_partkey", "p_name")
    return C.LabelEncoder(cols=["p_name"], inline_limit=0).fit(p).transform(p)


# ----------------------------------------------------------------------------- C23, C24

@reg("c23_encode_target_regression", f"""
SELECT l_orderkey, l_linenumber, TRY_CAST(l_qty_text AS DOUBLE) AS l_qty_text FROM ({D})
WHERE TRY_CAST(l_qty_text AS DOUBLE) IS NOT NULL
""")
def c23(spark, d):
    df = FR.dirty_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_qty_text")
    return C.encode_target(df, "l_qty_text", "regression")[0]


_SPACED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN ' ' || l_returnflag ELSE l_returnflag END AS flag FROM lineitem"


@reg("c24_encode_target_class", f"""
SELECT l_orderkey, l_linenumber,
       CAST(dense_rank() OVER (ORDER BY trim(flag)) - 1 AS INTEGER) AS flag FROM ({_SPACED})
""")
def c24(spark, d):
    li = FR.table(spark, d, "lineitem")
    df = li.select("l_orderkey", "l_linenumber",
                   F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" "), "l_returnflag"))
                   .otherwise(F.col("l_returnflag")).alias("flag"))
    return C.encode_target(df, "flag", "multiclass_classification")[0]


# ----------------------------------------------------------------------------- C25-C27

@reg("c25_log_transform", """
SELECT event_id,
       ROUND(CASE WHEN (SELECT min(value) FROM events) >= 0 THEN ln(1 + value) ELSE value END, 6) AS value,
       ROUND(CASE WHEN (SELECT min(user_id) FROM events) >= 0 THEN ln(1 + user_id) ELSE user_id END, 6) AS user_id
FROM events
""")
def c25(spark, d):
    ev = FR.table(spark, d, "events").select("event_id", "value", "user_id")
    out, _ = C.log_transform(ev, ["value", "user_id"])
    return out.withColumn("value", F.round("value", 6)).withColumn("user_id", F.round("user_id", 6))


def _clip(col: str) -> str:
    lo = f"(SELECT quantile_cont({col}, 0.01) FROM lineitem)"
    hi = f"(SELECT quantile_cont({col}, 0.99) FROM lineitem)"
    return f"ROUND(CASE WHEN {col} < {lo} THEN {lo} WHEN {col} > {hi} THEN {hi} ELSE {col} END, 6)"


@reg("c26_winsorize", f"""
SELECT l_orderkey, l_linenumber, {_clip('l_extendedprice')} AS l_extendedprice, {_clip('l_quantity')} AS l_quantity
FROM lineitem
""")
def c26(spark, d):
    li = FR.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    out = C.Winsorizer(exclude=["l_orderkey", "l_linenumber"]).fit(li).transform(li)
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 6)) \
        .withColumn("l_quantity", F.round("l_quantity", 6))


def _clip_count_sql(col: str) -> str:
    lo = f"(SELECT quantile_cont({col}, 0.01) FROM lineitem)"
    hi = f"(SELECT quantile_cont({col}, 0.99) FROM lineitem)"
    return (f"SELECT '{col}' AS \"column\", CAST(count_if({col} < {lo} OR {col} > {hi}) AS BIGINT) AS n_clipped, "
            f"ROUND({lo}, 6) AS low, ROUND({hi}, 6) AS high FROM lineitem")


@reg("c26_clip_counts", _clip_count_sql("l_extendedprice") + " UNION ALL " + _clip_count_sql("l_quantity"))
def c26c(spark, d):
    li = FR.table(spark, d, "lineitem").select("l_extendedprice", "l_quantity")
    out = C.Winsorizer().fit(li).clipped_counts(li)
    return out.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@reg("c27_bool_to_int", """
SELECT event_id, CAST(value > 10 AS TINYINT) AS high_value, CAST(event_type = 'error' AS TINYINT) AS is_error
FROM events
""")
def c27(spark, d):
    ev = FR.table(spark, d, "events").select("event_id", (F.col("value") > 10).alias("high_value"),
                                             (F.col("event_type") == "error").alias("is_error"))
    return C.bool_to_int(ev)


# ----------------------------------------------------------------------------- C28-C31, C33

@reg("c28_drop_duplicates", "SELECT DISTINCT text, lang FROM documents")
def c28(spark, d):
    return C.drop_duplicates(FR.table(spark, d, "documents").select("text", "lang"))


@reg("c28_duplicate_count", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST((SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents))
       AS BIGINT) AS n_distinct,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS BIGINT) AS n_duplicates
FROM documents
""")
def c28c(spark, d):
    return C.duplicate_count(FR.table(spark, d, "documents").select("text", "lang"))


_TWIN_FRAME = """
SELECT o_orderpriority, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS o_prio_num, o_orderstatus FROM orders
"""


@reg("c29_redundant_pairs", f"""
SELECT 'o_orderpriority' AS keep, 'o_prio_num' AS twin,
       count(DISTINCT o_orderpriority) = count(DISTINCT (o_orderpriority, o_prio_num))
       AND count(DISTINCT o_prio_num) = count(DISTINCT (o_orderpriority, o_prio_num)) AS one_to_one
FROM ({_TWIN_FRAME})
UNION ALL
SELECT 'o_orderpriority', 'o_orderstatus',
       count(DISTINCT o_orderpriority) = count(DISTINCT (o_orderpriority, o_orderstatus))
       AND count(DISTINCT o_orderstatus) = count(DISTINCT (o_orderpriority, o_orderstatus))
FROM ({_TWIN_FRAME})
""")
def c29(spark, d):
    o = FR.table(spark, d, "orders").select(
        "o_orderpriority", F.substring("o_orderpriority", 1, 1).cast("int").alias("o_prio_num"), "o_orderstatus")
    return C.redundant_pairs(o, [("o_orderpriority", "o_prio_num"), ("o_orderpriority", "o_orderstatus")])


@reg("c30_final_fill", f"""
SELECT l_orderkey, l_linenumber,
       {_r(f"COALESCE(l_quantity, {_med('l_quantity', D)})")} AS l_quantity,
       {_r(f"COALESCE(l_tax, {_med('l_tax', D)})")} AS l_tax,
       {_r(f"COALESCE(l_comment_len, {_med('l_comment_len', D)})")} AS l_comment_len,
       COALESCE(CASE WHEN l_linestatus IN ({STR_NULLS}) THEN NULL ELSE l_linestatus END,
                (SELECT v FROM (SELECT l_linestatus AS v, count(*) AS n FROM ({_LS})
                                WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)),
                'unknown') AS l_linestatus
FROM ({D})
""")
def c30(spark, d):
    df = FR.dirty_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_comment_len",
                                            "l_linestatus")
    out = C.final_fill(C.null_sentinels(df, exclude=["l_orderkey", "l_linenumber", "l_quantity", "l_tax",
                                                     "l_comment_len"]))
    return out.select("l_orderkey", "l_linenumber", "l_linestatus",
                      *[F.round(x, 6).alias(x) for x in ["l_quantity", "l_tax", "l_comment_len"]])


@reg("c31_drop_null_rows", f"SELECT * FROM ({D}) WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_comment_len IS NOT NULL")
def c31(spark, d):
    return C.drop_null_rows(FR.dirty_lineitem(spark, d))


@reg("c33_cleaning_summary", f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(13 AS BIGINT) AS n_cols, 'string' AS target_dtype,
       CAST(9 AS BIGINT) AS n_numeric,
       NOT bool_or(l_quantity IS NULL OR l_discount IS NULL OR l_tax IS NULL OR l_comment_len IS NULL) AS no_missing,
       CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_target_values,
       string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS target_values
FROM ({D})
""")
def c33(spark, d):
    df = FR.dirty_lineitem(spark, d)
    values = C.target_values(df, "l_returnflag").agg(  # a three-valued flag
        F.array_join(F.sort_array(F.collect_list("target_value")), ",").alias("target_values"))
    return C.cleaning_summary(df, "l_returnflag").join(values, F.lit(True))


@reg("c33_target_values", f"SELECT DISTINCT l_returnflag AS target_value FROM ({D})")
def c33v(spark, d):
    return C.target_values(FR.dirty_lineitem(spark, d), "l_returnflag")
