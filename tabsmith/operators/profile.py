"""Profiling operators.

Every profile is a long table keyed by ``column``. Statistics over many
columns run in one pass: a single wide aggregate for narrow tables, the
unpivoted form (``column``, ``value``) grouped by ``column`` for wide ones.
Only bounded results (one row per column or class) ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.aggregates import WIDE_LIMIT, exact_distinct, long_form, value_counts_long
from ..functions.cumulative import top_k_per_group
from ..functions.exprs import (
    c, corrected_skew, dtype_of, is_datetime, is_fractional, is_numeric, numeric_cols, string_cols, type_name,
)
from ..functions.cumulative import BROADCAST_ROWS, dense_ranks
from ..functions.gramian import correlations
from ..functions.quantiles import exact_quantiles


def _columns_frame(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(position, column, dtype) from the schema; size bounded by the table's width."""
    rows = [(i, n, type_name(dtype_of(df, n))) for i, n in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def _wide_to_long(agg_row_df: DataFrame, slots: dict[str, str], value_name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Turn a one-row wide aggregate with slot columns into (keep..., column, value) lazily."""
    names = F.create_map(*[x for slot, name in slots.items() for x in (F.lit(slot), F.lit(name))])
    return (
        agg_row_df.unpivot(list(keep), list(slots), "_slot", value_name)
        .withColumn("column", names[F.col("_slot")])
        .drop("_slot")
    )


def _is_missing(df: DataFrame, name: str) -> Column:
    col = c(name)
    return (col.isNull() | F.isnan(col)) if is_fractional(dtype_of(df, name)) else col.isNull()


# ----------------------------------------------------------------------------- B1, B2

def shape(df: DataFrame) -> DataFrame:
    """B1: (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("bigint"))


def role_of(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_numeric(dt):
        return "numeric"
    if is_datetime(dt):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "categorical"
    return "other"


def column_roles(df: DataFrame, target: str | None = None) -> DataFrame:
    """B2: (position, column, dtype, role) from the schema alone (no job)."""
    rows = [(i, f.name, type_name(f.dataType), "target" if f.name == target else role_of(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, role string")


# ----------------------------------------------------------------------------- B3, B4, B5

def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_missing, null_pct, n_rows). NaN counts as missing (pandas semantics)."""
    cols = list(cols or df.columns)
    slots = {f"_m{i}": n for i, n in enumerate(cols)}
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count_if(_is_missing(df, n)).alias(s) for s, n in slots.items()])
    long = _wide_to_long(agg, slots, "n_missing", keep=["n_rows"])
    return long.select(
        "column", "n_missing",
        F.when(F.col("n_rows") > 0, F.col("n_missing") / F.col("n_rows")).otherwise(F.lit(0.0)).alias("null_pct"),
        "n_rows",
    )


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_unique), nulls excluded, exact."""
    cols = list(cols or df.columns)
    return (_columns_frame(df, cols).join(exact_distinct(df, cols), "column", "left")
            .select("column", F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique")))


def approx_distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_unique_estimate), nulls excluded, by HyperLogLog in one aggregate."""
    slots = {f"_d{i}": n for i, n in enumerate(cols or df.columns)}
    agg = df.agg(*[F.approx_count_distinct(c(n)).alias(s) for s, n in slots.items()])
    return _wide_to_long(agg, slots, "n_unique_estimate").select("column", F.col("n_unique_estimate").cast("bigint"))


# ----------------------------------------------------------------------------- B6

def describe_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column count, mean, std (n-1), min, 25/50/75 % (exact, linear), max."""
    cols = list(cols or numeric_cols(df))
    stats = ["count", "mean", "std", "min", "max"]
    exprs = []
    for i, n in enumerate(cols):
        x = c(n).cast("double")
        exprs += [F.count(x).alias(f"count_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev_samp(x).alias(f"std_{i}"),
                  F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}")]
    row = df.agg(*exprs).first()
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    data = []
    for i, n in enumerate(cols):
        vals = {s: row[f"{s}_{i}"] for s in stats}
        p25, p50, p75 = q[n]
        data.append((n, int(vals["count"]), vals["mean"], vals["std"], vals["min"], p25, p50, p75, vals["max"]))
    schema = ("column string, count bigint, mean double, std double, min double, p25 double, p50 double, "
              "p75 double, max double")
    return df.sparkSession.createDataFrame(data, schema)


# ----------------------------------------------------------------------------- B7, B8, B16

def target_distribution(df: DataFrame, t: str, include_null: bool = False) -> DataFrame:
    """(value, n, pct). pct over the counted rows (nulls included only when asked)."""
    base = df if include_null else df.where(c(t).isNotNull())
    counts = base.groupBy(c(t).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = base.count()
    return counts.withColumn("pct", F.col("n") / F.lit(max(total, 1)))


def imbalance_ratio(df: DataFrame, t: str, max_classes: int = 10) -> DataFrame:
    """(n_classes, ratio). ratio = min/max class count rounded to 2, NULL above ``max_classes``.

    ``n_classes`` counts a null bucket, like ``unique()``; the counts exclude nulls.
    """
    counts = df.groupBy(c(t).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min(F.when(F.col("value").isNotNull(), F.col("n"))).alias("n_min"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("n_max"),
    ).select(
        "n_classes",
        F.when(F.col("n_classes") <= max_classes, F.round(F.col("n_min") / F.col("n_max"), 2)).alias("ratio"),
    )


# ----------------------------------------------------------------------------- B9

def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """(column, value, n, rank) — k most frequent values per column, ties by value."""
    cols = list(cols or string_cols(df))
    vc = value_counts_long(df, cols)
    return top_k_per_group(vc, ["column"], [F.col("n").desc(), F.col("value").asc()], k, spread_key=["value"])


# ----------------------------------------------------------------------------- B10

def target_codes(df: DataFrame, t: str, order: str = "sorted", order_col: str | None = None, out: str | None = None) -> DataFrame:
    """Numeric codes 0..k-1 for a string target (sorted values, or first appearance by ``order_col``), any number of levels."""
    out = out or t
    if is_numeric(dtype_of(df, t)):
        return df.withColumn(out, c(t).cast("double"))
    known = df.where(c(t).isNotNull())
    if order == "first":
        if order_col is None:
            raise ValueError("order='first' needs order_col: Spark rows have no positional order")
        keys, by = known.groupBy(c(t).alias("_level")).agg(F.min(c(order_col)).alias("_first_at")), ["_first_at", "_level"]
    else:
        keys, by = known.select(c(t).alias("_level")).distinct(), ["_level"]
    table, n = dense_ranks(keys, by)
    table = table.select("_level", "_code")
    codes = df.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, c(t) == F.col("_level"), "left").drop("_level")
    return codes.withColumn(out, F.col("_code").cast("double")).drop("_code")


# ----------------------------------------------------------------------------- B11, B12, B13, B14, B31

def target_correlations(df: DataFrame, t: str, cols: Sequence[str] | None = None, k: int | None = None,
                        digits: int | None = 3) -> DataFrame:
    """(column, r, abs_r) Pearson r with the target, pairwise-complete, NULL r dropped.

    With ``k``: the k largest |r| (ties by column name) with a ``rank``.
    """
    coded = target_codes(df, t, out="_t")
    cols = [n for n in (cols or numeric_cols(df)) if n != t]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, r double, abs_r double")
    if len(cols) <= WIDE_LIMIT:
        slots = {f"_r{i}": n for i, n in enumerate(cols)}
        agg = coded.agg(*[F.corr(c(n).cast("double"), F.col("_t")).alias(s) for s, n in slots.items()])
        res = _wide_to_long(agg, slots, "r")
    else:
        long = long_form(coded, cols, cast="double", ids=["_t"])
        res = long.groupBy("column").agg(F.corr("value", "_t").alias("r"))
    res = res.where(F.col("r").isNotNull() & ~F.isnan("r"))
    r = F.round("r", digits) + F.lit(0.0) if digits is not None else F.col("r")  # no signed zero after rounding
    res = res.select("column", r.alias("r")).withColumn("abs_r", F.abs("r"))
    if k is not None:
        w = Window.orderBy(F.col("abs_r").desc(), F.col("column"))  # one row per column: bounded
        res = res.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return res


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """Long (a, b, r) for a < b in column order; pairwise-complete rows (pandas ``corr``, NaN counts as missing), null where
    a column doesn't vary. One pass for all pairs (``functions.gramian``), nulls or not."""
    cols = list(cols or numeric_cols(df))
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    out = correlations(df, cols)
    return out.withColumn("r", F.round("r", digits)) if digits is not None else out


def correlation_heatmap(df: DataFrame, t: str, k: int = 20, digits: int | None = 3) -> DataFrame:
    """Correlation sub-matrix (a, b, r) of the k columns most correlated with the target."""
    top = [r["column"] for r in target_correlations(df, t, k=k, digits=None).orderBy("rank").collect()]
    return correlation_matrix(df, top, digits=digits)


# ----------------------------------------------------------------------------- B15

def skewness_table(df: DataFrame, cols: Sequence[str] | None = None, limit: float = K.LOG_SKEW) -> DataFrame:
    """(column, skew, is_skewed) bias-corrected skewness; is_skewed = |skew| > limit."""
    cols = list(cols or numeric_cols(df))
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, skew double, is_skewed boolean")
    if len(cols) <= WIDE_LIMIT:
        slots = {f"_s{i}": n for i, n in enumerate(cols)}
        res = _wide_to_long(df.agg(*[corrected_skew(c(n).cast("double")).alias(s) for s, n in slots.items()]),
                            slots, "skew")
    else:
        res = long_form(df, cols, cast="double").groupBy("column").agg(corrected_skew(F.col("value")).alias("skew"))
    return res.select("column", "skew", F.coalesce(F.abs("skew") > limit, F.lit(False)).alias("is_skewed"))


# ----------------------------------------------------------------------------- B27, B28

def datetime_columns(df: DataFrame, exclude: Sequence[str] = (), sample_share: float = K.DATETIME_SAMPLE_SHARE,
                     full_share: float = K.DATETIME_FULL_SHARE, min_sample: int = K.DATETIME_MIN_SAMPLE) -> DataFrame:
    """(column, kind, sample_share, full_share, is_datetime).

    Native date/time types count directly. Of a string column, the non-null values (at least ``min_sample``) must
    parse above ``sample_share``, and of all rows more than ``full_share``. Both shares are over the whole
    column, in one aggregate for all columns.
    """
    ex = set(exclude)
    native = [f.name for f in df.schema.fields if is_datetime(f.dataType) and f.name not in ex]
    strs = [n for n in string_cols(df) if n not in ex]
    spark = df.sparkSession
    schema = "column string, kind string, sample_share double, full_share double, is_datetime boolean"
    out = spark.createDataFrame([(n, "native", None, None, True) for n in native], schema)
    if not strs:
        return out
    per = [F.struct(F.lit(n).alias("column"), F.count(c(n)).alias("n"), F.count_if(F.try_to_timestamp(c(n)).isNotNull()).alias("ok"),
                    F.count(F.lit(1)).alias("rows")) for n in strs]
    found = df.agg(F.array(*per).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    shares = found.select("column", F.lit("string").alias("kind"), F.when(F.col("n") > 0, F.col("ok") / F.col("n")).alias("sample_share"),
                          F.when(F.col("rows") > 0, F.col("ok") / F.col("rows")).alias("full_share"), "n")
    return out.unionByName(shares.select(
        "column", "kind", "sample_share", "full_share",
        F.coalesce((F.col("n") >= min_sample) & (F.col("sample_share") > sample_share) & (F.col("full_share") > full_share),
                   F.lit(False)).alias("is_datetime")))


def text_columns(df: DataFrame, exclude: Sequence[str] = (), min_distinct: int = K.TEXT_MIN_DISTINCT,
                 distinct_share: float = K.TEXT_DISTINCT_SHARE, min_mean_len: float = K.TEXT_MIN_MEAN_LEN) -> DataFrame:
    """(column, n_unique, mean_len, is_text): distinct > max(50, 0.3 n) and mean length > 25."""
    strs = [n for n in string_cols(df) if n not in set(exclude)]
    if not strs:
        return df.sparkSession.createDataFrame([], "column string, n_unique bigint, mean_len double, is_text boolean")
    n_rows = F.lit(df.count())
    slots = {f"_l{i}": n for i, n in enumerate(strs)}
    lens = _wide_to_long(df.agg(*[F.avg(F.length(c(n))).alias(s) for s, n in slots.items()]), slots, "mean_len")
    nu = distinct_counts(df, strs)
    return nu.join(lens, "column").select(
        "column", "n_unique", "mean_len",
        ((F.col("n_unique") > F.greatest(F.lit(float(min_distinct)), distinct_share * n_rows))
         & (F.coalesce(F.col("mean_len"), F.lit(0.0)) > min_mean_len)).alias("is_text"),
    )


# ----------------------------------------------------------------------------- profile, B29, B30, B32

def profile(df: DataFrame, t: str | None = None) -> DataFrame:
    """Per-column profile: position, column, dtype, role, n_rows, n_missing, null_pct, n_unique, skew.

    One fused aggregate pass gives the row count, per-column null counts and (for narrow tables) skewness; exact distinct
    counts over hashes of the values are a second one. The result has one row per column.
    """
    cols = df.columns
    num = set(numeric_cols(df))
    fuse_skew = len(num) <= WIDE_LIMIT
    exprs = [F.count(F.lit(1)).alias("_n")]
    for i, n in enumerate(cols):
        exprs.append(F.count_if(_is_missing(df, n)).alias(f"_m{i}"))
        if fuse_skew and n in num:
            exprs.append(corrected_skew(c(n).cast("double")).alias(f"_s{i}"))
    row = df.agg(*exprs).first()
    n_rows = row["_n"]
    if fuse_skew:
        skew = {n: row[f"_s{i}"] for i, n in enumerate(cols) if n in num}
    else:
        skew = {r["column"]: r["skew"] for r in skewness_table(df, sorted(num)).collect()}
    uniq = {r["column"]: r["n_unique"] for r in distinct_counts(df, cols).collect()}
    rows = []
    for i, f in enumerate(df.schema.fields):
        n = f.name
        m = row[f"_m{i}"]
        rows.append((i, n, type_name(f.dataType), "target" if n == t else role_of(f.dataType), int(n_rows), int(m),
                     (m / n_rows) if n_rows else 0.0, int(uniq.get(n, 0)), skew.get(n)))
    schema = ("position int, column string, dtype string, role string, n_rows bigint, n_missing bigint, "
              "null_pct double, n_unique bigint, skew double")
    return df.sparkSession.createDataFrame(rows, schema)


def column_inventory(df: DataFrame, t: str) -> DataFrame:
    """Profile + correlation with the target + a note per column."""
    prof = profile(df, t)
    corr = target_correlations(df, t).select("column", "r")
    note = (F.when(F.col("role") == "target", F.lit("target"))
            .when(F.col("n_unique") <= 1, F.lit("constant"))
            .when(F.col("null_pct") > K.NULL_DROP, F.lit("mostly missing"))
            .when(F.col("n_missing") > 0, F.lit("has missing values"))
            .when(F.abs(F.col("skew")) > K.LOG_SKEW, F.lit("skewed"))
            .otherwise(F.lit("ok")))
    return prof.join(corr, "column", "left").withColumn("note", note)


def missing_table(df: DataFrame) -> DataFrame:
    """(column, n_missing, pct, total_missing) for columns with nulls, most first."""
    nc = null_counts(df).where(F.col("n_missing") > 0)
    everything = Window.partitionBy()  # one row per column: bounded by the table's width
    return nc.select("column", "n_missing", F.round(F.col("null_pct") * 100, 2).alias("pct"),
                     F.sum("n_missing").over(everything).alias("total_missing"))


def data_issues(df: DataFrame, t: str | None = None, low_variance: float = 1e-8,
                numeric_share: float = K.NUMERIC_PARSE_SHARE) -> DataFrame:
    """(column, issue, evidence) for possible outliers, low variance, inconsistent values, type mismatch.

    * outliers: values outside the 1 %/99 % percentiles (evidence = count)
    * low_variance: variance below ``low_variance`` or a single value
    * inconsistent: string values that collide after lower(trim()) but differ before
    * type_mismatch: string column whose values parse as numbers above ``numeric_share``
    """
    spark = df.sparkSession
    issues = []
    num = [n for n in numeric_cols(df) if n != t]
    strs = [n for n in string_cols(df) if n != t]
    if num:
        q = exact_quantiles(df, num, [K.CLIP_LOW, K.CLIP_HIGH])
        exprs = []
        for i, n in enumerate(num):
            lo, hi = q[n]
            x = c(n).cast("double")
            exprs.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"_o{i}") if lo is not None
                         else F.lit(0).cast("bigint").alias(f"_o{i}"))
            exprs.append(F.coalesce(F.var_samp(x), F.lit(0.0)).alias(f"_v{i}"))
        agg = df.agg(*exprs)
        out = _wide_to_long(agg, {f"_o{i}": n for i, n in enumerate(num)}, "evidence")
        issues.append(out.where(F.col("evidence") > 0)
                      .select("column", F.lit("possible_outliers").alias("issue"),
                              F.col("evidence").cast("double").alias("evidence")))
        var = _wide_to_long(agg, {f"_v{i}": n for i, n in enumerate(num)}, "evidence")
        issues.append(var.where(F.col("evidence") < low_variance)
                      .select("column", F.lit("low_variance").alias("issue"), F.col("evidence").cast("double")))
    if strs:
        vc = value_counts_long(df, strs)
        inc = (vc.groupBy("column", F.lower(F.trim("value")).alias("norm"))
               .agg(F.count(F.lit(1)).alias("forms"))
               .where(F.col("forms") > 1)
               .groupBy("column").agg(F.count(F.lit(1)).cast("double").alias("evidence")))
        issues.append(inc.select("column", F.lit("inconsistent_values").alias("issue"), "evidence"))
        share = df.agg(*[(F.count_if(c(n).try_cast("double").isNotNull()) /
                          F.greatest(F.count(c(n)), F.lit(1))).alias(f"_n{i}") for i, n in enumerate(strs)])
        mis = _wide_to_long(share, {f"_n{i}": n for i, n in enumerate(strs)}, "evidence")
        issues.append(mis.where(F.col("evidence") > numeric_share)
                      .select("column", F.lit("type_mismatch").alias("issue"), F.col("evidence").cast("double")))
    if not issues:
        return spark.createDataFrame([], "column string, issue string, evidence double")
    out = issues[0]
    for x in issues[1:]:
        out = out.unionByName(x)
    return out
