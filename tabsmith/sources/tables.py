"""Sources, sinks and admission.

Reads are lazy scans (Parquet pushes filters and prunes columns; CSV takes an
explicit schema when one is known, so types are inferred at most once).
Stage outputs are written to the shared checkpoint folder and read back,
which cuts lineage and survives executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.exprs import c, is_numeric, nan_to_null, numeric_cols, type_name
from ..session import shared_path


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
               header: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """A1/A2: CSV (header, inferred or given schema; header-less with ``columns``) or Parquet.
    NaN becomes NULL at ingest (pandas treats them as one)."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "parquet":
        return nan_to_null(spark.read.parquet(path))
    reader = spark.read.option("header", header).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False)
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", True).csv(path)
    if columns is not None:
        df = df.toDF(*columns)
    return nan_to_null(df)


def table_columns(df: DataFrame) -> DataFrame:
    """A3: (position, column, dtype) from the schema alone; no job for Parquet."""
    rows = [(i, f.name, type_name(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def preview(df: DataFrame, n: int = 5, order: Sequence[str] | None = None) -> DataFrame:
    """A4: first n rows (by ``order`` when given, which makes the preview deterministic)."""
    return (df.orderBy(*[c(x) for x in order]) if order else df).limit(n)


def row_count(df: DataFrame) -> int:
    """A5."""
    return df.count()


def preview_report(df: DataFrame, n: int = 5, order: Sequence[str] | None = None) -> dict:
    """Shape, columns, dtypes, head, null counts and describe, as small frames."""
    from ..operators import profile as P
    return {"shape": P.shape(df), "columns": table_columns(df), "head": preview(df, n, order),
            "nulls": P.null_counts(df), "describe": P.describe_table(df)}


def report_rows(report: dict) -> DataFrame:
    """A6's frames as one: (section, column, item, text, value), numbers as ``value``, anything else as ``text``."""
    parts = []

    def cells(section: str, df: DataFrame, name: str, column: Column, item: Column) -> None:
        number = is_numeric(df.schema[name].dataType)
        parts.append(df.select(F.lit(section).alias("section"), column.alias("column"), item.alias("item"),
                               (F.lit(None) if number else c(name)).cast("string").alias("text"),
                               (c(name) if number else F.lit(None)).cast("double").alias("value")))

    for x in report["shape"].columns:
        cells("shape", report["shape"], x, F.lit(None).cast("string"), F.lit(x))
    cells("columns", report["columns"], "dtype", F.col("column"), F.lit("dtype"))
    head = report["head"]
    numbered = head.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(head.collect())],  # the few rows of a preview
                                                 T.StructType([T.StructField("__row", T.IntegerType()), *head.schema.fields]))
    for x in head.columns:
        cells("head", numbered, x, F.lit(x), F.concat(F.lit("row "), F.col("__row")))
    cells("nulls", report["nulls"], "n_missing", F.col("column"), F.lit("n_missing"))
    for x in report["describe"].columns[1:]:
        cells("describe", report["describe"], x, F.col("column"), F.lit(x))
    return reduce(DataFrame.unionByName, parts)


def admission_check(df: DataFrame, min_rows: int = K.MIN_ROWS, min_cols: int = K.MIN_COLS, max_cols: int = K.MAX_COLS,
                    max_rows: int | None = None) -> DataFrame:
    """(check, passed, observed, limit): rows >= min_rows (and <= max_rows when set),
    min_cols <= columns <= max_cols, at least one numeric column."""
    n = df.count()
    k = len(df.columns)
    n_num = len(numeric_cols(df))
    rows = [("min_rows", n >= min_rows, float(n), float(min_rows)),
            ("min_columns", k >= min_cols, float(k), float(min_cols)),
            ("max_columns", k <= max_cols, float(k), float(max_cols)),
            ("has_numeric_column", n_num >= 1, float(n_num), 1.0)]
    if max_rows is not None:
        rows.append(("max_rows", n <= max_rows, float(n), float(max_rows)))
    return df.sparkSession.createDataFrame(rows, "check string, passed boolean, observed double, limit double")


def select_columns(df: DataFrame, rename: dict | None = None, drop: Sequence[str] = (),
                   numeric_only: bool = False) -> DataFrame:
    """Rename, drop, optionally keep numeric columns only."""
    out = df.withColumnsRenamed(rename) if rename else df
    out = out.drop(*drop)
    return out.select(*[c(x) for x in numeric_cols(out)]) if numeric_only else out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", header: bool = True) -> str:
    """Parquet or CSV without index; CSV keeps leading/trailing spaces (so " ?" survives)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", header).option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.parquet(path)
    return path


def materialize(df: DataFrame, stage: str) -> DataFrame:
    """A10: write a stage output to the shared checkpoint folder and continue from the written copy."""
    path = shared_path(df.sparkSession, stage)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_metrics(metrics: DataFrame, path: str, group: Sequence[str] = ()) -> str:
    """Nested JSON document(s): one object per group with a ``metrics`` map."""
    doc = (metrics.groupBy(*group) if group else metrics.groupBy(F.lit("run").alias("run"))).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    doc.select(F.to_json(F.struct(*doc.columns)).alias("value")).write.mode("overwrite").text(path)
    return path
