"""Column-expression helpers shared by all operators (JVM-side, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def c(name: str) -> Column:
    """Column by exact name (names may hold dots, spaces or slashes)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL + FRACTIONAL)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL)


def is_fractional(dt: T.DataType) -> bool:
    return isinstance(dt, FRACTIONAL)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in ex]


def string_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ex]


def boolean_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType) and f.name not in ex]


def datetime_typed_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_datetime(f.dataType) and f.name not in ex]


def type_name(dt: T.DataType) -> str:
    return dt.simpleString()


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN -> NULL for float/double columns (Spark keeps them apart; pandas merges them)."""
    targets = [f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (cols is None or f.name in cols)]
    if not targets:
        return df
    return df.withColumns({n: F.when(F.isnan(c(n)), F.lit(None)).otherwise(c(n)) for n in targets})


def inf_to_null(col: Column) -> Column:
    return F.when(F.abs(col) == F.lit(float("inf")), F.lit(None)).otherwise(col)


def corrected_skew(col: Column) -> Column:
    """Bias-corrected (sample) skewness, as pandas/DuckDB report it.

    Spark's ``skewness`` is the population form g1; G1 = g1 * sqrt(n(n-1)) / (n-2).
    NULL for n < 3 or zero variance.
    """
    n = F.count(col).cast("double")
    return F.when(n >= 3, F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


def hex_cut(fraction: float) -> str:
    """Eight-hex-digit cut point: md5 prefixes below it make up ``fraction`` of keys."""
    v = int(round(min(max(fraction, 0.0), 1.0) * 16 ** 8))
    return "%08x" % v if v < 16 ** 8 else "g"  # 'g' sorts after every hex digit


def hash8(keys: Sequence[str | Column], seed: int) -> Column:
    """First 8 hex digits of md5(key1:key2:...:seed) — same value in DuckDB."""
    parts = [(k if isinstance(k, Column) else c(k)).cast("string") for k in keys]
    return F.substring(F.md5(F.concat_ws(":", *parts, F.lit(str(seed)))), 1, 8)


def hash_unit(keys: Sequence[str | Column], seed: int) -> Column:
    """Uniform value in [0, 1) from the md5 prefix (for weights and ordering)."""
    return F.conv(hash8(keys, seed), 16, 10).cast("double") / float(16 ** 8)


def round6(col: Column) -> Column:
    return F.round(col.cast("double"), 6)


def safe_name(name: str) -> str:
    """Generated column names: no dots or backticks."""
    return name.replace(".", "_").replace("`", "_")
