"""Long-form (unpivoted) aggregates: one pass for many columns, partial aggregation map-side."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exprs import c

WIDE_LIMIT = 30  # below this many columns a single wide agg is cheaper than unpivot


def long_form(df: DataFrame, cols: Sequence[str], cast: str | None = None, ids: Sequence[str] = ()) -> DataFrame:
    """(ids..., column, value) with one row per (row, column). Names are kept in ``column``."""
    sel = [c(i) for i in ids] + [(c(x).cast(cast) if cast else c(x)).alias(f"_v{k}") for k, x in enumerate(cols)]
    names = F.create_map(*[x for k, name in enumerate(cols) for x in (F.lit(f"_v{k}"), F.lit(name))])
    return (
        df.select(*sel)
        .unpivot(list(ids), [f"_v{k}" for k in range(len(cols))], "_slot", "value")
        .withColumn("column", names[F.col("_slot")])
        .drop("_slot")
    )


def value_counts_long(df: DataFrame, cols: Sequence[str], include_null: bool = False) -> DataFrame:
    """(column, value:string, n) for every column; hot values collapse in the partial aggregate."""
    long = long_form(df, cols, cast="string")
    if not include_null:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def exact_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_unique), nulls excluded: distinct 128-bit hashes of the values, then a count per column, so no text
    is shuffled, and keys of three numbers are all that is grouped."""
    cols = list(cols)
    cells = [F.when(c(x).isNotNull(), F.struct(F.lit(i).alias("_i"), *hash128(*_told_apart(df, x)))) for i, x in enumerate(cols)]
    long = df.select(F.inline(F.array(*cells))).where(F.col("_i").isNotNull())
    counts = long.distinct().groupBy("_i").agg(F.count(F.lit(1)).alias("n_unique"))
    return counts.select(F.get(F.array(*[F.lit(x) for x in cols]), F.col("_i")).alias("column"), "n_unique")


def _told_apart(df: DataFrame, name: str) -> list[Column]:
    """What to hash of a column, so that values of different text differ. Most kinds are hashed as they are, which spares writing
    every number as text; fractions come with the text of a zero, as a hash doesn't tell -0.0 from 0.0."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType, T.StringType, T.DateType)):
        return [c(name)]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [c(name), F.when(c(name) == 0, c(name).cast("string"))]
    return [c(name).cast("string")]


def hash128(*values: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a tuple of values, nulls told apart from each other and from values."""
    parts = [x for v in values for x in (v.isNull(), v)]
    return F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit(0x5EED), *parts).alias("_h2")


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, mode): most frequent non-null value, smallest value on ties (string order)."""
    vc = value_counts_long(df, cols)
    return vc.groupBy("column").agg(F.min_by("value", F.struct((-F.col("n")).alias("k"), F.col("value"))).alias("mode"))


def level_counts(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, int]:
    """Distinct non-null counts, exact whenever the answer to "more than ``limit``?" depends on it.

    One HLL pass for all columns; columns whose estimate is near or below ``limit`` get an exact
    count (cheap: they have few values). Far-above columns keep the estimate, so a free-text
    column is never shuffled just to learn that it has too many levels.
    """
    cols = list(cols)
    if not cols:
        return {}
    row = df.agg(*[F.approx_count_distinct(c(x), 0.01).alias(f"_a{i}") for i, x in enumerate(cols)]).first()
    out = {}
    near = [x for i, x in enumerate(cols) if row[f"_a{i}"] <= 2 * limit + 10]
    if near:
        exact = df.agg(*[F.count_distinct(c(x)).alias(f"_e{i}") for i, x in enumerate(near)]).first()
        out.update({x: int(exact[f"_e{i}"]) for i, x in enumerate(near)})
    out.update({x: int(row[f"_a{i}"]) for i, x in enumerate(cols) if x not in out})
    return out


def student_t_sf2(t: float, dof: int) -> float:
    """Two-sided p-value of Student's t (regularised incomplete beta, continued fraction)."""
    if dof <= 0 or t is None or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    x = dof / (dof + t * t)
    return _betainc(dof / 2.0, 0.5, x)


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbeta) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbeta) * _betacf(b, a, 1 - x) / b


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1, a - 1
    cc, d = 1.0, 1 - qab * x / qap
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1 + aa * d
        d = 1 / (d if abs(d) > tiny else tiny)
        cc = 1 + aa / cc
        cc = cc if abs(cc) > tiny else tiny
        h *= d * cc
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1 + aa * d
        d = 1 / (d if abs(d) > tiny else tiny)
        cc = 1 + aa / cc
        cc = cc if abs(cc) > tiny else tiny
        de = d * cc
        h *= de
        if abs(de - 1) < 3e-16:
            break
    return h
