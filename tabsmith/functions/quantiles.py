"""Exact quantiles (linear interpolation, as pandas ``quantile`` / DuckDB ``quantile_cont``) by radix selection.

A double becomes a 64-bit integer that sorts as the double does. Level by level the rows of all columns are counted by
(column, leading bits): each task counts its own rows (vectorised over Arrow batches), the counts are summed by
prefix, and a running sum finds the prefixes that hold a wanted rank. The next level counts only rows with such a prefix, by
further bits, and only columns that still have one; a prefix whose least and greatest key agree is done. So a level is one pass
with one grouped count whose size depends on the levels' bits, not on the number of rows or distinct values, and there is one
path at every size. Integers and short decimals need one or two levels, any column at most three.

Only the answers (columns x probabilities) come back to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .cumulative import running_sums
from .exprs import c

DIGITS = (20, 22, 22)      # bits that each level resolves
HELD = 1 << 20             # counts that a task holds before it passes them on
COUNTS = "i int, parent long, prefix long, n long, low long, high long"


def keys_of(values: np.ndarray) -> np.ndarray:
    """int64 keys that sort like the doubles (both zeros alike, NaN last)."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def value_of(key: int) -> float:
    return float(np.array([key ^ ((key >> 63) & (2**63 - 1))], dtype=np.int64).view(np.float64)[0])


def _merge(parts: list) -> list[np.ndarray]:
    """Add up counts by (column, prefix)."""
    i, d, n, low, high = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((d, i))
    i, d, n, low, high = i[order], d[order], n[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (d[1:] != d[:-1])]))
    return [i[first], d[first], np.add.reduceat(n, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)]


def _level(df: DataFrame, cols: dict[int, str], parents: dict[int, np.ndarray] | None, above: int, shift: int) -> DataFrame:
    """(i, parent, prefix, n, low, high): rows of column i by their key's bits above ``shift``; with ``parents`` only rows whose
    bits above ``above`` are among column i's."""
    numbers = list(cols)
    src = df.select(*[c(x).cast("double").alias(f"v{i}") for i, x in cols.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def emit():
            i, d, n, low, high = _merge(parts)
            parent = d >> (above - shift) if above < 64 else np.zeros_like(d)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (i.astype(np.int32), parent, d, n, low, high)],
                                              ["i", "parent", "prefix", "n", "low", "high"])

        for b in batches:
            for at, i in enumerate(numbers):
                values = b.column(at).drop_null().to_numpy(zero_copy_only=False)
                k = keys_of(values)
                if parents is not None:
                    k = k[np.isin(k >> above, parents[i])]
                if not len(k):
                    continue
                k.sort()
                d = k >> shift
                first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                last = np.append(first[1:], len(k)) - 1
                parts.append((np.full(len(first), i), d[first], last - first + 1, k[first], k[last]))
                held += len(first)
            if held > HELD:
                parts = [_merge(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield emit()
                    parts, held = [], 0
        if parts:
            yield emit()

    return src.mapInArrow(run, COUNTS).groupBy("i", "parent", "prefix").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _selected(df: DataFrame, cols: Sequence[str], ranks_of) -> tuple[dict[int, int], dict[tuple[int, int], float]]:
    """({column: rows}, {(column, 0-based rank): value}). ``ranks_of(total)`` is the array column of ranks wanted of a column with
    so many rows."""
    ship_package(df.sparkSession)
    spark = df.sparkSession
    totals, done = {}, {}
    open_cols, parents, wanted = dict(enumerate(cols)), None, None
    above = 64
    for bits in DIGITS:
        shift = above - bits
        counts = _level(df, open_cols, parents, above, shift)
        inside = Window.partitionBy("i", "parent")
        below = F.sum("n").over(inside.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("below", F.coalesce(below, F.lit(0))).withColumn("total", F.sum("n").over(inside))
        if wanted is None:
            counts = counts.withColumn("ranks", ranks_of(F.col("total")))
        else:
            need = spark.createDataFrame([(i, p, sorted({left for left, _ in rs})) for (i, p), rs in wanted.items()],
                                         "i int, parent long, ranks array<long>")
            counts = counts.join(F.broadcast(need), ["i", "parent"])  # columns x ranks at most
        held = F.filter("ranks", lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("n")))
        hits = counts.withColumn("held", held).where(F.size("held") > 0) \
            .select("i", "parent", "prefix", "low", "high", "below", "total", "held").collect()
        following: dict[tuple[int, int], list] = {}
        for h in hits:
            if wanted is None:
                totals[h["i"]] = h["total"]
                mine = [(r, r) for r in h["held"]]
            else:
                mine = [(left, rank) for left, rank in wanted[h["i"], h["parent"]] if left in h["held"]]
            for left, rank in mine:
                if h["low"] == h["high"]:
                    done[h["i"], rank] = value_of(h["low"])
                else:
                    following.setdefault((h["i"], h["prefix"]), []).append((left - h["below"], rank))
        wanted, above = following, shift
        if not wanted:
            break
        open_cols = {i: cols[i] for i in sorted({i for i, _ in wanted})}
        parents = {i: np.array(sorted(p for j, p in wanted if j == i), dtype=np.int64) for i in open_cols}
    return totals, done


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """``{column: [q(p) for p in probs]}``; None for all-null columns."""
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols:
        return {}

    def ranks_of(total):
        at = [(total - 1) * F.lit(p) for p in probs]
        return F.array_distinct(F.array(*[f(h).cast("long") for h in at for f in (F.floor, F.ceil)]))

    totals, found = _selected(df, cols, ranks_of)
    out = {}
    for i, x in enumerate(cols):
        vals: list = []
        for p in probs:
            if i not in totals:
                vals.append(None)
                continue
            h = (totals[i] - 1) * p
            lo, hi = found[i, math.floor(h)], found[i, math.ceil(h)]
            vals.append(lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo))
        out[x] = vals
    return out


def order_statistics(df: DataFrame, order_col: str, part_col: str, wanted: Sequence[tuple]) -> dict[tuple, object]:
    """Values at 0-based ranks within parts: ``{(part, rank): value}`` for each requested pair.

    Counts per (part, value) feed bucketed running sums, so a part holding most rows is still
    spread over many tasks. ``wanted`` is small (parts x cut points).
    """
    if not wanted:
        return {}
    counts = df.groupBy(c(part_col).alias("_part"), c(order_col).alias("_v")).agg(
        F.count(F.lit(1)).alias("n")).persist()
    cum = running_sums(counts, "_v", ["n"], part_cols=["_part"])
    schema = f"_part {df.schema[part_col].dataType.simpleString()}, _pos long"
    pos = df.sparkSession.createDataFrame([(p, int(k)) for p, k in wanted], schema)
    hits = (cum.join(F.broadcast(pos), on="_part")  # pos: one row per requested cut, bounded
            .where((F.col("cum_n") - F.col("n") <= F.col("_pos")) & (F.col("_pos") < F.col("cum_n")))
            .select("_part", "_pos", "_v").collect())
    counts.unpersist()
    return {(r["_part"], r["_pos"]): r["_v"] for r in hits}


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {k: v[0] for k, v in exact_quantiles(df, cols, [0.5]).items()}
