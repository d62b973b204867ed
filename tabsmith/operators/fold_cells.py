"""Cells of all folds from passes that all folds share (F12, F15, F23): boosted regressions of complete numeric tables.

A boosted fit needs its fold's training rows as cells only, and rmse and r2 need of the held-out rows of a cell no more than their number, sum and squares.
So no fold's encoded rows are kept: one pass looks at the columns, one counts every fold's values (or ranges of them), from which each fold gets its
own standardisation and split candidates as the folds' counts but its own, and one turns every row into its cell of every fold, summed up in the
task. What stays is cells; rows are neither shuffled nor stored. Tables of at most ``ROWS_ALONE`` rows keep theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import c
from ..session import ship_package
from . import cells as CE

METRICS = ("rmse", "r2")
ROWS_ALONE = 250_000     # rows up to which folds keep their rows; ranges of many values are then cut by each fold's own quantiles
MAX_SLOTS = 60
WORD = 12                # intervals of 5 bits each in a number
CHUNK = 1 << 17          # rows that a task turns into cells at a time
HELD = 1 << 19           # cells of a fold that a task holds before it hands them on
SUMS = ("n", "s", "q", "total")  # rows, labels less their mean over all rows, squares of those, labels


def _counts(folded: DataFrame, t: str, num: Sequence[str]) -> tuple[list[dict], dict[str, list[list]]] | None:
    """([fold's number of rows, mean and squares of each column and the label], {column: [(fold, range, least, greatest, rows)]}); None where a number or
    label is missing or not finite."""
    rows = folded.select(F.col("fold"), *[c(x).cast("double").alias(f"x{i}") for i, x in enumerate([*num, t])])
    names = [f"x{i}" for i in range(len(num))]
    every = [*names, f"x{len(num)}"]
    odd = [F.max(F.coalesce(c(x).isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)), F.lit(True))) for x in every]
    at = [i / CE.RANGES for i in range(1, CE.RANGES)]
    edges = [F.percentile_approx(x, at, 10 * CE.RANGES) for x in names]
    n, lost, *found = rows.agg(F.count(F.lit(1)), F.max(F.col("fold").isNull()), *odd, *[F.approx_count_distinct(x) for x in names], *edges).first()
    odd, levels, edges = found[:len(every)], found[len(every):len(every) + len(names)], found[len(every) + len(names):]
    if not n or lost or any(x is not False for x in odd):
        return None
    borders = {x: sorted(set(e)) for x, k, e in zip(names, levels, edges) if n > CE.VALUES and k > CE.VALUES}
    if borders:
        rows = CE.Bucketizer(inputCols=list(borders), outputCols=[f"{x}_at" for x in borders],
                             splitsArray=[[-math.inf, *b, math.inf] for b in borders.values()]).transform(rows)
    places = [*(f"{x}_at" if x in borders else x for x in names), None]
    long = rows.select("fold", F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.lit(0.0).alias("at") if p is None else F.col(p).alias("at"), F.col(x).alias("x"))
                                                   for i, (x, p) in enumerate(zip(every, places))])).alias("v")).select("fold", "v.*")
    got = long.groupBy("fold", "column", "at").agg(F.min("x"), F.max("x"), F.count(F.lit(1)), F.avg("x"), F.var_pop("x")).collect()
    moments: dict[int, list] = {}
    ranges: dict[int, list] = {}
    for fold, i, place, least, greatest, m, mean, var in got:
        moments.setdefault(fold, [np.zeros(3) for _ in every])
        moments[fold][i] = _joined([moments[fold][i], np.array([m, mean, m * var])])
        ranges.setdefault(i, []).append((fold, place, least, greatest, m))
    return moments, ranges


def _joined(parts: Sequence[np.ndarray]) -> np.ndarray:
    """[number, mean, squared distances from it] of all parts."""
    n = sum(p[0] for p in parts)
    if not n:
        return np.zeros(3)
    mean = sum(p[0] * p[1] for p in parts) / n
    return np.array([n, mean, sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts)])


def _fitted(moments: dict, ranges: dict, m: int, fold: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(mean, scale, cuts of the scaled numbers) of the rows outside of ``fold``."""
    mean, scale, cuts = np.zeros(m), np.zeros(m), []
    for i in range(m):
        n, mean[i], squares = _joined([own[i] for f, own in moments.items() if f != fold])
        std = math.sqrt(squares / (n - 1)) if n > 1 else 0.0
        scale[i] = 1 / std if std else 0.0
        merged: dict[float, list] = {}
        for f, place, least, greatest, rows in ranges[i]:
            if f != fold:
                old = merged.get(place)
                merged[place] = [least, greatest, rows] if old is None else [min(old[0], least), max(old[1], greatest), old[2] + rows]
        scaled = sorted(((a - mean[i]) * scale[i], (b - mean[i]) * scale[i], float(w)) for a, b, w in merged.values())
        cuts.append(np.array(CE.stride_cuts(scaled)) if scale[i] else np.zeros(0))
    return mean, scale, cuts


def _words(codes: np.ndarray) -> np.ndarray:
    """Rows of intervals as whole numbers, ``WORD`` intervals in each."""
    words = [np.zeros(len(codes), np.int64) for _ in range(-(-codes.shape[1] // WORD))]
    for s in range(codes.shape[1]):
        words[s // WORD] |= codes[:, s] << (5 * (s % WORD))
    return np.column_stack(words)


def _summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, with their sums."""
    order = np.lexsort(keys.T) if keys.shape[1] > 1 else np.argsort(keys[:, 0])
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    return keys[starts], np.add.reduceat(sums[order], starts, axis=0)


def _to_cells(fitted: list[tuple], center: float, width: int):
    """Rows (fold, numbers, label) -> (fold, whether the row is held out, words, ``SUMS``) of its cell of every fold, summed up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in fitted]
        waiting, n = [], 0

        def put() -> None:
            fold, *x, y = (np.concatenate(v) for v in zip(*waiting))
            d = y - center
            sums = np.column_stack([np.ones(len(y)), d, d * d, y])
            for i, (mean, scale, cuts) in enumerate(fitted):
                codes = np.column_stack([np.searchsorted(own, (x[s] - mean[s]) * scale[s], "left") for s, own in enumerate(cuts)])
                keys = _words(codes)
                keys[:, -1] = keys[:, -1] << 1 | (fold == i)
                held[i].append(_summed(keys, sums))

        def ready(i: int, least: int) -> Iterator[pa.RecordBatch]:
            if sum(len(k) for k, _ in held[i]) > least:
                keys, sums = _summed(*(np.concatenate(v) for v in zip(*held[i])))
                held[i] = [(keys, sums)]
                if len(keys) > least // 2:
                    held[i] = []
                    for at in range(0, len(keys), 1 << 14):
                        k, s = keys[at:at + (1 << 14)], sums[at:at + (1 << 14)]
                        yield pa.RecordBatch.from_pydict({
                            "unit": pa.array(np.full(len(k), i, np.int32)), "held": pa.array((k[:, -1] & 1) == 1),
                            **{f"w{j}": pa.array(np.ascontiguousarray(k[:, j] >> (j == width - 1))) for j in range(width)},
                            **{x: pa.array(np.ascontiguousarray(s[:, j])) for j, x in enumerate(SUMS)}})

        for b in batches:
            if b.num_rows:
                waiting.append([v.to_numpy(zero_copy_only=False) for v in b.columns])
                n += b.num_rows
            if n >= CHUNK:
                put()
                waiting, n = [], 0
                for i in range(len(fitted)):
                    yield from ready(i, HELD)
        if waiting:
            put()
        for i in range(len(fitted)):
            yield from ready(i, 0)
    return run


def of_folds(folded: DataFrame, t: str, num: Sequence[str], k: int, rows_a_part: int) -> list[tuple] | None:
    """[(fold, rows outside, deviation of their label, training cells, held-out cells)]; cells are persisted: ``cells_of``'s columns, and (features, n, s, q,
    center). None where the table or a fold isn't of the kind that is served here."""
    if not 0 < len(num) <= MAX_SLOTS or folded.count() <= ROWS_ALONE:
        return None
    counted = _counts(folded, t, num)
    if counted is None or sorted(counted[0]) != list(range(k)) or k < 2:
        return None
    moments, ranges = counted
    fitted, label = [_fitted(moments, ranges, len(num), i) for i in range(k)], len(num)
    center = float(_joined([own[label] for own in moments.values()])[1])
    width = -(-len(num) // WORD)
    words = [f"w{j}" for j in range(width)]
    ship_package(folded.sparkSession)
    rows = folded.select(F.col("fold").cast("int"), *[c(x).cast("double").alias(f"x{i}") for i, x in enumerate([*num, t])])
    schema = ", ".join(["unit int, held boolean", *(f"{w} long" for w in words), *(f"{x} double" for x in SUMS)])
    cells = rows.mapInArrow(_to_cells(fitted, center, width), schema).groupBy("unit", "held", *words).agg(*[F.sum(x).alias(x) for x in SUMS])
    slots = [f"slot{s}" for s in range(len(num))]
    cells = cells.withColumns({x: F.shiftright(words[s // WORD], 5 * (s % WORD)).bitwiseAND(31).cast("double") + 0.0 for s, x in enumerate(slots)})
    cells = VectorAssembler(inputCols=slots, outputCol="features").transform(cells).select("unit", "held", "features", *SUMS).persist()
    sizes = {(r["unit"], r["held"]): r["cells"] for r in cells.groupBy("unit", "held").agg(F.count(F.lit(1)).alias("cells")).collect()}
    out = []
    for i in range(k):
        train = cells.where((F.col("unit") == i) & ~F.col("held")).select("features", (F.col("total") / F.col("n")).alias(t), F.col("n").alias(CE.WEIGHT))
        held = cells.where((F.col("unit") == i) & F.col("held")).select("features", "n", "s", "q", F.lit(center).alias("center"))
        dealt, held = CE.dealt(train, t, sizes[i, False], rows_a_part), held.coalesce(-(-sizes[i, True] // rows_a_part)).persist()
        held.count()
        n, _, squares = _joined([own[label] for f, own in moments.items() if f != i])
        out.append((i, int(n), math.sqrt(squares / n), dealt, held))
    cells.unpersist()
    return out
