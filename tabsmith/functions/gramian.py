"""Masked block Gramian: for every pair of columns the count, sums, sums of squares and sum of products over the rows where
both are present, in one pass over the table.

Each task turns its Arrow batches into a matrix X (missing: 0) and a mask M and adds up M'M, X'M, (X^2)'M and X'X, which hold all six
sums of every pair (pairwise-complete, as pandas ``corr``). It emits one row per block of SIDE x SIDE pairs; blocks of
all tasks are added in two steps (by block and a part of the tasks, then by block), each streaming over its rows, so no task
holds more than a few blocks. Columns are shifted by their mean first, which keeps the sums of squares free of cancellation.
Matrices of more than PASS_CELLS pairs take several passes, so that a task's memory is bounded however wide the table is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .exprs import c

SIDE = 64
FAN = 64                   # first step: tasks whose blocks meet in one place
PASS_CELLS = 1 << 22       # pairs of one pass: four matrices of so many doubles
BLOCK = "bi int, bj int, part int, sums array<double>"
FLAT = 1e-13               # a variance below this share of the squares' sum is rounding


def _blocks(m: int) -> list[list[tuple[int, int]]]:
    """Upper blocks of an m x m matrix, in passes."""
    n = -(-m // SIDE)
    every = [(i, j) for i in range(n) for j in range(i, n)]
    step = max(1, PASS_CELLS // (SIDE * SIDE))
    return [every[k:k + step] for k in range(0, len(every), step)]


def _task_sums(df: DataFrame, cols: Sequence[str], shift: Sequence[float], blocks: list[tuple[int, int]]) -> DataFrame:
    side, fan = SIDE, FAN
    used = sorted({k for b in blocks for k in b})
    names = [x for k in used for x in cols[k * side:(k + 1) * side]]
    offsets = np.array([v for k in used for v in shift[k * side:(k + 1) * side]])
    place = {k: n for n, k in enumerate(used)}
    src = df.select(*[c(x).cast("double").alias(f"v{i}") for i, x in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.empty((b.num_rows, len(names)))
            for i in range(len(names)):
                x[:, i] = b.column(i).to_numpy(zero_copy_only=False)  # null: NaN
            x -= offsets
            mask = ~np.isnan(x)
            x[~mask] = 0.0
            mask = mask.astype(np.float64)
            square = x * x
            part = []
            for i, j in blocks:
                a, d = (slice(place[k] * side, (place[k] + 1) * side) for k in (i, j))
                part.append(np.stack([mask[:, a].T @ mask[:, d], x[:, a].T @ mask[:, d], mask[:, a].T @ x[:, d],
                                      square[:, a].T @ mask[:, d], mask[:, a].T @ square[:, d], x[:, a].T @ x[:, d]]))
            total = part if total is None else [s + t for s, t in zip(total, part)]
        if total is not None:
            at = TaskContext.get().partitionId() % fan
            for (i, j), s in zip(blocks, total):
                yield pa.RecordBatch.from_pydict({"bi": pa.array([i], pa.int32()), "bj": pa.array([j], pa.int32()),
                                                  "part": pa.array([at], pa.int32()), "sums": [s.ravel()]})

    return src.mapInArrow(run, BLOCK)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add rows of the same (bi, bj, part), streaming."""
    held: dict[tuple[int, int, int], np.ndarray] = {}
    for b in batches:
        for key, sums in zip(zip(*(b.column(k).to_pylist() for k in range(3))), b.column(3)):
            values = sums.values.to_numpy()
            held[key] = held[key] + values if key in held else values
    for (i, j, part), s in held.items():
        yield pa.RecordBatch.from_pydict({"bi": pa.array([i], pa.int32()), "bj": pa.array([j], pa.int32()),
                                          "part": pa.array([part], pa.int32()), "sums": [s]})


def pair_sums(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """((bi, bj, sums) per block, the columns' shifts). ``sums`` holds six matrices, one after another: n, sum x, sum y, sum x^2, sum y^2,
    sum xy of the shifted values, rows by the block's first columns. NaN counts as missing."""
    ship_package(df.sparkSession)
    m = len(cols)
    row = df.agg(*[F.avg(F.when(~F.isnan(c(x).cast("double")), c(x).cast("double"))).alias(f"m{i}") for i, x in enumerate(cols)]).first()
    shift = [v if v is not None and np.isfinite(v) else 0.0 for v in row]
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for blocks in _blocks(m):
        tasks = _task_sums(df, cols, shift, blocks)
        some = tasks.repartition(min(width, len(blocks) * FAN), "bi", "bj", "part").mapInArrow(_added, BLOCK)
        whole = some.withColumn("part", F.lit(0)).repartition(min(width, len(blocks)), "bi", "bj").mapInArrow(_added, BLOCK)
        out = whole if out is None else out.unionByName(whole)
    return out.drop("part"), shift


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) for a before b in column order; r is null where a column has no variance over the pair's rows."""
    cols, side = list(cols), SIDE
    sums, _ = pair_sums(df, cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, s in zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), b.column("sums")):
                left, right = cols[i * side:(i + 1) * side], cols[j * side:(j + 1) * side]
                n, x, y, xx, yy, xy = s.values.to_numpy().reshape(6, len(left), len(right))
                with np.errstate(invalid="ignore", divide="ignore"):
                    vx, vy = n * xx - x * x, n * yy - y * y
                    flat = ~((vx > FLAT * n * xx) & (vy > FLAT * n * yy))
                    r = np.where(flat, np.nan, (n * xy - x * y) / np.sqrt(vx * vy))
                a, d = np.nonzero((np.arange(len(left))[:, None] < np.arange(len(right))) | (i < j))
                values = r[a, d]
                yield pa.RecordBatch.from_pydict({"a": pa.array([left[k] for k in a], pa.string()), "b": pa.array([right[k] for k in d], pa.string()),
                                                  "r": pa.array(values, mask=~np.isfinite(values))})

    return sums.mapInArrow(run, "a string, b string, r double")


def group_moments(df: DataFrame, exprs: Sequence[Column], group: str, shifted: Sequence[int] = ()) -> dict:
    """{group value: X'X} of the double columns ``exprs``, in one pass. ``shifted`` names columns that are moved by their overall mean
    first. There is a matrix per group on the driver, so groups are few (folds) and columns at most some hundred. A missing value
    makes its group's matrix NaN."""
    ship_package(df.sparkSession)
    width, fan = len(exprs), FAN
    row = df.agg(*[F.avg(exprs[i]).alias(f"m{i}") for i in shifted]).first() if shifted else ()
    shift = np.zeros(width)
    shift[list(shifted)] = [v if v is not None else 0.0 for v in row]
    src = df.where(c(group).isNotNull()).select(c(group).cast("int").alias("g"), *[e.alias(f"v{i}") for i, e in enumerate(exprs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.empty((b.num_rows, width))
            for i in range(width):
                x[:, i] = b.column(i + 1).to_numpy(zero_copy_only=False)
            x -= shift
            of = b.column(0).to_numpy(zero_copy_only=False)
            for g in np.unique(of):
                part = x[of == g]
                total[int(g)] = total.get(int(g), 0) + part.T @ part
        at = TaskContext.get().partitionId() % fan
        for g, m in total.items():
            yield pa.RecordBatch.from_pydict({"bi": pa.array([g], pa.int32()), "bj": pa.array([0], pa.int32()),
                                              "part": pa.array([at], pa.int32()), "sums": [m.ravel()]})

    some = src.mapInArrow(run, BLOCK).repartition("bi", "part").mapInArrow(_added, BLOCK)
    whole = some.withColumn("part", F.lit(0)).repartition("bi").mapInArrow(_added, BLOCK)
    return {r["bi"]: np.array(r["sums"]).reshape(width, width) for r in whole.collect()}
