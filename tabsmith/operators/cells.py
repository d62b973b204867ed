"""Boosted learners on cells (F4-F6): rows that a boosted fit can't tell apart are one row with their weight.

MLlib's trees see a number only as one of at most 32 intervals between its split candidates, and a row's gradient depends on its
label and its own prediction. Rows that lie in the same intervals and have the same label therefore stay together in every round; under
squared loss the label's mean stands for all labels of a cell, as gains and leaves depend on sums of labels only. A fit on cells
has the same trees as one on their rows (up to rounding), and there are never more cells than rows.

Candidates follow MLlib's rule (strides of the sorted values, cuts halfway between neighbours), over all rows instead of a sample of 10,000.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasWeightCol
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import c

BINS = 32              # MLlib's maxBins
VALUES = 10_000        # distinct values of a column that are counted one by one; ...
RANGES = 2_000         # ... above that, ranges of about equal size are
WEIGHT = "__cell_weight"
BOOSTED = (GBTClassifier, GBTRegressor)


def stride_cuts(ranges: Sequence[tuple[float, float, float]], bins: int = BINS) -> list[float]:
    """Cuts by MLlib's rule from sorted (least value, greatest value, weight)."""
    between = [(a[1] + b[0]) / 2 for a, b in zip(ranges, ranges[1:])]
    if len(between) < bins:
        return between
    stride = sum(w for _, _, w in ranges) / bins
    cuts, seen, target = [], ranges[0][2], stride
    for cut, (_, _, w) in zip(between, ranges[1:]):
        before, seen = seen, seen + w
        if abs(before - target) < abs(seen - target):
            cuts.append(cut)
            target += stride
    return cuts


def _ranged(df: DataFrame, cols: Sequence[str], borders: dict[str, list[float]]) -> DataFrame:
    """(column, least, greatest, weight) of every value, or of every range of a column with borders."""
    if borders:
        df = Bucketizer(inputCols=list(borders), outputCols=[f"{x}_at" for x in borders],
                        splitsArray=[[-math.inf, *b, math.inf] for b in borders.values()]).transform(df)
    cells = [F.struct(F.lit(x).alias("column"), c(f"{x}_at" if x in borders else x).alias("at"), c(x).alias("x")) for x in cols]
    long = df.select(F.explode(F.array(*cells)).alias("v"), c(WEIGHT)).select("v.*", WEIGHT)
    return long.groupBy("column", "at").agg(F.min("x").alias("least"), F.max("x").alias("greatest"), F.sum(WEIGHT).alias("weight"))


def candidate_cuts(df: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """Cuts of each double column, weighted by ``WEIGHT``. Constant columns have none, nor have those with a null or a value that is not finite. The
    driver gets some ``VALUES`` rows a column at most."""
    odd = [F.max(F.coalesce(c(x).isNull() | F.isnan(c(x)) | (F.abs(c(x)) == F.lit(math.inf)), F.lit(True))) for x in cols]
    levels = [F.approx_count_distinct(c(x)) for x in cols]  # only says how a column is counted
    n, *found = df.agg(F.count(F.lit(1)), *odd, *levels).first()
    odd, levels = found[:len(cols)], dict(zip(cols, found[len(cols):]))
    whole = [x for x, bad in zip(cols, odd) if bad is False]
    if not whole:
        return {x: [] for x in cols}
    wide, borders = [x for x in whole if n > VALUES and levels[x] > VALUES], {}
    if wide:
        at = [i / RANGES for i in range(1, RANGES)]
        row = df.agg(*[F.array_sort(F.array_distinct(F.percentile_approx(c(x), at, 10 * RANGES))) for x in wide]).first()
        borders = dict(zip(wide, row))
    ranges: dict[str, list] = {x: [] for x in whole}
    for r in _ranged(df, whole, borders).collect():
        ranges[r["column"]].append((r["least"], r["greatest"], r["weight"]))
    return {x: stride_cuts(sorted(ranges[x])) if x in ranges else [] for x in cols}


def _slots(df: DataFrame, vector: str, n: int, prefix: str) -> tuple[DataFrame, list[str]]:
    """The vector's slots as columns beside the others."""
    names = [f"{prefix}{i}" for i in range(n)]
    array = f"{prefix}array"
    return df.withColumn(array, vector_to_array(vector)).withColumns({x: F.col(array)[i] for i, x in enumerate(names)}).drop(array), names


class IntervalCoder(Estimator, HasInputCol, HasOutputCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """Vector of numbers -> vector of the intervals (0, 1, ...) that they lie in."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, weightCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> IntervalCoderModel:
        vector = self.getInputCol()
        weight = c(self.getWeightCol()).cast("double") if self.isSet(self.weightCol) else F.lit(1.0)
        first = df.select(vector).first()
        rows, names = _slots(df.select(vector, weight.alias(WEIGHT)), vector, len(first[0]) if first else 0, "s")
        rows = rows.drop(vector).persist()
        cuts = candidate_cuts(rows, names)
        rows.unpersist()
        model = IntervalCoderModel()
        model._set(cuts=[",".join(map(repr, map(float, cuts[x]))) for x in names])
        return self._copyValues(model)


class IntervalCoderModel(Model, HasInputCol, HasOutputCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """Each slot's cuts; a number at a cut lies below it, as in a tree. Slots without cuts stay as they are, so that MLlib refuses what it
    refuses on rows."""

    cuts = Param(Params._dummy(), "cuts", "cuts of each slot, ascending, joined by commas", typeConverter=TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        cuts = [[float(x) for x in s.split(",") if x] for s in self.getOrDefault(self.cuts)]
        out, names = _slots(df, self.getInputCol(), len(cuts), "__slot_")
        open_ = [i for i, x in enumerate(cuts) if x]
        coded = [f"{x}_at" for x in names]
        if open_:
            edges = [[-math.inf, *sorted({math.nextafter(x, math.inf) for x in cuts[i]}), math.inf] for i in open_]
            out = Bucketizer(inputCols=[names[i] for i in open_], outputCols=[coded[i] for i in open_], splitsArray=edges,
                             handleInvalid="keep").transform(out)
        # a sum, as a plain column would bring Bucketizer's levels along, and trees would take them for categories; a number that is
        # missing lies in the last interval, as in MLlib
        plain = {x: F.least(F.col(x) + 0.0, F.lit(float(len(cuts[i])))) if i in open_ else F.col(names[i]) + 0.0
                 for i, x in enumerate(coded)}
        out = VectorAssembler(inputCols=coded, outputCol=self.getOutputCol(), handleInvalid="keep").transform(out.withColumns(plain))
        return out.drop(*names, *coded)


def cells_of(df: DataFrame, t: str, regression: bool, weight: str | None = None, rows_a_part: int = 50_000) -> DataFrame:
    """(features, label, ``WEIGHT``), persisted: one row for every cell, in an order that depends on the rows alone."""
    w = c(weight).cast("double") if weight else F.lit(1.0)
    y = c(t).cast("double")
    rows = df.select("features", y.alias(t), w.alias(WEIGHT))
    # what MLlib refuses stays for it to refuse: sums and means pass over nulls
    total = F.when(F.max(c(WEIGHT).isNull()), F.lit(None)).when(F.min(WEIGHT) < 0, F.min(WEIGHT)).otherwise(F.sum(WEIGHT))
    if regression:
        mean = F.when(F.max(c(t).isNull()), F.lit(None)).when(F.sum(WEIGHT) > 0, F.sum(c(t) * c(WEIGHT)) / F.sum(WEIGHT)).otherwise(F.avg(c(t)))
        cells = rows.groupBy("features").agg(mean.alias(t), total.alias(WEIGHT))
    else:
        cells = rows.groupBy("features", c(t)).agg(total.alias(WEIGHT))
    cells = cells.persist()
    out = dealt(cells, t, cells.count(), rows_a_part)
    cells.unpersist()
    return out


def dealt(cells: DataFrame, t: str, n: int, rows_a_part: int) -> DataFrame:
    """``n`` cells dealt to the partitions that they are worth, in an order that depends on them alone, persisted."""
    from .models import parts_of
    out = cells.repartition(parts_of(n, rows_a_part), "features", c(t)).sortWithinPartitions("features", c(t)).persist()
    out.count()
    return out


def is_boosted(learner) -> bool:
    return isinstance(learner, BOOSTED) or isinstance(learner, OneVsRest) and isinstance(learner.getClassifier(), BOOSTED)


def weighted(learner):
    """The learner, told to weigh cells."""
    return learner.copy().setWeightCol(WEIGHT)


class OnCells(Estimator):
    """Fits a boosted learner on the cells of its rows; the fitted model is MLlib's."""

    def __init__(self, learner, weight: str | None = None):
        super().__init__()
        self.learner, self.weight = learner, weight

    def _fit(self, df: DataFrame):
        cells = cells_of(df, self.learner.getLabelCol(), isinstance(self.learner, GBTRegressor), self.weight)
        try:
            return weighted(self.learner).fit(cells)
        finally:
            cells.unpersist()
