"""Frequency coding as a pipeline stage (F1, string features of very many levels).

The fitted levels are a table, never a driver-side list: they are written to the shared folder when fitted, travel with a saved
model, and are joined on the value when applied. Null and unseen values have share 0.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import c, safe_name
from ..session import shared_path

SUFFIX = "_share"


def frequency_column(name: str) -> str:
    """Name of the numeric feature that stands for a frequency-coded string column."""
    return f"{safe_name(name)}{SUFFIX}"


class FrequencyCoder(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Value -> share of all fitted rows that hold it."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FrequencyCoderModel:
        x, total = c(self.getInputCol()), max(df.count(), 1)
        levels = df.where(x.isNotNull()).groupBy(x.alias("level")).agg((F.count(F.lit(1)) / F.lit(float(total))).alias("share"))
        path = shared_path(df.sparkSession, "levels")
        levels.write.parquet(path)  # a lost executor costs no second count
        return self._copyValues(FrequencyCoderModel(df.sparkSession.read.parquet(path)))


class FrequencyCoderModel(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Levels with their shares, joined on the value; no hint, so the join's form follows the table's size."""

    def __init__(self, levels: DataFrame | None = None):
        super().__init__()
        self.levels = levels

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        key, share = f"__{out}_level", f"__{out}_found"
        table = self.levels.select(F.col("level").alias(key), F.col("share").alias(share))
        joined = df.join(table, c(self.getInputCol()) == F.col(key), "left")
        return joined.withColumn(out, F.coalesce(F.col(share), F.lit(0.0))).drop(key, share)

    def write(self) -> MLWriter:
        return _LevelsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LevelsReader(cls)


class _LevelsWriter(MLWriter):
    def __init__(self, model: FrequencyCoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.levels.write.parquet(f"{path}/levels")


class _LevelsReader(MLReader):
    def __init__(self, cls: type[FrequencyCoderModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FrequencyCoderModel:
        spark = self.sparkSession or SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(spark.read.parquet(f"{path}/levels"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
