"""Apply fitted stages (and a saved model) to a file stream.

Fitted cleaners, encoders and feature steps are stateless projections, so the
same callables used on batch frames run on a streaming DataFrame. The query
uses ``availableNow`` (process what is there, then stop), keeps its progress
in the shared checkpoint folder, and writes Parquet that batch jobs read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import shared_path


def apply_to_stream(spark: SparkSession, source: str, schema: T.StructType,
                    transform: Callable[[DataFrame], DataFrame], sink: str | None = None,
                    fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Run ``transform`` over every file under ``source`` as a stream; return the written result."""
    sink = sink or shared_path(spark, "stream-out")
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = transform(reader.load(source))
    query = (stream.writeStream.format("parquet")
             .option("checkpointLocation", sink.rstrip("/") + "_checkpoint")
             .option("path", sink)
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()
    return spark.read.parquet(sink)


def score_stream(spark: SparkSession, source: str, schema: T.StructType, model_path: str,
                 prepare: Callable[[DataFrame], DataFrame] | None = None, sink: str | None = None) -> DataFrame:
    """Score a file stream with a saved pipeline and threshold (F19 on a stream)."""
    from ..operators.models import score

    def run(df: DataFrame) -> DataFrame:
        return score(prepare(df) if prepare else df, model_path)
    return apply_to_stream(spark, source, schema, run, sink)
