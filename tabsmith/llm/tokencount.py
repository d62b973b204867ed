"""Token counts of documents in flat, unindexed token files by a separator scan.

A flat file is nothing but token ids, each document followed by the end-of-document id. The scan reads
fixed-size blocks in any order and on any executor, finds the separators of a block in one vectorised
comparison, and stitches documents that cross block boundaries with a prefix scan over one summary row
per block (separators so far and position of the last one).

``write_flat`` makes such files from a table: null text counts as empty, texts of any length are
encoded whole, repeated rows repeat, an empty table gives no documents. Tokens after the last separator
of a file come out as an unfinished document (complete = false).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .files import publish, read_range

BLOCK_TOKENS = 1 << 19


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, path: str, pattern: str, end_id: int, uri: str, width: int = 2, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One flat file per input partition; the stored result lists which document is the n-th of which file
    (part, ordinal, id_col), plus the file's tokens on its last row (tokens, else null)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ordinal", T.LongType()),
                           T.StructField("id", kind), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = encoder(path, pattern)
        done = tokens = 0
        held = None
        with publish(f"{uri}/part-{part:06d}.bin") as (out,):
            for b in C.chunks(batches, "text"):
                for i, text in enumerate(C.text_array(b.column("text")).to_pylist()):
                    ids = enc.encode_ordinary(text)
                    ids.append(end_id)
                    arr = np.array(ids, dtype=np.int64)
                    if arr.max() >= 1 << (8 * width):
                        raise ValueError("token ids don't fit the width of the file")
                    out.write(arr.astype(f"<u{width}").tobytes())
                    tokens += len(ids)
                if held is not None:
                    yield held
                held = pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b.num_rows, part, dtype=np.int32)), pa.array(np.arange(done, done + b.num_rows)),
                     b.column("id"), pa.nulls(b.num_rows, pa.int64())], ["part", "ordinal", "id", "tokens"])
                done += b.num_rows
        if held is not None:
            last = pa.array([None] * (held.num_rows - 1) + [tokens], pa.int64())
            yield pa.RecordBatch.from_arrays([*held.columns[:3], last], held.schema.names)

    return C.stored(src.mapInArrow(run, schema).withColumnRenamed("id", id_col), "flat-order")


def scan(files: DataFrame, uri: str, end_id: int, width: int = 2) -> DataFrame:
    """Documents of flat files (rows part, tokens): part, ordinal, start, n_tokens (without the separator), complete."""
    blocks = files.filter("tokens > 0").select("part", "tokens", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(BLOCK_TOKENS).cast("long"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = min(BLOCK_TOKENS, row["tokens"] - row["at"])
                ids = np.frombuffer(read_range(f"{uri}/part-{row['part']:06d}.bin", row["at"] * width, n * width), dtype=f"<u{width}")
                found = np.flatnonzero(ids == end_id).astype(np.int64) + row["at"]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]], pa.int32()), "at": [row["at"]], "tokens": [row["tokens"]],
                    "found": pa.array([found], pa.list_(pa.int64()))})

    width_out = C.shuffle_width(files.sparkSession)
    marks = C.stored(blocks.repartition(width_out, "part", "at").mapInArrow(run, "part int, at long, tokens long, found array<long>"),
                     "flat-marks")
    before = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summary = marks.select("part", "at", F.size("found").cast("long").alias("n"),
                           F.try_element_at("found", F.lit(-1)).alias("last"))
    carried = summary.select("part", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                             F.coalesce(F.max("last").over(before), F.lit(-1)).alias("prev"))
    # shift the separators by one so that each row carries the one before it without copying the array
    shifted = F.concat(F.array("prev"), F.col("found"))
    whole = marks.join(carried, ["part", "at"]).select("part", "base", F.posexplode(F.arrays_zip(
        F.slice(shifted, 1, F.size("found")).alias("prev"), F.col("found").alias("end"))).alias("i", "z")) \
        .select("part", "base", "i", F.col("z.prev").alias("prev"), F.col("z.end").alias("end"))
    start = F.col("prev") + 1
    whole = whole.select("part", (F.col("base") + F.col("i")).alias("ordinal"), start.alias("start"),
                         (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("complete"))
    ends = summary.groupBy("part").agg(F.sum("n").alias("n"), F.max("last").alias("last")).join(
        files.filter("tokens > 0").select("part", "tokens"), "part")
    rest = F.col("tokens") - F.coalesce("last", F.lit(-1)) - 1
    tail = ends.filter(rest > 0).select("part", F.col("n").alias("ordinal"), (F.coalesce("last", F.lit(-1)) + 1).alias("start"),
                                        rest.alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.unionByName(tail)


def token_counts(docs: DataFrame, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a table's flat files, scan them, and name the documents: id_col, part, ordinal, start, n_tokens."""
    uri = C.shared_uri(docs.sparkSession, "flat-tokens")
    order = write_flat(docs, path, pattern, end_id, uri, id_col=id_col, text_col=text_col)
    files = order.filter("tokens is not null").select("part", "tokens")
    found = scan(files, uri, end_id)
    return order.drop("tokens").join(found, ["part", "ordinal"]).select(id_col, "part", "ordinal", "start", "n_tokens")
