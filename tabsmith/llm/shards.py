"""Sharding by a two-pass external shuffle: scatter rows into memory-sized buckets, shuffle each bucket, write it.

Pass 1 deals rows to buckets by a seeded hash of the key, so every bucket gets a like share of any order the table was in.
How many buckets there are follows from the table's bytes, counted by cells (leading bits of the hash) beforehand; that count also
tells the rows of each bucket. A cell that is too large for memory holds a key that repeats (a third of all rows may share
one); its rows are dealt further by a hash that also takes in the text and the row's place in its file. Pass 2 takes one
bucket at a time, orders its rows by their hashes, applies a seeded Fisher-Yates shuffle and writes them. Buckets one after another
are the shuffled order; shard s takes the s-th of equal parts of it, so row counts of shards differ by at most one (law "rows").

``docs`` has to give the same rows in the same order whenever it is read, as a table in files does: buckets are counted in one job and
dealt in another. Each bucket's rows are compared with their count, and the job fails where they differ.

Defined cases: a null key is a key like any other; null text has no bytes; repeated rows are kept and dealt apart; equal seeds
and tables give equal shards whatever the number of tasks (rows that agree in key and text are interchangeable; rows of oversized
cells follow the files' layout); an empty table gives empty shards; columns of ``docs`` are written under their own names, and
the two added ones take further underscores where ``docs`` already has ``shard`` or ``slot``; a text of any length stays whole,
in a bucket of its own where it must.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LAW = "rows"
CELL_BITS = 20                # cells the table is counted by: a million rows of counts at most
BUCKET_BYTES = 16 << 20       # text bytes of a bucket
ROW_BYTES = 64                # counted for a row besides its text
SEED = 20


def cell_of(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def row_bytes(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES


def bucket_plan(docs: DataFrame, seed: int, id_col: str, text_col: str, bucket_bytes: int) -> tuple[int, DataFrame]:
    """(bits, large): buckets are the leading ``bits`` of the key's hash; ``large`` lists the buckets that hold more than four times
    their share, with how many parts each is cut into and the number of its first part (bounded: they share the table's bytes)."""
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    cells = C.stored(docs.select(cell_of(h, CELL_BITS).alias("cell"), row_bytes(text_col).alias("bytes"))
                     .groupBy("cell").agg(F.sum("bytes").alias("bytes")), "shard-cells")
    total = cells.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("t")).first()["t"]
    bits = min(CELL_BITS, max(0, (total // bucket_bytes)).bit_length())
    share = max(bucket_bytes, total >> bits)
    sized = cells.groupBy(F.shiftright("cell", CELL_BITS - bits).alias("bucket")).agg(F.sum("bytes").alias("bytes")) \
        .filter(F.col("bytes") > 4 * share).withColumn("parts", F.ceil(F.col("bytes") / share).cast("long"))
    first = F.sum("parts").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row per oversized bucket
    return bits, C.stored(sized.select("bucket", "parts", (F.lit(1 << bits) + F.coalesce(first, F.lit(0))).alias("first")), "shard-large")


def dealt(docs: DataFrame, bits: int, large: DataFrame, seed: int, id_col: str, text_col: str, own: str) -> DataFrame:
    """``docs`` with helper columns (prefix ``own``): bucket, and the hash that orders rows inside it."""
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    spread = F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text_col), F.monotonically_increasing_id())
    rows = docs.select("*", h.alias(own + "h"), spread.alias(own + "spread")).withColumn(own + "cell", cell_of(F.col(own + "h"), bits))
    big = large.toDF(own + "cell_", own + "parts", own + "first")
    rows = rows.join(F.broadcast(big), F.col(own + "cell") == F.col(own + "cell_"), "left")  # at most a quarter of the buckets
    part = F.col(own + "first") + F.pmod(F.col(own + "spread"), F.col(own + "parts"))
    return rows.withColumn(own + "bucket", F.coalesce(part, F.col(own + "cell"))) \
        .withColumn(own + "order", F.xxhash64(F.lit(seed + 2), F.col(id_col), F.col(text_col)))


def offsets(rows: DataFrame, own: str) -> DataFrame:
    """(bucket, n, before, total): rows of every bucket, of those before it, and of all. Running sums go by runs of 1,024 buckets,
    then over one row per run."""
    counts = C.stored(rows.groupBy(F.col(own + "bucket").alias("bucket")).agg(F.count("*").alias("n")), "shard-counts") \
        .withColumn("run", F.shiftright("bucket", 10))
    inside = F.sum("n").over(Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    runs = counts.groupBy("run").agg(F.sum("n").alias("run_n"))
    over = Window.orderBy("run")  # a row per 1,024 buckets
    whole = F.sum("run_n").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    runs = runs.select("run", F.coalesce(F.sum("run_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("run_before"),
                       whole.alias("total"))
    return counts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(runs, "run") \
        .select("bucket", "n", (F.col("run_before") + F.col("inside")).alias("before"), "total")


def shard(docs: DataFrame, uri: str, shards: int = 16, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
          bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all rows of ``docs`` to ``uri`` in folders ``shard=0`` ... and read them back: the columns of ``docs``, shard (int) and
    slot (long, from 0 without gaps in every shard, in shuffled order)."""
    own = C.free_name("__shuffle_", [c[:10] for c in docs.columns])
    name_shard, name_slot = C.free_name("shard", docs.columns), C.free_name("slot", docs.columns)
    bits, large = bucket_plan(docs, seed, id_col, text_col, bucket_bytes)
    rows = dealt(docs, bits, large, seed, id_col, text_col, own)
    # the count reads the key alone unless a bucket is oversized
    plan = offsets(dealt(docs, bits, large, seed, id_col, text_col, own) if not large.isEmpty()
                   else docs.select(cell_of(F.xxhash64(F.lit(seed), F.col(id_col)), bits).alias(own + "bucket")), own)
    payload = rows.select(*[F.col(f"`{c}`") for c in docs.columns], own + "bucket", own + "order")
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema],
                           T.StructField(name_shard, T.IntegerType()), T.StructField(name_slot, T.LongType())])

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        n, at = left.num_rows, right.to_pylist()
        if not at or at[0]["n"] != n:
            raise RuntimeError("a bucket's rows differ from their count: docs must give the same rows each time it is read")
        bucket, before, total = at[0]["bucket"], at[0]["before"], at[0]["total"]
        order = np.argsort(left.column(own + "order").to_numpy(), kind="stable")
        order = order[np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, bucket])).permutation(n)]  # Fisher-Yates
        place = before + np.arange(n, dtype=np.int64)
        which = place * shards // total
        begin = -((-np.arange(shards + 1, dtype=np.int64) * total) // shards)  # least place of every shard
        out = left.select(docs_columns).take(pa.array(order))
        return out.append_column(name_shard, pa.array(which.astype(np.int32))).append_column(name_slot, pa.array(place - begin[which]))

    docs_columns = list(docs.columns)
    out = payload.groupBy(own + "bucket").cogroup(plan.groupBy("bucket")).applyInArrow(write, schema)
    out.write.partitionBy(name_shard).parquet(uri)
    return docs.sparkSession.read.schema(schema).parquet(uri)


def placed(docs: DataFrame, shards: int = 16, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard the table in the shared folder and describe every row from what was written: id_col, size (UTF-8 bytes of the text and
    one more), text_crc32, law, shard, slot and grown_shard (null: the law deals every row anew when shards are added)."""
    taken = docs.columns
    out = shard(docs, C.shared_path(docs.sparkSession, "shards"), shards, seed, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return out.select(id_col, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                      F.lit(LAW).alias("law"), F.col(C.free_name("shard", taken)).alias("shard"), F.col(C.free_name("slot", taken)).alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
