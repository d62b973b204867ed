"""Distributed running sums and top-k without an unpartitioned window on raw rows.

A global running sum over a sorted key is normally a single-task window. Here
the key range is cut into ``buckets`` by approximate quantiles; each bucket is
summed on its own (a bounded small table: parts x buckets rows), the bucket
totals give offsets, and a window *partitioned by bucket* adds the offset. No
task ever holds more than about 1/buckets of the rows of one part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .exprs import c

SMALL_TABLE_ROWS = 200_000  # broadcast limit for bounded helper tables (checked by count)


def default_buckets(df: DataFrame) -> int:
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(16, min(4096, 2 * shuffle))


def running_sums(
    df: DataFrame,
    order_col: str,
    sum_cols: Sequence[str],
    part_cols: Sequence[str] = (),
    buckets: int | None = None,
    prefix: str = "cum_",
) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` ordered by ``order_col`` ascending, per ``part_cols``.

    ``(part_cols, order_col)`` must be unique (aggregate first) and ``order_col`` non-null
    and numeric. ``part_cols`` must have bounded cardinality (column names, classes).
    """
    parts = list(part_cols)
    b = buckets or default_buckets(df)
    probs = [i / b for i in range(1, b)]
    acc = max(10_000, 20 * b)
    spark = df.sparkSession
    bounds_agg = F.array_distinct(F.percentile_approx(c(order_col).cast("double"), probs, acc)).alias("_bounds")
    bounds = (df.groupBy(*[c(p) for p in parts]).agg(bounds_agg) if parts else df.agg(bounds_agg))

    # pass 1: bucket edges (parts x buckets values) -> literal table, broadcast
    if parts:
        rows = bounds.limit(SMALL_TABLE_ROWS + 1).collect()
        if len(rows) <= SMALL_TABLE_ROWS:
            edges = spark.createDataFrame(rows, bounds.schema)
            keyed = df.join(F.broadcast(edges), on=parts)
        else:  # too many parts to hold: keep the edge table distributed
            keyed = df.join(bounds, on=parts)
    else:
        edge = bounds.first()["_bounds"] or []
        keyed = df.withColumn("_bounds", F.array(*[F.lit(float(x)) for x in edge]) if edge
                              else F.array().cast("array<double>"))
    keyed = keyed.withColumn(
        "_bucket", F.size(F.filter(F.col("_bounds"), lambda x: x < c(order_col).cast("double")))
    ).drop("_bounds")

    # pass 2: per-bucket totals (parts x buckets rows) -> offsets computed once, broadcast
    totals = keyed.groupBy(*[c(p) for p in parts], "_bucket").agg(
        *[F.sum(c(s)).alias(f"_t_{i}") for i, s in enumerate(sum_cols)]
    )
    w_off = Window.partitionBy(*[c(p) for p in parts]).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)  # each window partition holds at most `buckets` rows
    offsets = totals.select(
        *[c(p) for p in parts], "_bucket",
        *[F.coalesce(F.sum(f"_t_{i}").over(w_off), F.lit(0)).alias(f"_o_{i}") for i in range(len(sum_cols))],
    )
    off_rows = offsets.limit(SMALL_TABLE_ROWS + 1).collect()
    if len(off_rows) <= SMALL_TABLE_ROWS:
        joined = keyed.join(F.broadcast(spark.createDataFrame(off_rows, offsets.schema)), on=parts + ["_bucket"])
    else:
        joined = keyed.join(offsets, on=parts + ["_bucket"])

    # pass 3: running sum inside each bucket plus its offset
    w_in = Window.partitionBy(*[c(p) for p in parts], "_bucket").orderBy(c(order_col)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumns(
        {f"{prefix}{s}": F.sum(c(s)).over(w_in) + F.col(f"_o_{i}") for i, s in enumerate(sum_cols)}
    )
    return out.drop("_bucket", *[f"_o_{i}" for i in range(len(sum_cols))])


def top_k_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank_col: str = "rank",
    spread: int = 64,
    spread_key: Sequence[str] | None = None,
) -> DataFrame:
    """Exact top-k rows per group under a total order, in two levels.

    Level one ranks inside (group, hash bucket) so a huge group is split over
    ``spread`` tasks; level two ranks the at most k*spread survivors per group.
    ``order`` must be a total order (add tie-breakers) for exact results.
    """
    groups = [c(g) for g in group_cols]
    key_cols = list(spread_key) if spread_key else [col for col in df.columns if col not in group_cols]
    salted = df.withColumn("_spread", F.pmod(F.xxhash64(*[c(x) for x in key_cols]), F.lit(spread)))
    w1 = Window.partitionBy(*groups, "_spread").orderBy(*order)
    first = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_spread")
    w2 = Window.partitionBy(*groups).orderBy(*order) if groups else Window.orderBy(*order)
    return first.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


BROADCAST_ROWS = 100_000  # a table of names and numbers of up to so many rows is sent to every executor


def dense_ranks(keys: DataFrame, order: Sequence[str], rank: str = "_code") -> tuple[DataFrame, int]:
    """(``keys`` with ``rank`` 0, 1, ... in ascending order of ``order``, number of rows). Rows have to be distinct in ``order``.

    A range-partitioned sort, kept by a reliable checkpoint; the rows of each partition are counted and every partition starts at
    the sum of those before it. No task sees more than a partition, and there is no limit on the number of rows.
    """
    placed = cut_lineage(keys.repartitionByRange(*[c(x) for x in order]).sortWithinPartitions(*[c(x) for x in order])
                         .withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # as that function numbers rows
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy(part.alias("_part")).count().collect())  # a row per partition
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    first = keys.sparkSession.createDataFrame(starts, "_part long, _first long")
    return placed.withColumn("_part", part).join(F.broadcast(first), "_part") \
        .withColumn(rank, F.col("_first") + inside).drop("_part", "_first", "_at"), total
