"""Exact top-k search over integer vectors by block-at-a-time pruning.

Vectors become sparse-free integer rows v = floor(SCALE * x). Rows are put in an order that keeps similar ones together
(nearest of a few anchor vectors, a bounded sample that affects the work only) and cut into ranges of BLOCK rows; a
forward index holds each block's rows, its largest and smallest value per term, and its smallest id. For a query the sum over
terms of q * (largest if q > 0 else smallest) bounds every score in a block. Blocks are taken in falling order of that bound
and scored through their forward index; the search ends when the bound is below the query's k-th score so far (a
block that can only tie is skipped when all its ids are larger than the k-th). The first round searches the query's own
shard of the index; its k-th score is where the other shards start, so most of their blocks are pruned at once.

Queries are the rows picked by ``is_query``; candidates are all rows but the query's own row (the same id). Rows whose
vector is null or holds null, NaN or infinite components take no part. Vectors of different length are compared as if the
shorter ended in zeros. Ties go to the smaller id; fewer candidates than k give shorter lists; rows with a null id
take no part; an id that repeats counts as separate candidates, and each of its rows as a query with a list (ranks 1 to k) of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SCALE = 256
BLOCK = 64
SHARD_BLOCKS = 64
QUERY_CHUNK = 4096
ANCHORS = 256
NO_ID = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min


def finite(vector: Column) -> Column:
    """The vector is not null and holds neither null, NaN nor infinity."""
    inf = float("inf")
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf))


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return df.filter(F.col(id_col).isNotNull() & F.coalesce(finite(F.col(vec_col)), F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as one int64 matrix, short rows filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.asarray(column.offsets).astype(np.int64)
    size = np.diff(off)
    out = np.zeros((len(size), width if width is not None else int(size.max(initial=0))), dtype=np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(size)), size), C.spread(np.zeros(len(size), dtype=np.int64), size)] = flat[off[0]:off[-1]]
    return out


def ordered(rows: DataFrame) -> DataFrame:
    """rows with ``near``: the anchor with the largest cosine, so that alike rows get alike places."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(ANCHORS).select("v").toArrow()
    anchors = matrix(sample.column("v")).astype(np.float64)
    anchors /= np.maximum(np.linalg.norm(anchors, axis=1, keepdims=True), 1)
    shared = spark.sparkContext.broadcast(anchors)  # ANCHORS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = shared.value
            v = matrix(b.column("v")).astype(np.float64)
            d = min(v.shape[1], a.shape[1])
            near = (v[:, :d] @ a[:, :d].T).argmax(axis=1) if len(a) and len(v) else np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], ["id", "v", "near"])

    return rows.mapInArrow(run, "id long, v array<long>, near int")


def forward_index(rows: DataFrame) -> DataFrame:
    """A stored row per block: shard (0, 1, ...), ids, rows (flat), width, largest, smallest. Rows are dealt by ranges of (anchor,
    vector hash, id), so whatever repeats, a shard has SHARD_BLOCKS blocks at most."""
    src = ordered(rows).withColumn("same", F.xxhash64("v"))
    placed = src.repartitionByRange(C.shuffle_width(rows.sparkSession), "near", "same", "id").sortWithinPartitions("near", "same", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, done = TaskContext.get().partitionId(), 0
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]).select(["id", "v"])
            held = t if held is None else pa.concat_tables([held, t])
            whole = held.num_rows // BLOCK * BLOCK
            if whole:
                yield blocks(held.slice(0, whole), part, done)
                held, done = held.slice(whole), done + whole // BLOCK
        if held is not None and held.num_rows:
            yield blocks(held, part, done)

    found = C.stored(placed.select("id", "v").mapInArrow(run, INDEX), "topk-blocks")
    # number the shards of all partitions one after another: a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.groupBy("part").agg(F.max("nth").alias("last")).select(
        "part", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("base"))
    return C.stored(found.join(parts, "part").withColumn("shard", F.col("base") + F.col("nth")).drop("part", "nth", "base"), "topk-index")


INDEX = "part int, nth long, ids array<long>, rows array<long>, width int, largest array<long>, smallest array<long>"


def blocks(t: pa.Table, part: int, done: int) -> pa.RecordBatch:
    out = {k: [] for k in ("part", "nth", "ids", "rows", "width", "largest", "smallest")}
    for i in range(0, t.num_rows, BLOCK):
        piece = t.slice(i, BLOCK)
        m = matrix(piece.column("v"))
        out["part"].append(part)
        out["nth"].append((done + i // BLOCK) // SHARD_BLOCKS)
        out["ids"].append(piece.column("id").to_numpy())
        out["rows"].append(m.ravel())
        out["width"].append(m.shape[1])
        out["largest"].append(m.max(axis=0) if m.size else np.zeros(0, dtype=np.int64))
        out["smallest"].append(m.min(axis=0) if m.size else np.zeros(0, dtype=np.int64))
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(out["part"], pa.int32()), pa.array(out["nth"], pa.int64()), *[pa.array(out[k], longs) for k in ("ids", "rows")], pa.array(out["width"], pa.int32()),
         *[pa.array(out[k], longs) for k in ("largest", "smallest")]], list(out))


def search_shard(queries: pa.Table, index: pa.Table, k: int) -> pa.Table:
    """Best k of one shard for each query that beat its floor (floor_score, floor_id)."""
    n, m = queries.num_rows, index.num_rows
    if n == 0 or m == 0:
        none = np.zeros(0, dtype=np.int64)
        return _found(none, none, np.zeros((0, k), dtype=np.int64), np.zeros((0, k), dtype=np.int64))
    width = index.column("width").to_numpy()
    d = max(int(width.max()), max((len(x) for x in queries.column("v")), default=0))
    q = matrix(queries.column("v"), d)
    qid = queries.column("id").to_numpy()
    hi, lo = matrix(index.column("largest"), d), matrix(index.column("smallest"), d)
    ids = np.full((m, BLOCK), NO_ID)
    rows = np.zeros((m, BLOCK, d), dtype=np.int64)
    for i in range(m):
        own = index.column("ids")[i].values.to_numpy()
        ids[i, :len(own)] = own
        rows[i, :len(own), :width[i]] = index.column("rows")[i].values.to_numpy().reshape(len(own), width[i])
    first = ids.min(axis=1)
    peak = max(float(np.abs(q.astype(np.float64)).max(initial=0)), 1) * max(float(np.abs(rows.astype(np.float64)).max(initial=0)), 1) * max(d, 1)
    if peak < 2 ** 53:  # every sum is exact in double precision, which has faster products
        q, rows, hi, lo = (x.astype(np.float64) for x in (q, rows, hi, lo))
    bound = (np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T).astype(np.int64)
    order = np.argsort(-bound, axis=1, kind="stable")
    top_s, top_i = np.full((n, k), LOWEST), np.full((n, k), NO_ID)
    floor_s = queries.column("floor_score").to_numpy().copy()
    floor_i = queries.column("floor_id").to_numpy().copy()
    live = np.arange(n)
    for r in range(m):
        block = order[live, r]
        limit = bound[live, block]
        go = limit >= floor_s[live]
        live, block, limit = live[go], block[go], limit[go]  # bounds only fall from here: the rest is done
        if len(live) == 0:
            break
        use = (limit > floor_s[live]) | (first[block] < floor_i[live])
        for a in range(0, int(use.sum()), 256):
            who, at = live[use][a:a + 256], block[use][a:a + 256]
            score = np.matmul(rows[at], q[who][:, :, None])[:, :, 0].astype(np.int64)
            cand = ids[at]
            score = np.where((cand == qid[who][:, None]) | (cand == NO_ID), LOWEST, score)
            better = (score > floor_s[who][:, None]) | ((score == floor_s[who][:, None]) & (cand < floor_i[who][:, None]))
            some = np.flatnonzero((better & (score > LOWEST)).any(axis=1))
            if len(some) == 0:
                continue
            who, score, cand = who[some], score[some], cand[some]
            s, i = np.concatenate([top_s[who], score], axis=1), np.concatenate([top_i[who], np.where(score > LOWEST, cand, NO_ID)], axis=1)
            best = np.lexsort((i, ~s), axis=1)[:, :k]
            top_s[who], top_i[who] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            full = top_i[who, k - 1] < NO_ID
            ks, ki, w = top_s[who, k - 1][full], top_i[who, k - 1][full], who[full]
            up = (ks > floor_s[w]) | ((ks == floor_s[w]) & (ki < floor_i[w]))
            floor_s[w[up]], floor_i[w[up]] = ks[up], ki[up]
    return _found(queries.column("nth").to_numpy(), qid, top_i, top_s)


def _found(nth: np.ndarray, qid: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    at = np.nonzero(ids < NO_ID)
    return pa.table({"nth": nth[at[0]], "query_id": qid[at[0]], "vec_id": ids[at], "score": scores[at]})


FOUND = "nth long, query_id long, vec_id long, score long"


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query. ``is_query`` is over id_col."""
    index = forward_index(quantised(df, id_col, vec_col))
    spread_rows = F.explode(F.arrays_zip("ids", F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.slice(
        "rows", i * F.col("width") + 1, F.col("width"))).alias("v")))
    own = index.select("shard", spread_rows.alias("r")).select("shard", F.col("r.ids").alias(id_col), F.col("r.v").alias("v")) \
        .filter(is_query).withColumnRenamed(id_col, "id").withColumn("floor_score", F.lit(int(LOWEST)).cast("long")) \
        .withColumn("floor_id", F.lit(int(NO_ID)).cast("long")).withColumn("nth", F.monotonically_increasing_id())

    def search(queries: pa.Table, shard: pa.Table) -> pa.Table:
        return search_shard(queries, shard, k)

    own = C.stored(own, "topk-queries")  # with it the queries' numbers, as ids may repeat
    home = C.stored(own.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(search, FOUND), "topk-home")
    order = Window.partitionBy("nth").orderBy(F.desc("score"), "vec_id")
    floors = home.withColumn("at", F.row_number().over(order)).filter(F.col("at") == k).select(
        "nth", F.col("score").alias("fs"), F.col("vec_id").alias("fi"))
    started = own.join(floors, "nth", "left").select(
        "nth", "id", "v", F.col("shard").alias("home"), F.coalesce("fs", "floor_score").alias("floor_score"), F.coalesce("fi", "floor_id").alias("floor_id"))
    shards, queries = index.agg(F.max("shard")).first()[0], own.count()
    if not queries:
        return home.withColumn("rank", F.lit(0)).filter("false").select("query_id", "rank", "vec_id", "score")
    chunks = F.lit(-(-queries // QUERY_CHUNK)).cast("long")
    # every query meets every other shard, in blocks of QUERY_CHUNK queries by one shard
    asked = started.withColumn("chunk", F.pmod(F.xxhash64("nth"), chunks)) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards).cast("long")))) \
        .filter("shard <> home").drop("home")
    parts = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    rest = asked.groupBy("chunk", "shard").cogroup(parts.groupBy("chunk", "shard")).applyInArrow(search, FOUND)
    return home.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
