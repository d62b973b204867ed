"""Approximate nearest neighbours by largest inner product with cross-polytope hashing.

Rows are cut into bands by norm, each half as long as the one before, so that a few long vectors don't press the others into one
point. A band's vectors are scaled by its upper end and completed to unit length with one more coordinate (queries with zero), so
that the largest inner product is the smallest angle. A table rotates them with three rounds of (random signs, fast Hadamard
transform) and assigns each to the nearest signed axis. A query looks into the PROBES axes nearest to it in every one of TABLES
tables of every band, and in the first table into as many more as hold ENOUGH of the band's rows (at least k others), or all of them;
whatever it finds there is scored exactly, in double precision, on the original vectors, and the best k stay. Lists are therefore as
long as the candidates allow, and bands of up to ENOUGH rows are searched whole.

A bucket's rows are scored in place, so candidate pairs are never listed: (band, table, axis, piece) groups hold at most about PIECE rows,
large buckets being cut by a hash of the id, and send back the best k per query. Every row is indexed in every table.
Measured recall is in the tests and the README.

Rows whose vector is null, zero, or holds null or non-finite components take no part, nor rows with a null id. Ties go to the
smaller id. Vectors of different length are compared as if the shorter ended in zeros. Equal vectors are equal candidates;
only a row's own id is left out of its list. Rows that share an id are one query with one merged list, their nearest over all of them. Fewer candidates than k give shorter lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .topk import finite

TABLES = 8
PROBES = 28
ENOUGH = 512
PIECE = 2048
QUERY_PIECE = 4096
SEED = 20_011
NO_ID = np.iinfo(np.int64).max


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotations(dim: int, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """Random signs [tables, 3, dim]."""
    return np.random.default_rng([seed, dim]).choice([-1.0, 1.0], size=(tables, 3, dim))


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def nearest_axes(x: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of every row, nearest first: i for +e_i, dim + i for -e_i."""
    both = np.concatenate([x, -x], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def floats(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.asarray(column.offsets).astype(np.int64)
    size = np.diff(off)
    out = np.zeros((len(size), width))
    flat = column.values.to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(size)), size), C.spread(np.zeros(len(size), dtype=np.int64), size)] = flat[off[0]:off[-1]]
    return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vec_col)
    keep = F.coalesce(finite(v), F.lit(False)) & F.exists(v, lambda x: x.cast("double") != 0) & F.col(id_col).isNotNull()
    return df.filter(keep).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))


def axes_of(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """The nearest axes in every table: row, table, probe."""
    return np.stack([nearest_axes(rotated(x, s), probes) for s in signs], axis=1)


def dimension(width: int) -> int:
    return 1 << (width + 1 - 1).bit_length()  # power of two with room for the added coordinate


def indexed(rows: DataFrame, width: int, longest: float, tables: int) -> DataFrame:
    """rows with the bucket they belong to in every table: id, v, band, tab, axis."""
    dim = dimension(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = rotations(dim, tables)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                b = batch.slice(a, 2000)
                v = floats(b.column("v"), width)
                x = np.zeros((len(v), dim))
                share = np.linalg.norm(v, axis=1) / longest
                band = np.maximum(-np.frexp(share)[1], 0)  # 0 from half of the longest on
                share = np.ldexp(share, band)
                x[:, :width] = np.ldexp(v / longest, band[:, None])
                x[:, width] = np.sqrt(np.maximum(1 - share ** 2, 0))
                axes = axes_of(x, signs, 1)[:, :, 0]
                yield pa.RecordBatch.from_arrays([
                    b.column("id"), b.column("v"), pa.array(band.astype(np.int32)), pa.array(list(axes.astype(np.int32)), pa.list_(pa.int32()))],
                    ["id", "v", "band", "axes"])

    out = rows.mapInArrow(run, "id long, v array<double>, band int, axes array<int>")
    return out.select("id", "v", "band", F.posexplode("axes").alias("tab", "axis"))


def asked(queries: DataFrame, width: int, probes: int, tables: int, enough: int, sizes: dict[tuple[int, int], dict[int, int]]) -> DataFrame:
    """queries with the filled buckets they look into: id, v, band, tab, axis. ``sizes``: rows by axis of every (band, table)."""
    dim = dimension(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = rotations(dim, tables)
        filled = []
        for (band, tab), by_axis in sorted(sizes.items()):
            counts = np.zeros(2 * dim, dtype=np.int64)
            counts[list(by_axis)] = list(by_axis.values())
            filled.append((band, tab, counts))
        step, some = max(1, min(500, 2 ** 22 // (dim * tables))), max(1, 2 ** 20 // width)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                b = batch.slice(a, step)
                v = floats(b.column("v"), width)
                x = np.zeros((len(v), dim))
                x[:, :width] = v / np.linalg.norm(v, axis=1)[:, None]
                near = axes_of(x, signs, 2 * dim)
                for band, tab, counts in filled:
                    rows = counts[near[:, tab]]
                    look = np.broadcast_to(np.arange(2 * dim) < probes, rows.shape)
                    if tab == 0:
                        look = look | (np.cumsum(rows, axis=1) - rows < enough)
                    q, i = np.nonzero(look & (rows > 0))
                    axis = near[q, tab, i].astype(np.int32)
                    for c in range(0, len(q), some):
                        take, to = pa.array(q[c:c + some]), axis[c:c + some]
                        yield pa.RecordBatch.from_arrays([
                            b.column("id").take(take), b.column("v").take(take), pa.array(np.full(len(to), band, dtype=np.int32)),
                            pa.array(np.full(len(to), tab, dtype=np.int32)), pa.array(to)], ["id", "v", "band", "tab", "axis"])

    return queries.mapInArrow(run, "id long, v array<double>, band int, tab int, axis int")


def rank_bucket(queries: pa.Table, rows: pa.Table, k: int, width: int) -> pa.Table:
    """The best k rows of a bucket piece for every query that probes it."""
    if queries.num_rows == 0 or rows.num_rows == 0:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    q, x = floats(queries.column("v"), width), floats(rows.column("v"), width)
    qid, xid = queries.column("id").to_numpy(), rows.column("id").to_numpy()
    by_id = np.argsort(xid, kind="stable")
    x, xid = x[by_id], xid[by_id]
    if (xid[1:] == xid[:-1]).any():  # copies of a row are one candidate
        first = np.sort(np.unique(np.column_stack([np.cumsum(np.r_[0, xid[1:] != xid[:-1]]), x]), axis=0, return_index=True)[1])
        x, xid = x[first], xid[first]
    outs = []
    for a in range(0, len(q), 256):
        score = exact(q[a:a + 256], x)
        score[qid[a:a + 256, None] == xid[None, :]] = -np.inf
        take = min(k, len(xid))
        best = np.argsort(-score, axis=1, kind="stable")[:, :take] if len(xid) <= 4 * k else _best(score, take)
        s = np.take_along_axis(score, best, 1)
        keep = np.nonzero(s > -np.inf)
        outs.append((qid[a:a + 256][keep[0]], xid[best[keep]], s[keep]))
    return pa.table({n: np.concatenate([o[i] for o in outs]) for i, n in enumerate(("query_id", "vec_id", "score"))})


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, each summed in one fixed order whatever the block, so that every copy of a pair gets one score."""
    return np.einsum("qd,xd->qx", q, x, optimize=False)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, ties by column (columns are in id order)."""
    kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(score), k), dtype=np.int64)
    for i in range(len(score)):
        at = np.flatnonzero(score[i] >= kth[i])
        out[i] = at[np.argsort(-score[i, at], kind="stable")[:k]]
    return out


def neighbours(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
               tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found; ``is_query`` is over id_col."""
    rows = usable(df, id_col, vec_col)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    width, longest = rows.agg(F.max(F.size("v")), F.max(norm)).first()
    if width is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = rows.withColumnRenamed("id", id_col).filter(is_query).withColumnRenamed(id_col, "id")
    probes = min(probes, 2 << width.bit_length())
    index = C.stored(indexed(rows, width, longest, tables), "ann-index")
    # a row per bucket and piece: large buckets are cut by id, and so are the queries that come to them
    buckets = index.groupBy("band", "tab", "axis").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
    cut = C.stored(buckets.withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("long")), "ann-buckets")  # bands x TABLES x 2 x dim rows
    sizes: dict[tuple[int, int], dict[int, int]] = {}
    for r in cut.collect():
        sizes.setdefault((r.band, r.tab), {})[r.axis] = r.ids
    bucket = ["band", "tab", "axis"]
    cut = cut.select(*bucket, "pieces")
    to = C.stored(asked(queries, width, probes, tables, max(ENOUGH, k + 1), sizes).join(F.broadcast(cut), bucket), "ann-probes")
    heavy = to.groupBy(*bucket).agg(F.ceil(F.count("*") / QUERY_PIECE).cast("long").alias("parts"))
    left = to.join(F.broadcast(heavy), bucket).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))) \
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    right = index.join(F.broadcast(cut), bucket).join(F.broadcast(heavy), bucket) \
        .withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))) \
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    key = [*bucket, "piece", "part"]

    def rank(q: pa.Table, x: pa.Table) -> pa.Table:
        return rank_bucket(q, x, k, width)

    found = left.select(*key, "id", "v").groupBy(*key).cogroup(right.select(*key, "id", "v").groupBy(*key)) \
        .applyInArrow(rank, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
