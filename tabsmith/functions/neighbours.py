"""Exact nearest neighbours inside classes, by pivots and triangle-inequality bounds.

Points of a class are assigned to the nearest of its pivots (a Voronoi partition); large cells are cut into blocks. A
point's k-th nearest candidate so far (in its own block, or among the pivots) bounds the distance of its neighbours, so a cell whose
ball, or whose bisector to the point's own cell, lies farther away cannot hold one. Blocks are compared pairwise where some point
of the one cannot rule out the other's cell; a pair of blocks is one row, so no task holds more than two blocks at a time, however
many points a cell has. Results are exact, whatever the pivots; they and the work's layout come from the points alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

CELL = 1000            # points a pivot stands for
BLOCK = 2000           # points of a block
MAX_PIVOTS = 16_384    # of all classes together: larger cells are cut into more blocks
SLACK = 1 + 1e-9       # rounding of bounds


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed feature by feature in a fixed order (the same for either side)."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _pivots(points: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """About one point in CELL of each class, chosen by a hash of the point, at least one, MAX_PIVOTS or so altogether."""
    share = min(1.0, MAX_PIVOTS * CELL / max(1, sum(sizes.values())))
    rate = F.broadcast(points.sparkSession.createDataFrame(
        [(k, n, max(1, round(n * share / CELL))) for k, n in sizes.items()], "_k int, _size long, _take long"))
    least = points.groupBy("_k").agg(F.min("_id").alias("_least"))
    chosen = points.join(rate, "_k").join(F.broadcast(least), "_k").where(  # a row per class
        (F.pmod(F.xxhash64("_id"), F.col("_size")) < F.col("_take")) | (F.col("_id") == F.col("_least")))
    found: dict[int, list] = {}
    for r in chosen.select("_k", "_id", "_x").collect():
        found.setdefault(r["_k"], []).append((r["_id"], r["_x"]))
    return {k: np.array([x for _, x in sorted(v)], dtype=float) for k, v in found.items()}


def nearest(points: DataFrame, k: int) -> DataFrame:
    """(_k, _id, _near): for every row of ``points`` (_k int class number, _id string, _x array<double>, _m long; (_k, _id) distinct) the k
    nearest other rows of its class as structs (d, id, m, x), nearest first, ties by id; fewer where the class has fewer. Rows alone in
    their class don't appear."""
    ship_package(points.sparkSession)
    sizes = {r["_k"]: r["count"] for r in points.groupBy("_k").count().collect()}  # a row per class
    if not sizes:
        return points.select("_k", "_id", F.array().cast("array<struct<d:double,id:string,m:long,x:array<double>>>").alias("_near"))
    pivots = _pivots(points, sizes)
    block_size = BLOCK

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cls, x = b.column("_k").to_numpy(), matrix(b.column("_x"), b.num_rows)
            cell, far = np.zeros(len(cls), dtype=np.int32), np.zeros(len(cls))
            for c in np.unique(cls):
                at = np.flatnonzero(cls == c)
                for part in np.array_split(at, -(-len(at) * len(pivots[c]) // 2_000_000)):
                    d = distances(x[part], pivots[c])
                    cell[part] = d.argmin(axis=1)
                    far[part] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_id"), b.column("_x"), b.column("_m"), pa.array(cell), pa.array(far)],
                                             ["_k", "_id", "_x", "_m", "_cell", "_far"])

    placed = cut_lineage(points.select("_k", "_id", "_x", "_m").mapInArrow(
        assign, "_k int, _id string, _x array<double>, _m long, _cell int, _far double"))
    cells = placed.groupBy("_k", "_cell").agg(F.count("*").alias("_n"), F.max("_far").alias("_radius")) \
        .withColumn("_parts", F.ceil(F.col("_n") / block_size))
    radius = {c: np.full(len(p), -np.inf) for c, p in pivots.items()}  # a cell without points rules itself out
    for r in cells.collect():  # a row per pivot
        radius[r["_k"]][r["_cell"]] = r["_radius"]
    blocks = placed.join(F.broadcast(cells.select("_k", "_cell", "_parts")), ["_k", "_cell"]) \
        .withColumn("_block", F.pmod(F.xxhash64("_id"), "_parts").cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        n, c, cell = table.num_rows, table.column("_k")[0].as_py(), table.column("_cell")[0].as_py()
        x, far = matrix(table.column("_x"), n), table.column("_far").to_numpy()
        own = distances(x, x)
        np.fill_diagonal(own, np.inf)
        to = distances(x, pivots[c])
        others = np.where(to > 0, to, np.inf)  # a pivot at distance 0 may be the point itself
        # k other points lie within either bound; the two kinds aren't mixed, as a pivot may be in the block as well
        bound = np.minimum(*[np.partition(np.concatenate([m, np.full((n, k), np.inf)], axis=1), k - 1, axis=1)[:, k - 1] for m in (own, others)])
        reach = np.maximum(to - radius[c], (to - far[:, None]) / 2) <= bound[:, None] * SLACK
        reach[:, cell] = True
        reach &= np.isfinite(radius[c])
        return pa.table({"_k": pa.array([c], pa.int32()), "_cell": pa.array([cell], pa.int32()),
                         "_block": pa.array([table.column("_block")[0].as_py()], pa.int32()), "ids": [table.column("_id").to_pylist()],
                         "xs": [x.ravel()], "ms": [table.column("_m").to_pylist()], "bounds": [bound], "visits": pa.array([np.flatnonzero(reach.any(axis=0)).astype(np.int32)], pa.list_(pa.int32()))})

    packed = cut_lineage(blocks.groupBy("_k", "_cell", "_block").applyInArrow(
        pack, "_k int, _cell int, _block int, ids array<string>, xs array<double>, ms array<long>, bounds array<double>, visits array<int>"))
    wanted = packed.select("_k", F.col("_cell").alias("q_cell"), F.col("_block").alias("q_block"), F.explode("visits").alias("_cell")) \
        .join(packed.select("_k", "_cell", "_block"), ["_k", "_cell"])
    asking = packed.select("_k", F.col("_cell").alias("q_cell"), F.col("_block").alias("q_block"), F.col("ids").alias("q_ids"),
                           F.col("xs").alias("q_xs"), "bounds")
    pairs = wanted.join(asking, ["_k", "q_cell", "q_block"]).join(packed.drop("bounds", "visits"), ["_k", "_cell", "_block"]) \
        .select("_k", "q_ids", "q_xs", "bounds", "ids", "xs", "ms")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                q_ids, ids = b.column("q_ids")[r].as_py(), b.column("ids")[r].as_py()
                q, x = (b.column(name)[r].values.to_numpy(zero_copy_only=False).reshape(len(i), -1) for name, i in (("q_xs", q_ids), ("xs", ids)))
                d = distances(q, x)
                place = {i: n for n, i in enumerate(ids)}
                for n, i in enumerate(q_ids):
                    if i in place:
                        d[n, place[i]] = np.inf
                d[d > b.column("bounds")[r].values.to_numpy()[:, None] * SLACK] = np.inf
                best = np.argsort(d, axis=1, kind="stable")[:, :k]  # points lie in order of their ids
                near = np.take_along_axis(d, best, axis=1)
                rows, cols = np.nonzero(np.isfinite(near))
                if len(rows):
                    at, m = best[rows, cols], b.column("ms")[r].values.to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), b.column("_k")[r].as_py(), dtype=np.int32)), pa.array([q_ids[i] for i in rows]),
                         pa.StructArray.from_arrays([pa.array(near[rows, cols]), pa.array([ids[i] for i in at]), pa.array(m[at]), pa.array(list(x[at]))],
                                                    ["d", "id", "m", "x"])],
                        ["_k", "_id", "_c"])

    found = pairs.mapInArrow(compare, "_k int, _id string, _c struct<d:double,id:string,m:long,x:array<double>>")
    return found.groupBy("_k", "_id").agg(F.slice(F.array_sort(F.collect_list("_c")), 1, k).alias("_near"))
