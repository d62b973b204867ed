"""Forests on cells (F3, F5): every row is drawn for every tree once, and trees grow on sums of what they drew.

MLlib's forests send every row down every tree again for every level. Here one pass codes the rows as the intervals between MLlib's split candidates
(``operators.cells``) and deals them by cell; each row gets its Poisson(1) number for every tree, as in MLlib's bootstrap, and only a cell's drawn
weight, labels and squares go on, tree by tree. A task then grows a few whole trees: variance gain (of two classes it is half of Gini's, so the
splits are the same), a fresh random subset of slots for every node, twin leaves joined, as MLlib does. The model is MLlib's, made through its own files.

Draws are others than MLlib's, so scores differ as between two seeds. Tables of at most ``ROWS_ALONE`` rows, more than ``MAX_CELLS`` cells (a tree's
cells must fit a task) and what differs from MLlib's defaults are left to MLlib.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import c
from ..session import ship_package, shared_path
from . import boost as B
from .cells import BINS, IntervalCoder

FORESTS = (RandomForestClassifier, RandomForestRegressor)
ROWS_ALONE = 250_000       # rows up to which MLlib's forest is fitted
MAX_CELLS = 1_000_000      # cells that a task grows trees on
MAX_SLOTS = 64
ROWS_A_PART = 250_000
TREES_A_TASK = 4
CHUNK = 1 << 18            # rows that are coded at a time
DRAWN = 1 << 13            # rows that are drawn for all trees at a time
HEAVY = 1 << 12            # rows of a cell in a chunk above which the cell is dealt to several tasks
ROWS, SUMS = "key binary, salt long, y double", "part int, codes binary, sums binary"


def can_grow(learner) -> bool:
    """Whether the forest is of the kind that is grown here."""
    return (isinstance(learner, FORESTS) and learner.getMaxDepth() <= B.MAX_DEPTH and learner.getNumTrees() > 1 and learner.getMaxBins() == BINS
            and learner.getFeatureSubsetStrategy() == "auto" and learner.getBootstrap() and learner.getSubsamplingRate() == 1.0
            and learner.getMinInstancesPerNode() == 1 and learner.getMinInfoGain() == 0.0 and learner.getMinWeightFractionPerNode() == 0.0
            and not (learner.isSet("weightCol") and learner.getWeightCol()) and not learner.isSet("thresholds" if isinstance(learner, RandomForestClassifier) else "leafCol"))


class OnDraws(Estimator):
    """Fits a forest on the sums of its trees' draws; the fitted model is MLlib's."""

    def __init__(self, learner):
        super().__init__()
        self.learner = learner

    def _fit(self, df: DataFrame):
        return fit(self.learner, df)


def fit(learner, df: DataFrame):
    """The learner's model; ``df`` has its features and label."""
    n = df.count() if can_grow(learner) else 0
    model = _fit_on_draws(learner, df, n) if n > ROWS_ALONE else None
    return learner.fit(df) if model is None else model


def _fit_on_draws(learner, df: DataFrame, n: int):
    spark, classes = df.sparkSession, isinstance(learner, RandomForestClassifier)
    x, y = learner.getFeaturesCol(), c(learner.getLabelCol()).cast("double")
    first = df.select(x).first()
    if first is None or first[0] is None or not 0 < len(first[0]) <= MAX_SLOTS:
        return None
    rows = df.select(vector_to_array(x).alias("x"), y.alias("y"))
    m = len(first[0])
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    good = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") != F.lit(float("inf"))) & (F.size("x") == m) & ~bad
    if classes:
        good = good & F.col("y").isin(0.0, 1.0)
    plain, mean, least, greatest = rows.agg(F.min(F.coalesce(good, F.lit(False))), F.avg("y"), F.min("y"), F.max("y")).first()
    if plain is not True or classes and least == greatest:
        return None  # MLlib's to refuse, or not of two classes
    coder = IntervalCoder(inputCol=x, outputCol="__at").fit(df)
    cuts = [np.array([float(v) for v in s.split(",") if v]) for s in coder.getOrDefault(coder.cuts)]
    ship_package(spark)
    parts = -(-n // ROWS_A_PART)
    dealt = rows.mapInArrow(_coder(cuts), ROWS).repartition(parts, "key", "salt").sortWithinPartitions("key", "y").persist()
    try:
        if dealt.agg(F.approx_count_distinct("key")).first()[0] > MAX_CELLS:
            return None
        trees = _grow(dealt, learner, m, 0.0 if classes else mean, classes)
    finally:
        dealt.unpersist()
    return _model(learner, spark, trees, cuts, m, classes)


def _coder(cuts: list[np.ndarray]):
    """Rows -> (intervals as bytes, salt, label). A cell of very many rows gets several salts."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for x, y in _chunks(batches, len(cuts)):
            codes = np.column_stack([np.searchsorted(own, x[:, s], "left").astype(np.uint8) for s, own in enumerate(cuts)])
            _, cell = np.unique(_words(codes), return_inverse=True)
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0])
            place = np.arange(len(y)) - np.repeat(starts, np.diff(np.r_[starts, len(y)]))
            salt = np.zeros(len(y), np.int64)
            salt[order] = np.where(place < HEAVY, 0, (part * 1_000_003 + number) * 1000 + place // HEAVY)
            number += 1
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(y), [None, pa.py_buffer(np.ascontiguousarray(codes))])
            for at in range(0, len(y), 1 << 14):
                yield pa.RecordBatch.from_pydict({"key": keys[at:at + (1 << 14)].cast(pa.binary()), "salt": pa.array(salt[at:at + (1 << 14)]), "y": pa.array(y[at:at + (1 << 14)])})
    return code


def _words(codes: np.ndarray) -> np.ndarray:
    """One number a row that tells cells apart, as far as a salt needs it."""
    out = np.zeros(len(codes), np.uint64)
    for s in range(codes.shape[1]):
        out = out * np.uint64(1_000_003) + codes[:, s]
    return out


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append((b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), b.column(1).to_numpy(zero_copy_only=False)))
            n += b.num_rows
        if n >= CHUNK:
            yield tuple(np.concatenate(v) for v in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(v) for v in zip(*held))


def _grow(dealt: DataFrame, learner, m: int, mean: float, classes: bool) -> list[tuple[np.ndarray, ...]]:
    """The trees' nodes; labels are taken from their mean, so that squares don't cancel."""
    n_trees, seed, depth = learner.getNumTrees(), learner.getSeed() & (2 ** 63 - 1), learner.getMaxDepth()
    subset = int(np.ceil(np.sqrt(m))) if classes else max(1, int(np.ceil(m / 3)))
    groups = [range(i, min(i + TREES_A_TASK, n_trees)) for i in range(0, n_trees, TREES_A_TASK)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for b in batches:
            for at in range(0, b.num_rows, DRAWN):
                own = b.slice(at, DRAWN)
                codes = np.frombuffer(b"".join(own.column(0).to_pylist()), np.uint8).reshape(own.num_rows, m)
                y = own.column(2).to_numpy(zero_copy_only=False) - mean
                starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
                drawn = rng.poisson(1.0, (own.num_rows, n_trees)).astype(np.float64)
                sums = np.empty((n_trees, 3, len(starts)))
                for k in range(3):  # weight, labels, squares
                    sums[:, k] = np.add.reduceat(drawn, starts, axis=0).T
                    drawn *= y[:, None]
                kept = codes[starts].tobytes()
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(range(len(groups)), pa.int32()), "codes": [kept] * len(groups),
                    "sums": [np.ascontiguousarray(sums[g.start:g.stop]).tobytes() for g in groups]})

    def grown(part: int, blocks: Iterator[tuple]) -> Iterator[tuple]:
        held = [(np.frombuffer(a, np.uint8).reshape(-1, m), np.frombuffer(s).reshape(len(groups[part]), 3, -1)) for _, (a, s) in blocks]
        if not held:
            return
        codes = np.concatenate([a for a, _ in held])
        for k, i in enumerate(groups[part]):
            sums = np.concatenate([s[k] for _, s in held], axis=1)
            yield i, _tree(codes, sums, depth, subset, np.random.default_rng([seed, 1, i]))

    blocks = dealt.mapInArrow(draw, SUMS).rdd.map(lambda r: (r[0], (bytes(r[1]), bytes(r[2]))))
    found = dict(blocks.partitionBy(len(groups), lambda g: g).mapPartitionsWithIndex(grown).collect())
    out = []
    for i in range(n_trees):
        slot, cut, gain, w, s, q = found[i]
        out.append((slot, cut, gain, w, s + w * mean, q + 2 * mean * s + w * mean * mean))
    return out


def _tree(codes: np.ndarray, sums: np.ndarray, depth: int, subset: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(slot or -1, cut, gain, weight, labels, squares) of the nodes of a tree, laid out as a heap."""
    drawn = sums[0] > 0
    codes, sums = codes[drawn], sums[:, drawn]
    size, m = (2 << depth) - 1, codes.shape[1]
    slot, cut, gain, total = np.full(size, -1), np.zeros(size, np.int64), np.full(size, -1.0), np.zeros((3, size))
    total[:, 0] = sums.sum(axis=1)
    nodes, node = np.zeros(1, np.int64), np.zeros(len(codes), np.int64)  # open nodes; the node that a cell is in
    for _ in range(depth):
        place = np.full(size, -1)
        place[nodes] = np.arange(len(nodes))
        at = place[node]
        inside = at >= 0
        if not inside.all():
            codes, sums, node, at = codes[inside], sums[:, inside], node[inside], at[inside]
        hist = np.empty((3, len(nodes), m, BINS))
        for s in range(m):
            key = at * BINS + codes[:, s]
            for k in range(3):
                hist[k, :, s] = np.bincount(key, sums[k], len(nodes) * BINS).reshape(-1, BINS)
        left = np.cumsum(hist, axis=3)
        right = left[..., -1:] - left
        filled = np.cumsum(hist[0] > 0, axis=2)
        offered = np.argsort(rng.random((len(nodes), m)), axis=1) < subset  # a random subset of the slots for each node
        fair = (filled > 0) & (filled < filled[..., -1:]) & offered[:, :, None]
        whole = total[:, nodes]
        with np.errstate(all="ignore"):
            gains = B._variance(whole)[:, None, None] - (left[0] * B._variance(left) + right[0] * B._variance(right)) / (left[0] + right[0])
        flat = np.where(fair, gains, -np.inf).reshape(len(nodes), -1)
        best = flat.argmax(axis=1)
        rows = np.flatnonzero(flat[np.arange(len(nodes)), best] > 0)
        nodes, best = nodes[rows], best[rows]
        if not len(nodes):
            break
        slot[nodes], cut[nodes], gain[nodes] = best // BINS, best % BINS, flat[rows, best]
        children = []
        for side, sides in ((1, left), (2, right)):
            child = 2 * nodes + side
            total[:, child] = sides[:, rows, best // BINS, best % BINS]
            children.append(child[np.abs(B._variance(total[:, child])) >= B.EPSILON])
        inner = slot[node] >= 0
        codes, sums, node = codes[inner], sums[:, inner], node[inner]
        node = 2 * node + 1 + (codes[np.arange(len(node)), slot[node]] > cut[node])
        nodes = np.sort(np.concatenate(children))
        if not len(nodes):
            break
    return slot, cut, gain, *total


def _model(learner, spark, trees: list[tuple[np.ndarray, ...]], cuts: list[np.ndarray], m: int, classes: bool):
    """MLlib's model of these trees: the files of a model of two rows, with these nodes in the place of its own."""
    two = spark.createDataFrame([(Vectors.dense([float(i)] * m), float(i)) for i in range(2)], [learner.getFeaturesCol(), learner.getLabelCol()])
    model, path = learner.fit(two), shared_path(spark, "forest")
    model.write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    nodes = [(i, x) for i, tree in enumerate(trees) for x in _nodes(tree, cuts, classes)]
    table = spark.createDataFrame(nodes, schema)
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return type(model).load(path)


def _nodes(tree: tuple[np.ndarray, ...], cuts: list[np.ndarray], classes: bool) -> list[tuple]:
    """A tree's nodes as MLlib saves them, numbered in the order of a walk."""
    slot, cut, gain, w, s, q = (x.tolist() for x in tree)
    size, out = len(slot), []
    variance = B._variance(np.array(tree[3:])).tolist()
    value = [float(b > a - b) if classes else b / a if a else 0.0 for a, b in zip(w, s)]
    leaf = [x < 0 for x in slot]
    for i in reversed(range(size // 2)):  # leaves of one prediction are one leaf
        if not leaf[i] and leaf[2 * i + 1] and leaf[2 * i + 2] and value[2 * i + 1] == value[2 * i + 2]:
            leaf[i] = True

    def walk(i: int) -> int:
        number = len(out)
        out.append(None)
        stats = [w[i] - s[i], s[i]] if classes else [w[i], s[i], q[i]]
        impurity = (2 if classes else 1) * max(variance[i], 0.0)
        if leaf[i]:
            out[number] = (number, value[i], impurity, stats, round(w[i]), -1.0, -1, -1, (-1, [], -1))
        else:
            a, b = walk(2 * i + 1), walk(2 * i + 2)
            own = (slot[i], [float(cuts[slot[i]][cut[i]])], -1)
            out[number] = (number, value[i], impurity, stats, round(w[i]), (2 if classes else 1) * gain[i], a, b, own)
        return number

    walk(0)
    return out
