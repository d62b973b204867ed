"""Boosted fits of a search, side by side or on shared passes (F4-F6 in F9, F10, F12, F15, F21, F22, F23).

A boosted fit needs one pass over its cells for every level of every tree, and fitted one by one the fits of a search run as many small jobs
as there are fits. Here a fit whose cells are one part's worth is one task. On more cells, all fits of a depth take each pass together: tasks add up, for every open node of every fit, the weight and the weighted
gradient of each interval of each slot; the sums of all tasks give the next splits. Trees, gradients and predictions are those of MLlib's boosted trees
(variance gain, squared or logistic loss, first tree on the label, all slots tried, a node closed when nothing is gained).

Cells stay in the tasks, persisted with every fit's prediction, and are checkpointed every few rounds. The driver holds sums and trees, whose
size goes by fits, nodes and slots, not by rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import c
from ..session import ensure_checkpoint_dir, ship_package
from .cells import BINS, BOOSTED, WEIGHT

MAX_DEPTH = 10         # nodes of a tree are laid out in full
BLOCK_ROWS = 1 << 13   # cells that a task works on at a time
KEEP_EVERY = 20        # rounds between checkpoints
FEW_TASKS = 48         # sums of more tasks are added on the executors first
EPSILON = 2.0 ** -52   # MLlib closes nodes of less variance


@dataclass
class Tree:
    """Heap of nodes; slot -1: a leaf. A row goes right where its slot lies above the cut."""
    slot: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    variance: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.uint8), np.zeros(n), np.zeros(n))

    def reach(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row comes to within so many levels."""
        n, width = codes.shape
        flat, start, node = codes.ravel(), np.arange(n) * width, np.zeros(n, np.int64)
        for _ in range(levels):
            slot = self.slot[node]
            inner = slot >= 0
            if not inner.any():
                break
            right = flat[start + np.maximum(slot, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node


@dataclass
class Fit:
    """One boosted fit on the cells number ``unit``."""
    unit: int
    rounds: int
    depth: int
    rate: float
    logistic: bool
    trees: list[Tree] = field(default_factory=list)

    def step(self, number: int) -> float:
        return self.rate if number else 1.0


def gradient(y: np.ndarray, f: np.ndarray | None, logistic: bool) -> np.ndarray:
    """What the next tree is fitted to; labels of the logistic loss are -1 and 1."""
    if f is None:
        return y
    if logistic:
        with np.errstate(over="ignore"):  # far on the wrong side's other end: no gradient
            return 4 * y / (1 + np.exp(2 * y * f))
    return 2 * (y - f)


def can_share(learner) -> bool:
    """Whether the fit is of the kind that is made here; what differs from MLlib's defaults elsewhere is left to MLlib."""
    return isinstance(learner, BOOSTED) and learner.getMaxDepth() <= MAX_DEPTH


def fit_of(learner, unit: int) -> Fit:
    return Fit(unit, learner.getMaxIter(), learner.getMaxDepth(), learner.getStepSize(), isinstance(learner, GBTClassifier))


def plain_cells(cells: DataFrame, t: str, binary: bool) -> bool:
    """Whether all labels, weights and numbers are such that MLlib would take them; the rest is left for it to refuse."""
    x = vector_to_array("features")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    y, w = c(t).cast("double"), c(WEIGHT)
    good = y.isNotNull() & ~F.isnan(y) & w.isNotNull() & ~F.isnan(w) & (w > 0) & ~bad & (F.size(x) > 0)
    if binary:
        good = good & y.isin(0.0, 1.0)
    return cells.agg(F.min(F.coalesce(good, F.lit(False)))).first()[0] is True


def _codes(column: pa.Array, n: int) -> np.ndarray:
    """Slots of a batch as intervals; a slot without cuts is constant and stays so."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))
    return np.ascontiguousarray(np.clip(x, 0, BINS - 1).astype(np.uint8))


def _blocks(cells: DataFrame, t: str, unit: int, logistic: bool, parts: int) -> RDD:
    """(unit, codes, label, weight, {fit: prediction}) of at most BLOCK_ROWS cells each."""
    rows = cells.select(vector_to_array("features").alias("x"), c(t).cast("double").alias("y"), c(WEIGHT).cast("double").alias("w"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = _codes(b.column(0), b.num_rows)
                yield pa.RecordBatch.from_pydict({"x": [codes.tobytes()], "y": [b.column(1).to_numpy().tobytes()], "w": [b.column(2).to_numpy().tobytes()]})

    def unpack(packed: Iterator) -> Iterator[tuple]:
        held, n = [], 0

        def block():
            x, y, w = (np.concatenate(v) for v in zip(*held))
            return unit, x, 2 * y - 1 if logistic else y, w, {}

        for r in packed:
            y = np.frombuffer(r["y"])
            held.append((np.frombuffer(r["x"], np.uint8).reshape(len(y), -1), y, np.frombuffer(r["w"])))
            n += len(y)
            if n >= BLOCK_ROWS:
                yield block()
                held, n = [], 0
        if held:
            yield block()

    # in the cells' own order, or one that depends on them alone, so that a rerun adds up the same numbers in the same order
    dealt = rows.coalesce(1) if parts == 1 else rows.repartition(parts, "x", "y").sortWithinPartitions("x", "y")
    return dealt.mapInArrow(pack, "x binary, y binary, w binary").rdd.mapPartitions(unpack)


def _block_sums(codes: np.ndarray, w: np.ndarray, y: np.ndarray, tree: Tree, nodes: np.ndarray, level: int) -> np.ndarray:
    """[weight, weighted gradient and its square, slot, open node and interval] of a block's cells with gradients ``y``."""
    first, size = (1 << level) - 1, len(nodes) * BINS
    place = np.full(1 << level, -1, np.int64)
    place[nodes - first] = np.arange(len(nodes))
    at = tree.reach(codes, level) - first
    at = np.where(at >= 0, place[np.maximum(at, 0)], -1)
    if (at < 0).any():
        kept = at >= 0
        codes, at, y, w = codes[kept], at[kept], y[kept], w[kept]
    out, base, g = np.empty((3, codes.shape[1], size)), at * BINS, w * y
    square = g * y
    for s in range(codes.shape[1]):
        key = base + codes[:, s]
        out[0, s], out[1, s], out[2, s] = np.bincount(key, w, size), np.bincount(key, g, size), np.bincount(key, square, size)
    return out


def _level_sums(state: RDD, open_: dict[int, tuple[bool, Tree, np.ndarray]], by_unit: dict[int, list[int]], level: int) -> dict[int, np.ndarray]:
    """{fit: [weight, weighted gradient and its square, open node, slot, interval]} of one level of all fits."""
    def add_up(blocks: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        sums: dict[int, np.ndarray] = {}
        for unit, codes, y, w, f in blocks:
            for i in by_unit.get(unit, ()):
                logistic, tree, nodes = open_[i]
                own = _block_sums(codes, w, gradient(y, f.get(i), logistic), tree, nodes, level)
                sums[i] = sums[i] + own if i in sums else own
        yield from sums.items()

    added = state.mapPartitions(add_up)
    if state.getNumPartitions() > FEW_TASKS:
        added = added.reduceByKey(np.add, min(FEW_TASKS, len(open_)))
    out: dict[int, np.ndarray] = {}
    for i, s in added.collect():
        out[i] = out[i] + s if i in out else s
    return {i: _by_node(s) for i, s in out.items()}


def _by_node(sums: np.ndarray) -> np.ndarray:
    return sums.reshape(3, sums.shape[1], -1, BINS).transpose(0, 2, 1, 3)


def _variance(sums: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(sums[0] == 0, 0.0, (sums[2] - sums[1] * sums[1] / sums[0]) / sums[0])


def _split(tree: Tree, nodes: np.ndarray, sums: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Split each node where most is gained, by MLlib's formula step by step, so that near ties fall alike; returns the open children."""
    left = np.cumsum(sums, axis=3)
    right = left[:, :, :, -1:] - left
    filled = np.cumsum(sums[0] > 0, axis=2)
    fair = (filled > 0) & (filled < filled[:, :, -1:])
    vl, vr = _variance(left), _variance(right)
    if nodes[0] == 0:
        tree.variance[0] = _variance(left[:, 0, 0, -1])
    both = left[0] + right[0]
    with np.errstate(all="ignore"):
        gain = tree.variance[nodes][:, None, None] - left[0] / both * vl - right[0] / both * vr
    flat = np.where(fair, gain, -np.inf).reshape(len(nodes), -1)
    best = flat.argmax(axis=1)
    good = flat[np.arange(len(nodes)), best] > 0
    rows, nodes, best = np.flatnonzero(good), nodes[good], best[good]
    slot, at = best // BINS, best % BINS
    tree.slot[nodes] = slot
    tree.cut[nodes] = present[slot, at]
    children = []
    for side, part, var in ((1, left, vl), (2, right, vr)):
        child = 2 * nodes + side
        tree.value[child] = part[1, rows, slot, at] / part[0, rows, slot, at]
        tree.variance[child] = var[rows, slot, at]
        children.append(child[np.abs(tree.variance[child]) >= EPSILON])
    return np.sort(np.concatenate(children))


def _cut_of(sums: np.ndarray) -> np.ndarray:
    """For each slot and interval the cut above it: halfway to the next interval that has rows, as MLlib cuts numbers."""
    found = sums[0].sum(axis=0) > 0
    out = np.zeros(found.shape, np.uint8)
    for s, own in enumerate(found):
        at = np.flatnonzero(own)
        for a, b in zip(at, at[1:]):
            out[s, a:b] = (a + b) // 2
    return out


def _drop_checkpoint(state: RDD) -> None:
    file = state.getCheckpointFile()
    if file:
        path = state.ctx._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(state.ctx._jsc.hadoopConfiguration()).delete(path, True)


def _older_freed(states: list[RDD]) -> list[RDD]:
    """Free the states before the last, which has been made; a checkpoint stays until a later state has its own."""
    *old, last = states
    for x in old:
        x.unpersist()
    if not last.isCheckpointed():
        return [x for x in old if x.isCheckpointed()] + [last]
    for x in old:
        _drop_checkpoint(x)
    return [last]


def fit_all(units: Sequence[tuple[DataFrame, bool]], t: str, fits: Sequence[Fit], n_cells: Sequence[int], rows_a_part: int = 250_000) -> None:
    """Grow the trees of all fits, each on the cells of its unit; ``units`` are (cells, whether the loss is logistic).

    Cells that are one part's worth, ``rows_a_part`` at most, need no sums of other tasks: each of their fits is one task. Larger
    units are dealt to as many tasks as they are worth, and their fits share passes: those of a depth go round by round together,
    those of other depths, which need more or fewer passes a round, beside them."""
    spark = units[0][0].sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    parts = [max(-(-n // rows_a_part), 1) for n in n_cells]
    base = [_blocks(cells, t, u, logistic, parts[u]).persist(StorageLevel.MEMORY_AND_DISK) for u, (cells, logistic) in enumerate(units)]
    sc.union(base).count()
    single = sorted((i for i, f in enumerate(fits) if parts[f.unit] == 1), key=lambda i: -fits[i].rounds * fits[i].depth)  # longest first
    spread = {i: f for i, f in enumerate(fits) if parts[f.unit] > 1}
    depths = sorted({f.depth for f in spread.values()}, reverse=True)
    jobs = [lambda: _grow_apart(sc, base, {i: fits[i] for i in single})] if single else []
    if spread:
        large = sc.union([x for u, x in enumerate(base) if parts[u] > 1])
        jobs += [lambda depth=depth: _grow(large, {i: f for i, f in spread.items() if f.depth == depth}, depth) for depth in depths]
    with ThreadPool(max(1, len(jobs))) as pool:
        pool.map(lambda job: job(), jobs, chunksize=1)
    for x in base:
        x.unpersist()


def _grow_apart(sc, base: list[RDD], fits: dict[int, Fit]) -> None:
    """Grow the trees of fits whose cells are one part each: a task a fit."""
    def grown(i: int, rounds: int, depth: int, rate: float, logistic: bool):
        def run(blocks: Iterator[tuple]) -> Iterator[tuple[int, list[Tree]]]:
            held = list(blocks)
            f, trees, cuts = [None] * len(held), [], None
            for number in range(rounds if held else 0):
                tree, nodes = Tree.of_depth(depth), np.zeros(1, np.int64)
                g = [gradient(y, f[k], logistic) for k, (_, _, y, _, _) in enumerate(held)]
                for level in range(depth):
                    sums = _by_node(sum(_block_sums(x, w, g[k], tree, nodes, level) for k, (_, x, _, w, _) in enumerate(held)))
                    if level == 0:
                        cuts = _cut_of(sums) if cuts is None else cuts
                        tree.value[0] = sums[1, 0, 0].sum() / sums[0, 0, 0].sum()
                    nodes = _split(tree, nodes, sums, cuts)
                    if not len(nodes):
                        break
                for k, (_, x, _, _, _) in enumerate(held):
                    add = (rate if number else 1.0) * tree.value[tree.reach(x, depth)]
                    f[k] = add if f[k] is None else f[k] + add
                trees.append(tree)
            yield i, trees
        return run

    tasks = [base[x.unit].mapPartitions(grown(i, x.rounds, x.depth, x.rate, x.logistic)) for i, x in fits.items()]
    for i, trees in sc.union(tasks).collect():
        fits[i].trees.extend(trees)


def _grow(base: RDD, fits: dict[int, Fit], depth: int) -> None:
    """Grow the trees of fits of one depth."""
    state, kept, cuts = base, [], {}
    for number in range(max(f.rounds for f in fits.values())):
        live = {i: Tree.of_depth(depth) for i, f in fits.items() if number < f.rounds}
        nodes = {i: np.zeros(1, np.int64) for i in live}
        for level in range(depth):
            open_ = {i: (fits[i].logistic, tree, nodes[i]) for i, tree in live.items() if len(nodes[i])}
            if not open_:
                break
            by_unit: dict[int, list[int]] = {}
            for i in open_:
                by_unit.setdefault(fits[i].unit, []).append(i)
            for i, sums in _level_sums(state, open_, by_unit, level).items():
                _, tree, at = open_[i]
                if level == 0:
                    if fits[i].unit not in cuts:
                        cuts[fits[i].unit] = _cut_of(sums)
                    tree.value[0] = sums[1, 0, 0].sum() / sums[0, 0, 0].sum()
                nodes[i] = _split(tree, at, sums, cuts[fits[i].unit])
            if level == 0 and kept:  # the state is made by now
                kept = _older_freed(kept)
        for i, tree in live.items():
            fits[i].trees.append(tree)
        state = _moved(state, depth, {i: (fits[i].unit, fits[i].step(number), tree) for i, tree in live.items() if number + 1 < fits[i].rounds})
        state.persist(StorageLevel.MEMORY_AND_DISK)
        if number % KEEP_EVERY == KEEP_EVERY - 1:
            state.checkpoint()
        kept.append(state)
    for old in kept:
        old.unpersist()
        _drop_checkpoint(old)


def _moved(state: RDD, depth: int, grown: dict[int, tuple[int, float, Tree]]) -> RDD:
    """The cells with the predictions that the new trees give them."""
    def move(block: tuple) -> tuple:
        unit, codes, y, w, f = block
        moved = {}
        for i, (of, step, tree) in grown.items():
            if of == unit:
                add = step * tree.value[tree.reach(codes, depth)]
                moved[i] = f[i] + add if i in f else add
        return unit, codes, y, w, moved
    return state.map(move)


def staged_predictions(rows: DataFrame, t: str, fit: Fit, stages: Sequence[int]) -> DataFrame:
    """(label, p0, p1, ...): what the first ``stages[k]`` rounds predict for each row with ``features`` in intervals (a margin under
    the logistic loss)."""
    ship_package(rows.sparkSession)
    trees, depth, steps = rows.sparkSession.sparkContext.broadcast(fit.trees), fit.depth, [fit.step(i) for i in range(len(fit.trees))]
    wanted = list(stages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, out = _codes(b.column(0), b.num_rows), {}
            f = np.zeros(b.num_rows)
            if b.num_rows:
                kinds, back = np.unique(codes, axis=0, return_inverse=True)
                g = np.zeros(len(kinds))
                for i, tree in enumerate(trees.value):
                    g += steps[i] * tree.value[tree.reach(kinds, depth)]
                    for k, n in enumerate(wanted):
                        if n == i + 1:
                            out[f"p{k}"] = pa.array(g[back.ravel()])
            cols = {"label": b.column(1)} | {f"p{k}": out.get(f"p{k}", pa.array(f)) for k in range(len(wanted))}
            yield pa.RecordBatch.from_pydict(cols)

    schema = ", ".join(["label double", *(f"p{k} double" for k in range(len(wanted)))])
    return rows.select(vector_to_array("features").alias("x"), c(t).cast("double").alias("y")).mapInArrow(run, schema)


def staged_errors(held: DataFrame, fit: Fit, stages: Sequence[int]) -> list[dict[str, float | None]]:
    """rmse and r2 (1 - SSE/SST) of the first ``stages[k]`` rounds of a regression on held-out cells (``fold_cells``)."""
    ship_package(held.sparkSession)
    trees, depth, steps = held.sparkSession.sparkContext.broadcast(fit.trees), fit.depth, [fit.step(i) for i in range(len(fit.trees))]
    wanted = list(stages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, errors = np.zeros(3), np.zeros(len(wanted))
        for b in batches:
            if b.num_rows:
                codes, (n, s, q, center) = _codes(b.column(0), b.num_rows), (b.column(i).to_numpy() for i in range(1, 5))
                total += n.sum(), s.sum(), q.sum()
                g = -center
                for i, tree in enumerate(trees.value):
                    g = g + steps[i] * tree.value[tree.reach(codes, depth)]
                    for k, w in enumerate(wanted):
                        if w == i + 1:  # within a cell, then the cell's mean from the prediction
                            errors[k] += (np.maximum(q - s * s / n, 0) + n * (s / n - g) ** 2).sum()
        yield pa.RecordBatch.from_pydict({x: [float(v)] for x, v in zip(names, [*total, *errors])})

    names = ["n", "s", "q", *(f"e{k}" for k in range(len(wanted)))]
    rows = held.select(vector_to_array("features").alias("x"), "n", "s", "q", "center").mapInArrow(run, ", ".join(f"{x} double" for x in names))
    n, s, q, *errors = rows.agg(*[F.sum(x) for x in names]).first()
    if not n:
        return [{"rmse": None, "r2": None} for _ in wanted]
    sst = q - s * s / n
    return [{"rmse": float(np.sqrt(e / n)), "r2": 1 - e / sst if sst > 0 else None} for e in errors]


def as_scored(staged: DataFrame, column: str, logistic: bool) -> DataFrame:
    """(label, prediction, score) of one stage, as ``models.predictions`` gives them."""
    p = F.col(column)
    if not logistic:
        return staged.select("label", p.alias("prediction"), F.lit(None).cast("double").alias("score"))
    return staged.select("label", (p > 0).cast("double").alias("prediction"), (1 / (1 + F.exp(-2 * p))).alias("score"))
