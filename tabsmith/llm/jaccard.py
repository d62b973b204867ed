"""N-gram Jaccard join of whole texts in the Jaccard metric space: pivots, regions, windows, recursion; exact.

Two texts link when the Jaccard similarity of their sets of five-word shingles is at least 0.8, a distance of at most
EPS = 0.2. Words are runs of characters other than space and \\t \\n \\v \\f \\r, A-Z lower-cased; a text of one to four words has
its whole sequence as the only element; an empty one has no set and links with nothing. Equal sets are one point ("node",
a 128-bit digest of the set).

Nearly every pair of unrelated texts has distance exactly 1, so pivots drawn from the corpus would leave almost all points in
one tie. Regions are therefore seeded by shared elements: of linked sets, each contains one of the other's first
n - ceil(0.8 n) + 1 elements in any fixed order of all elements, so the points that have an element among these form its
seed region, and points in no common seed region are too far apart. The order is (frequent elements last, hash): elements found in more
than HOT sets count as frequent, at most MAX_FREQUENT of the most frequent; the choice affects the work, never the result.

Every region has a pivot p. A point's counts of elements in BINS hash classes (its distances to that many fixed sets) give a lower
bound on any distance, since the counts of two sets differ by no more than the sets do; where the bound allows d(x, p) <= 2 EPS the
distance is computed exactly from the texts. Then, by the triangle inequality:

* points with d(x, p) <= EPS link to p and so to each other's component;
* the inner region d <= 2 EPS is joined exactly within itself, each point given by its difference from p, since
  |x ^ y| = |(x ^ p) ^ (y ^ p)|; large ones in blocks, every block on its own task;
* the outer region d > EPS (the shell EPS < d <= 2 EPS is in both: the window of the boundary) has all linked pairs with a point
  beyond 2 EPS. They are joined directly where |d(x, p) - d(y, p)| <= EPS and the bound allows it (blocks of larger regions each on
  a task); regions of more than LARGE points recurse with a new pivot from beyond 2 EPS. After MAX_LEVELS levels what is left is joined directly whatever its size.

Links become components by alternating star contraction on stored tables. Null text counts as empty. A row in is a row out;
``component_id`` is the smallest key of the component (null keys are ignored, null if it has no other), for empty texts the
row's own key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WORDS = 5
NUM, DEN = 80, 100  # similarity threshold
EPS = 0.2
SLACK = 1e-9  # for comparisons of distances in floating point; links themselves are compared in integers
HOT = 32
MAX_FREQUENT = 500_000
SMALL = 256
LARGE = 4096
BLOCK = 1024
MAX_LEVELS = 2
CHUNK = 1 << 20  # bytes of text whose sets a task holds at a time
BINS = 256
HOT_GROUP = 1000  # rows of a frequent element that meet in one window


# ---- sets ---------------------------------------------------------------------------------------------------------

def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            every = np.full(n, base, dtype=np.uint64)
            every[0] = 1
            _POWERS[i] = np.multiply.accumulate(every)
    return _POWERS[0][:n], _POWERS[1][:n]


BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
LETTERS = np.random.default_rng(20_117).integers(0, 1 << 64, 256, dtype=np.uint64)  # a random number for every byte
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets per text, 64-bit hash of every word), A-Z lower-cased.

    The hash of a word is a polynomial in BASE over its bytes' numbers; all come from one running sum over the chunk, from
    which a word's part is cut out and shifted back to power zero."""
    offsets, data = C.raw_bytes(texts)
    n = len(data)
    if n == 0:
        return np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.uint64)
    low = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    blank = BLANK[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1] | edge[1:n]
    last[:-1] &= blank[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(LETTERS[low] * up, dtype=np.uint64)])
    return np.searchsorted(start, offsets), C.mix64((run[end] - run[start]) * down[start])


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, elements): the sorted distinct 64-bit shingle hashes of every text."""
    off, h = word_keys(texts)
    count = np.diff(off)
    m = np.uint64(BASE)
    roll = h.copy()
    for k in range(1, WORDS):
        if len(h) > k:
            roll[:-k] = roll[:-k] * m + h[k:]
    many = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    out = C.mix64(roll[C.spread(off[:-1], many)])
    first = np.cumsum(many) - many
    for i in np.flatnonzero((count > 0) & (count < WORDS)):
        out[first[i]] = C.mix64(np.array([hash_short(h[off[i]:off[i + 1]])], dtype=np.uint64))[0]
    for a, n in zip(first.tolist(), many.tolist()):
        if n > 1:
            out[a:a + n].sort()
    owner = np.repeat(np.arange(len(many)), many)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(many)))]), out[keep]


def hash_short(keys: np.ndarray) -> int:
    """Hash of a whole short sequence, apart from those of full shingles."""
    acc = len(keys) * 0x2545F4914F6CDD1D
    for k in keys.tolist():
        acc = (acc * 0xD6E8FEB86659FD93 + k + 1) & 0xFFFFFFFFFFFFFFFF
    return acc


def digest(off: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over every set (as signed numbers); 0, 0 for empty sets."""
    out = []
    for salt in (0x51ED270B7F4A7C15, 0x7B1699A3D4E5F017):
        run = np.concatenate([[np.uint64(0)], np.cumsum(C.mix64(sets ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((run[off[1:]] - run[off[:-1]]).view(np.int64))
    return out[0], out[1]


def prefix_mask(off: np.ndarray, frequent: np.ndarray | None, more: float = 0) -> np.ndarray:
    """Marks the first n - ceil(0.8 n) + 1 elements (and a share ``more`` of n) of every set in the order (frequent last, hash)."""
    n = np.diff(off)
    want = n - (NUM * n + DEN - 1) // DEN + 1 + (more * n).astype(np.int64)
    want[n == 0] = 0
    total = int(off[-1])
    start = np.repeat(off[:-1], n)
    if frequent is None:
        return np.arange(total) - start < np.repeat(want, n)
    rare = ~frequent
    run = np.concatenate([[0], np.cumsum(rare)])
    n_rare = run[off[1:]] - run[off[:-1]]
    rank_rare = run[:-1] - np.repeat(run[off[:-1]], n)
    rank_hot = np.arange(total) - start - rank_rare + np.repeat(n_rare, n)
    return np.where(rare, rank_rare, rank_hot) < np.repeat(want, n)


def fits(a: Column, b: Column) -> Column:
    """Sizes that allow a similarity of 0.8."""
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def node(s1: str, s2: str) -> Column:
    return F.struct(F.col(s1).alias("a"), F.col(s2).alias("b"))


def sketch(off: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Elements of every set in BINS hash classes, cut off at 255 (which keeps differences from growing): uint8 [sets, BINS]."""
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    cell = owner * BINS + (sets >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=n * BINS), 255).astype(np.uint8).reshape(n, BINS)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)),
                                                  pa.py_buffer(np.ascontiguousarray(rows))])


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), BINS).astype(np.int16)


def least_distance(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """A lower bound on the Jaccard distance from sketches and sizes."""
    apart = np.maximum(np.abs(a - b).sum(axis=1), np.abs(na - nb))
    return 2 * apart / np.maximum(na + nb + apart, 1)


# ---- passes over the texts ----------------------------------------------------------------------------------------

def _map(src: DataFrame, fn, schema) -> DataFrame:
    """fn(batch, offsets, sets) -> record batch, over chunks of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches, "text", CHUNK):
            off, sets = shingle_sets(C.text_array(b.column("text")))
            yield fn(b, off, sets)

    return src.mapInArrow(run, schema)


def points(src: DataFrame, extra: str = "sketch") -> DataFrame:
    """(id, s1, s2, n, and ``sketch`` or ``text``) of every row."""
    def fn(b, off, sets):
        s1, s2 = digest(off, sets)
        last = packed(sketch(off, sets)) if extra == "sketch" else b.column("text")
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array(s1), pa.array(s2), pa.array(np.diff(off)), last],
                                          ["id", "s1", "s2", "n", extra])

    last = T.StructField("sketch", T.BinaryType()) if extra == "sketch" else src.schema["text"]
    return _map(src, fn, T.StructType([src.schema["id"], *[T.StructField(c, T.LongType()) for c in ("s1", "s2", "n")], last]))


def frequent_elements(src: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted elements that more than HOT rows have among their first ones, windows that each is spread over); at most
    MAX_FREQUENT, the most frequent. Counted a little beyond the first elements, as sets with frequent ones reach further."""
    def fn(b, off, sets):
        token, count = np.unique(sets[prefix_mask(off, None, 0.05)], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count.astype(np.int32))], ["token", "k"])

    hot = _map(src, fn, "token long, k int").groupBy("token").agg(F.sum("k").alias("k")).filter(F.col("k") > HOT) \
        .orderBy(F.desc("k"), "token").limit(MAX_FREQUENT).toArrow()
    token = hot.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    # counts fall short of all rows that may come: five times as many windows
    return token[order], 5 * (hot.column("k").to_numpy()[order] // HOT_GROUP) + 1


def _among(sets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is in the sorted table, position in it)."""
    if len(table) == 0:
        return np.zeros(len(sets), dtype=bool), np.zeros(len(sets), dtype=np.int64)
    at = np.minimum(np.searchsorted(table, sets), len(table) - 1)
    return table[at] == sets, at


def seed_regions(src: DataFrame) -> DataFrame:
    """(p, x): first digest words of pivot and point, for every seed region with other points than its pivot, which is the smallest.

    The rows of a frequent element are spread over windows by a hash of the point; its pivot is the smallest of theirs."""
    shared = src.sparkSession.sparkContext.broadcast(frequent_elements(src))  # MAX_FREQUENT pairs at most

    def fn(b, off, sets):
        table, windows = shared.value
        hot, at = _among(sets, table)
        mask = prefix_mask(off, hot)
        x = np.repeat(digest(off, sets)[0], np.diff(off))[mask]
        token, hot, at = sets[mask], hot[mask], at[mask]
        part = np.full(len(x), -1, dtype=np.int32)
        if hot.any():
            part[hot] = (C.mix64(x[hot].view(np.uint64)) % windows[at[hot]].astype(np.uint64)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(part), pa.array(x)], ["token", "part", "x"])

    group = Window.partitionBy("token", "part")
    rows = _map(src, fn, "token long, part int, x long") \
        .withColumn("p", F.min("x").over(group)).withColumn("q", F.max("x").over(group)) \
        .filter("p <> q or part >= 0").select("token", "part", "p", "x")
    rows = C.stored(rows, "jaccard-shared")
    frequent = rows.filter("part >= 0")
    top = frequent.groupBy("token").agg(F.min("p").alias("p"))
    members = rows.filter("part < 0").select("p", "x").unionByName(frequent.drop("p").join(top, "token").select("p", "x"))
    return members.filter("p <> x").distinct()


# ---- exact distances ----------------------------------------------------------------------------------------------

def compare(pairs: DataFrame, texts: DataFrame, differences: bool) -> DataFrame:
    """Exact comparison of node pairs (p, x): adds ``both`` (elements in common) and, if asked for, ``diff`` (x ^ p) within 2 EPS."""
    left = texts.select(F.col("node").alias("p"), F.col("text").alias("p_text"))
    right = texts.select(F.col("node").alias("x"), F.col("text").alias("x_text"))
    src = pairs.join(right, "x").join(left, "p")
    kinds = [src.schema[c] for c in pairs.columns]
    schema = T.StructType([*kinds, T.StructField("both", T.LongType()), *[T.StructField("diff", T.ArrayType(T.LongType()))] * differences])
    names = list(pairs.columns)
    limit = 2 * EPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_set = None, None
        for batch in batches:
            for b in C.chunks([batch], "x_text", CHUNK):
                off, sets = shingle_sets(C.text_array(b.column("x_text")))
                both, diffs = [], []
                for i, text in enumerate(b.column("p_text").to_pylist()):
                    if text != last_text or last_set is None:
                        last_text, last_set = text, shingle_sets(C.text_array(pa.array([text])))[1]
                    x = sets[off[i]:off[i + 1]]
                    n = len(np.intersect1d(x, last_set, assume_unique=True))
                    both.append(n)
                    if differences:
                        near = 1 - n / (len(x) + len(last_set) - n) <= limit
                        diffs.append(np.setxor1d(x, last_set, assume_unique=True).view(np.int64) if near else None)
                cols = [b.column(c) for c in names] + [pa.array(both, pa.int64())]
                if differences:
                    cols.append(pa.array(diffs, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, [*names, "both", *["diff"] * differences])

    return src.select(*names, "p_text", "x_text").mapInArrow(run, schema)


def inner_links(batch: pa.Table) -> pa.Table:
    """Links within one block pair of an inner region, from the differences to the pivot. Rows: x, n, diff, left, right.
    Linked points of the block are returned as a star around their smallest."""
    rows = batch.select(["x", "n", "diff", "left", "right"]).combine_chunks()
    names = rows.column("x").to_pylist()
    n = rows.column("n").to_numpy()
    lists = rows.column("diff").combine_chunks() if rows.num_rows else None
    out_a, out_b = [], []
    if rows.num_rows > 1:
        off = np.asarray(lists.offsets).astype(np.int64)
        flat = lists.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]
        size = np.diff(off)
        owner = np.repeat(np.arange(len(size)), size)
        token, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[inverse] > 1
        owner, column = owner[keep], np.unique(inverse[keep], return_inverse=True)[1]
        left, right = (np.flatnonzero(rows.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            i, j = np.searchsorted(column, [a, a + 2048])
            part = np.zeros((len(size), 2048), dtype=np.float32)
            part[owner[i:j], column[i:j] - a] = 1
            common += part[left] @ part[right].T
        apart = size[left][:, None] + size[right][None, :] - 2 * common.astype(np.int64)
        total = n[left][:, None] + n[right][None, :]
        link = DEN * (total - apart) >= NUM * (total + apart)
        label = np.arange(len(size))
        while True:  # smallest index over links, until nothing changes
            new = label.copy()
            new[left] = np.minimum(new[left], np.where(link, label[right][None, :], len(size)).min(axis=1, initial=len(size)))
            np.minimum.at(new, right, np.where(link, new[left][:, None], len(size)).min(axis=0, initial=len(size)))
            if np.array_equal(new, label):
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(size)))
        out_a, out_b = [names[label[i]] for i in moved], [names[i] for i in moved]
    kind = rows.schema.field("x").type
    return pa.table({"u": pa.array(out_a, kind), "v": pa.array(out_b, kind)})


def join_inner(near: DataFrame) -> DataFrame:
    """Links (u, v) inside all inner regions: rows p, x, n, d, diff. A pair needs a point outside the ball (d > EPS)."""
    sizes = near.groupBy("p").agg(F.count("*").alias("all"), F.sum((F.col("d") > EPS).cast("int")).alias("out"),
                                  F.min(F.when(F.col("d") > EPS, F.col("d"))).alias("from")).filter("out > 0")
    rows = near.join(sizes, "p").filter(F.col("d") >= F.col("from") - EPS - SLACK) \
        .withColumn("rows", F.ceil(F.col("out") / BLOCK)).withColumn("cols", F.ceil(F.col("all") / BLOCK)) \
        .withColumn("h", F.xxhash64("x"))
    as_left = rows.filter(F.col("d") > EPS).withColumn("i", F.pmod("h", "rows")) \
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1))).withColumn("is_left", F.lit(True))
    as_right = rows.withColumn("j", F.pmod("h", "cols")) \
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("is_left", F.lit(False))
    cols = ["p", "i", "j", "x", "n", "diff", "is_left"]
    both = as_left.select(*cols).unionByName(as_right.select(*cols)) \
        .withColumn("left", F.col("is_left")).withColumn("right", ~F.col("is_left"))
    kind = near.schema["x"].dataType
    return both.select("p", "i", "j", "x", "n", "diff", "left", "right").groupBy("p", "i", "j") \
        .applyInArrow(inner_links, T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))


def measured(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Region members (p, x, np, n, sketch of x, lo): nodes of the (p, x) pairs with the lower bound of their distance."""
    named = nodes.select("node", "n", "sketch")
    src = pairs.join(named.select(F.col("node").alias("x"), "n", "sketch"), "x") \
        .join(named.select(F.col("node").alias("p"), F.col("n").alias("np"), F.col("sketch").alias("p_sketch")), "p") \
        .select("p", "x", "np", "n", "sketch", "p_sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = least_distance(unpacked(b.column("sketch")), unpacked(b.column("p_sketch")),
                                b.column("n").to_numpy(), b.column("np").to_numpy()) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(lo)], ["p", "x", "np", "n", "sketch", "lo"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields[:5], T.StructField("lo", T.DoubleType())]))


def small_pairs(members: DataFrame) -> DataFrame:
    """(p, u, v, nu, nv) for points of one small region whose sizes and sketches allow a link."""
    few = members.filter((F.col("k") > 1) & (F.col("k") <= SMALL))
    a = few.select("p", F.col("x").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    b = few.select("p", F.col("x").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    src = a.join(b, "p").filter((F.col("u") < F.col("v")) & fits(F.col("nu"), F.col("nv"))).select("p", "u", "v", "nu", "nv", "su", "sv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lo = least_distance(unpacked(b.column("su")), unpacked(b.column("sv")), b.column("nu").to_numpy(), b.column("nv").to_numpy())
                yield b.select(["p", "u", "v", "nu", "nv"]).filter(pa.array(lo <= EPS + SLACK))

    return src.mapInArrow(run, T.StructType(src.schema.fields[:5]))


def large_pairs(sides: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of larger regions that sizes, sketches and the windows on the distances to the pivot (rows p, x, lo, hi) leave open,
    compared block by block within tasks."""
    blocks = F.ceil(F.col("k") / BLOCK)
    dealt = members.select("p", "x", "n", "k", "sketch").join(sides, ["p", "x"]).withColumn("own", F.pmod(F.xxhash64("x"), blocks)) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))) \
        .select("p", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "x", "n", "sketch", "lo", "hi")
    p, x = dealt.schema["p"].dataType, dealt.schema["x"].dataType
    schema = T.StructType([T.StructField("p", p), T.StructField("u", x), T.StructField("v", x),
                           T.StructField("nu", T.LongType()), T.StructField("nv", T.LongType())])
    return dealt.groupBy("p", "i", "j").applyInArrow(block_pairs, schema)


def block_pairs(rows: pa.Table) -> pa.Table:
    """Open pairs of two blocks of a region (or within one)."""
    rows = rows.combine_chunks()
    own, n, lo, hi = (rows.column(c).to_numpy() for c in ("own", "n", "lo", "hi"))
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    table = unpacked(rows.column("sketch"))
    left = np.flatnonzero(own == i)
    right = np.flatnonzero(own == j)
    us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for a in left:
        near = right[(DEN * np.minimum(n[a], n[right]) >= NUM * np.maximum(n[a], n[right])) & ((right > a) | (i != j))
                     & (np.maximum(hi[a], hi[right]) > 2 * EPS) & (lo[a] - hi[right] <= EPS + SLACK) & (lo[right] - hi[a] <= EPS + SLACK)]
        near = near[least_distance(table[a][None, :], table[near], n[a], n[near]) <= EPS + SLACK]
        us.append(np.full(len(near), a))
        vs.append(near)
    u, v = np.concatenate(us), np.concatenate(vs)
    return pa.table({"p": rows.column("p").take(pa.array(u)), "u": rows.column("x").take(pa.array(u)), "v": rows.column("x").take(pa.array(v)),
                     "nu": n[u], "nv": n[v]})


def texts_of(src: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes (rows ``node``): the text of the row that gave the node its key."""
    keys = nodes.join(wanted.distinct(), "node").select(F.col("id").alias("w"), F.col("node.a").alias("w1"), F.col("node.b").alias("w2"))
    full = points(src, "text")
    picked = full.join(keys, full.id.eqNullSafe(F.col("w")) & (full.s1 == F.col("w1")) & (full.s2 == F.col("w2")))
    return C.stored(_once(picked.select(node("s1", "s2").alias("node"), "text")), "jaccard-texts")


def links(src: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(u, v): enough links between nodes to connect every component."""
    routed = nodes.select(F.col("s1").alias("r"), "node")
    pairs = seeds.join(routed.select(F.col("r").alias("x"), F.col("node").alias("xn")), "x") \
        .join(routed.select(F.col("r").alias("p"), F.col("node").alias("pn")), "p") \
        .select(F.col("pn").alias("p"), F.col("xn").alias("x"))
    linked = DEN * F.col("both") >= NUM * (F.col("np") + F.col("n") - F.col("both"))
    found = []
    for level in range(MAX_LEVELS):
        last = level + 1 == MAX_LEVELS
        members = C.stored(measured(pairs, nodes), f"jaccard-region-{level}")
        members = members.join(members.groupBy("p").agg(F.count("*").alias("k")), "p")
        middle = members.filter((F.col("k") > SMALL) & (F.lit(last) | (F.col("k") <= LARGE)))
        close = members.filter(F.col("lo") <= 2 * EPS + SLACK).select("p", "x", "np", "n")
        direct = C.stored(small_pairs(members), f"jaccard-pairs-{level}")
        texts = texts_of(src, nodes, close.select(F.explode(F.array("p", "x")).alias("node")).unionByName(
            direct.select(F.explode(F.array("u", "v")).alias("node"))).unionByName(middle.select(F.col("x").alias("node"))))
        d = 1 - F.col("both") / (F.col("np") + F.col("n") - F.col("both"))
        star = C.stored(compare(close, texts, True).withColumn("d", d).withColumn("linked", linked), f"jaccard-star-{level}")
        found.append(star.filter("linked").select(F.col("p").alias("u"), F.col("x").alias("v")))
        found.append(C.stored(join_inner(star.filter("diff is not null").select("p", "x", "n", "d", "diff")), f"jaccard-inner-{level}"))
        found.append(join_outer(direct, members, middle, star, texts, level))
        if last:
            break
        # large regions go on with a new pivot from beyond 2 EPS; the shell EPS < d <= 2 EPS goes along
        known = star.select("p", "x", "linked", F.col("diff").isNotNull().alias("near"))
        outer = members.join(known, ["p", "x"], "left").filter(~F.coalesce("linked", F.lit(False))) \
            .select("p", "x", "n", (~F.coalesce("near", F.lit(False))).alias("beyond"))
        outer = outer.join(members.filter(F.col("k") > LARGE).select("p").distinct(), "p", "left_semi")
        start = outer.groupBy("p").agg(
            F.min(F.when(F.col("beyond"), F.struct("n", "x")))["x"].alias("next")).filter("next is not null")
        pairs = C.stored(outer.join(start, "p").filter("x <> next").select(F.col("next").alias("p"), "x").distinct(), f"jaccard-next-{level}")
        if pairs.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return C.stored(out.distinct(), "jaccard-links")


def join_outer(direct: DataFrame, members: DataFrame, middle: DataFrame, star: DataFrame, texts: DataFrame, level: int) -> DataFrame:
    """Links among the pairs that no region rules out: by the window on the distances to its pivot, or because its inner region joins
    them already. A distance that wasn't computed lies between its lower bound and 1."""
    sides = members.select("p", "x", "lo").join(star.select("p", "x", "d"), ["p", "x"], "left").select(
        "p", "x", F.coalesce("d", "lo").alias("lo"), F.coalesce("d", F.lit(1.0)).alias("hi"))

    def side(name: str) -> DataFrame:
        return sides.withColumnsRenamed({"x": name, "lo": f"lo_{name}", "hi": f"hi_{name}"})

    near = (F.col("hi_u") <= 2 * EPS) & (F.col("hi_v") <= 2 * EPS)
    window = (F.col("lo_u") - F.col("hi_v") <= EPS + SLACK) & (F.col("lo_v") - F.col("hi_u") <= EPS + SLACK)
    small = direct.join(side("u"), ["p", "u"]).join(side("v"), ["p", "v"]).groupBy("u", "v", "nu", "nv") \
        .agg(F.min(window & ~near).alias("open")).filter("open").drop("open")
    pairs = small.unionByName(large_pairs(sides, middle).drop("p")).select(
        F.col("u").alias("p"), F.col("v").alias("x"), F.col("nu").alias("np"), F.col("nv").alias("n")).distinct()
    linked = DEN * F.col("both") >= NUM * (F.col("np") + F.col("n") - F.col("both"))
    return C.stored(compare(pairs, texts, False).filter(linked).select(F.col("p").alias("u"), F.col("x").alias("v")), f"jaccard-far-{level}")


# ---- components ---------------------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every node in a link except the roots themselves: alternating large and small stars."""
    def hub(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = None
    while True:
        twoway = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = twoway.join(hub(twoway), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.join(hub(large), "u")
        edges = C.stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "jaccard-stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen = state


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_shingles, component_id, and ``node`` / ``root`` (digests of its set and of its component's root; null: empty)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    slim = C.stored(points(src), "jaccard-points").withColumn("node", F.when(F.col("n") > 0, node("s1", "s2")))
    nodes = C.stored(slim.filter("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.min("sketch").alias("sketch"))
                     .withColumn("node", node("s1", "s2")), "jaccard-nodes")
    roots = components(links(src, nodes, C.stored(seed_regions(src), "jaccard-seeds"))).withColumnRenamed("v", "node")
    rooted = C.stored(nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), "jaccard-roots")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select("node", "root", "component_id")
    return slim.join(named, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "node", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, all columns kept: the one with its smallest key (null keys last, then by digest); of rows that
    repeat a key and a set one stays. Empty texts are components of their own, one row for each key."""
    linked = join(docs, id_col, text_col)
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.coalesce("node", F.struct(
        F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).alias("node"))).alias("k")
    keep = C.stored(linked.withColumn("own", F.when(F.col("n_shingles") == 0, F.col(id_col)))
                    .groupBy("root", "own").agg(first)
                    .select(F.col("k.id").alias("keep_id"), F.col("k.node.a").alias("keep_1"), F.col("k.node.b").alias("keep_2")), "jaccard-keep")
    own_keys = [C.free_name(n, docs.columns) for n in ("__set_1", "__set_2")]
    extra = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in own_keys]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in C.chunks(batches, text_col, CHUNK):
            s1, s2 = digest(*shingle_sets(C.text_array(b.column(text_col))))
            new = []
            for key in zip(b.column(id_col).to_pylist(), s1.tolist(), s2.tolist()):  # a row that repeats in a task goes no further
                new.append(key not in seen)
                seen.add(key)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s1), pa.array(s2)], [*b.schema.names, *own_keys]).filter(pa.array(new))

    def chosen(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
        kept = kept.select(F.col("keep_id").alias(id_col), F.col("keep_1").alias(own_keys[0]), F.col("keep_2").alias(own_keys[1]))
        # dealt by the same columns as the join, so this moves no row again
        return rows.mapInArrow(run, extra).join(kept.select(*keys), keys, "left_semi").dropDuplicates(keys)

    named = chosen(docs.filter(F.col(id_col).isNotNull()), keep.filter("keep_id is not null"), [id_col, *own_keys])
    unnamed = chosen(docs.filter(F.col(id_col).isNull()), keep.filter("keep_id is null"), own_keys)
    return named.unionByName(unnamed).select(*[F.col(f"`{c}`") for c in docs.columns])


def _once(picked: DataFrame) -> DataFrame:
    """Repeated rows of one node within a task come through once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            names = [(x["a"], x["b"]) for x in b.column("node").to_pylist()]
            keep = []
            for x in names:
                keep.append(x not in seen)
                seen.add(x)
            yield b.filter(pa.array(keep, pa.bool_()))

    return picked.mapInArrow(run, picked.schema)
