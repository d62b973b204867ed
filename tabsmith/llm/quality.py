"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The right-hand sum equals the sum over all pairs of features <v_i, v_j> x_i x_j, so scoring takes time linear
in the features of a text. Features: the words of the whole text hashed to BUCKETS (log counts, unit length), structure
shares (letters, capitals, digits, marks, lines, repetition) in STATS, and the metadata column ``n_chars``.
Labels, language, source and the key are never features.

The machine is fitted on at most MAX_FIT labelled rows: those of the learning folds with the smallest hash of the key, a
documented bound. Everything else reads all rows. Null text counts as empty, null n_chars as the text's length; empty texts get
the score of their (all-zero word) features; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BUCKETS = 1 << 14
MAX_FIT = 4000
RANK = 8
STATS = 20
FEATURES = BUCKETS + STATS


def _classes() -> np.ndarray:
    """0/1 rows over byte values: capital, small, digit, each kind of mark, line end, blank, non-ASCII."""
    groups = [rb"[A-Z]", rb"[a-z]", rb"[0-9]", rb"[.,;:?]", rb"[!]", rb"[|]", rb"[$%&*#@^~+=<>\\/{}\[\]_]", rb"[\"'()-]", rb"\n",
              rb"[ \t]", rb"[\x80-\xff]"]
    every = bytes(range(256))
    out = np.zeros((len(groups), 256))
    for i, g in enumerate(groups):
        out[i, [m.start() for m in re.finditer(g, every)]] = 1
    return out


CLASSES = _classes()


def features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, feature ids, values, dense statistics): words as a sparse row per text, statistics as a matrix."""
    n = len(texts)
    offsets, data = C.raw_bytes(texts)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    hist = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256) if n else np.zeros((0, 256))
    shares = hist @ CLASSES.T / np.maximum(size, 1)[:, None]
    word_off, flat = C.words(texts)
    count = np.diff(word_off)
    owner = np.repeat(np.arange(n), count)
    key = C.word_hashes(flat)
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
    per = np.maximum(count, 1)
    tail = _last_byte_is_mark(flat)
    bucket = (C.mix64(key) % np.uint64(BUCKETS)).astype(np.int64)
    cell, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
    at = cell // BUCKETS
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(at, value ** 2, minlength=n))
    distinct = np.bincount(at, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, at, times)
    mean_len = np.bincount(owner, length, minlength=n) / per
    stats = np.column_stack([
        shares, np.log1p(size) / 10, np.log1p(count) / 10, np.log1p(np.maximum(n_chars, 0)) / 10, mean_len / 10,
        np.bincount(owner, length ** 2, minlength=n) / per / 100, np.bincount(owner, tail, minlength=n) / per,
        distinct / per, most / per, np.ones(n)])
    return np.searchsorted(at, np.arange(n + 1)), cell % BUCKETS, value / np.maximum(norm, 1e-12)[at], stats


def _last_byte_is_mark(flat: pa.Array) -> np.ndarray:
    """1 for words that end in ASCII punctuation other than . , ; : ? !"""
    if len(flat) == 0:
        return np.zeros(0)
    off, data = C.raw_bytes(flat)
    last = data[off[1:] - 1]
    return np.isin(last, np.frombuffer(b"$%&*#@^~+=<>\\/{}[]_|", dtype=np.uint8)).astype(np.float64)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def raw(self, off: np.ndarray, ids: np.ndarray, values: np.ndarray, stats: np.ndarray) -> np.ndarray:
        dense = np.clip((stats - self.mean) / self.scale, -8, 8)
        v = self.factors[ids] * values[:, None]
        first = _sums(self.linear[ids] * values, off) + dense @ self.linear[BUCKETS:]
        total = _sums(v, off) + dense @ self.factors[BUCKETS:]
        squares = _sums(v ** 2, off) + dense ** 2 @ self.factors[BUCKETS:] ** 2
        return self.bias + first + 0.5 * (total ** 2 - squares).sum(axis=1)

    def score(self, texts: pa.Array, n_chars: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(texts, n_chars)), -40, 40)))


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the rows off[i]:off[i+1]."""
    run = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    return run[off[1:]] - run[off[:-1]]


def fit_machine(rows: list, epochs: int = 8, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the logistic loss over (ids, values, stats, label) rows."""
    rng = np.random.default_rng(seed)
    stats = np.array([r["stats"] for r in rows]).reshape(len(rows), STATS)
    label = np.array([r["label"] for r in rows], dtype=np.float64)
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    mean[-1], scale[-1] = 0, 1  # the constant column lets single features act through the factors
    dense = np.clip((stats - mean) / scale, -8, 8)
    ids = [np.array(r["ids"], dtype=np.int64) for r in rows]
    values = [np.array(r["values"]) for r in rows]
    prior = np.clip(label.mean(), 0.01, 0.99)
    theta = np.zeros((FEATURES, 1 + RANK))
    theta[:, 1:] = rng.normal(0, 0.02, (FEATURES, RANK))
    bias, step = np.log(prior / (1 - prior)), 0
    m, s, mb, sb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    structure = np.arange(BUCKETS, FEATURES)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            pick = order[a:a + batch]
            off = np.concatenate([[0], np.cumsum([len(ids[i]) for i in pick])])
            fid = np.concatenate([ids[i] for i in pick]).astype(np.int64)
            val = np.concatenate([values[i] for i in pick])
            x = dense[pick]
            v = theta[fid, 1:]
            vx = v * val[:, None]
            total = _sums(vx, off) + x @ theta[BUCKETS:, 1:]
            squares = _sums(vx ** 2, off) + x ** 2 @ theta[BUCKETS:, 1:] ** 2
            z = bias + _sums(theta[fid, 0] * val, off) + x @ theta[BUCKETS:, 0] + 0.5 * (total ** 2 - squares).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[pick]) / len(pick)
            e = np.repeat(err, np.diff(off))
            who = np.repeat(np.arange(len(pick)), np.diff(off))
            g_word = np.column_stack([e * val, (e * val)[:, None] * (total[who] - vx)])
            g_stat = np.column_stack([err @ x, x.T @ (err[:, None] * total) - (err @ x ** 2)[:, None] * theta[BUCKETS:, 1:]])
            touched, inverse = np.unique(fid, return_inverse=True)
            g = np.zeros((len(touched), 1 + RANK))
            np.add.at(g, inverse, g_word)
            at = np.concatenate([touched, structure])
            g = np.concatenate([g, g_stat]) + decay * theta[at]
            step += 1
            m[at] = 0.9 * m[at] + 0.1 * g
            s[at] = 0.99 * s[at] + 0.01 * g ** 2
            theta[at] -= rate * (m[at] / (1 - 0.9 ** min(step, 200))) / (np.sqrt(s[at] / (1 - 0.99 ** min(step, 2000))) + 1e-6)
            gb = err.sum()
            mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb ** 2
            bias -= rate * mb / (np.sqrt(sb) + 1e-6)
    return Machine(float(bias), theta[:, 0].copy(), theta[:, 1:].copy(), mean, scale)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       _length(docs, text_col).alias("n_chars"))


def _length(docs: DataFrame, text_col: str) -> Column:
    """The metadata column n_chars where it is there and a number, else the text's length."""
    given = [F.col("n_chars").cast("string").try_cast("long")] if "n_chars" in docs.columns else []
    return F.coalesce(*given, F.length(text_col), F.lit(0)).cast("long")


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo 3; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_FIT) -> Machine:
    """Learn from rows of the learning folds (fold != 1) with a label; at most ``max_rows`` of them, by smallest key hash.
    Several labels of one key count as their mean, rounded. Without any labelled row every score is 0.5."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != 1)) \
        .groupBy(F.col(id_col).alias("id")).agg(F.round(F.avg(label_col)).cast("int").alias("label")) \
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    sample = _source(docs, id_col, "text").join(F.broadcast(known), "id")  # max_rows keys at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches, "text"):
            off, ids, values, stats = features(C.text_array(b.column("text")), b.column("n_chars").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([
                b.column("id").cast(pa.string()), pa.ListArray.from_arrays(off.astype(np.int32), ids.astype(np.int32)),
                pa.ListArray.from_arrays(off.astype(np.int32), values.astype(np.float32)),
                pa.array(list(stats), pa.list_(pa.float64())), b.column("label")], ["id", "ids", "values", "stats", "label"])

    shape = "id string, ids array<int>, values array<float>, stats array<double>, label int"
    rows = sample.select("id", "text", "n_chars", "label").mapInArrow(run, shape).orderBy(F.xxhash64("id"), F.xxhash64("stats")) \
        .limit(max_rows).toArrow().to_pylist()
    if not rows:
        return Machine(0.0, np.zeros(FEATURES), np.zeros((FEATURES, RANK)), np.zeros(STATS), np.ones(STATS))
    return fit_machine(rows)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double) of every whole text."""
    src = _source(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # FEATURES x (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches, "text"):
            out = shared.value.score(C.text_array(b.column("text")), b.column("n_chars").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out)], ["id", "score"])

    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("score", T.DoubleType())])).withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, machine: Machine, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    own = C.free_name("__n_chars", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches, text_col):
            length = b.column(own).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(shared.value.score(C.text_array(b.column(text_col)), length) >= least))

    rows = docs.withColumn(own, _length(docs, text_col))
    return rows.mapInArrow(run, rows.schema).drop(own)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id_col, held_out (fold 1), score, predicted (score >= 0.5)."""
    return score(docs, fit(docs, labels, id_col), id_col).select(
        id_col, (fold(id_col) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
