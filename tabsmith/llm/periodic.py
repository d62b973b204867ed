"""Periodic runs of words by block convolution at dyadic scales.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
max(MIN_WORDS, 3 q) words that no neighbouring word extends keeping period q.

Words become integers. At scale B (8, 16, 32, ...) every text is cut into blocks of B words. A run whose period lies in
[B, 2B) (at the first scale: in [1, 16)) holds a whole block whose copy one period later lies in the run too, since its first
length - q words are at least 2B - 1. For each block, the sum of squared differences to every place of the window that follows,
``sum(block^2) + sum(window^2) - 2 * correlation``, is computed by number-theoretic transforms modulo a prime, in exact
integers. It is zero wherever the block occurs. Each such distance is a seed: the stretch around the block in which words that
far apart are equal is measured (binary search over prefix sums of a polynomial hash) and the runs so found are compared
word by word. A sum that is zero modulo the prime alone, or a hash that agrees by chance, is found out there, and such a
stretch is measured again word by word, so results are exact.

Blocks that cannot occur in their window are left out before the transform: a word in them doesn't recur within it. So
are blocks whose whole window lies in a run already found, since a block of at least one period occurs in its run at multiples
of the period only. Work grows with n log^2 n for any text.

Defined cases: null and empty texts have no words and no runs; a null key plants nothing; texts may be of any length and
are never cut; repeated rows repeat; an empty table gives no rows; further columns of the table are left alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MIN_WORDS = 24
FIRST = 8                 # words of a block at the first scale
PRIME = 15 * 2**27 + 1    # products of two residues fit 64 bits; transforms of up to 2^27 points
ROOT = 31                 # generates the residues' multiplicative group
SLICE = 1 << 20           # numbers in a slice of blocks that are transformed together


# ---- exact convolution ----

@lru_cache(maxsize=64)
def twiddles(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 * half."""
    w = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        w = pow(w, PRIME - 2, PRIME)
    out = np.ones(half, dtype=np.uint64)
    done = 1
    while done < half:  # doubling: w^(done + i) = w^done * w^i
        out[done:2 * done] = out[:done] * np.uint64(pow(w, done, PRIME)) % np.uint64(PRIME)
        done *= 2
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """NTT of every row (length a power of two); results are in bit-reversed order."""
    m, n = rows.shape
    a, p, half = rows, np.uint64(PRIME), n // 2
    while half:
        a = a.reshape(m, -1, 2, half)
        u, v = a[:, :, 0], a[:, :, 1]
        a = np.stack([(u + v) % p, (u + (p - v)) * twiddles(half, False) % p], axis=2)
        half //= 2
    return a.reshape(m, n)


def back(rows: np.ndarray) -> np.ndarray:
    """Inverse of transform()."""
    m, n = rows.shape
    a, p, half = rows, np.uint64(PRIME), 1
    while half < n:
        a = a.reshape(m, -1, 2, half)
        u, v = a[:, :, 0], a[:, :, 1] * twiddles(half, True) % p
        a = np.stack([(u + v) % p, (u + (p - v)) % p], axis=2)
        half *= 2
    return a.reshape(m, n) * np.uint64(pow(n, PRIME - 2, PRIME)) % p


def squared_differences(x: np.ndarray, squares: np.ndarray, starts: np.ndarray, size: int, low: int, high: int) -> np.ndarray:
    """[block, d - low]: sum of (x[s + i] - x[s + d + i])^2 over i < size, modulo PRIME, for low <= d <= high.

    ``x`` holds residues (uint64) with enough zeros at its end, ``squares`` the running sum of x^2 modulo PRIME before each place.
    """
    p, wide = np.uint64(PRIME), size + high - low
    n = 1 << (wide - 1).bit_length()
    window = np.zeros((len(starts), n), dtype=np.uint64)
    window[:, :wide] = x[starts[:, None] + (low + np.arange(wide))]
    block = np.zeros((len(starts), n), dtype=np.uint64)
    block[:, -np.arange(size)] = x[starts[:, None] + np.arange(size)]  # reversed, so that the product correlates
    cross = back(transform(window) * transform(block) % p)[:, :high - low + 1]
    at = starts[:, None] + (low + np.arange(high - low + 1))
    own = (squares[starts + size] - squares[starts]) % p
    return (own[:, None] + (squares[at + size] - squares[at]) % p + (p - cross) * np.uint64(2)) % p


# ---- stretches around seeds ----

class Stretch:
    """Longest common extensions between places of one sequence."""

    def __init__(self, x: np.ndarray):
        self.x, self.p = x, np.uint64(PRIME)
        n, base = len(x) + 1, 0x3C6EF372 % PRIME
        self.power = np.ones(n, dtype=np.uint64)
        done = 1
        while done < n:
            part = min(done, n - done)
            self.power[done:done + part] = self.power[:part] * np.uint64(pow(base, done, PRIME)) % self.p
            done *= 2
        mixed = C.mix64(x.astype(np.uint64)) % self.p
        self.sums = np.concatenate([[0], np.cumsum(mixed * self.power[:-1] % self.p)]).astype(np.uint64)  # below 2^31 each

    def equal(self, i: np.ndarray, d: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Does x[i : i + size] agree with the words d later (by hash)?"""
        one = (self.sums[i + size] - self.sums[i]) % self.p
        two = (self.sums[i + d + size] - self.sums[i + d]) % self.p
        return one * self.power[d] % self.p == two

    def right(self, i: np.ndarray, d: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i on agree with those d later, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.equal(i, d, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def left(self, i: np.ndarray, d: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before i agree with those d later, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.equal(i - mid, d, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def exact(self, start: int, end: int, d: int, seed: int, size: int, first: int, last: int) -> list[tuple[int, int]]:
        """The stretch [start, end) of period d found around a seed, checked word by word; measured anew if a hash or a residue misled."""
        x = self.x
        same = bool((x[start:end - d] == x[start + d:end]).all())
        if same and (start == first or x[start - 1] != x[start - 1 + d]) and (end == last or x[end] != x[end - d]):
            return [(start, end)]
        differ = np.flatnonzero(x[first:last - d] != x[first + d:last]) + first
        if np.searchsorted(differ, seed) != np.searchsorted(differ, seed + size):  # the block doesn't occur there at all
            return []
        i = int(np.searchsorted(differ, seed))
        return [(int(differ[i - 1]) + 1 if i else first, int(differ[i]) + d if i < len(differ) else last)]


def next_distance(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words from each place to the next occurrence of its word in the same text (a huge number if there is none)."""
    order = np.lexsort((x, doc))  # stable: places of a word stay in order
    out = np.full(len(x), np.iinfo(np.int64).max)
    a, b = order[:-1], order[1:]
    same = (x[a] == x[b]) & (doc[a] == doc[b])
    out[a[same]] = (b - a)[same]
    return out


def find_runs(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of texts ``codes[offsets[i]:offsets[i + 1]]``, starts counted in the text,
    ordered by text, start, period. Codes are integers from 1."""
    codes, sizes = codes.astype(np.int64), np.diff(offsets)
    found: dict[tuple[int, int], int] = {}  # (start, end) over all texts -> smallest period
    longest = int(sizes.max()) if len(sizes) else 0
    if longest >= MIN_WORDS:
        doc = np.repeat(np.arange(len(sizes)), sizes)
        gap = next_distance(codes, doc)
        x = np.concatenate([codes, np.zeros(4 * max(longest, 2 * FIRST), dtype=np.int64)]).astype(np.uint64) % np.uint64(PRIME)
        squares = np.concatenate([[0], np.cumsum(x * x % np.uint64(PRIME))]).astype(np.uint64)
        stretch = None
        size = FIRST
        while 3 * (size if size > FIRST else 1) <= longest:
            low, high = (size if size > FIRST else 1), 2 * size - 1
            count = np.where(sizes >= max(MIN_WORDS, 3 * low), sizes // size, 0)
            starts = np.repeat(offsets[:-1], count) + size * C.spread(np.zeros(len(sizes), dtype=np.int64), count)
            starts = starts[starts + size + low <= offsets[1:][doc[starts]]]
            if len(starts):  # every word of the block has to recur within the window
                late = np.concatenate([[0], np.cumsum(gap > high)])
                starts = starts[late[starts + size] == late[starts]]
            if len(starts) and found:  # nothing new where the whole window lies in a run
                starts = starts[~covered(np.array(sorted(found), dtype=np.int64), starts,
                                         np.minimum(starts + size + high, offsets[1:][doc[starts]]))]
            step = max(1, SLICE // (4 * size))
            seeds = []
            for k in range(0, len(starts), step):
                part = starts[k:k + step]
                i, t = np.nonzero(squared_differences(x, squares, part, size, low, high) == 0)
                i, d = part[i], t + low
                inside = i + d + size <= offsets[1:][doc[i]]
                seeds.append(np.stack([i[inside], d[inside]]))
            i, d = np.concatenate(seeds, axis=1) if seeds else np.zeros((2, 0), dtype=np.int64)
            if len(i):
                stretch = stretch or Stretch(codes)
                first, last = offsets[:-1][doc[i]], offsets[1:][doc[i]]
                start = i - stretch.left(i, d, i - first)
                end = i + d + size + stretch.right(i + size, d, last - (i + size) - d)
                long = end - start >= np.maximum(MIN_WORDS, 3 * d)
                rows = pd.DataFrame({"start": start, "end": end, "d": d, "seed": i, "first": first, "last": last})[long]
                rows = rows.drop_duplicates(["start", "end", "d"]).sort_values(["d", "start"], kind="stable")
                for r in rows.itertuples(index=False):
                    if (r.start, r.end) in found and r.d % found[r.start, r.end] == 0:
                        continue
                    for a, b in stretch.exact(r.start, r.end, r.d, r.seed, size, r.first, r.last):
                        if b - a >= max(MIN_WORDS, 3 * r.d):
                            found.setdefault((a, b), r.d)
            size *= 2
    if not found:
        return np.zeros((0, 4), dtype=np.int64)
    rows = np.array([(a, b, q) for (a, b), q in found.items()], dtype=np.int64)
    text = np.searchsorted(offsets, rows[:, 0], "right") - 1
    out = np.stack([text, rows[:, 0] - offsets[text], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def covered(known: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Is [low, high) inside one of the intervals ``known`` (rows start, end, ordered by start)?"""
    reach = np.maximum.accumulate(known[:, 1])  # the farthest end among intervals that start no later
    at = np.searchsorted(known[:, 0], low, "right") - 1
    return (at >= 0) & (reach[np.maximum(at, 0)] >= high)


# ---- texts ----

def planted(ids: list, offsets: np.ndarray) -> np.ndarray | None:
    """Word indexes after the planted repeats of the check (``plant``), None if no text changes."""
    index = None
    for j, key in enumerate(ids):
        n = int(offsets[j + 1] - offsets[j])
        if key is None or n == 0:
            continue
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            index = np.arange(offsets[-1]) if index is None else index
            index[offsets[j] + a:offsets[j + 1]] = offsets[j] + a + np.arange(n - a) % p
    return index


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def runs(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, runs (array of start, length, period, ordered by start, then period) and ``collapsed``, the text without
    the words that a run repeats (all of a run's words after its first q; kept words joined by one space).

    ``plant`` repeats words in a tenth of the texts before looking for runs, as the check of this operator has it.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([src.schema["id"], T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    arrow_run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches, "text"):
            offsets, flat = C.words(C.text_array(b.column("text")))
            if plant:
                index = planted(b.column("id").to_pylist(), offsets)
                flat = flat if index is None else flat.take(pa.array(index))
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
            rows = find_runs(codes, offsets)
            if len(rows):
                begin = offsets[rows[:, 0]] + rows[:, 1]
                edge = np.zeros(len(codes) + 1, dtype=np.int64)
                np.add.at(edge, begin + rows[:, 3], 1)
                np.add.at(edge, begin + rows[:, 2], -1)
                keep = np.cumsum(edge[:-1]) == 0
                flat = flat.filter(pa.array(keep))
                kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
            else:
                kept = offsets
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), flat), pa.scalar(" ", flat.type))
            at = np.searchsorted(rows[:, 0], np.arange(b.num_rows + 1)).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(at), found).cast(arrow_run)
            yield pa.RecordBatch.from_arrays([b.column("id"), lists, text.cast(pa.string())], ["id", "runs", "collapsed"])

    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` with planted repeats: id_col, n_runs, the run of greatest exact length / period (start, length, period,
    exponent_milli; ties to the smallest start, then period; null without runs), runs_sha256, collapsed_sha256."""
    found = runs(docs, plant=True, id_col=id_col, text_col=text_col)

    def better(a, r):  # a: the best run so far; cross products compare the quotients exactly
        return F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)

    best = F.aggregate("runs", F.lit(None).cast(RUN), better)
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
