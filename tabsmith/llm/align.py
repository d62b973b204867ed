"""Alignment of two tokenizers over a corpus, with counts of aligned id pairs by minimal perfect hashing.

Every text is encoded by a byte-level BPE (A) and a sentence-piece model (B) over the bytes of space + text. Byte offsets where
tokens of both end cut the tokens into groups; every A and B token of a group are linked. A pair's count is the number of
documents that hold it linked.

First pass: documents are aligned and each task sums its documents' distinct pairs. The distinct pairs of the corpus, dealt to
PARTS by a hash, get a minimal perfect hash per part. Task sums become dense vectors indexed by it (every key is compared with the
one stored at its index), which a tree of fan-in FAN adds up; each part's hash, keys and counts go to a file in the shared
folder. Second pass: documents are aligned again and look their pairs up in these files, of which a worker keeps CACHE_BYTES at
a time. Pairs are bounded by the product of the vocabularies, parts by a PARTS-th of it.

Texts are cut before a space that follows a character which is no white space: neither tokenizer has a token across such a
place (checked against B's pieces on loading; A's pre-splitter ends there), so both have a boundary there, and distinct
fragments are encoded and aligned once per chunk. Inside a group, distinct ids with their multiplicities are paired.

Defined cases: texts that are null or empty, or whose A or B tokens joined differ from space + text (as with U+2581 in the
text) have no tokens: zeros, and no groups. Strings of special tokens are plain text. Repeated rows are documents of their own; null
keys are carried; texts of any length are encoded whole; an empty table gives no rows; other columns of the table are left alone.
"""

from __future__ import annotations

import hashlib
import io
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .bpe import ByteBpe
from .files import open_fs, publish
from .perfect_hash import PerfectHash

PARTS = 256
FAN = 64
FLUSH_KEYS = 1 << 20        # distinct pairs that a task holds before it hands them on
PAIR_SLICE = 1 << 22        # pairs that are made at a time
CACHE_BYTES = 256 << 20     # part files that a worker keeps
SHORT = 200                 # bytes of a fragment that is encoded together with others
JOINED = 256                # fragments encoded together
MARK = "▁"             # stands for a space in B's pieces


def distinct_of(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by a sort, which beats numpy's hashing here)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def solid(data: np.ndarray) -> np.ndarray:
    """Does a character end at this byte that is surely no white space? ASCII marks, letters and digits; characters of two bytes but
    U+0080 to U+00BF; of three bytes from U+4000 on and U+2010 to U+2027; of four bytes."""
    b = np.concatenate([np.zeros(3, dtype=np.uint8), data])  # b[i + 3] is data[i]
    one, two, three, four = b[3:], b[2:-1], b[1:-2], b[:-3]
    tail = one >= 0x80
    return ((one > 0x20) & (one < 0x7F)) | (tail & (two >= 0xC3) & (two < 0xE0)) | (tail & (three >= 0xE4) & (three < 0xF0)) \
        | ((three == 0xE2) & (two == 0x80) & (one >= 0x90) & (one < 0xA8)) | (tail & (four >= 0xF0))


def cuts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Byte offsets of the fragments of all texts, the end included: texts' starts, and spaces after a solid character."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = (data[1:] == 0x20) & solid(data)[:-1]
    cut[offsets] = True
    return np.flatnonzero(cut)


class Aligner:
    """Both tokenizers, over fragments that begin with a space."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        self.a = ByteBpe(a_path)
        self.a.added = {}  # their strings are plain text here
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes on after a space, so texts can't be cut before spaces")
        raw = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.b_len = np.array([len(r) for r in raw], dtype=np.int64)
        self.b_off = np.cumsum(self.b_len) - self.b_len
        self.b_bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.space = self.b.piece_to_id(MARK)
        self.n_b = len(pieces)

    def encode(self, fragments: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """((ids of every fragment, all ids) of A, the same of B). Short fragments with a solid end are encoded JOINED at a time,
        since both tokenizers have a boundary between them; the others one by one."""
        own, data = C.raw_bytes(fragments)
        sizes, texts = np.diff(own), fragments.to_pylist()
        sure = np.flatnonzero(solid(data)[own[1:] - 1] & (sizes <= SHORT)) if len(data) else np.zeros(0, dtype=np.int64)
        a, b, single = [], [], [np.setdiff1d(np.arange(len(texts)), sure)]
        for k in range(0, len(sure), JOINED):
            part = sure[k:k + JOINED]
            joined, ends = "".join([texts[i] for i in part]), np.cumsum(sizes[part])
            one = self.split(self.a.ranked.encode_ordinary(joined), self.a.piece_len, ends)
            two = self.split(self.b.encode(joined[1:]), self.b_len, ends)
            if one is None or two is None:  # a fragment that B can't give back, as with U+2581
                single.append(part)
            else:
                a.append((part, *one))
                b.append((part, *two))
        rest = np.concatenate(single)
        ids = self.a.encode(fragments.take(pa.array(rest)))
        off = np.asarray(ids.offsets).astype(np.int64)
        a.append((rest, np.diff(off), ids.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]))
        lists = [[self.space] if texts[i] == " " else self.b.encode(texts[i][1:]) for i in rest]  # B puts a space in front; alone it needs help
        b.append((rest, np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)), np.fromiter(chain.from_iterable(lists), dtype=np.int64)))
        return self.in_order(a, len(texts)), self.in_order(b, len(texts))

    @staticmethod
    def split(ids: list, length: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of every fragment, all ids) of joined fragments, None unless a token ends where each fragment does."""
        ids = np.array(ids, dtype=np.int64)
        to = np.cumsum(length[ids])
        last = np.searchsorted(to, ends)
        if last[-1] != len(to) - 1 or (to[last] != ends).any():
            return None
        return np.diff(last, prepend=-1), ids

    @staticmethod
    def in_order(parts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of parts (fragments, their sizes, ids) into the order of the fragments."""
        size = np.zeros(n, dtype=np.int64)
        for of, sizes, _ in parts:
            size[of] = sizes
        first = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), dtype=np.int64)
        for of, sizes, ids in parts:
            out[C.spread(first[of], sizes)] = ids
        return size, out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


class Aligned:
    """Alignment of a chunk's distinct fragments, and which fragments make up which text."""

    def __init__(self, model: Aligner, texts: pa.Array):
        n = len(texts)
        blank = pa.scalar(" ", pa.large_string())
        offsets, data = C.raw_bytes(pc.binary_join_element_wise(blank, texts, pa.scalar("", pa.large_string())))
        starts = cuts(offsets, data)
        fragments = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data.tobytes()))
        coded = fragments.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.searchsorted(starts, offsets)                      # text i has fragments first[i] to first[i + 1]
        self.n, self.m = len(coded.dictionary), model.n_b
        own, own_data = C.raw_bytes(coded.dictionary)
        sizes = np.diff(own)

        (a_n, a_ids), (b_n, b_ids) = model.encode(coded.dictionary)
        self.ok = self.matches(model, sizes, own, own_data, b_n, b_ids)
        a_ids, b_ids = a_ids[np.repeat(self.ok, a_n)], b_ids[np.repeat(self.ok, b_n)]
        self.a_n, self.b_n = np.where(self.ok, a_n, 0), np.where(self.ok, b_n, 0)

        a_end, b_end = np.cumsum(model.a.piece_len[a_ids]), np.cumsum(model.b_len[b_ids])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        self.a_ids, self.b_ids = a_ids, b_ids
        self.a_group, self.b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        self.group_fragment = np.searchsorted(np.cumsum(np.where(self.ok, sizes, 0)), both)
        self.groups = np.bincount(self.group_fragment, minlength=self.n)
        links = np.bincount(self.a_group, minlength=len(both)) * np.bincount(self.b_group, minlength=len(both))
        self.links = self.per_fragment(self.group_fragment, links)
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
        self.valid = (self.per_text((~self.ok).astype(np.int64)) == 0) & ~empty if n else np.zeros(0, dtype=bool)

    @staticmethod
    def matches(model: Aligner, sizes, own, own_data, b_n, b_ids) -> np.ndarray:
        """Do a fragment's B tokens joined give its bytes?"""
        at = np.concatenate([[0], np.cumsum(b_n)])
        got = np.concatenate([[0], np.cumsum(model.b_len[b_ids])])
        ok = got[at[1:]] - got[at[:-1]] == sizes
        ids = b_ids[np.repeat(ok, b_n)]
        joined = model.b_bytes[C.spread(model.b_off[ids], model.b_len[ids])]
        differ = np.concatenate([[0], np.cumsum(joined != own_data[C.spread(own[:-1][ok], sizes[ok])])])
        ends = np.cumsum(sizes[ok])
        ok[np.flatnonzero(ok)[differ[ends] != differ[ends - sizes[ok]]]] = False
        return ok

    def per_fragment(self, fragment: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, dtype=np.int64)
        np.add.at(out, fragment, values)
        return out

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over every text's fragments."""
        run = np.concatenate([[0], np.cumsum(values[self.code])])
        return run[self.first[1:]] - run[self.first[:-1]]

    def pairs(self, limit: int = PAIR_SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(fragment, pair, links) in slices: a pair is A id * number of B ids + B id; a group gives each distinct pair once."""
        wide = 1 << 32
        a_key, a_times = np.unique(self.a_group * wide + self.a_ids, return_counts=True)
        b_key, b_times = np.unique(self.b_group * wide + self.b_ids, return_counts=True)
        a_of, a_id = np.divmod(a_key, wide)
        b_of, b_id = np.divmod(b_key, wide)
        b_size = np.bincount(b_of, minlength=len(self.group_fragment))
        b_first = np.cumsum(b_size) - b_size
        times = b_size[a_of]
        part = np.cumsum(times) // limit
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(times)]])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if lo < hi:
                i = np.repeat(np.arange(lo, hi), times[lo:hi])
                j = C.spread(b_first[a_of[lo:hi]], times[lo:hi])
                yield self.group_fragment[a_of[i]], a_id[i] * self.m + b_id[j], a_times[i] * b_times[j]

    def document_counts(self, limit: int = PAIR_SLICE) -> tuple[np.ndarray, np.ndarray]:
        """(pair, number of texts that hold it linked)."""
        text = np.repeat(np.arange(len(self.valid)), np.diff(self.first))
        seen = self.valid[text]
        held = distinct_of(text[seen] * self.n + self.code[seen])         # distinct (text, fragment)
        text, fragment = np.divmod(held, self.n)
        lists = list(self.pairs(limit))
        if not lists or not len(held):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        owner, key = np.concatenate([x[0] for x in lists]), np.concatenate([x[1] for x in lists])
        distinct, key = np.unique(key, return_inverse=True)
        mine = distinct_of(owner * len(distinct) + key)                    # distinct (fragment, pair)
        owner, key = np.divmod(mine, len(distinct))
        size = np.bincount(owner, minlength=self.n)
        begin = np.cumsum(size) - size
        counts = np.zeros(len(distinct), dtype=np.int64)
        part = np.cumsum(size[fragment]) // limit                     # texts stay whole in a slice
        edges = np.unique(np.concatenate([[0], np.searchsorted(text, text[np.flatnonzero(np.diff(part)) + 1]), [len(text)]]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            times = size[fragment[lo:hi]]
            both = distinct_of(np.repeat(text[lo:hi], times) * len(distinct) + key[C.spread(begin[fragment[lo:hi]], times)])
            counts += np.bincount(both % len(distinct), minlength=len(distinct))
        held = counts > 0
        return distinct[held], counts[held]

    def group_texts(self) -> pa.Array:
        """``a1,a2|b1;...`` of every text ('' without tokens)."""
        join = lambda values, first, mark: pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first), values), pa.scalar(mark, pa.large_string()))
        side = lambda ids, of: join(pa.array(ids).cast(pa.large_string()),
                                    np.searchsorted(of, np.arange(len(self.group_fragment) + 1)), ",")
        groups = pc.binary_join_element_wise(side(self.a_ids, self.a_group), side(self.b_ids, self.b_group), pa.scalar("|", pa.large_string()))
        fragments = join(groups, np.searchsorted(self.group_fragment, np.arange(self.n + 1)), ";")
        texts = join(fragments.take(pa.array(self.code)), self.first, ";")
        return pc.if_else(pa.array(self.valid), texts, pa.scalar("", pa.large_string()))


# ---- first pass: distinct pairs, their hashes and counts ----

def part_of(keys: np.ndarray) -> np.ndarray:
    return (C.mix64(keys.astype(np.uint64) + np.uint64(0xD1B54A32D192ED03)) % np.uint64(PARTS)).astype(np.int64)


def summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return distinct, total


def task_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str) -> DataFrame:
    """(part, task, keys, counts): the documents of each task that hold a pair, by part of the pairs' hash."""
    src = docs.select(F.col(text_col).cast("string").alias("text"))
    flush, slice_, chunk = FLUSH_KEYS, PAIR_SLICE, C.CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, task = aligner(a_path, b_path), TaskContext.get().partitionId()
        keys, counts, held = [], [], 0

        def emit():
            k, c = summed(keys, counts)
            part = part_of(k)
            order = np.argsort(part, kind="stable")
            k, c = k[order], c[order]
            found, at = np.unique(part[order], return_index=True)
            lists = pa.array(np.concatenate([at, [len(k)]]).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.full(len(found), task, dtype=np.int32)),
                                               pa.ListArray.from_arrays(lists, pa.array(k)), pa.ListArray.from_arrays(lists, pa.array(c))],
                                              ["part", "task", "keys", "counts"])

        for b in C.chunks(batches, "text", chunk):
            k, c = Aligned(model, C.text_array(b.column("text"))).document_counts(slice_)
            if len(k):
                keys.append(k)
                counts.append(c)
                held += len(k)
            if held > flush:
                k, c = summed(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > flush // 2:
                    yield emit()
                    keys, counts, held = [], [], 0
        if keys:
            yield emit()

    return C.stored(src.mapInArrow(run, "part int, task int, keys array<long>, counts array<long>"), "pair-tasks")


def perfect_hashes(tasks: DataFrame) -> DataFrame:
    """A row per part: part, sizes, words (the perfect hash) and keys in order of their index."""
    distinct = tasks.select("part", F.explode("keys").alias("key")).distinct()

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        mph = PerfectHash.build(keys)
        placed = np.empty_like(keys)
        placed[mph.index(keys)] = keys
        return pa.table({"part": [table.column("part")[0].as_py()], "sizes": [mph.sizes], "words": [mph.words.view(np.int64)], "keys": [placed]},
                        schema=HASHES)

    return C.stored(distinct.groupBy("part").applyInArrow(build, "part int, sizes array<long>, words array<long>, keys array<long>"), "pair-hashes")


HASHES = pa.schema([("part", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("sizes", "words", "keys")]])
VECTORS = pa.schema([("part", pa.int32()), ("task", pa.int32()), ("counts", pa.list_(pa.int64()))])


def hash_of(row) -> PerfectHash:
    column = lambda c: row.column(c)[0].values.to_numpy()
    return PerfectHash(column("sizes"), column("words").view(np.uint64))


def count_vectors(tasks: DataFrame, hashes: DataFrame) -> DataFrame:
    """A row per part: part, task (0) and counts, the sum of all tasks' dense vectors by index, added FAN at a time."""
    node = tasks.withColumn("node", (F.col("task") / FAN).cast("int"))
    copies = node.select("part", "node").distinct().join(hashes, "part").toDF("part_", "node_", "sizes", "words", "keys_in_order")

    def dense(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("keys_in_order")[0].values.to_numpy()
        mph, total = hash_of(right), np.zeros(len(keys), dtype=np.int64)
        for k, c in zip(left.column("keys"), left.column("counts")):
            k, c = k.values.to_numpy(), c.values.to_numpy()
            at = mph.index(k)
            if (at < 0).any() or (keys[at] != k).any():
                raise RuntimeError("a pair is missing from its part's hash")
            total[at] += c  # a task's row has every pair once
        return pa.table({"part": [left.column("part")[0].as_py()], "task": [left.column("node")[0].as_py()], "counts": [total]}, schema=VECTORS)

    def add(table: pa.Table) -> pa.Table:
        total = sum(c.values.to_numpy() for c in table.column("counts"))
        return pa.table({"part": [table.column("part")[0].as_py()], "task": [table.column("node")[0].as_py()], "counts": [total]}, schema=VECTORS)

    kind = "part int, task int, counts array<long>"
    out = C.stored(node.groupBy("part", "node").cogroup(copies.groupBy("part_", "node_")).applyInArrow(dense, kind), "pair-vectors")
    last = out.agg(F.max("task").alias("t")).first()["t"]
    while last:
        out = C.stored(out.withColumn("node", (F.col("task") / FAN).cast("int")).groupBy("part", "node").applyInArrow(add, kind), "pair-vectors")
        last //= FAN
    return out


def write_counts(hashes: DataFrame, vectors: DataFrame, uri: str, n_b: int) -> DataFrame:
    """Write every part's hash, keys and counts to a file of its own; (part, a, top): the highest count of each A id in the part."""

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        part = left.column("part")[0].as_py()
        keys, counts = left.column("keys")[0].values.to_numpy(), right.column("counts")[0].values.to_numpy()
        mph = hash_of(left)
        with publish(f"{uri}/part-{part:04d}.npz") as (out,):
            packed = io.BytesIO()
            np.savez(packed, sizes=mph.sizes, words=mph.words, keys=keys, counts=counts)
            out.write(packed.getvalue())
        a, at = np.unique(keys // n_b, return_inverse=True)
        top = np.zeros(len(a), dtype=np.int64)
        np.maximum.at(top, at, counts)
        return pa.table({"part": pa.array([part] * len(a), pa.int32()), "a": pa.array(a), "top": pa.array(top)})

    return C.stored(hashes.groupBy("part").cogroup(vectors.groupBy("part")).applyInArrow(write, "part int, a long, top long"), "pair-tops")


class Counts:
    """Looks pairs up in the parts' files; keeps up to CACHE_BYTES of them."""

    def __init__(self, uri: str):
        self.uri, self.held, self.size = uri, OrderedDict(), 0

    def part(self, number: int) -> tuple[PerfectHash, np.ndarray, np.ndarray]:
        if number in self.held:
            self.held.move_to_end(number)
            return self.held[number][:3]
        fs, path = open_fs(f"{self.uri}/part-{number:04d}.npz")
        with fs.open_input_file(path) as f:
            packed = np.load(io.BytesIO(f.read()))
            entry = PerfectHash(packed["sizes"], packed["words"]), packed["keys"], packed["counts"]
        size = 16 * len(entry[1]) + 16 * len(entry[0].words)
        while self.held and self.size + size > CACHE_BYTES:
            self.size -= self.held.popitem(last=False)[1][3]
        self.held[number] = (*entry, size)
        self.size += size
        return entry

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs, all of which have to be there."""
        part, out = part_of(keys), np.empty(len(keys), dtype=np.int64)
        order = np.argsort(part, kind="stable")
        found, at = np.unique(part[order], return_index=True)
        for number, lo, hi in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(keys)]):
            mine = order[lo:hi]
            mph, stored, counts = self.part(number)
            i = mph.index(keys[mine])
            if (i < 0).any() or (stored[i] != keys[mine]).any():
                raise RuntimeError("a pair of the second pass was not seen in the first: docs must give the same rows each time it is read")
            out[mine] = counts[i]
        return out


@lru_cache(maxsize=1)
def counts_at(uri: str) -> Counts:
    return Counts(uri)


def count_pairs(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> tuple[str, np.ndarray]:
    """(folder of the parts' files, highest count of every A id): the whole first pass. The array has an entry per A id."""
    model = aligner(a_path, b_path)
    uri = C.shared_uri(docs.sparkSession, "pair-counts")
    tasks = task_counts(docs, a_path, b_path, text_col)
    hashes = perfect_hashes(tasks)
    tops = write_counts(hashes, count_vectors(tasks, hashes), uri, model.n_b)
    top = np.zeros(len(model.a.piece_len), dtype=np.int64)
    for r in tops.groupBy("a").agg(F.max("top").alias("top")).toLocalIterator():  # at most A's vocabulary
        top[r["a"]] = r["top"]
    return uri, top


def pair_counts(spark, uri: str, n_b: int) -> DataFrame:
    """The counted pairs as a table: a_id, b_id, n_docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number in b.column("id").to_pylist():
                fs, path = open_fs(f"{uri}/part-{number:04d}.npz")
                if fs.get_file_info(path).type == pafs.FileType.File:
                    _, keys, counts = Counts(uri).part(number)
                    yield pa.RecordBatch.from_arrays([pa.array(keys // n_b), pa.array(keys % n_b), pa.array(counts)], ["a_id", "b_id", "n_docs"])

    return spark.range(PARTS).mapInArrow(run, "a_id long, b_id long, n_docs long")


# ---- second pass ----

NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = True) -> DataFrame:
    """Per row of ``docs``: id_col, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair has its A id's highest count),
    count_sum (of counts over links), groups_sha256, and with ``groups`` the groups' ids themselves (``a1,a2|b1;...``).

    ``docs`` is read twice and has to give the same rows each time, as a table in files does.
    """
    uri, top = count_pairs(docs, a_path, b_path, text_col)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", *NUMBERS, "groups_sha256", *(["groups"] if groups else [])]
    schema = T.StructType([src.schema["id"], *[T.StructField(c, T.LongType()) for c in NUMBERS],
                           *[T.StructField(c, T.StringType()) for c in names[1 + len(NUMBERS):]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = aligner(a_path, b_path), counts_at(uri)
        for b in C.chunks(batches, "text"):
            got = Aligned(model, C.text_array(b.column("text")))
            usable = np.zeros(got.n, dtype=bool)                            # fragments of texts that count
            usable[got.code[np.repeat(got.valid, np.diff(got.first))]] = True
            best, total = np.zeros(got.n, dtype=np.int64), np.zeros(got.n, dtype=np.int64)
            for owner, key, links in got.pairs():
                mine = usable[owner]
                owner, links = owner[mine], links[mine]
                distinct, at = np.unique(key[mine], return_inverse=True)
                n = counts.look_up(distinct)
                high = n == top[distinct // model.n_b]
                total += got.per_fragment(owner, links * n[at])
                best += got.per_fragment(owner, links * high[at])
            numbers = [got.per_text(v) * got.valid for v in (got.a_n, got.b_n, got.groups, got.links, best, total)]
            shown = got.group_texts()
            digest = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in shown.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, numbers), pa.array(digest, pa.string()),
                                              *([shown.cast(pa.string())] if groups else [])], names)

    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
