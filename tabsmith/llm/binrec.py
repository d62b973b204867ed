"""Token-id output as length-delimited binary records with a separate offset index.

Record: u64 length, u32 masked CRC-32C of those 8 bytes, payload, u32 masked CRC-32C of the payload
(all little-endian). Payload: i64 document id, u16 1 if the id is null, u16 bytes per token, token ids.
Index: u64 offset of every record, then the file's length. A reader can fetch any record by two index
entries, so records can be read in a shuffled order without scanning the file.

Documents are written in ascending id order (null ids first; equal ids by text) by range partitions, one
file each; file order is partition order. Texts of any length are encoded whole; null counts as empty;
repeated rows give repeated records; an empty table gives no records. Only the two named columns are
read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .bpe import byte_letters
from .files import publish, read_range

POLY = 0x82F63B78  # CRC-32C, reflected
MASK_DELTA = 0xA282EAD8
HEAD = 12  # length and its checksum
PAYLOAD_HEAD = 12
FRAME = HEAD + PAYLOAD_HEAD + 4
RECORDS_PER_READ = 4096
WRITE_BYTES = 16 << 20  # text that is encoded at a time: more of it shares more words
BLOCK = 256


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLY), t >> 1).astype(np.uint32)
    return t


TABLE = _byte_table()


def _shifts() -> list[np.ndarray]:
    """Tables [4, 256] that move a CRC state over 2^k zero bytes, k = 0..39."""
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = TABLE[one & 0xFF] ^ (one >> np.uint32(8))  # image of every state bit under one zero byte
    out = []
    byte = np.arange(256)
    for _ in range(40):
        table = np.zeros((4, 256), dtype=np.uint32)
        for bit in range(32):
            table[bit // 8] ^= np.where(byte >> (bit % 8) & 1, step[bit], 0).astype(np.uint32)
        out.append(table)
        step = _apply(table, step)
    return out


def _apply(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return (table[0][state & 0xFF] ^ table[1][(state >> 8) & 0xFF] ^ table[2][(state >> 16) & 0xFF] ^ table[3][state >> 24])


SHIFTS = _shifts()


def masked_crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of many byte ranges at once.

    A CRC without its initial value is linear and blind to leading zeros: every range is padded in front to
    whole blocks, all blocks advance together byte by byte, the blocks of a range are folded with a
    precomputed shift, and the initial value, shifted by the range's length, is added last.
    """
    n = len(starts)
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    owner_end = np.cumsum(blocks)
    grid = np.zeros(total * BLOCK, dtype=np.uint8)
    grid[C.spread(owner_end * BLOCK - lengths, lengths)] = data[C.spread(starts, lengths)]
    lanes = np.ascontiguousarray(grid.reshape(total, BLOCK).T)
    raw = np.zeros(total, dtype=np.uint32)
    for lane in lanes:
        raw = TABLE[(raw ^ lane) & 0xFF] ^ (raw >> np.uint32(8))
    state = np.zeros(n, dtype=np.uint32)
    first = owner_end - blocks
    order = np.argsort(-blocks, kind="stable")  # ranges with a k-th block come first
    fold = SHIFTS[BLOCK.bit_length() - 1]
    many = blocks[order]
    for k in range(int(many[0]) if n else 0):
        live = order[:int(np.searchsorted(-many, -k, "left"))]
        state[live] = _apply(fold, state[live]) ^ raw[first[live] + k]
    init = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for k, table in enumerate(SHIFTS):
        bit = (lengths >> k) & 1 == 1
        if bit.any():
            init[bit] = _apply(table, init[bit])
    crc = state ^ init ^ np.uint32(0xFFFFFFFF)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


MARKS = r"[!-&(-/:-@\[-`{-~]"
WORD = rf"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>{MARKS}*)$"
PLAIN = rf"^([a-zß-öø-ÿ]+|{MARKS}+)$"
ALPHABET = {b: c for c, b in byte_letters().items()}


def latin_lower(texts: pa.Array) -> pa.Array:
    """Latin-1 letters in lower case (texts of such letters alone)."""
    offsets, data = C.raw_bytes(texts)
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    big = ((data >= 65) & (data <= 90)) | (after & (data >= 0x80) & (data <= 0x9E))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data + np.uint8(32) * big))


class WordIds:
    """A word BPE tokenizer file; ids of whole texts from their distinct words.

    The tokenizer drops white space and no piece spans it, so the ids of a text are those of its words.
    A word of Latin-1 letters followed by ASCII punctuation other than an apostrophe is cut once more: letters and
    punctuation are separate pieces there, and letters are lower-cased as the tokenizer does (they are composed already).
    """

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts, each with ``end_id`` at its end."""
        offsets, flat = C.words(texts)
        enc = flat.dictionary_encode()
        word = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cut = pc.extract_regex(enc.dictionary, WORD)
        head = pc.if_else(pc.is_valid(cut), latin_lower(C.text_array(pc.struct_field(cut, "a"))), enc.dictionary)
        tail = pc.fill_null(pc.struct_field(cut, "b"), "")
        parts = pa.chunked_array([head, tail]).combine_chunks().dictionary_encode()
        size, ids = self.encode_distinct(parts.dictionary)
        size, ids = np.append(size, 1), np.append(ids, np.uint32(end_id))  # the last one is the end id
        first = np.cumsum(size) - size
        code = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n, texts_n = len(enc.dictionary), len(texts)
        seq = np.empty(2 * len(word) + texts_n, dtype=np.int64)  # two parts a word, then an end for every text
        ends = 2 * offsets[1:] + np.arange(texts_n)
        inner = np.ones(len(seq), dtype=bool)
        inner[ends] = False
        seq[ends] = len(size) - 1
        pair = np.empty(2 * len(word), dtype=np.int64)
        pair[0::2] = code[:n][word]
        pair[1::2] = code[n:][word]
        seq[inner] = pair
        out = ids[C.spread(first[seq], size[seq])]
        stops = np.cumsum(size[seq])[ends] if texts_n else np.zeros(0, dtype=np.int64)
        return np.concatenate([[0], stops]), out


    def encode_distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of every part, all ids). Small Latin-1 letters or ASCII punctuation alone are what the tokenizer's normaliser
        and splitting would hand to its model (bytes spelt in the byte-level alphabet), so they go there directly; other parts
        take the whole way."""
        plain = pc.match_substring_regex(parts, PLAIN).to_pylist()
        model = self.tokenizer.model
        lists: list = [()] * len(parts)
        rest = []
        for i, (part, simple) in enumerate(zip(parts.to_pylist(), plain)):
            if simple:
                spelt = part if part.isascii() else part.encode().decode("latin-1").translate(ALPHABET)
                lists[i] = [t.id for t in model.tokenize(spelt)]
            elif part:
                rest.append((i, part))
        for a in range(0, len(rest), 20_000):
            some = rest[a:a + 20_000]
            for (i, _), e in zip(some, self.tokenizer.encode_batch([p for _, p in some], add_special_tokens=False)):
                lists[i] = e.ids
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return size, np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(size.sum()))


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)


def frame(ids: pa.Array, offsets: np.ndarray, tokens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all records, their byte offsets with the end)."""
    n = len(offsets) - 1
    count = np.diff(offsets)
    body = PAYLOAD_HEAD + width * count
    at = np.concatenate([[0], np.cumsum(HEAD + body + 4)])
    unit = np.zeros(at[-1] // width, dtype=f"<u{width}")
    unit[C.spread((at[:-1] + HEAD + PAYLOAD_HEAD) // width, count)] = tokens
    data = unit.view(np.uint8)

    def put(where: np.ndarray, values: np.ndarray) -> None:
        raw = values.view(np.uint8).reshape(n, -1)
        data[where[:, None] + np.arange(raw.shape[1])] = raw

    put(at[:-1], body.astype("<u8"))
    null = pc.is_null(ids).to_numpy(zero_copy_only=False)
    put(at[:-1] + HEAD, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8"))
    put(at[:-1] + HEAD + 8, null.astype("<u2"))
    put(at[:-1] + HEAD + 10, np.full(n, width, dtype="<u2"))
    put(at[:-1] + 8, masked_crc32c(data, at[:-1], np.full(n, 8)).astype("<u4"))
    put(at[1:] - 4, masked_crc32c(data, at[:-1] + HEAD, body).astype("<u4"))
    return data, at


def write(docs: DataFrame, path: str, uri: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents below ``uri``; the stored manifest has a row per file:
    part int, records long, bytes long, tokens long."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = src.withColumn("tie", tie).withColumn("row", F.monotonically_increasing_id()) \
        .repartitionByRange(C.shuffle_width(docs.sparkSession), "id", "tie", "row") \
        .sortWithinPartitions("id", "tie", "row").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{uri}/part-{part:06d}"
        model = load(path)
        records = size = tokens = 0
        with publish(name + ".rec", name + ".idx") as (rec, idx):
            for b in C.chunks(batches, "text", WRITE_BYTES):
                offsets, ids = model.encode(C.text_array(b.column("text")), end_id)
                data, at = frame(b.column("id"), offsets, ids, model.width)
                rec.write(data.tobytes())
                idx.write((at[:-1] + size).astype("<u8").tobytes())
                records, size, tokens = records + b.num_rows, size + len(data), tokens + len(ids)
            idx.write(np.array([size], dtype="<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "records": [records], "bytes": [size],
                                          "tokens": [tokens]})

    return C.stored(ordered.mapInArrow(run, "part int, records long, bytes long, tokens long"), "binrec-manifest")


def read(manifest: DataFrame, uri: str, with_ids: bool = False) -> DataFrame:
    """Records of all files, checksums verified: doc_id, start (tokens before it in all files), n_tokens,
    ids_crc32 (of the ids as little-endian u32), and ``ids`` if asked for."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    spans = manifest.filter("records > 0").withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))) \
        .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(RECORDS_PER_READ).cast("long")))) \
        .select("part", "base", "first", F.least(F.lit(RECORDS_PER_READ), F.col("records") - F.col("first")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for span in b.to_pylist():
                name = f"{uri}/part-{span['part']:06d}"
                at = np.frombuffer(read_range(name + ".idx", 8 * span["first"], 8 * (span["n"] + 1)), dtype="<u8").astype(np.int64)
                for a, z in _cuts(at):
                    yield decode(name, at[a:z + 1], span["first"] + a, span["base"], with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return spans.repartition(C.shuffle_width(manifest.sparkSession), "part", "first").mapInArrow(run, schema)


def _cuts(at: np.ndarray) -> list[tuple[int, int]]:
    """Record ranges of about CHUNK_BYTES each (one record at least)."""
    part = (at[1:] - at[0] - 1) // C.CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(at) - 1]
    return list(zip(cuts, cuts[1:]))


def decode(name: str, at: np.ndarray, first: int, base: int, with_ids: bool) -> pa.RecordBatch:
    """The records at byte offsets ``at[:-1]``, which are the file's records from ``first`` on."""
    data = np.frombuffer(read_range(name + ".rec", int(at[0]), int(at[-1] - at[0])), dtype=np.uint8)
    origin, at = int(at[0]), at - at[0]

    def get(where: np.ndarray, dtype: str) -> np.ndarray:
        return data[where[:, None] + np.arange(np.dtype(dtype).itemsize)].view(dtype).ravel()

    body = get(at[:-1], "<u8").astype(np.int64)
    if not np.array_equal(body + HEAD + 4, np.diff(at)):
        raise ValueError(f"{name}: the index doesn't match the record lengths")
    checks = [(at[:-1] + 8, at[:-1], np.full(len(body), 8)), (at[1:] - 4, at[:-1] + HEAD, body)]
    if any(not np.array_equal(get(where, "<u4"), masked_crc32c(data, starts, lengths)) for where, starts, lengths in checks):
        raise ValueError(f"{name}: checksum mismatch")
    width = int(get(at[:1] + HEAD + 10, "<u2")[0])
    count = (body - PAYLOAD_HEAD) // width
    before = (origin - FRAME * first) // width  # every byte before that is not frame is a token
    tokens = [data[a:a + width * n].view(f"<u{width}").astype("<u4") for a, n in zip(at[:-1] + HEAD + PAYLOAD_HEAD, count)]
    out = {
        "doc_id": pa.array(get(at[:-1] + HEAD, "<i8").astype(np.int64), mask=get(at[:-1] + HEAD + 8, "<u2") > 0),
        "start": pa.array(base + before + np.cumsum(count) - count),
        "n_tokens": pa.array(count),
        "ids_crc32": pa.array([zlib.crc32(t.tobytes()) for t in tokens], pa.int64()),
    }
    if with_ids:
        out["ids"] = pa.array([t.astype(np.int64) for t in tokens], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(out)


def read_at(locations: DataFrame, uri: str) -> DataFrame:
    """Shuffled reads: for rows (part, record) in any order, the document id and ids of that record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.select(["part", "record"]).to_pylist():
                name = f"{uri}/part-{row['part']:06d}"
                at = np.frombuffer(read_range(name + ".idx", 8 * row["record"], 16), dtype="<u8").astype(np.int64)
                yield decode(name, at, row["record"], 0, True).select(["doc_id", "ids"])

    return locations.mapInArrow(run, "doc_id long, ids array<long>")
