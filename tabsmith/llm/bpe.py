"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged, so a text may be cut
between the two bytes. Cuts are taken only where the pre-splitter (the byte-level pattern with its
contractions and white-space look-ahead) also sees the same pieces on either side:

* the left byte is printable ASCII and not white space, so no run of white space is torn;
* the right byte starts a character;
* an apostrophe is cut off only after a letter or digit, since a contraction starts at the apostrophe
  only if it does not continue a run of punctuation.

Strings of added tokens are cut out first, as the tokenizer does. Each distinct fragment of a chunk is
encoded once and the ids of a text are the ids of its fragments in order. Fragments go to a rank-based
encoder, which merges the pair whose joined token has the lowest id; that is the tokenizer's own order of
merges where the i-th merge makes the i-th token (checked on loading) and every token encodes to itself
(checked in the tests). Text may be of any length;
null counts as empty; an empty text has no ids. Rows are never dropped or merged: repeated rows repeat
in the result, and the key is carried as it is (null included).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Fixed value: the pre-splitter of byte-level BPE files that set use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE tokenizer file with its table of forced boundaries."""

    def __init__(self, path: str):
        import tiktoken
        spec = json.load(open(path, encoding="utf-8"))
        kinds = (spec["normalizer"], spec["pre_tokenizer"]["type"], spec["pre_tokenizer"]["add_prefix_space"])
        if kinds != (None, "ByteLevel", False):
            raise ValueError("forced boundaries are derived for byte-level BPE without a normaliser or prefix space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        vocab, letters = spec["model"]["vocab"], byte_letters()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
            raise ValueError("token ids don't follow the order of the merges")
        pieces = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.ranked = tiktoken.Encoding("fragments", pat_str=PATTERN, special_tokens={},
                                        mergeable_ranks={p: i for i, p in pieces.items()})
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.cut = self.boundaries(pieces.values())
        pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.piece_len = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.piece_off = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)

    @staticmethod
    def boundaries(tokens) -> np.ndarray:
        """cut[256 * left + right]: the pair is inside no token and the pre-splitter allows the cut."""
        inside = np.zeros(1 << 16, dtype=bool)
        for t in tokens:
            b = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
            inside[b[:-1] * 256 + b[1:]] = True
        left, right = np.divmod(np.arange(1 << 16), 256)
        alnum = np.isin(left, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", dtype=np.uint8))
        return (~inside & (left > 0x20) & (left < 0x7F) & ((right < 0x80) | (right > 0xBF))
                & ((right != ord("'")) | alnum))

    def fragments(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Byte offsets of the fragments of all texts, the end included."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data) > 1:
            cut[1:-1] = self.cut[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        whole = data.tobytes()
        for literal in self.added:
            at = whole.find(literal)
            while at >= 0:
                end = at + len(literal)
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end - 1, "right"):  # one text
                    cut[at + 1:end] = False
                    cut[[at, end]] = True
                    at = whole.find(literal, end)
                else:
                    at = whole.find(literal, at + 1)
        cut[offsets] = True
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array) -> pa.Array:
        """list<int32> of ids, one list per text."""
        offsets, data = C.raw_bytes(texts)
        if len(data) == 0:
            return pa.array([[]] * len(texts), type=pa.list_(pa.int32()))
        starts = self.fragments(offsets, data)
        n = len(starts) - 1
        frags = pa.LargeStringArray.from_buffers(n, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data.tobytes()))
        enc = frags.dictionary_encode()
        code = enc.indices.to_numpy(zero_copy_only=False)
        size, flat = self.encode_distinct(enc.dictionary)
        first = np.cumsum(size) - size
        ids = flat[C.spread(first[code], size[code])]
        ends = np.concatenate([[0], np.cumsum(size[code])])[np.searchsorted(starts, offsets)]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))

    def encode_distinct(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of every fragment, all ids)."""
        one, added = self.ranked.encode_ordinary, {a.decode(): i for a, i in self.added.items()}
        sizes, flats = [], []
        for i in range(0, len(texts), 20_000):
            lists = [one(t) if t not in added else [added[t]] for t in texts.slice(i, 20_000).to_pylist()]
            sizes.append(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
            flats.append(np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(sizes[-1].sum())))
        return np.concatenate(sizes), np.concatenate(flats)

    def decode(self, lists: pa.Array) -> pa.Array:
        """Text of every id list: the bytes of its tokens, malformed UTF-8 replaced."""
        off = np.asarray(lists.offsets).astype(np.int64)
        ids = lists.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]
        off = off - off[0]
        size = self.piece_len[ids]
        data = self.piece_bytes[C.spread(self.piece_off[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[off]
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], type=pa.string())


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): ids of every whole text, without special tokens added."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in C.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), model.encode(C.text_array(b.column("text")))], ["id", "ids"])

    schema = T.StructType([src.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids, decoded string); null ids decode to an empty text."""
    src = tokens.select(F.col(id_col).alias("id"), F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ids"), model.decode(b.column("ids"))],
                                                 ["id", "ids", "decoded"])

    schema = T.StructType([src.schema["id"], src.schema["ids"], T.StructField("decoded", T.StringType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and then decode() in one pass: (id_col, ids, decoded)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in C.chunks(batches, "text"):
            ids = model.encode(C.text_array(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids, model.decode(ids)], ["id", "ids", "decoded"])

    schema = T.StructType([src.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256."""
    return round_trip(docs, path, id_col, text_col).select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
