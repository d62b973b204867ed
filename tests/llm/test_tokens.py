"""BPE, binary records and token counts against the tokenizer libraries; edge rows; round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import binrec, bpe, queries as Q, tokencount
from tabsmith.llm import common as C

PIECES = ["'", "s", "'s", "'ll", "%", "  ", "\n", " \n\t", "a", "Z", "9", "é", "é", "　", " ", "中", "<|endoftext|>",
          "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "🙂", "_", "\x1c", "\x85", "$$$", "...", "--", "'t", "re", "Σ", "H̱", "İ",
          "Thea,", " The", "word", "\x00"]


def odd_texts(n=4000, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(0, 14))) for _ in range(n)] + ["", " ", "x" * 5000, "a b " * 9000]


def library(path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def edge_docs(spark):
    rows = [(1, None, "a"), (None, "null key", "b"), (3, "", None), (4, "same text", "c"), (4, "same text", "c"),
            (5, "it's <|endoftext|> 中文  x" * 3000, "d")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_forced_boundaries_agree_with_library():
    texts = odd_texts()
    model, t = bpe.ByteBpe(Q.BYTE_BPE), library(Q.BYTE_BPE)
    lists = model.encode(C.text_array(pa.array(texts)))
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert lists.to_pylist() == want
    assert model.decode(lists).to_pylist() == [t.decode(i, skip_special_tokens=False) for i in want]


def test_cut_pairs_are_inside_no_token_and_tokens_encode_to_themselves():
    model = bpe.ByteBpe(Q.BYTE_BPE)
    plain = [p for p in model.pieces if p and p not in model.added]
    assert not any(model.cut[256 * a + b] for p in plain for a, b in zip(p, p[1:]))
    assert all(model.ranked._encode_single_piece(p) == [i] for i, p in enumerate(model.pieces) if p in set(plain))


def test_op7_edges(spark):
    t = library(Q.BYTE_BPE)
    out = {}
    for r in bpe.digests(edge_docs(spark), Q.BYTE_BPE).collect():
        out.setdefault(r.doc_id, []).append(r)
    for key, text in ((1, ""), (None, "null key"), (3, ""), (4, "same text"), (5, "it's <|endoftext|> 中文  x" * 3000)):
        ids = t.encode(text, add_special_tokens=False).ids
        for r in out[key]:
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(out[4]) == 2
    assert bpe.digests(edge_docs(spark).limit(0), Q.BYTE_BPE).count() == 0
    tokens = spark.createDataFrame([(1, [1, 2]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(tokens, Q.BYTE_BPE).collect()} == {1: t.decode([1, 2]), 2: ""}


def test_word_ids_agree_with_library():
    texts = odd_texts(seed=5)
    off, ids = binrec.WordIds(Q.WORD_BPE).encode(C.text_array(pa.array(texts)), 2)
    want = library(Q.WORD_BPE).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [e.ids + [2] for e in want]


def test_masked_crc32c():
    def one(b):
        c = 0xFFFFFFFF
        for x in b:
            c = int(binrec.TABLE[(c ^ x) & 255]) ^ (c >> 8)
        c ^= 0xFFFFFFFF
        return (((c >> 15) | (c << 17)) + binrec.MASK_DELTA) & 0xFFFFFFFF

    assert one(b"123456789") == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + binrec.MASK_DELTA) & 0xFFFFFFFF  # published check value
    data = np.frombuffer(random.Random(1).randbytes(9000), dtype=np.uint8)
    starts, lengths = np.array([0, 5, 100, 1000, 3000, 3000]), np.array([0, 8, 256, 513, 5000, 1])
    assert binrec.masked_crc32c(data, starts, lengths).tolist() == [one(data[a:a + n].tobytes()) for a, n in zip(starts, lengths)]


def records_of(docs, spark):
    uri = C.shared_uri(spark, "test-records")
    manifest = binrec.write(docs, Q.WORD_BPE, uri)
    return uri, manifest


def test_op4_edges_order_and_shuffled_reads(spark):
    t = library(Q.WORD_BPE)
    docs = edge_docs(spark)
    uri, manifest = records_of(docs, spark)
    rows = sorted(binrec.read(manifest, uri, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 3, 4, 4, 5]
    start = 0
    texts = {1: "", None: "null key", 3: "", 4: "same text", 5: "it's <|endoftext|> 中文  x" * 3000}
    for r in rows:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    where = manifest.filter("records > 0").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)).alias("record"))
    again = binrec.read_at(where.orderBy(F.desc("record")), uri).collect()
    assert sorted((r.ids for r in again)) == sorted(r.ids for r in rows)
    uri, manifest = records_of(docs.limit(0), spark)
    assert binrec.read(manifest, uri).count() == 0


def test_op4_detects_damage(spark, tmp_path):
    uri, manifest = records_of(edge_docs(spark), spark)
    part = manifest.filter("records > 0").first().part
    name = f"{uri}/part-{part:06d}.rec"
    from tabsmith.llm.files import open_fs
    fs, path = open_fs(name)
    with fs.open_input_file(path) as f:
        raw = bytearray(f.read())
    raw[-6] ^= 1
    with fs.open_output_stream(path) as f:
        f.write(bytes(raw))
    with pytest.raises(Exception, match="checksum"):
        binrec.read(manifest, uri).count()


def test_op3_counts_and_stitching(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "BLOCK_TOKENS", 7)  # documents cross many blocks
    docs = edge_docs(spark).limit(5)
    enc = tokencount.encoder(Q.BYTE_RANKS, Q.public_tokenizers.PATTERN)
    out = tokencount.token_counts(docs, Q.BYTE_RANKS, Q.public_tokenizers.PATTERN, Q.FREE_ID).collect()
    want = sorted((str(r.doc_id), len(enc.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == want
    assert tokencount.token_counts(docs.limit(0), Q.BYTE_RANKS, Q.public_tokenizers.PATTERN, Q.FREE_ID).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_scan_of_any_file(spark, monkeypatch, block):
    monkeypatch.setattr(tokencount, "BLOCK_TOKENS", block)
    rnd = random.Random(block)
    uri = C.shared_uri(spark, "test-flat")
    files, want = [], []
    from tabsmith.llm.files import open_fs
    for part in range(3):
        ids = [9 if rnd.random() < 0.3 else rnd.randrange(9) for _ in range(40)]
        fs, path = open_fs(f"{uri}/part-{part:06d}.bin")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(np.array(ids, dtype="<u2").tobytes())
        files.append((part, len(ids)))
        start = ordinal = 0
        for i, x in enumerate([*ids, None]):
            if x == 9 or (x is None and start < len(ids)):
                want.append((part, ordinal, start, i - start, x == 9))
                start, ordinal = i + 1, ordinal + 1
    got = tokencount.scan(spark.createDataFrame(files, "part int, tokens long"), uri, 9).collect()
    assert sorted(tuple(r[c] for c in ("part", "ordinal", "start", "n_tokens", "complete")) for r in got) == sorted(want)
