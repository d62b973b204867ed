"""Cross-tokenizer alignment against the tokenizer libraries on whole texts; perfect hashing."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabsmith.llm import align as A
from tabsmith.llm import common as C
from tabsmith.llm import queries as Q
from tabsmith.llm.perfect_hash import PerfectHash

SMALL = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Libraries:
    def __init__(self):
        import sentencepiece
        self.a = Tokenizer.from_file(Q.BYTE_BPE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=Q.PIECE_BPE)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if i != 50256}
        self.a_bytes[50256] = b"<|endoftext|>"

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        """[(A ids, B ids)] of a text, walking both token lists byte by byte."""
        if not text:
            return []
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        one, two = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if b"".join(one) != whole or b"".join(two) != whole:
            return []
        out, i, j = [], 0, 0
        while i < len(a):
            i0, j0, x, y = i, j, len(one[i]), len(two[j])
            while x != y:
                if x < y:
                    i += 1
                    x += len(one[i])
                else:
                    j += 1
                    y += len(two[j])
            i, j = i + 1, j + 1
            out.append((a[i0:i], b[j0:j]))
        return out


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


def brute(libraries, rows):
    docs = [(k, libraries.groups(t)) for k, t in rows]
    counts = Counter()
    for _, groups in docs:
        counts.update({(a, b) for x, y in groups for a in x for b in y})
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = []
    for k, groups in docs:
        links = [(a, b) for x, y in groups for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((k, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, counts


ROWS = [(1, None), (2, ""), (3, " "), (4, "  "), (5, "a"), (5, "a"), (None, "a b"), (6, "trailing  "), (7, "\n\n lead \t tab\r\nx  y   z "),
        (8, "<|endoftext|> and <s> </s> <unk> <0x41>"), (9, "mark ▁ inside"), (10, "▁"), (11, "été naïve “quoted” text — dash… 中文 字 です 😀 ok"),
        (12, "nbsp  after　 wide  thin\u0085 next  x"), (13, "a" * 5000), (14, "it's I'll 'tis don't ' s"), (15, "\x00 nul \x7f del"),
        (16, "ﬁ é ​ zero"), (17, "12345 67,890.12 $3"), (18, "word " * 800), (19, "\t"), (20, "x\n"), (21, "x \n y"),
        (22, " ".join(f"w{i}q" for i in range(2000))), (23, "def f(x):\n    return x  # ok\n"), (24, "���"), (25, "é " * 50)]


def test_rows_equal_the_libraries(spark, libraries, monkeypatch):
    schema = "doc_id long, text string, part int, keys long, counts string, id string, groups int"
    docs = spark.createDataFrame([(*r, 1, 2, "c", "i", 3) for r in ROWS], schema).repartition(3)
    got = A.alignments(docs, Q.BYTE_BPE, Q.PIECE_BPE).collect()
    want, counts = brute(libraries, ROWS)
    assert sorted((str(r.doc_id), *r[1:8]) for r in got) == sorted((str(r[0]), *r[1:]) for r in want)
    texts = {r.doc_id: r.groups for r in got}
    assert texts[9] == texts[2] == "" and texts[5] == ";".join(
        ",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in libraries.groups("a"))
    assert A.alignments(docs.limit(0), Q.BYTE_BPE, Q.PIECE_BPE).count() == 0


def test_counted_pairs_with_small_limits(spark, libraries, monkeypatch):
    for name, value in (("FAN", 2), ("FLUSH_KEYS", 50), ("PAIR_SLICE", 64)):
        monkeypatch.setattr(A, name, value)
    monkeypatch.setattr(C, "CHUNK_BYTES", 300)
    docs = spark.createDataFrame([r for r in ROWS if r[0] not in (13, 18, 22)], "doc_id long, text string").repartition(9)
    uri, top = A.count_pairs(docs, Q.BYTE_BPE, Q.PIECE_BPE)
    got = {(r.a_id, r.b_id): r.n_docs for r in A.pair_counts(spark, uri, 32000).collect()}
    _, counts = brute(libraries, [r for r in ROWS if r[0] not in (13, 18, 22)])
    assert got == dict(counts)
    assert top.max() == max(counts.values())


def test_given_table(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted(tuple(r[c] for c in FIELDS) for r in Q.op11_token_alignment(spark, SMALL).collect())
    assert got == sorted(brute(libraries, rows)[0])


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 70_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    mph = PerfectHash.build(keys)
    assert sorted(mph.index(keys).tolist()) == list(range(len(keys)))
    again = PerfectHash(mph.sizes, mph.words.view(np.int64).view(np.uint64))
    others = np.arange(1 << 41, (1 << 41) + 100)
    assert (again.index(keys) == mph.index(keys)).all() and (again.index(others) < len(keys)).all()


def test_small_cache_reads_parts_again(spark, monkeypatch):
    docs = spark.createDataFrame([r for r in ROWS if r[0] in (11, 22)], "doc_id long, text string")
    uri, _ = A.count_pairs(docs, Q.BYTE_BPE, Q.PIECE_BPE)
    pairs = A.pair_counts(spark, uri, 32000).collect()
    keys = np.array([r.a_id * 32000 + r.b_id for r in pairs])
    monkeypatch.setattr(A, "CACHE_BYTES", 1000)
    counts = A.Counts(uri)
    assert counts.look_up(keys).tolist() == [r.n_docs for r in pairs] and len(counts.held) < 40
    with pytest.raises(RuntimeError):
        counts.look_up(np.array([50256 * 32000 + 5]))
