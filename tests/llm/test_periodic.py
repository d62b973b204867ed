"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsmith.llm import periodic as P
from tabsmith.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """(start, length, period): every maximal stretch of each period; the smallest period of a stretch counts."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def brute(key, text):
    w = WORD.findall(text or "")
    n, h = len(w), None if key is None else zlib.crc32(str(key).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def got_runs(texts):
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.array([c for t in texts for c in t], dtype=np.int64)
    rows = P.find_runs(codes, np.concatenate([[0], np.cumsum(sizes)]))
    return [[tuple(map(int, r[1:])) for r in rows if r[0] == i] for i in range(len(texts))]


def crafted(rnd):
    """Texts of repeats over small alphabets, with errors, nested and neighbouring runs."""
    out = []
    for _ in range(rnd.randrange(1, 6)):
        part = [rnd.randrange(1, rnd.choice([2, 3, 5, 40])) for _ in range(rnd.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 64]))]
        if rnd.random() < 0.3:
            part = part * 9
        part = part * rnd.randrange(1, 7) + part[:rnd.randrange(len(part))]
        if rnd.random() < 0.3:
            part[rnd.randrange(len(part))] = 99
        out += part
    return out


@pytest.mark.parametrize("seed", range(6))
def test_crafted_texts_equal_brute_force(seed):
    rnd = random.Random(seed)
    texts = [crafted(rnd) for _ in range(60)]
    assert got_runs(texts) == [brute_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=150), max_size=4))
def test_random_texts_equal_brute_force(texts):
    assert got_runs(texts) == [brute_runs(t) for t in texts]


def test_every_period_and_offset_at_the_limits():
    texts = []
    for q in range(1, 70):
        for off in (0, 1, 5, 7, 13):
            length = max(24, 3 * q)
            base = list(range(1000, 1000 + q))
            run = (base * 30)[:length]
            texts.append(list(range(1, off + 1)) + run + [7777])
            texts.append(list(range(1, off + 1)) + run[:-1] + [7777])  # one word short
    assert got_runs(texts) == [brute_runs(t) for t in texts]


def test_convolution_is_exact():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, P.PRIME, 400).astype(np.uint64)
    squares = np.concatenate([[0], np.cumsum(x * x % np.uint64(P.PRIME))]).astype(np.uint64)
    for size, low, high in ((8, 1, 15), (16, 16, 31), (64, 64, 127)):
        starts = np.arange(0, 400 - 3 * size, size)
        got = P.squared_differences(x, squares, starts, size, low, high)
        for k, s in enumerate(starts):
            for d in range(low, high + 1):
                want = sum((int(x[s + i]) - int(x[s + d + i])) ** 2 for i in range(size)) % P.PRIME
                assert int(got[k, d - low]) == want


def test_misleading_hash_is_found_out(monkeypatch):
    monkeypatch.setattr(P.Stretch, "equal", lambda self, i, d, size: np.ones(len(i), dtype=bool))  # every hash agrees
    texts = [[1, 2, 3] * 12 + [5, 6, 7, 8] + [1, 2, 3, 4] * 9, [9] * 30 + [1] + [9] * 40]
    assert [r for t in got_runs(texts) for r in t]
    for got, t in zip(got_runs(texts), texts):
        assert set(got) <= set(brute_runs(t))


@pytest.mark.parametrize("text", ["a " * 200_000, "a " * 60_000 + "b " + "a " * 60_000 + "c " + "a " * 60_000,
                                  " ".join("ab"[bin(i).count("1") % 2] for i in range(1 << 17))])
def test_long_texts_in_step(text):
    words = text.split()
    codes = np.array([ord(w) for w in words])
    t0 = time.time()
    rows = P.find_runs(codes, np.array([0, len(codes)]))
    assert time.time() - t0 < 60
    for _, s, length, q in rows:
        assert (codes[s:s + length - q] == codes[s + q:s + length]).all()
    if words[0] == words[1] == "a" and len(set(words)) == 1:
        assert rows.tolist() == [[0, 0, len(words), 1]]


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "a b " * 20), (10, "x y z " * 30 + "end"), (10, "x y z " * 30 + "end"),
        (11, "é ü x " * 15), (12, "A a " * 12), (20, "w " * 23), (21, "w " * 24),
        *[(k, " ".join(f"w{i}" for i in range(k % 300 + 1))) for k in range(100, 400)]]


def test_edge_rows_and_planted_repeats(spark):
    schema = "doc_id long, text string, runs string, period long, best string, id string, collapsed long"
    docs = spark.createDataFrame([(*r, "r", 1, "b", "i", 2) for r in EDGE], schema)
    got = [tuple(r) for r in P.digests(docs).collect()]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(got, key=lambda r: str(r)) == sorted((brute(*r) for r in EDGE), key=lambda r: str(r))
    assert P.digests(docs.limit(0)).count() == 0
    found = P.runs(docs).where("doc_id = 10").collect()
    assert len(found) == 2 and [tuple(x) for x in found[0].runs] == [(0, 90, 3)] and found[0].collapsed == "x y z end"


def test_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = [r for r in rows if len(r[1]) < 12_000]  # brute force takes quadratic time; the operator has all rows
    got = {r.doc_id: tuple(r) for r in Q.op12_periodic_runs(spark, SMALL).collect()}
    assert [got[k] for k, _ in rows] == [brute(k, t) for k, t in rows]
