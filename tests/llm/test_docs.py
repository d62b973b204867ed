"""Join, mix, classifier, secret and license operators against brute force; the pipeline's stages."""

import base64
import hashlib
import json
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from oracle_check import compare
from tabsmith.llm import common as C
from tabsmith.llm import jaccard, license_scan, mix, quality, queries as Q, secret_scan

SMALL = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_chars long, id string, size string, copies string, x long, p long"


def frame(spark, rows, schema=SCHEMA):
    """(doc_id, text, source) rows with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r[:2], r[2] if len(r) > 2 else "s", None, "i", "z", "c", 1, 2) for r in rows], schema)


# ---- near duplicates ----

def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    at, parent = defaultdict(list), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for t in s:
            for j in at[t]:
                common[j] += 1
            at[t].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    best = defaultdict(list)
    for i, r in enumerate(rows):
        best[root(i)].append(r[0])
    return sorted((str(r[0]), len(s), str(min((x for x in best[root(i)] if x is not None), default=None) if s else r[0]))
                  for i, (r, s) in enumerate(zip(rows, sets)))


def near_copies(seed=4, families=6, size=25):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    rows = []
    for f in range(families):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(40, 160))]
        for _ in range(size):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6])):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            rows.append(" ".join(t))
    rows += [" ".join([rnd.choice(vocab) for _ in range(rnd.randrange(1, 80))] + passage) for _ in range(30)]
    rows += ["A b c", "a  B\tc", "a b", "", " \n", None, "one two three four five", "One two three four five"]
    rnd.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (3, "another text of key three here"), (None, rows[5]), (None, "only null key text here"), (None, "")]


@pytest.mark.parametrize("hot,small,block,levels", [(32, 64, 1024, 6), (3, 2, 4, 2)])
def test_join_equals_brute_force(spark, monkeypatch, hot, small, block, levels):
    for name, value in (("HOT", hot), ("SMALL", small), ("LARGE", 2 * small), ("BLOCK", block), ("MAX_LEVELS", levels)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(frame(spark, rows)).collect())
    assert got == brute_components(rows)


def test_join_of_empty_table_and_kept_rows(spark):
    rows = near_copies(families=2, size=6)
    docs = frame(spark, rows)
    assert jaccard.join(docs.limit(0)).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = {(i, c) for i, n, c in brute_components(rows)}
    ids = [str(r.doc_id) for r in kept.collect()]
    assert {i for i in ids if i != "None"} == {c for _, c in want if c != "None"}
    texts = [frozenset(shingle_set(r.text)) for r in kept.collect()]
    full = [t for t in texts if t]
    assert len(full) == len(set(full))


def test_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in Q.op9_ngram_jaccard_join(spark, SMALL).collect())
    assert got == brute_components(rows)


# ---- mixing ----

def filled(sizes, weights):
    """Targets by repeated sharing."""
    total, target, held = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in held)
        free = [i for i in range(len(sizes)) if i not in held]
        for i in free:
            target[i] = left * weights[i] / sum(weights[j] for j in free)
        over = {i for i in free if target[i] > 3 * sizes[i]}
        if not over:
            return [3.0 * sizes[i] if i in held else target[i] for i in range(len(sizes))]
        held |= over


def mix_rows(seed=1):
    rnd = random.Random(seed)
    rows = []
    for source, n in (("a", 200), ("b", 3), (None, 40), ("ü", 1), ("B", 60), ("zz", 2), ("none", 0)):
        rows += [(len(rows) + i, " ".join("x" for _ in range(rnd.randrange(0, 60))), source) for i in range(n)]
    return rows + [(None, None, "a"), (None, "a b", "a"), (7, rows[7][1], "a"), (9000, "", "empty"), (9001, None, "empty")]


def test_mix_targets_and_words(spark):
    rows = mix_rows()
    docs = frame(spark, rows)
    got = mix.taken(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    target = dict(zip(order, filled([size[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    source_of = defaultdict(list)
    for r in mix.targets(mix.sizes(docs)).collect():
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source]
    assert all(r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"] for r in got)
    for i, _, s in rows:
        source_of[i].append(s)
    taken = defaultdict(int)
    for r in got:
        if len(set(source_of[r.doc_id])) == 1:
            taken[source_of[r.doc_id][0]] += r.taken
    longest = 60
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in taken)
    assert sorted(map(str, got)) == sorted(map(str, mix.taken(docs.repartition(5)).collect()))


def test_mixed_rows_repeat_as_taken(spark):
    docs = frame(spark, mix_rows())
    out = mix.mixed(docs)
    assert out.columns == docs.columns
    words = sum(len(WORD.findall(r.text or "")) for r in out.collect())
    assert words == sum(r.taken for r in mix.taken(docs).collect())
    assert mix.taken(docs.limit(0)).count() == 0 and mix.mixed(docs.limit(0)).count() == 0


def test_mix_oracle(spark, duck):
    assert compare("op5", Q.op5_source_mix(spark, SMALL).toPandas(), duck.execute(mix.ORACLE).df()) == (True, "ok")


# ---- quality ----

def test_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, quality.RANK)) / 10,
                        np.zeros(quality.STATS), np.ones(quality.STATS))
    import pyarrow as pa
    off, ids, values, stats = quality.features(C.text_array(pa.array(["the cat sat on the mat", ""])), np.array([22, 0]))
    for i, got in enumerate(m.raw(off, ids, values, stats)):
        x = np.zeros(quality.FEATURES)
        x[ids[off[i]:off[i + 1]]] = values[off[i]:off[i + 1]]
        x[quality.BUCKETS:] = stats[i]
        at = np.flatnonzero(x)
        v = m.factors[at] * x[at, None]
        pairs = sum(v[a] @ v[b] for a in range(len(at)) for b in range(a))
        assert abs(got - (m.bias + m.linear @ x + pairs)) < 1e-9


def test_quality_held_out(spark):
    out = Q.op8_quality_classifier(spark, "/root/testdata/sf0.1")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 1000 and np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark):
    docs = frame(spark, [(i, t) for i, t in enumerate(["good clean words here", "bad!! bad!! bad!!"] * 30)] + [(100, None), (None, ""), (100, "x " * 60000)])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (777, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)
    assert out.count() == 63 and out.filter("score is null or isnan(score)").count() == 0
    want = {str(i): __import__("zlib").crc32(str(i).encode()) % 3 == 1 for i in range(60)}
    assert all(want[str(r.doc_id)] == r.held_out for r in out.collect() if str(r.doc_id) in want)
    none = quality.classify(docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
    kept = quality.accepted(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out.filter("predicted = 1").collect())


# ---- secrets ----

def tlv(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 + (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def rsa_key():
    rnd = random.Random(2)
    return tlv(0x30, tlv(2, b"\x00") + b"".join(tlv(2, b"\x01" + rnd.randbytes(n)) for n in (128, 2, 128, 64, 64, 64, 64, 64)))


def ssh_key():
    def field(b):
        return len(b).to_bytes(4, "big") + b
    return (b"openssh-key-v1\x00" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big")
            + field(field(b"ssh-ed25519") + field(b"k" * 32)) + field(b"\x01" * 96))


def b64(b, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(b).decode()


def naive_base(text):
    out = []
    at = 0
    word = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    while m := word.search(text, at):
        at = m.end()
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_secret_spans(spark):
    jwt = ".".join([b64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode(), True).rstrip("="), b64(b'{"sub":"1"}', True).rstrip("="), "c2ln"])
    body = b64(rsa_key())
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(body[i:i + 64] for i in range(0, len(body), 64)) + "\n-----END RSA PRIVATE KEY-----"
    yes = {"jwt": jwt, "der": pem, "ssh": b64(ssh_key())}
    for kind, text in yes.items():
        found = secret_scan.find(f"é🙂 before {text} after")
        assert [s["kind"] for s in found if s["kind"] not in secret_scan.BASE_KINDS] == [kind]
        assert f"é🙂 before {text} after"[found[0]["start"]] == ("M" if kind == "der" else text[0])
    assert [s["kind"] for s in secret_scan.find("x " + rsa_key().hex())] == ["hex", "der"]
    no = [b64(random.Random(1).randbytes(200)), b64(rsa_key()[:-1]), b64(ssh_key() + b"x"), "eyJub3QiOiJhIn0.eyJ4IjoxfQ.sig",
          b64(tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86")) + tlv(3, b"\x00" * 64))), "A" * 400, "é" * 100]
    assert all(s["kind"] in secret_scan.BASE_KINDS for t in no for s in secret_scan.find(t))


def pkcs8_key(n):
    return tlv(0x30, tlv(2, b"\x00") + tlv(0x30, tlv(6, b"\x2b\x65\x70")) + tlv(4, random.Random(n).randbytes(n)))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_secret_keys_of_every_length(end):
    """A key is found whatever its length modulo 3, in PEM, before further lines and with several in a row."""
    def field(b):
        return len(b).to_bytes(4, "big") + b
    ssh = [b"openssh-key-v1\x00" + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(b"k" * 51) + field(b"\x01" * n)
           for n in (136, 144, 152)]
    ders = [pkcs8_key(n) for n in (34, 35, 36, 121, 122, 123, 200, 300, 301, 302, 1200)]
    assert {len(k) % 3 for k in ssh} == {len(k) % 3 for k in ders} == {0, 1, 2}
    for kind, keys in (("der", ders), ("ssh", ssh)):
        for key in keys:
            for width in (64, 70, 10_000):
                body = b64(key)
                lines = end.join(body[i:i + width] for i in range(0, len(body), width))
                for a, z in (("-----BEGIN PRIVATE KEY-----" + end, end + "-----END PRIVATE KEY-----"), ("", end + "The next paragraph."),
                             ("x" * 50 + end, end + "words" + end + "y" * 64), ("-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----")):
                    found = [s for s in secret_scan.find(f"{a}{lines}{z}") if s["kind"] not in secret_scan.BASE_KINDS]
                    assert found == [{"kind": kind, "start": len(a), "end": len(a) + len(lines)}], (len(key), width, a, z)
    two = b64(ders[2]).rstrip("=") + end + b64(ssh[0]).rstrip("=")
    assert [s["kind"] for s in secret_scan.find(two)] == ["der", "ssh"]


@pytest.mark.parametrize("joint", ["\n    ", " \r\n\t", "\\n", "\\r\\n", "\n"])
def test_secret_keys_in_other_layouts(joint):
    """Indented lines, escaped line ends, short lines, no gap before the key; hex over lines and with stray digits."""
    for kind, key in (("der", pkcs8_key(34)), ("der", rsa_key()), ("ssh", ssh_key())):
        for body, width in ((b64(key), 64), (b64(key), 30), (key.hex(), 32), (key.hex().upper(), 60)):
            lines = joint.join(body[i:i + width] for i in range(0, len(body), width))
            for a, z in (("BEGIN KEY-----" + joint, joint + "-----END KEY-----"), ("key: |" + joint, joint + "next: 1"), ("/etc/", "\n")):
                found = [s for s in secret_scan.find(a + lines + z) if s["kind"] not in secret_scan.BASE_KINDS]
                assert found == [{"kind": kind, "start": len(a), "end": len(a) + len(lines)}], (a, lines, z)
        stray = [s for s in secret_scan.find(f"f{key.hex()}7") if s["kind"] not in secret_scan.BASE_KINDS]
        assert stray == [{"kind": kind, "start": 1, "end": 1 + 2 * len(key)}]
        assert all(s["kind"] in secret_scan.BASE_KINDS for s in secret_scan.find(key[:-1].hex()))


def test_secret_base_digests(spark):
    rnd = random.Random(9)
    parts = ["password", "PassWD", "Api_key", "apikey", "token", "ſecret", "secret", "=", ":", " = ", "\"", "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef",
             "deadbeef", "abc", " ", "\n", "é", "==", "x.y-z/w", "AKIAAKIA"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 16)))) for i in range(1500)]
    rows += [(5000, None), (None, "password=abcdef1"), (5001, "z" * 200_000 + " token: abcdef"), (5000, None)]
    got = secret_scan.digests(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        spans = naive_base(t or "")
        text = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert by[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert (by[i].n_assign, by[i].n_access, by[i].n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert by[i].spans == text
    assert secret_scan.digests(frame(spark, rows).limit(0)).count() == 0


def test_redaction(spark):
    rows = [(1, "a token=abcdef123 z"), (2, None), (3, "clean words"), (3, "clean words")]
    out = secret_scan.redact(frame(spark, rows), length_col="n_chars")
    assert out.columns == frame(spark, rows).columns
    got = sorted((r.doc_id, r.text, r.n_chars) for r in out.filter("text is not null").collect())
    assert got == [(1, "a [SECRET] z", 12), (3, "clean words", None), (3, "clean words", None)]


@pytest.mark.parametrize("piece", ["MIIEvgIBADAN", "MIIE/wIBADAN\n", "eyJhbGci", "b3BlbnNzaC1rZXktdjEAAAAA", "3082ffff0201", "6f70656e7373682d", "eyJh.",
                                   "MIP/////", "3084000fffff02", "token: abcdef "])
def test_secret_scan_takes_linear_time(piece):
    """Many places that may start a structure, each stating a great length, in one run."""
    times = []
    for n in (150_000, 600_000):
        text = piece * (n // len(piece))
        t0 = time.process_time()
        secret_scan.find(text)
        times.append(time.process_time() - t0)
    assert times[1] < 10 and times[1] < 12 * max(times[0], 0.05)


# ---- licenses ----

def normal(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def naive_licenses(text):
    """Best containment over all stretches of 2m shingles, wherever they start."""
    words = normal(text)
    sh = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    out = {}
    for name, t in license_scan.TEMPLATES.items():
        w = normal(t)
        own = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        m, at = len(own), [i for i, x in enumerate(sh) if x in own]
        best = max((len({sh[j] for j in at if i <= j < i + 2 * m}) / m for i in at), default=0)
        if best >= 0.8:
            out[name] = best
    return out


def test_notices_with_inserted_words_are_found_at_every_offset(spark):
    """30 words inserted at one place, 20 at another, or a prefix on each line: found wherever the notice stands in the text."""
    words = license_scan.TEMPLATES["apache-2.0-notice"].split()
    m = len({tuple(normal(" ".join(words))[i:i + 5]) for i in range(len(normal(" ".join(words))) - 4)})
    rows = []
    for off in range(0, 2 * m + 3):
        pad = " ".join(f"p{off}x{i}" for i in range(off))
        for at, n in ((30, 30), (12, 20), (55, 45)):
            inserted = words[:at] + [f"new{i}" for i in range(n)] + words[at:]
            rows.append((len(rows), f"{pad} {' '.join(inserted)} tail of other words"))
        lines = [" ".join(words[i:i + 30]) for i in range(0, len(words), 30)]
        rows.append((len(rows), f"{pad} dnl " + " dnl ".join(lines)))
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan(frame(spark, rows)).collect()}
    want = {(i, name): c for i, t in rows for name, c in naive_licenses(t).items()}
    assert len({i for i, name in want if name == "apache-2.0-notice"}) == len(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_license_scan_of_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {(r.doc_id, r.license): r.containment for r in Q.op1_license_scan(spark, SMALL).collect()}
    want = {(i, name): c for i, t in rows for name, c in naive_licenses(t).items()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_licenses(spark):
    rnd = random.Random(3)
    filler = [f"f{i}" for i in range(50)]
    rows = []
    for i in range(60):
        t = rnd.choice(list(license_scan.TEMPLATES.values())).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            t[rnd.randrange(len(t))] = "changed"
        pad = [rnd.choice(filler) for _ in range(rnd.randrange(0, 90))]
        rows.append((i, " ".join(pad + t + pad[:7])))
    rows += [(100, None), (101, ""), (102, "MIT License"), (None, "Released under the MIT License."), (103, "word " * 30000 + "Licensed under CC BY-NC 4.0."),
             (103, "word " * 30000 + "Licensed under CC BY-NC 4.0.")]
    got = license_scan.scan(frame(spark, rows)).collect()
    want = {(i, name): c for i, t in rows for name, c in naive_licenses(t).items()}
    assert {(r.doc_id, r.license) for r in got} == set(want)
    assert all(abs(r.containment - want[(r.doc_id, r.license)]) < 1e-9 for r in got)
    at = next(r for r in got if r.doc_id is None)
    assert (at.first_word, at.end_word) == (0, 5)
    assert license_scan.scan(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(frame(spark, rows), {"short": "too short"})


def test_band_settings_keep_collisions_likely():
    assert (1 - 0.8 / 3.2) ** license_scan.BANDS < 1e-6


# ---- pipeline ----

def test_stages_keep_columns_that_clash(spark):
    own = ["__n_chars", "__set_1", "__set_2", "size", "label"]
    docs = C.table(spark, SMALL, "documents").select("*", *[F.lit(f"own {n}").alias(n) for n in own])
    machine = quality.fit(docs, C.table(spark, SMALL, "labels"))
    for out in (quality.accepted(docs, machine), jaccard.keep_one(docs), secret_scan.redact(docs), mix.mixed(docs)):
        assert out.columns == docs.columns
        row = out.first()
        assert all(row[n] == f"own {n}" for n in own)


def test_pipeline_stages(spark):
    docs = C.table(spark, SMALL, "documents")
    names = docs.columns
    good = C.stored(P.quality_stage(spark, docs, SMALL), "t")
    scored = {r.doc_id: r.predicted for r in Q.op8_quality_classifier(spark, SMALL).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scored.items() if p == 1}
    one = C.stored(P.near_duplicate_stage(spark, good, SMALL), "t")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted({c for _, _, c in brute_components(rows)})
    clean = C.stored(P.secret_stage(spark, one, SMALL), "t")
    assert {r.doc_id: r.text for r in clean.collect()} == {r.doc_id: secret_scan.masked(r.text, "[SECRET]") for r in one.collect()}
    mixed = C.stored(P.mixing_stage(spark, clean, SMALL), "t")
    assert good.columns == one.columns == clean.columns == mixed.columns == names
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    assert all(times[r.doc_id] * r["size"] == r.taken for r in mix.taken(clean).collect() if r["size"])
    out = P.token_stage(spark, mixed, SMALL).collect()
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.TOKENIZER)
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert len(out) == sum(times.values())
    for r in out:
        assert list(r.ids) == t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert P.run(spark, SMALL).count() == len(out)


def test_stages_take_empty_tables(spark):
    docs = C.table(spark, SMALL, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
