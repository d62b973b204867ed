"""Secret scan with structural confirmation.

Base patterns (each leftmost and non-overlapping within its kind; matches that fail the length rule are
dropped): ``assign`` (a named value), ``access`` (an access-key id) and ``hex``. They are reported as they are.

Further candidates are base64 or hex runs. They are reported only when decoding confirms a structure:

* ``jwt``  three base64url parts; the header is a JSON object with a text ``alg``, the payload a JSON object;
* ``der``  base64 (also over several lines, as in PEM) or hex whose nested tag-length-value lengths fit exactly
  and whose outline is that of a private key (RSA, EC, PKCS#8 or encrypted PKCS#8);
* ``ssh``  an OpenSSH private key: magic, then length-prefixed fields that fit exactly.

A base64 structure ends where its own outer length says, whatever lines follow; there its line, or the run, must end. Lines are joined
over a line end or its escape (a backslash and n, as in JSON) with blanks around it, in base64 and in hex; a first line may be short. In hex
with stray digits beside it the structure is looked for from every place that may start one. A run is joined once and
read at any place, and only the headers of nested lengths are decoded, so the time is linear in the text however many places may
start a structure and whatever lengths they state.

Offsets are code points, the end exclusive. Null text counts as empty; texts are scanned whole; a row in is a
row out, repeated and null keys included; a document without secrets has an empty span list.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BASE64URL = re.compile(r"[A-Za-z0-9_-]+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]+")
JOINT = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*")
#: First characters of a DER sequence and of the OpenSSH magic; a letter or digit before them is part of another word, but for an
#: escaped line end.
HEAD = re.compile(r"M[A-P](?:(?<![A-Za-z0-9]..)|(?<=\\n..))|b3Bl(?:(?<![A-Za-z0-9]....)|(?<=\\n....))")
PADDING = re.compile(r"={0,2}")
LEAST = 40  # base64 characters
HEX_BYTES = re.compile(r"[0-9A-Fa-f]+")
HEX_HEAD = re.compile(r"30(?=[0-7]|8[1-4])|6[Ff]70656[Ee]7373682[Dd]")
LEAST_HEX = 64  # digits

INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
SSH_MAGIC = b"openssh-key-v1\x00"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the base patterns."""
    out = []
    if "=" in text or ":" in text:
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def from_base64(run: str) -> bytes | None:
    body = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Chain:
    """The base64 characters or hex digits from a place on, joined over line ends as far as they go."""

    def __init__(self, text: str, start: int, alphabet: re.Pattern):
        self.text, self.hex, self.parts, self.before = text, alphabet is HEX_BYTES, [], [0]
        m = alphabet.match(text, start)
        while m:
            self.parts.append((m.start(), m.end()))
            self.before.append(self.before[-1] + m.end() - m.start())
            joint = JOINT.match(text, m.end())
            m = joint and alphabet.match(text, joint.end())
        self.start, self.end = start, self.parts[-1][1] if self.parts else start
        self.body = "".join([text[a:b] for a, b in self.parts])

    def offset(self, place: int) -> int:
        """Characters of the chain before a place of the text that lies in it."""
        i = bisect_right(self.parts, (place, len(self.text))) - 1
        return self.before[i] + place - self.parts[i][0]

    def place_after(self, n: int) -> int:
        """Where in the text the chain's first n characters end."""
        i = bisect_left(self.before, n) - 1
        return self.parts[i][0] + n - self.before[i]


class Run:
    """Bytes encoded from a character of a chain on."""

    def __init__(self, chain: Chain, first: int):
        self.chain, self.first = chain, first

    def length(self, n: int) -> int:
        """Characters of n bytes."""
        return 2 * n if self.chain.hex else -(-n * 4 // 3)

    def read(self, at: int, n: int) -> bytes | None:
        """Decoded bytes at .. at + n; None beyond the chain's end."""
        last = self.first + self.length(at + n)
        if last > len(self.chain.body):
            return None
        if self.chain.hex:
            return bytes.fromhex(self.chain.body[self.first + 2 * at:last])
        return from_base64(self.chain.body[self.first + at // 3 * 4:last])[at % 3:]

    def fits(self, n: int) -> bool:
        return self.first + self.length(n) <= len(self.chain.body)

    def stops(self, place: int) -> bool:
        """The line or the run ends here (hex may have stray digits beside it)."""
        return self.chain.hex or BASE64.match(self.chain.text, place) is None or self.chain.text.startswith("-----", place)


#: Members of a key's outer sequence and keys of an OpenSSH file; the formats have at most ten and, so far, one.
MOST_MEMBERS, MOST_KEYS = 16, 64


def element(run: Run, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start and end of the content) of the element at a byte, None if it doesn't lie before ``end``."""
    head = run.read(at, 2) if at + 2 <= end else None
    if head is None:
        return None
    size, at = head[1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        raw = run.read(at, n) if 1 <= n <= 4 and at + n <= end else None
        if raw is None:
            return None
        size, at = int.from_bytes(raw, "big"), at + n
    return (head[0], at, at + size) if at + size <= end else None


def elements(run: Run, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill the bytes at .. end exactly, None if some length doesn't fit or there are more than a key has."""
    out = []
    while at < end:
        found = element(run, at, end)
        if found is None or len(out) == MOST_MEMBERS:
            return None
        out.append(found)
        at = found[2]
    return out


def starts_with_oid(run: Run, sequence: tuple[int, int, int]) -> bool:
    parts = elements(run, *sequence[1:])
    return bool(parts) and parts[0][0] == OID


def private_der(run: Run) -> int | None:
    """Bytes of the private key in DER that starts here: nested lengths fit and the outer members are those of a key."""
    room = 3 * len(run.chain.body)
    top = element(run, 0, room)
    if top is None or top[0] != SEQUENCE or not run.fits(top[2]) or not (parts := elements(run, *top[1:])):
        return None
    tags, size = [p[0] for p in parts], [p[2] - p[1] for p in parts]
    if tags[0] == INTEGER and size[0] == 1:
        if len(tags) >= 6 and all(t == INTEGER for t in tags[:6]):  # RSA: version, modulus, exponents, primes
            key = all(size[1:6])
        elif tags[1:2] == [OCTETS] and run.read(parts[0][1], 1) == b"\x01":  # EC: version 1, key, optional tagged fields
            key = size[1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
        else:  # PKCS#8: version, algorithm, key
            key = tags[1:3] == [SEQUENCE, OCTETS] and starts_with_oid(run, parts[1])
    else:  # encrypted PKCS#8: scheme, ciphertext
        key = tags == [SEQUENCE, OCTETS] and starts_with_oid(run, parts[0]) and size[1] >= 32
    return top[2] if key else None


def private_ssh(run: Run) -> int | None:
    """Bytes of the OpenSSH key that starts here: magic, three strings, a count, that many public keys and one private block."""
    if run.read(0, len(SSH_MAGIC)) != SSH_MAGIC:
        return None
    at = len(SSH_MAGIC)

    def number() -> int | None:
        raw = run.read(at, 4)
        return None if raw is None else int.from_bytes(raw, "big")

    fields = 3
    for counted in (False, True):
        for _ in range(fields):
            if (size := number()) is None or not run.fits(at + 4 + size):
                return None
            at += 4 + size
        if not counted:
            if (size := number()) is None or not 1 <= size <= MOST_KEYS:
                return None
            at, fields = at + 4, size + 1
    return at


def structure_at(chain: Chain, start: int) -> tuple[int, int] | None:
    """(kind index, end) of the confirmed structure whose base64 or hex form starts here."""
    run = Run(chain, chain.offset(start))
    ssh = private_ssh(run)
    size = private_der(run) if ssh is None else ssh
    if size is None or run.length(size) < (LEAST_HEX if chain.hex else LEAST):
        return None
    end = chain.place_after(run.first + run.length(size))
    if not run.stops(end):
        return None
    return KINDS.index("der" if ssh is None else "ssh"), end if chain.hex else PADDING.match(chain.text, end).end()


def is_signed_token(run: str) -> bool:
    parts = []
    for piece in run.split(".")[:2]:
        raw = from_base64(piece)
        try:
            parts.append(json.loads(raw) if raw else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def signed_tokens(text: str) -> Iterator[re.Match]:
    """Matches of JWT. Where one fails, it fails from every place of the same run of characters, so each run is looked at once."""
    at = text.find("eyJ")
    while at >= 0:
        m = JWT.match(text, at) if text.startswith(".", run := BASE64URL.match(text, at).end()) else None
        if m:
            yield m
        at = text.find("eyJ", m.end() if m else run)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(KINDS.index("jwt"), m.start(), m.end()) for m in signed_tokens(text) if is_signed_token(m[0])]
    for head, alphabet in ((HEAD, BASE64), (HEX_HEAD, HEX_BYTES)):
        done, chain = 0, None
        for m in head.finditer(text):  # a key may follow a path or another word without a gap
            if m.start() < done:
                continue
            if chain is None or m.start() >= chain.end:
                chain = Chain(text, m.start(), alphabet)
            if hit := structure_at(chain, m.start()):
                out.append((hit[0], m.start(), hit[1]))
                done = hit[1]
    return out


def find(text: str) -> list[dict]:
    """All spans by start, then kind, then end."""
    spans = sorted((s, k, e) for k, s, e in base_spans(text) + confirmed_spans(text))
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, found array<struct<kind, start, end>>)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches, "text"):
            found = pa.array([find(t) if t else [] for t in b.column("text").to_pylist()], type=ARROW_SPANS)
            yield pa.RecordBatch.from_arrays([b.column("id"), found], ["id", "found"])

    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("found", SPANS)])).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def of(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return scan(docs, id_col, text_col).select(
        id_col, *[of(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` with every span (overlapping ones merged) replaced by ``mark``; ``length_col`` follows a changed
    text. Null stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches, text_col):
            at = b.schema.get_field_index(text_col)
            old = b.column(at).to_pylist()
            new = [t and masked(t, mark) for t in old]
            if length_col is not None:
                i = b.schema.get_field_index(length_col)
                sizes = [n if t is u or t == u else len(u) for n, t, u in zip(b.column(i).to_pylist(), old, new)]
                b = b.set_column(i, b.schema.field(i), pa.array(sizes, type=b.schema.field(i).type))
            yield b.set_column(at, b.schema.field(at), pa.array(new, type=b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, mark: str) -> str:
    out, done = [], 0
    for s in find(text):
        if s["end"] <= done:
            continue
        if s["start"] >= done:
            out += [text[done:s["start"]], mark]
        done = s["end"]
    return "".join([*out, text[done:]]) if done else text
