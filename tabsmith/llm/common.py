"""Helpers shared by the training-data operators: tables, the shared folder, Arrow text handling."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path

_SHIPPED: set[str] = set()

#: Bytes of text that a task turns into numpy arrays at a time.
CHUNK_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't inherit it from the environment (once a session)."""
    sc, home = spark.sparkContext, Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.applicationId in _SHIPPED or any(p and Path(p).resolve() == home for p in known):
        return
    place = tempfile.mkdtemp(prefix="tabsmith-package-")  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    name = __package__.split(".")[0]
    sc.addPyFile(shutil.make_archive(f"{place}/{name}", "zip", home, name))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_uri(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` as a URI that pyarrow.fs can open on any executor."""
    path = shared_path(spark, name)
    return path if "://" in path else "file://" + (path[5:] if path.startswith("file:") else path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array, offsets starting at 0."""
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or len(texts) == 0:
        return np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]


def ascii_lower(texts: pa.Array) -> pa.Array:
    """A-Z in lower case (Arrow's own kernel damages large_string arrays here, so it is done on the bytes)."""
    offsets, data = raw_bytes(texts)
    low = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(low))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` (one row at least; rows stay whole). When a task is done,
    its freed memory goes back to the system, since Python workers stay on for later tasks."""
    try:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            if len(size) == 0:
                continue
            part = np.cumsum(size, dtype=np.int64) // limit
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory of Arrow and of the C library (where it is glibc) to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Runs of characters other than space, tab, LF, VT, FF, CR: (offsets per text, flat words)."""
    texts = pc.ascii_trim_whitespace(ascii_lower(texts) if lower else texts)
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return offsets - offsets[0], lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hash of every word; each distinct word is hashed once."""
    if len(flat) == 0:
        return np.zeros(0, dtype=np.uint64)
    enc = flat.dictionary_encode()
    keys = pd.util.hash_array(enc.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return keys[enc.indices.to_numpy(zero_copy_only=False)]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (uint64 in, uint64 out)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of every (start, length) run, one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores at its end if a column in ``taken`` has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
