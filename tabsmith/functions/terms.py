"""Term counts of tokenised texts, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


TOKENS_AT_ONCE = 1 << 18  # tokens whose codes are held at once; a single longer text goes by itself


def _slices(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Consecutive rows of ``lists`` that hold at most TOKENS_AT_ONCE tokens together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(lists):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + TOKENS_AT_ONCE, side="right")))
        yield lists.slice(start, stop - start)
        start = stop


def batch_term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, total, df) of some rows of token lists at a time: how often a term occurs, and in how many rows. Batches are cut by
    their tokens, so that memory doesn't grow with the length of the texts."""
    for lists in (part for batch in batches for part in _slices(batch.column(0))):
        terms = lists.flatten().dictionary_encode()
        width = len(terms.dictionary)
        if not width:
            continue
        code = terms.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        pairs = pa.array(row * width + code).unique().to_numpy()  # each pair of row and term once
        yield pa.RecordBatch.from_arrays(
            [terms.dictionary, pa.array(np.bincount(code, minlength=width)), pa.array(np.bincount(pairs % width, minlength=width))],
            names=["term", "total", "df"])
