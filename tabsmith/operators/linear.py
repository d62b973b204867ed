"""Leave-a-fold-out linear fits (F7, F8 in F12, F15, F23) from one Gramian per fold.

One pass over the table gives every fold's moment matrix (counts, sums and products of intercept, features and target). The
training moments of a fold are the sum of all minus its own, so k folds and any number of penalties cost one pass; the held-out
score follows from the fold's own moments. Features are the preprocessor's: numerics standardised by the training rows' mean and
n-1 deviation, one column per level of a string feature that occurs in the training rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import c
from ..functions.gramian import group_moments

MAX_WIDTH = 500       # columns of a moment matrix
LINEAR = ("LinearRegression", "Ridge", "Lasso")
SCORES = ("rmse", "r2")
SWEEPS, TOLERANCE = 10_000, 1e-12  # coordinate descent of the lasso


def moments(folded: DataFrame, t: str, num: Sequence[str], cat: Sequence[str], fold: str = "fold"
            ) -> tuple[dict[int, np.ndarray], int] | None:
    """({fold: moments of [1, numerics, levels, target]}, number of numerics), None where the closed form doesn't serve: incomplete
    rows or more than MAX_WIDTH columns."""
    levels: list[tuple[str, str]] = []
    for x in cat:
        found = folded.select(c(x).alias("v")).distinct().limit(MAX_WIDTH + 1).collect()
        if len(found) + len(levels) + len(num) > MAX_WIDTH or any(r["v"] is None for r in found):
            return None
        levels += [(x, r["v"]) for r in found]
    exprs = [F.lit(1.0), *[c(x).cast("double") for x in num], *[(c(x) == F.lit(v)).cast("double") for x, v in levels], c(t).cast("double")]
    at = [1 + i for i in range(len(num))] + [len(exprs) - 1]
    out = group_moments(folded, exprs, fold, shifted=at)
    return (out, len(num)) if out and all(np.isfinite(m).all() for m in out.values()) else None


def solve(m: np.ndarray, n_num: int, name: str, alpha: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients in the moments' units) of the fit on rows with moments ``m``."""
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    gram = m[1:-1, 1:-1] - n * np.outer(mean, mean)
    y_mean = m[0, -1] / n
    xy = m[1:-1, -1] - n * mean * y_mean
    scale = np.ones(len(mean))
    if n > 1:
        scale[:n_num] = np.sqrt(np.maximum(np.diag(gram)[:n_num], 0) / (n - 1))
    # a column without variance over the training rows has no coefficient (a level that doesn't occur, a constant)
    used = np.diag(gram) > 1e-12 * np.maximum(np.diag(m)[1:-1], 1e-300)
    g, v, s = gram[np.ix_(used, used)], xy[used], scale[used]
    g, v = g / np.outer(s, s), v / s
    if name == "LinearRegression":
        b = np.linalg.lstsq(g, v, rcond=1e-12)[0]
    elif name == "Ridge":
        b = np.linalg.solve(g + alpha * np.eye(len(g)), v) if len(g) else v
    else:
        b, limit = np.zeros(len(g)), n * alpha
        for _ in range(SWEEPS):
            moved = 0.0
            for j in range(len(g)):
                rest = v[j] - g[j] @ b + g[j, j] * b[j]
                new = np.sign(rest) * max(abs(rest) - limit, 0.0) / g[j, j]
                moved, b[j] = max(moved, abs(new - b[j]) * np.sqrt(g[j, j])), new
            if moved <= TOLERANCE * max(1.0, np.sqrt(max(m[-1, -1] - n * y_mean**2, 0))):
                break
    coef = np.zeros(len(mean))
    coef[used] = b / s
    return y_mean - mean @ coef, coef


def held_out(m: np.ndarray, intercept: float, coef: np.ndarray) -> dict[str, float | None]:
    """rmse and r2 (1 - SSE/SST) on rows with moments ``m``."""
    b = np.concatenate([[intercept], coef, [-1.0]])
    n, sse = m[0, 0], max(float(b @ m @ b), 0.0)
    sst = m[-1, -1] - m[0, -1] ** 2 / n
    return {"rmse": float(np.sqrt(sse / n)), "r2": float(1 - sse / sst) if sst > 0 else None}


def fold_scores(folded: DataFrame, t: str, num: Sequence[str], cat: Sequence[str], jobs: Sequence[tuple[str, float]], metric: str
                ) -> list[dict[int, float | None]] | None:
    """{fold: score} of every (learner, alpha), each fold scored by the fit on the others; None where the closed form doesn't serve."""
    found = moments(folded, t, num, cat)
    if found is None:
        return None
    by_fold, n_num = found
    whole = sum(by_fold.values())
    return [{f: held_out(m, *solve(whole - m, n_num, name, alpha))[metric] for f, m in by_fold.items()} for name, alpha in jobs]
