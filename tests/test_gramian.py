"""Masked Gramian against pandas' pairwise correlations."""

import time

import numpy as np
import pandas as pd
import pytest

from tabsmith.functions import gramian as G
from tabsmith.operators import profile as P


def _table(rows, cols, seed=0, gaps=0.1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((rows, cols)) @ rng.standard_normal((cols, cols)) + rng.standard_normal(cols) * 1e6
    x[rng.random((rows, cols)) < gaps] = np.nan
    return pd.DataFrame(x, columns=[f"c.{i}" for i in range(cols)])


def _matches(got, pdf, atol=1e-7):
    want = pdf.corr().to_numpy()
    at = {n: i for i, n in enumerate(pdf.columns)}
    assert len(got) == len(pdf.columns) * (len(pdf.columns) - 1) // 2
    for a, b, r in got[["a", "b", "r"]].itertuples(index=False):
        assert at[a] < at[b]
        w = want[at[a], at[b]]
        assert (np.isnan(w) and pd.isna(r)) or abs(w - r) < atol, (a, b, w, r)


@pytest.mark.parametrize("side,cells", [(64, 1 << 22), (3, 1 << 22), (2, 8)])
def test_pairs_with_gaps_equal_pandas(spark, monkeypatch, side, cells):
    monkeypatch.setattr(G, "SIDE", side)
    monkeypatch.setattr(G, "PASS_CELLS", cells)
    pdf = _table(400, 9)
    pdf["const"] = 5.1
    pdf["empty"] = np.nan
    pdf.loc[pdf.index[3:], "few"] = 1.0
    pdf.loc[:2, "few"] = [2.0, 4.0, 3.0]
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"`{n}` double" for n in pdf.columns)).repartition(5)
    _matches(P.correlation_matrix(df).toPandas(), pdf)


def test_500_columns_with_gaps_in_one_pass(spark):
    pdf = _table(300, 500, seed=1)
    df = spark.createDataFrame(pdf).repartition(4)
    t0 = time.time()
    got = P.correlation_matrix(df).toPandas()
    assert time.time() - t0 < 120
    _matches(got, pdf, 1e-6)


def test_narrow_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert [tuple(r) for r in P.correlation_matrix(df).collect()] == [("a", "b", None)]
    assert P.correlation_matrix(df.limit(0)).count() == 0
    assert P.correlation_matrix(df.select("a")).count() == 0
