"""Exact neighbours, SMOTE and class cuts against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.functions import neighbours as N
from tabsmith.operators import split as E


def _points(seed=0, dims=3):
    """Clusters, a line of near copies, exact copies, far outliers, two classes of unlike size."""
    rng = np.random.default_rng(seed)
    big = np.concatenate([rng.normal(c, s, (n, dims)) for c, s, n in ((0, 1, 300), (50, 0.1, 200), (-20, 5, 100), (1e4, 1, 3))])
    big = np.concatenate([big, np.tile(rng.normal(0, 1, dims), (40, 1)), np.outer(np.arange(30), np.ones(dims)) * 1e-3])
    return [("a", *map(float, x)) for x in big] + [("b", *map(float, x)) for x in rng.normal(0, 1, (7, dims))] + [("c", 1.0, 2.0, 3.0)]


def _brute(points, k):
    out = {}
    for cls in {p["_k"] for p in points}:
        mine = sorted((p for p in points if p["_k"] == cls), key=lambda p: p["_id"])
        x = np.array([p["_x"] for p in mine])
        d = N.distances(x, x)
        np.fill_diagonal(d, np.inf)
        for i, p in enumerate(mine):
            best = np.argsort(d[i], kind="stable")[:min(k, len(mine) - 1)]
            if len(best):
                out[cls, p["_id"]] = [(d[i, j], mine[j]["_id"], mine[j]["_m"]) for j in best]
    return out


@pytest.mark.parametrize("cell,block,k", [(1000, 2000, 5), (20, 7, 5), (5, 3, 1), (50, 1000, 12)])
def test_nearest_equal_brute_force(spark, monkeypatch, cell, block, k):
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "BLOCK", block)
    df = spark.createDataFrame(_points(), "t string, x double, y double, z double").repartition(3)
    points = E.class_points(df, "t", ["x", "y", "z"], ["a", "b", "c"])
    got = {(r["_k"], r["_id"]): [(s["d"], s["id"], s["m"]) for s in r["_near"]] for r in N.nearest(points, k).collect()}
    assert got == _brute(points.collect(), k)


def test_smote_does_not_depend_on_layout_or_settings(spark):
    rows = _points(3)
    schema = "t string, x double, y double, z double"
    made = []
    for parts, width, order in ((1, "8", 1), (7, "3", -1)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            out = E.smote(spark.createDataFrame(rows[::order], schema).repartition(parts), "t")
            made.append(Counter(tuple(r) for r in out.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == made[1]
    counts = Counter()
    for r, n in made[0].items():
        counts[r[0]] += n
    assert counts == {"a": counts["a"], "b": counts["a"], "c": 1}


def test_smote_of_copies(spark, monkeypatch):
    """A point that most rows share makes its share of rows, in parts; two equal rows are each other's neighbours."""
    monkeypatch.setattr(E, "SPREAD", 10)
    rows = [("big", float(i), 0.0) for i in range(500)] + [("hot", 1.0, 1.0)] * 90 + [("hot", 2.0, 2.0)] * 3 + [("two", 5.0, 5.0)] * 2
    out = E.smote(spark.createDataFrame(rows, "t string, x double, y double"), "t")
    assert {r["t"]: r["count"] for r in out.groupBy("t").count().collect()} == {"big": 500, "hot": 500, "two": 500}
    assert out.where("t = 'two' and (x <> 5 or y <> 5)").count() == 0
    assert out.where("t = 'hot' and x = 1").count() > 400  # a copy's five nearest are copies


def test_a_thousand_classes(spark):
    rows = [(i, f"c{i % 1000}", float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, t string, x double")
    train, test = E.train_test_split(df, "t", 0.34, key="id")
    assert {r["count"] for r in test.groupBy("t").count().collect()} == {2} and train.count() == 4000
    folds = E.add_fold(df, 3, "t", key="id").groupBy("t", "fold").count().collect()
    assert len(folds) == 3000 and {r["count"] for r in folds} == {2}
    assert E.stratified_sample(df, "t", 2000, key="id").groupBy("t").count().where("count = 2").count() == 1000
    more = df.unionByName(df.where("t = 'c7'").withColumn("x", F.col("x") + 0.5))
    out = E.smote(more, "t", ["x"])
    assert {r["count"] for r in out.groupBy("t").count().collect()} == {12}
    with pytest.raises(ValueError):
        E.train_test_split(df, "id", 0.2)
