"""Metamorphic properties on the provided tables: layout, duplication and affine maps."""

import math

from pyspark.sql import functions as F

from tabsmith.functions.quantiles import exact_quantiles
from tabsmith.operators import profile as P
from tabsmith.operators import split as E
from tabsmith.plans import frames as FR

from conftest import SMALL


def test_partition_count_does_not_change_profile(spark):
    li = FR.table(spark, SMALL, "lineitem")
    a = {r["column"]: (r["n_missing"], r["n_unique"]) for r in P.profile(li).collect()}
    b = {r["column"]: (r["n_missing"], r["n_unique"]) for r in P.profile(li.repartition(7)).collect()}
    assert a == b


def test_duplicating_rows_keeps_median_and_correlation(spark):
    li = FR.table(spark, SMALL, "lineitem")
    twice = li.unionByName(li)
    assert exact_quantiles(li, ["l_quantity"], [0.5]) == exact_quantiles(twice, ["l_quantity"], [0.5])
    r1 = P.correlation_matrix(li, ["l_quantity", "l_extendedprice"]).first()["r"]
    r2 = P.correlation_matrix(twice, ["l_quantity", "l_extendedprice"]).first()["r"]
    assert math.isclose(r1, r2, rel_tol=1e-9)


def test_affine_map_keeps_abs_correlation(spark):
    df = FR.doc_features(spark, SMALL)
    moved = df.withColumn("n_words", -3.0 * F.col("n_words") + 7.0)
    a = {r["column"]: r["abs_r"] for r in P.target_correlations(df, "quality", ["n_words"], digits=6).collect()}
    b = {r["column"]: r["abs_r"] for r in P.target_correlations(moved, "quality", ["n_words"], digits=6).collect()}
    assert a == b


def test_split_independent_of_layout_and_disjoint(spark):
    docs = FR.labelled_docs(spark, SMALL).select("doc_id", "quality")
    a = E.test_flag(docs, "quality", stratify=True, key="doc_id").where("is_test").select("doc_id")
    b = E.test_flag(docs.repartition(5), "quality", stratify=True, key="doc_id").where("is_test").select("doc_id")
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())
    train, test = E.train_test_split(docs, "quality", key="doc_id")
    assert train.join(test, "doc_id").count() == 0
    assert train.count() + test.count() == docs.count()


def test_stratified_cuts_are_order_statistics(spark):
    docs = FR.labelled_docs(spark, SMALL).select("doc_id", "quality").withColumn("_h", E.row_hash(FR.labelled_docs(spark, SMALL), "doc_id"))
    rows = docs.unionByName(docs.where("quality = 0")).collect()  # one class has every hash twice
    by = {}
    for r in rows:
        by.setdefault(r["quality"], []).append(r["_h"])
    ranks = {q: [0, len(h) // 3, len(h) - 1] for q, h in by.items()}
    got = E._class_cuts(docs.unionByName(docs.where("quality = 0")), "quality", "_h", ranks)
    assert {key: value for key, (value, _) in got.items()} == {(q, r): sorted(by[q])[r] for q, rs in ranks.items() for r in rs}
    assert all(left == r - sorted(by[q]).index(value) for (q, r), (value, left) in got.items())


def test_nested_learning_subsets(spark):
    li = FR.table(spark, SMALL, "lineitem").select("l_orderkey", "l_linenumber")
    sub = E.learning_subsets(li, key=["l_orderkey", "l_linenumber"])
    counts = [sub.where(F.col("subset") <= i).count() for i in range(6)]
    assert counts == sorted(counts) and counts[-1] == li.count()


def test_smote_rows_lie_between_minority_points(spark):
    feats = ["n_chars", "n_words"]
    df = FR.doc_features(spark, SMALL).select("quality", *feats)
    out = E.smote(df, "quality", feats)
    counts = {r["quality"]: r["count"] for r in out.groupBy("quality").count().collect()}
    assert len(set(counts.values())) == 1
    minority = df.groupBy("quality").count().orderBy("count").first()["quality"]
    box = df.where(F.col("quality") == minority).agg(*[F.min(x).alias(f"lo_{x}") for x in feats],
                                                      *[F.max(x).alias(f"hi_{x}") for x in feats]).first()
    synth = out.where(F.col("quality") == minority)
    for x in feats:
        assert synth.where((F.col(x) < box[f"lo_{x}"] - 1e-9) | (F.col(x) > box[f"hi_{x}"] + 1e-9)).count() == 0


def test_smote_raises_every_class_and_makes_up_nothing(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    rows = [("big", float(x), float(y)) for x, y in rng.normal(size=(60, 2))]
    rows += [("mid", 10 + float(x), float(y)) for x, y in rng.normal(size=(17, 2))] + [("mid", None, 1.0), ("mid", float("nan"), 2.0)]
    rows += [("low", float(x), 20 + float(y)) for x, y in rng.normal(size=(7, 2))] + [("lone", 5.0, 5.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "label string, x double, y double")
    out = E.smote(df, "label", ["x", "y"])
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"big": 60, "mid": 60, "low": 60, "lone": 1, None: 1}
    for name in ("mid", "low"):
        real = np.array([(x, y) for c, x, y in rows if c == name and x is not None and x == x])
        made = [(r.x, r.y) for r in out.where(F.col("label") == name).exceptAll(df.where(F.col("label") == name)).collect()]
        for p in made:  # on a segment between two real rows
            a, d = real[:, None, :], real[None, :, :] - real[:, None, :]
            u = np.clip(((np.array(p) - a) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-12), 0, 1)
            assert np.abs(a + u[..., None] * d - np.array(p)).sum(-1).min() < 1e-6
