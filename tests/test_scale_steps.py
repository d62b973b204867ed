"""Steps that grow with the table: what they read at once, how often whole rows move, what their results are read from."""

from __future__ import annotations

import datetime
import decimal

import pyarrow as pa
from pyspark.sql import functions as F

from tabsmith.functions import terms
from tabsmith.functions.aggregates import exact_distinct
from tabsmith.operators import models as M
from tabsmith.plans import presets as PR
from tabsmith.plans import stages as S
from tabsmith.plans.rules import build_plan


def test_few_rows_of_a_large_input_are_made_by_many_tasks(spark):
    made = spark.range(0, 800, numPartitions=8).withColumn("by", F.spark_partition_id())
    few = M.compact(made, 800)
    assert few.rdd.getNumPartitions() == 1
    assert few.select("by").distinct().count() == 8


def test_partitions_grow_with_the_rows(spark):
    parts = [M.compact(spark.range(10), n).rdd.getNumPartitions() for n in (0, 1, 50_001, 3_000_000, 30_000_000)]
    assert parts == [1, 1, 2, 12, 120]


def test_cleaner_moves_whole_rows_once(spark, monkeypatch):
    rows = [(i % 40, float(i % 7) if i % 5 else None, "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "x int, y double, t string")
    plans = []
    cut = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().withCachedData().toString()) or cut(d))
    fitted, cleaned = S.Cleaner(build_plan(df, "t")).fit(df)
    assert cleaned.count() == cleaned.distinct().count() < 200
    above = plans[-1].split("InMemoryRelation")[0]
    assert "InMemoryRelation" in plans[-1] and "Aggregate" not in above and "Deduplicate" not in above


def test_distinct_counts_hash_numbers_as_they_are(spark):
    day, d = datetime.date(2024, 1, 1), decimal.Decimal
    rows = [(1, 0.0, "a", day, d("1.10"), True), (1, -0.0, "", day, d("1.1"), False), (None, float("nan"), None, None, d("2"), None),
            (2, float("nan"), "a", day, None, True), (2, None, "b", day, None, True)]
    df = spark.createDataFrame(rows, "i int, x double, s string, d date, m decimal(5,2), b boolean")
    got = exact_distinct(df, df.columns)
    assert {r["column"]: r["n_unique"] for r in got.collect()} == {"i": 2, "x": 3, "s": 3, "d": 1, "m": 2, "b": 2}
    plan = exact_distinct(df.select("i", "b"), ["i", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "as string" not in plan


def test_term_counts_hold_few_tokens_at_once(monkeypatch):
    monkeypatch.setattr(terms, "TOKENS_AT_ONCE", 4)
    texts = [["a", "b", "a"], [], ["b"], [], ["a"] * 9, ["c", "b"], ["c", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.list_(pa.string()))], names=["tokens"])
    got = [b.to_pydict() for b in terms.batch_term_counts(iter([batch]))]
    assert [sum(b["total"]) for b in got] == [4, 9, 4]
    total, df = {}, {}
    for b in got:
        for t, n, k in zip(b["term"], b["total"], b["df"]):
            total[t], df[t] = total.get(t, 0) + n, df.get(t, 0) + k
    assert total == {"a": 11, "b": 3, "c": 3} and df == {"a": 2, "b": 3, "c": 2}


def test_probability_metrics_read_written_scores(spark):
    df = spark.range(120).select((F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 3 + F.col("id") % 7).cast("double").alias("x"))
    out, curves = PR.evaluate_many({"t": (df, "y", [])}, params={"maxIter": 2, "maxDepth": 2, "stepSize": 0.1})
    for frame in (out, curves):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "UDF" not in plan and "Range" not in plan
    assert {r["metric"] for r in out.collect()} >= {"f1_binary", "pr_auc"}
