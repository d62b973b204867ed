"""Physical-plan properties: filters and columns reach the Parquet scan; heavy expressions run once."""

from pyspark.sql import functions as F

from tabsmith.operators import features as FE
from tabsmith.operators import profile as P
from tabsmith.plans import frames as FR

from conftest import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_projection_reach_the_scan(spark):
    li = FR.table(spark, SMALL, "lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey", "l_quantity")
    plan = _plan(li)
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan


def test_profile_reads_only_profiled_columns(spark):
    ev = FR.table(spark, SMALL, "events")
    plan = _plan(P.skewness_table(ev, ["value"]))
    assert "ReadSchema: struct<value:double>" in plan


def test_labels_join_is_broadcast(spark):
    plan = _plan(FR.labelled_docs(spark, SMALL))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_running_sum_window_is_partitioned_by_bucket(spark):
    from tabsmith.functions.cumulative import running_sums, top_k_per_group
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("v"), F.lit(1).alias("n"))
    counts = df.groupBy("v").agg(F.sum("n").alias("n"))
    windows = [ln for ln in _plan(running_sums(counts, "v", ["n"], buckets=8)).splitlines() if "Window " in ln]
    assert windows and all("_bucket" in ln for ln in windows)
    top = top_k_per_group(df.withColumn("g", F.lit(1)), ["g"], [F.col("v").desc()], 3, spread_key=["v"])
    assert any("_spread" in ln for ln in _plan(top).splitlines() if "Window " in ln)


def test_tfidf_tokenises_once_per_document(spark):
    docs = FR.table(spark, SMALL, "documents").select("doc_id", "text")
    tf = FE.TfidfFeatures(col="text", key="doc_id")
    tf.vocab, tf.idf = ["de", "el", "la"], {"de": 1.0, "el": 2.0, "la": 3.0}
    plan = tf.transform_long(docs, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
