"""String features of very many levels reach no index: shares of rows instead, in a model that saves and loads."""

import pytest
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import functions as F

from tabsmith.operators import models as M
from tabsmith.operators.frequency import FrequencyCoder, FrequencyCoderModel
from tabsmith.plans import stages as S
from tabsmith.plans.rules import build_plan
from tabsmith.session import shared_path

SETTINGS = {"maxIter": 20, "C": 1.0}


def frame(spark, n=3000, *keys):
    """``tag`` has a level of its own for two rows of three; the third ones share 'hot' and are positive more often."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(*keys,
        F.when(hot, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("tag"),
        F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("kind"),
        (hot & (F.col("id") % 7 != 0)).cast("int").alias("y"))


def test_shares_equal_a_count(spark):
    df = frame(spark)
    model = FrequencyCoder(inputCol="tag", outputCol="s").fit(df)
    want = {r["tag"]: r["n"] / 3000 for r in df.where("tag is not null").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = model.transform(df).select("tag", "s").distinct().collect()
    assert {r["tag"]: r["s"] for r in got} == pytest.approx({**want, None: 0.0})
    unseen = model.transform(spark.createDataFrame([("new",), (None,)], "tag string")).collect()
    assert [r["s"] for r in unseen] == [0.0, 0.0]


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "tag string")
    model = FrequencyCoder(inputCol="tag", outputCol="s").fit(df)
    rows = spark.createDataFrame([("x", 1.0, 2.0)], "tag string, level double, share double")
    out = model.transform(rows).first()
    assert out["s"] == 0.0 and (out["level"], out["share"]) == (1.0, 2.0)


def test_only_narrow_columns_are_indexed(spark):
    df = frame(spark)
    assert M.wide_strings(df, ["tag", "kind"]) == ["tag"]
    assert M.wide_strings(df, ["tag", "kind"], limit=1) == ["tag", "kind"]
    model = M.model_pipeline(df, "y", "LogisticRegression", "binary_classification", SETTINGS).fit(df)
    assert [s.getInputCol() for s in model.stages if isinstance(s, StringIndexerModel)] == ["kind"]
    assert M.feature_importance(model, 1).first()["feature"] == "tag_share"
    assert M.metric_value(M.evaluate(model, df, "y", "binary_classification"), "roc_auc") > 0.9


def test_a_saved_model_carries_its_levels(spark):
    df = frame(spark)
    model = M.model_pipeline(df, "y", "LogisticRegression", "binary_classification", SETTINGS).fit(df)
    path = M.save_pipeline(model, shared_path(spark, "wide-model"), threshold=0.5)
    want = sorted(r["score"] for r in M.predictions(model, df, "y").collect())
    assert sorted(r["score"] for r in M.score(df, path).collect()) == pytest.approx(want)
    again = M.save_pipeline(model, path, threshold=0.5)  # written over
    loaded = M.PipelineModel.load(again)
    assert isinstance(loaded.stages[0], FrequencyCoderModel) and loaded.stages[0].levels.count() == model.stages[0].levels.count()


def test_folds_take_wide_columns(spark):
    scores = M.cross_validate(frame(spark, 3000, "id"), "y", "LogisticRegression", "binary_classification", 3, "roc_auc", SETTINGS,
                              key="id").collect()
    assert len(scores) == 3 and all(r["score"] > 0.9 for r in scores)


def test_missing_flags_of_the_composed_run_show_the_raw_gaps(spark):
    n = 2000
    df = spark.range(n).select(
        F.when(F.col("id") % 100 == 0, F.lit(None)).otherwise((F.col("id") * 37 % 101).cast("double")).alias("few"),
        F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise((F.col("id") * 31 % 97).cast("double")).alias("some"),
        (F.col("id") * 17 % 89).cast("double").alias("whole"),
        (F.col("id") % 12 == 0).cast("int").alias("y"))
    plan = build_plan(df, "y")
    assert plan.missing_flags
    fitted, cleaned = S.Cleaner(plan, drop_duplicates=False).fit(df)
    assert cleaned.agg(F.sum("few_was_missing")).first()[0] == n // 100
    assert cleaned.agg(F.sum("some_was_missing")).first()[0] == n // 10
    assert "whole_was_missing" not in cleaned.columns
    replay = fitted.transform(spark.createDataFrame([(None, 1.0, 2.0, 0), (3.0, None, 2.0, 1)], df.schema))
    assert sorted((r["few_was_missing"], r["some_was_missing"]) for r in replay.collect()) == [(0, 1), (1, 0)]
    assert "few" in {r["column"] for r in fitted.log(spark).where("action = 'missing_flag'").collect()}
