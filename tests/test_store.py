"""The stage store restores finished stages, and only those."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tabsmith.session import shared_path
from tabsmith.sources import store as S


def _run(spark, root, path, calls, fail=False, limit=5):
    def keep(df):
        calls.append("keep")
        return df.where(F.col("id") >= limit)

    def total(df):
        calls.append("total")
        if fail:
            raise RuntimeError("lost")
        return df.agg(F.sum("id").alias("total"))

    return S.run_stages(S.StageStore(spark, root), spark.read.parquet(path), S.source_key(spark, path),
                        [("keep", keep, {"limit": limit}), ("total", total, {})])


def test_a_run_after_a_failed_one_skips_finished_stages(spark):
    root, path, calls = shared_path(spark, "store"), shared_path(spark, "in"), []
    spark.range(10).write.parquet(path)
    with pytest.raises(RuntimeError):
        _run(spark, root, path, calls, fail=True)
    assert calls == ["keep", "total"]
    second = _run(spark, root, path, calls)
    assert calls[2:] == ["total"] and [s.restored for s in second] == [True, False] and second[1].rows.first()[0] == 35
    third = _run(spark, root, path, calls)
    assert calls[3:] == [] and all(s.restored for s in third) and third[1].rows.first()[0] == 35
    assert third[0].rows.schema == spark.range(1).schema or third[0].rows.columns == ["id"]


def test_other_inputs_parameters_and_damage_are_built_anew(spark):
    root, path, calls = shared_path(spark, "store"), shared_path(spark, "in"), []
    spark.range(10).write.parquet(path)
    _run(spark, root, path, calls)
    assert _run(spark, root, path, calls, limit=8)[1].rows.first()[0] == 17
    spark.range(12).write.mode("overwrite").parquet(path)
    assert _run(spark, root, path, calls)[1].rows.first()[0] == 56
    calls.clear()
    part = next(p for p in glob.glob(f"{root}/keep/*/data-*/part-*") if os.path.getsize(p))
    with open(part, "ab") as f:  # bytes that the manifest doesn't list
        f.write(b"x")
    _run(spark, root, path, calls)
    _run(spark, root, path, calls, limit=8)
    _run(spark, root, path, calls)
    assert calls.count("keep") <= 1


def test_half_written_stages_are_ignored(spark):
    root, path = shared_path(spark, "store"), shared_path(spark, "in")
    spark.range(10).write.parquet(path)
    store, key = S.StageStore(spark, root), S.source_key(spark, path)
    name = S.stage_key("keep", [key], {})
    spark.range(99).write.parquet(f"{root}/keep/{name}/data-half")
    os.makedirs(f"{root}/keep/{name}", exist_ok=True)
    with open(f"{root}/keep/{name}/draft-half", "w") as f:
        f.write('{"data": ')
    done = store.stage("keep", lambda: spark.read.parquet(path), [key], {})
    assert not done.restored and done.rows.count() == 10
    assert store.stage("keep", lambda: 1 / 0, [key], {}).rows.count() == 10
