"""Where lineage is cut."""

import pytest

from careflow.session import cut_lineage, ensure_checkpoint_dir


def test_named_folder_is_used_and_rows_are_kept(spark):
    folder = ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert folder == named.rstrip("/")
    assert ensure_checkpoint_dir(spark) == folder
    out = cut_lineage(spark.range(10).selectExpr("id", "cast(id as string) as s"))
    assert out.count() == 10 and out.columns == ["id", "s"]
    assert all(folder in path for path in out.inputFiles())


@pytest.mark.parametrize("name", ["movements", "census_ledger", "flow_edges"])
def test_plans_stay_on_the_jvm_without_cross_joins(spark, name):
    from __spark_entry__ import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
