"""Scale guards on the physical plans of every registered query.

* no Cartesian product or nested-loop join (no pair generation);
* no Python UDF evaluation of any kind (everything stays in the JVM);
* no window without a partition key (it would run in a single task);
* no broadcast hint except the bounded quantile offset table.
"""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.queries())
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def single_task_windows(plan: str) -> int:
    """Windows whose input is gathered into one partition (no partition key)."""
    lines = plan.splitlines()
    hits = 0
    for i, line in enumerate(lines):
        if "Window [" in line:
            below = lines[i + 1 : i + 3]
            hits += any("Exchange SinglePartition" in b for b in below)
    return hits


def test_detector_flags_unpartitioned_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    bad = spark.range(5).withColumn("s", F.sum("id").over(Window.orderBy("id")))
    good = spark.range(5).withColumn("s", F.sum("id").over(Window.partitionBy("id").orderBy("id")))
    assert single_task_windows(plan_text(bad)) == 1
    assert single_task_windows(plan_text(good)) == 0


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_forbidden_operators(spark, name):
    plan = plan_text(E.queries()[name](spark, SF))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"
    assert single_task_windows(plan) == 0, f"{name} has an unpartitioned window"
