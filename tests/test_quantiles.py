"""PRF-5: exact quartiles whatever the values' frequencies are."""

import math
import random

import numpy as np
import pytest

from ordermart.operators import profile as P


def shapes(n):
    rnd = random.Random(n)
    return {
        "flag": [k % 2 for k in range(n)],
        "rare_flag": [int(k % 97 == 0) for k in range(n)],
        "three": [k % 3 for k in range(n)],
        "score": [1 + k % 5 for k in range(n)],
        "quarter": [int(4 * k >= n) for k in range(n)],  # the first quartile's rank lies on the step
        "quarter_less": [int(4 * k > n) for k in range(n)],
        "constant": [7.5] * n,
        "distinct": rnd.sample(range(10 * n), n),
        "normal": [rnd.gauss(0, 1) for _ in range(n)],
        "heavy": [5.0 if k % 3 else rnd.random() * 10 for k in range(n)],
        "two_heavy": [(1.0, 2.0, rnd.random() * 3)[k % 3] for k in range(n)],
        "tail": [math.exp(rnd.random() * 300) for _ in range(n)],
        "gaps": [None if k % 2 else k for k in range(n)],
        "empty": [None] * n,
        "one": [3.0 if k == 0 else None for k in range(n)],
    }


def frame(spark, columns):
    rows = list(zip(*[[None if v is None else float(v) for v in c] for c in columns.values()], strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)


@pytest.mark.parametrize(("n", "most"), [(1201, 1), (1200, 10), (1202, 100), (1199, None), (3, 1), (1, 1)])
def test_quartiles_equal_numpy(spark, n, most):
    columns = shapes(n)
    got = {r.column_name: r for r in P.numeric_summary(frame(spark, columns), nd=9, most=most).collect()}
    for c, values in columns.items():
        values = [v for v in values if v is not None]
        assert got[c]["count"] == len(values), c
        if not values:
            assert got[c].p25 is None and got[c].p75 is None
            continue
        if c == "tail":
            continue  # beyond the digits that reports are rounded to
        want = np.percentile(np.array(values, float), [25, 50, 75])
        assert (got[c].p25, got[c].p50, got[c].p75) == pytest.approx(tuple(want), abs=1e-8), c


def test_values_of_every_size_are_selected(spark):
    columns = {"tail": shapes(3000)["tail"]}
    df = frame(spark, columns)
    got = P._select_ranks(df, ["tail"], (0.0, 0.25, 0.5, 0.99, 1.0), 5)
    assert tuple(got.values()) == pytest.approx(tuple(np.percentile(columns["tail"], [0, 25, 50, 99, 100])))


def test_many_rows_of_few_values_end(spark):
    # Each of these has ranks between two values that hold most rows.
    df = spark.range(400_000).selectExpr("cast(id % 2 as int) AS flag", "id % 3 AS three", "if(id < 100000, 0, 1) AS step", "if(id <= 100000, 0, 1) AS step_more")
    got = {r.column_name: (r.p25, r.p50, r.p75) for r in P.numeric_summary(df, most=1000).collect()}
    assert got == {"flag": (0, 0.5, 1), "three": (0, 1, 2), "step": (0.75, 1, 1), "step_more": (0, 1, 1)}


def test_infinite_and_undefined_numbers(spark):
    values = [float("nan"), float("inf"), -float("inf"), 1.0, 1.0, -0.0, 0.0, 2.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for most in (1, 100):
        assert P._select_ranks(df, ["x"], (0.5,), most)["x", 0.5] == 1.0  # eight numbers; NaN is the largest
