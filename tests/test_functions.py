"""Column-function semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ordermart.functions import (
    BUCKET_LABELS,
    day_of_week,
    dp,
    pct,
    safe_corr,
    severity_bucket,
    trunc_ts,
    whole_days,
)


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_whole_days_floors(spark):
    # Delivered 12:00 vs estimate next day 00:00 is -1 day, not 0.
    rows = [
        (ts("2024-01-01 12:00:00"), ts("2024-01-02 00:00:00")),
        (ts("2024-01-02 00:00:00"), ts("2024-01-02 00:00:00")),
        (ts("2024-01-02 23:00:00"), ts("2024-01-02 00:00:00")),
        (ts("2024-01-03 00:00:00"), ts("2024-01-02 00:00:00")),
        (None, ts("2024-01-02 00:00:00")),
    ]
    df = spark.createDataFrame(rows, "d timestamp_ntz, e timestamp_ntz")
    got = [r[0] for r in df.select(whole_days("d", "e")).collect()]
    assert got == [-1, 0, 0, 1, None]


def test_round_half_away_from_zero(spark):
    # Decimals round half away from zero.
    df = spark.createDataFrame([(2.345,), (-2.345,), (1.005,)], "x double")
    got = [r[0] for r in df.select(dp("x")).collect()]
    assert got == [2.35, -2.35, 1.01]


def test_pct_guards_zero_denominator(spark):
    # A zero denominator gives null, not an exception.
    df = spark.createDataFrame([(1, 3), (2, 0), (1, 8)], "n long, d long")
    got = [r[0] for r in df.select(pct("n", "d")).collect()]
    assert got == [33.33, None, 12.5]


def test_rounds_once_at_large_counts(spark):
    df = spark.createDataFrame([(1_234_499_999, 10_000_000_000), (1_234_500_000, 10_000_000_000), (10**17 // 3, 10**17)], "n long, d long")
    assert [r[0] for r in df.select(pct("n", "d")).collect()] == [12.34, 12.35, 33.33]
    big = spark.createDataFrame([(1.5e13 + 0.125,), (3e24,), (4e30,), (None,)], "x double")
    assert [r[0] for r in big.select(dp("x")).collect()] == [1.5e13 + 0.13, 3e24, 4e30, None]


def test_safe_corr(spark):
    # Constant input -> null; single row -> null; three points -> -0.5.
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "x double, y double")
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    three = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 1.0)], "x double, y double")
    assert const.agg(safe_corr("x", "y")).first()[0] is None
    assert one.agg(safe_corr("x", "y")).first()[0] is None
    assert three.agg(safe_corr("x", "y")).first()[0] == pytest.approx(-0.5)


def test_day_of_week_sunday_is_zero(spark):
    # S11
    df = spark.createDataFrame([(ts("2024-01-07 10:00:00"),), (ts("2024-01-13 10:00:00"),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(day_of_week("t")).collect()] == [0, 6]
    assert df.select(day_of_week("t")).dtypes[0][1] == "bigint"


def test_week_starts_monday(spark):
    # Sunday and the following Monday fall in different weeks.
    df = spark.createDataFrame([(ts("2024-01-07 10:00:00"),), (ts("2024-01-08 10:00:00"),)], "t timestamp_ntz")
    out = df.select(trunc_ts("week", "t").alias("w"))
    assert out.dtypes[0][1] == "timestamp_ntz"
    assert [r[0] for r in out.collect()] == [ts("2024-01-01 00:00:00"), ts("2024-01-08 00:00:00")]


def test_severity_bucket_boundaries(spark):
    # Integer BETWEEN bounds; fractional 3.5 falls through to 15+.
    vals = [0.0, 1.0, 3.0, 3.5, 4.0, 7.0, 8.0, 14.0, 15.0, -5.0]
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    got = [r[0] for r in df.select(severity_bucket("d")).collect()]
    on, b1, b4, b8, b15 = BUCKET_LABELS
    assert got == [on, b1, b1, b15, b4, b4, b8, b8, b15, on]


def test_no_python_udfs_in_plans(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    plan = df.select(dp("x"), pct("x", F.lit(2))).select("*")._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_whole_days_and_trunc_ignore_session_zone(spark):
    # Sao Paulo started DST at midnight on 1996-10-06, so that wall-clock
    # midnight does not exist there: a zoned difference to 1996-11-03 00:00
    # gives 27 days instead of 28. The zone-less result must not move.
    df = spark.createDataFrame(
        [(ts("1996-11-03 00:00:00"), ts("1996-10-06 00:00:00"))], "d timestamp_ntz, e timestamp_ntz"
    )
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Sao_Paulo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            r = df.select(
                whole_days("d", "e").alias("n"), trunc_ts("day", "e").alias("day"), trunc_ts("month", "d").alias("m")
            ).first()
            assert (r.n, r.day, r.m) == (28, ts("1996-10-06 00:00:00"), ts("1996-11-01 00:00:00")), zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
