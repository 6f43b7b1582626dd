"""Warehouse SQL: the respelled text, and its results against DataFrames."""

import pytest
from pyspark.sql import functions as F

from ordermart.functions.columns import day_of_week, dp, safe_corr
from ordermart.sources.dialect import run_warehouse_sql, to_spark


@pytest.mark.parametrize(
    ("given", "spark_sql"),
    [
        ("x::numeric", "x::decimal(38,12)"),
        ("x::numeric(10,2)", "x::numeric(10,2)"),
        ("CAST(f(x) AS numeric)", "CAST(f(x) AS decimal(38,12))"),
        ("x::double  precision", "x::double"),
        ("'a::numeric' -- ORDER BY x\n", "'a::numeric' -- ORDER BY x\n\n"),
        ('SELECT "Order By" FROM t ORDER BY "Order By", f(a, b) DESC LIMIT 3', "SELECT `Order By` FROM t ORDER BY `Order By` NULLS LAST, f(a, b) DESC NULLS FIRST LIMIT 3"),
        ("row_number() OVER (PARTITION BY a ORDER BY b DESC, c NULLS FIRST)", "row_number() OVER (PARTITION BY a ORDER BY b DESC NULLS FIRST, c NULLS FIRST)"),
        ("SELECT rows_n FROM t ORDER BY rows_n;", "SELECT rows_n FROM t ORDER BY rows_n NULLS LAST;"),
    ],
)
def test_respelled(given, spark_sql):
    assert to_spark(given) == spark_sql


def test_equals_dataframes(spark, mart):
    sql = """
    SELECT EXTRACT(DOW FROM order_purchase_timestamp) AS "day", -- Sunday is 0
           ROUND(AVG(delivery_delay_days)::numeric, 2)::double precision AS mean_delay,
           CORR(delivery_delay_days, estimated_delivery_days) AS r,
           CORR(delivery_delay_days, estimated_delivery_days) FILTER (WHERE delivery_delay_days > 0) AS r_late,
           CORR(delivery_delay_days, 1) AS flat
    FROM orders GROUP BY 1 ORDER BY 1 DESC;
    """
    late = F.when(F.col("delivery_delay_days") > 0, F.col("delivery_delay_days"))
    window = F.when(F.col("delivery_delay_days").isNotNull(), F.col("estimated_delivery_days"))
    late_window = F.when(late.isNotNull(), F.col("estimated_delivery_days"))
    delay = F.when(F.col("estimated_delivery_days").isNotNull(), F.col("delivery_delay_days"))
    want = mart.orders.groupBy(day_of_week("order_purchase_timestamp").alias("day")).agg(
        dp(F.avg("delivery_delay_days")).alias("mean_delay"), safe_corr(delay, window).alias("r"), safe_corr(late, late_window).alias("r_late")
    )
    got = run_warehouse_sql(spark, mart.tables(), sql).collect()
    expected = {r.day: r for r in want.collect()}
    days = [r.day for r in got]
    assert days == sorted((d for d in days if d is not None), reverse=True) or days[0] is None
    assert set(days) == set(expected)
    for r in got:
        e = expected[r.day]
        assert r.mean_delay == e.mean_delay
        assert r.r == pytest.approx(e.r, abs=1e-9) and r.r_late == pytest.approx(e.r_late, abs=1e-9)
        assert r.flat is None


def test_order_of_nulls(spark):
    t = {"some_values": spark.createDataFrame([(1,), (None,), (3,)], "x int")}
    of = lambda order: [r.x for r in run_warehouse_sql(spark, t, f"SELECT x FROM some_values ORDER BY x{order}").collect()]
    assert of("") == of(" ASC") == [1, 3, None]
    assert of(" DESC") == [None, 3, 1]
    assert of(" DESC NULLS LAST") == [3, 1, None]
