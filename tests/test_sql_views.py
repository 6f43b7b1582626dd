"""SRC-3/4: SQL text runs on the loaded tables via spark.sql.

One dialect difference matters: Spark's ``numeric`` is ``decimal(10,0)``, so
PostgreSQL's ``::numeric`` must be written ``::decimal(18,6)`` (the bare form
would round every average to a whole number; the second test pins that).
"""

from pyspark.sql import functions as F

from ordermart.functions.columns import dp, trunc_ts
from ordermart.sources.views import run_sql

# FILTER, ``::`` casts and date_trunc in one statement of our own.
MONTHS_SQL = """
SELECT date_trunc('month', order_purchase_timestamp) AS month, sum(1) AS n,
       sum(1) FILTER (WHERE delivery_delay_days BETWEEN 1 AND 7) AS week_late,
       round(avg(estimated_delivery_days)::decimal(18,6), 2) AS window_days
FROM orders WHERE order_status IN ('delivered') AND delivery_delay_days <= 7
GROUP BY 1
"""


def test_sql_text_matches_dataframes(spark, mart):
    got = {(str(r.month), r.n, r.week_late, float(r.window_days)) for r in run_sql(spark, mart.tables(), MONTHS_SQL).collect()}
    some = mart.orders.filter("order_status = 'delivered' AND delivery_delay_days <= 7")
    late = F.when(F.col("delivery_delay_days") >= 1, 1)
    want = some.groupBy(trunc_ts("month", "order_purchase_timestamp").alias("month")).agg(
        F.count("*").alias("n"), F.sum(late).alias("late"), dp(F.avg("estimated_delivery_days")).alias("window")
    )
    assert got == {(str(r.month), r.n, r.late, r.window) for r in want.collect()}


def test_bare_numeric_cast_rounds_to_integer(spark, mart):
    sql = MONTHS_SQL.replace("::decimal(18,6)", "::numeric")
    got = run_sql(spark, mart.tables(), sql).first()
    assert float(got.window_days) == round(float(got.window_days))
