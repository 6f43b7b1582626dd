"""S15 (empty input) and S16 (null states in the two shipping variants)."""

from ordermart.operators import analytics as A

ORDERS = "order_id long, customer_id long, order_status string, delivery_delay_days double"


def test_overview_on_empty_input_returns_null_rate(spark):
    # The reference raises on an empty population; here the rate is null.
    empty = spark.createDataFrame([], ORDERS)
    r = A.overview_kpi(empty).first()
    assert (r.total_orders, r.delayed_orders, r.delay_rate_pct, r.avg_delay_days_all) == (0, 0, None, None)


def test_null_seller_state_goes_opposite_ways(spark):
    # One order whose only item has a seller with a null state.
    orders = spark.createDataFrame([(1, 10, "delivered", 2.0)], ORDERS)
    customers = spark.createDataFrame([(10, "SP")], "customer_id long, customer_state string")
    items = spark.createDataFrame([(1, 1, 7)], "order_id long, order_item_id long, seller_id long")
    sellers = spark.createDataFrame([(7, None)], "seller_id long, seller_state string")
    any_cross = A.shipping_type_any_cross(orders, customers, items, sellers).first()
    item_grain = A.same_vs_cross_state(orders, customers, items, sellers).first()
    assert any_cross.shipping_type == "Same State"  # bool_or(null) -> ELSE branch
    assert item_grain.shipping_type == "Cross State"  # (null = x) is not true -> ELSE branch


TREND = (
    "order_id long, customer_id long, order_status string, delivery_delay_days double, "
    "estimated_delivery_days long, order_purchase_timestamp timestamp_ntz"
)


def test_month_without_late_orders_reports_zero_and_null_window(spark):
    import datetime as dt

    jan, feb = dt.datetime(2018, 1, 5), dt.datetime(2018, 2, 5)
    rows = [
        (1, 1, "delivered", -3.0, 10, jan),  # January: nothing late
        (2, 1, "delivered", -1.0, 12, jan),
        (3, 1, "delivered", 4.0, 0, feb),  # February: late, promised window 0 days
        (4, 1, "delivered", -4.0, 0, feb),
    ]
    df = spark.createDataFrame(rows, TREND)
    trend = {r.order_month.month: r for r in A.delay_trend(df, "month").collect()}
    assert (trend[1].delayed_orders, trend[1].delay_rate_pct, trend[1].avg_delay_days_delayed) == (0, 0.0, 0.0)
    assert trend[2].avg_delay_days_delayed == 4.0
    window = {r.order_month.month: r for r in A.monthly_trend(df).collect()}
    assert window[1].pct_of_window_used == round((11 + -2) / 11 * 100, 2)
    assert window[2].avg_estimated_delivery_days == 0.0 and window[2].pct_of_window_used is None
    # A-01 has no coalesce: with no late order its late average is null
    assert A.overview_kpi(df.where("order_id <= 2")).first().avg_delay_days_delayed is None
