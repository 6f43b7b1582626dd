"""SRT-1..5, 7: the results come in their documented order (the oracle gate
compares sets of rows)."""

import pytest

from ordermart.plans import registry

SF = "/root/testdata/sf0.001"
# query -> sort keys, "-" for descending (nulls first then, as in PostgreSQL).
ORDERS = {
    "a02_delay_days_distribution": ["delivery_delay_days"],
    "a03_monthly_delay_rate": ["order_month"],
    "a04_delay_by_dow": ["day_of_week"],
    "a08_monthly_estimated_window": ["order_month"],
    "a09_monthly_trend": ["order_month"],
    "a10_delay_by_state": ["-delay_rate_pct"],
    "a11_seller_distribution_by_state": ["-seller_count"],
    "a12_shipping_type_any_cross": ["-delay_rate_pct"],
    "a13_same_vs_cross_state": ["-delay_rate_pct"],
    "a14_review_counts_by_status": ["-delivery_status"],
    "a16_review_score_pct_by_status": ["-delivery_status"],
    "prf_value_counts": ["-count", "order_status"],
    "prf_value_pct": ["-pct", "payment_type"],
    "prf_dup_preview": ["review_id"],
    "dq_null_delay_by_status": ["-n"],
    "dq_constraint_list": ["table_name", "constraint_type", "constraint_name", "column_name"],
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_order(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert rows
    expected = list(rows)
    for key in reversed(ORDERS[name]):
        column = key.lstrip("-")
        assert all(r[column] is not None for r in rows)
        expected.sort(key=lambda r, c=column: r[c], reverse=key.startswith("-"))
    keys = [k.lstrip("-") for k in ORDERS[name]]
    assert [[r[k] for k in keys] for r in rows] == [[r[k] for k in keys] for r in expected]


def test_buckets_by_severity(spark):
    labels = [r.delay_bucket for r in registry.queries()["a15_review_score_by_delay_bucket"](spark, SF).collect()]
    assert labels == ["On Time", "1-3 Days Late", "4-7 Days Late", "8-14 Days Late", "15+ Days Late"]
