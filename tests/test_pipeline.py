"""T4: invariants across the analytic questions, cleaning and repair (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from ordermart.operators import analytics as A
from ordermart.operators import quality as Q
from ordermart.operators.repair import repair_tables
from ordermart.operators.rows import keep_first


@pytest.fixture(scope="module")
def kpi(mart):
    return A.overview_kpi(mart.orders).first()


def test_distribution_sums_to_delayed(mart, kpi):
    assert A.delay_days_distribution(mart.orders).agg(F.sum("delayed_orders")).first()[0] == kpi.delayed_orders


def test_dow_and_state_totals(mart, kpi):
    assert A.delay_by_dow(mart.orders).agg(F.sum("total_orders")).first()[0] == kpi.total_orders
    # Orders whose customer is unknown have no state: the join leaves them out.
    known = mart.orders.join(mart.customers, "customer_id", "left_semi")
    by_state = A.delay_by_state(mart.orders, mart.customers).agg(F.sum("total_orders")).first()[0]
    assert by_state == A.overview_kpi(known).first().total_orders < kpi.total_orders


def test_shares_sum_to_100(mart):
    s = A.seller_distribution_by_state(mart.sellers).agg(F.sum("pct_of_all_sellers")).first()[0]
    assert s == pytest.approx(100, abs=0.5)


def test_cross_state_equal_in_both_definitions(mart):
    # An unknown state is no difference in one and no equality in the other.
    customers, sellers = mart.customers.filter("customer_state IS NOT NULL"), mart.sellers.filter("seller_state IS NOT NULL")
    a12 = {r.shipping_type: r for r in A.shipping_type_any_cross(mart.orders, customers, mart.order_items, sellers).collect()}
    a13 = {r.shipping_type: r for r in A.same_vs_cross_state(mart.orders, customers, mart.order_items, sellers).collect()}
    assert a12["Cross State"].total_orders == a13["Cross State"].total_orders
    assert a12["Cross State"].delayed_orders == a13["Cross State"].delayed_orders


def test_review_pct_consistent_with_counts(mart):
    counts = {r.delivery_status: r for r in A.review_counts_by_status(mart.orders, mart.order_reviews).collect()}
    pcts = {r.delivery_status: r for r in A.review_score_pct_by_status(mart.orders, mart.order_reviews).collect()}
    for k, c in counts.items():
        for s in range(1, 6):
            assert pcts[k][f"pct_score_{s}"] == pytest.approx(round(c[f"score_{s}"] * 100 / c.total_orders, 2), abs=0.006)


def test_buckets_partition_reviews(mart):
    b = A.review_score_by_delay_bucket(mart.orders, mart.order_reviews).agg(F.sum("total_orders")).first()[0]
    s = A.review_counts_by_status(mart.orders, mart.order_reviews).agg(F.sum("total_orders")).first()[0]
    assert b == s


def test_repaired_tables_have_no_orphans(mart):
    t = mart.tables()
    fixed = repair_tables(t, persist=True)
    for child in ("order_items", "order_reviews", "order_payments"):
        # NOT IN keeps null keys.
        assert Q.fk_violations(fixed[child], "order_id", fixed["orders"], "order_id").count() == 0
        assert fixed[child].filter("order_id IS NULL").count() == t[child].filter("order_id IS NULL").count()
    assert Q.missing_codes(fixed["products"], "product_category_name", fixed["category_translation"],
                           "product_category_name").count() == 0


def test_review_dedupe_idempotent(mart):
    once = mart.order_reviews
    assert once.groupBy("review_id").count().where("count > 1").count() == 0
    again = keep_first(once.withColumn("o", F.lit(0)), ["review_id"], ["o"]).drop("o")
    assert again.count() == once.count()


def test_cleaned_orders_have_metrics(mart):
    o = mart.orders
    assert {"delivery_delay_days", "estimated_delivery_days"} <= set(o.columns)
    bad = o.where((F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNull())
    assert bad.count() == 0
