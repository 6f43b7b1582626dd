"""The sixteen named analytic questions (A-01..A-16) as DataFrame plans.

Inputs are the cleaned tables; outputs are small tidy DataFrames whose
column names match the reference's result columns.

Population P0 is ``order_status = 'delivered' AND delivery_delay_days IS NOT
NULL``; "late" is ``delivery_delay_days > 0``; every rate is
``round(late * 100 / n, 2)``.

Scale notes (the plans are written for fact tables of billions of rows):

* every metric is an algebraic aggregate (count / sum / avg / bool_or), so
  Spark combines map-side before the shuffle and a hot key collapses inside
  each map task;
* shares of a total use a scalar subquery for the total, never an
  unpartitioned window, so groups stay distributed however many there are;
* the item-grain questions (A-12, A-13) first reduce order_items to one row
  per (order, seller state) with an item count, and the review questions
  (A-14..A-16) first reduce reviews to one row per order with a score
  histogram. Only those reduced frames meet the orders table, so the big
  fact-to-fact join moves pre-aggregated rows and a single order with a
  huge number of items or reviews is already one row before it is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermart.functions.columns import (
    BUCKET_LABELS,
    day_of_week,
    dp,
    is_late,
    pct,
    safe_corr,
    severity_bucket,
    status_label,
    trunc_ts,
)

DELAY = "delivery_delay_days"
EST = "estimated_delivery_days"
PURCHASE = "order_purchase_timestamp"
CROSS = "Cross State"
SAME = "Same State"


# ---------------------------------------------------------------- helpers
def delivered(orders: DataFrame, *not_null: str) -> DataFrame:
    """Delivered orders whose listed columns are all non-null."""
    cond = F.col("order_status") == "delivered"
    for c in not_null:
        cond = cond & F.col(c).isNotNull()
    return orders.where(cond)


def population(orders: DataFrame, *extra_not_null: str) -> DataFrame:
    """P0 plus optional extra non-null requirements."""
    return delivered(orders, DELAY, *extra_not_null)


def _late_count() -> Column:
    return F.count_if(is_late(DELAY))


def _late_avg() -> Column:
    return F.avg(F.when(is_late(DELAY), F.col(DELAY)))


def delay_metrics(coalesce_late: bool = False) -> dict[str, Column]:
    """Aggregate columns shared by A-01, A-03, A-09, A-10."""
    late_avg = F.coalesce(_late_avg(), F.lit(0.0)) if coalesce_late else _late_avg()
    return {
        "total_orders": F.count(F.lit(1)),
        "delayed_orders": _late_count(),
        "delay_rate_pct": pct(_late_count(), F.count(F.lit(1))),
        "avg_delay_days_delayed": dp(late_avg),
        "avg_delay_days_all": dp(F.avg(DELAY)),
    }


def _agg(df: DataFrame, keys: Sequence[Column | str], metrics: dict[str, Column], names: Sequence[str]):
    cols = [metrics[n].alias(n) for n in names]
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def share_of_total(counts: DataFrame, count_col: str, out: str, nd: int = 2) -> DataFrame:
    """Add ``out`` = count * 100 / sum(count) over all rows, rounded.

    The grand total is a scalar subquery over the same grouped frame (its
    exchange is reused), so the groups are never pulled into one task.
    """
    total = counts.agg(F.sum(count_col)).scalar()
    return counts.withColumn(out, pct(F.col(count_col), total, nd))


# ------------------------------------------------------------------ A-01
def overview_kpi(orders: DataFrame) -> DataFrame:
    """A-01: platform-wide delay rate and severity, one row."""
    names = ["total_orders", "delayed_orders", "delay_rate_pct", "avg_delay_days_all", "avg_delay_days_delayed"]
    return _agg(population(orders), [], delay_metrics(), names)


# ------------------------------------------------------------------ A-02
def delay_days_distribution(orders: DataFrame) -> DataFrame:
    """A-02: late orders per whole delay day and their share of all late."""
    late = delivered(orders).where(is_late(DELAY))
    counts = late.groupBy(DELAY).agg(F.count(F.lit(1)).alias("delayed_orders"))
    return share_of_total(counts, "delayed_orders", "pct_of_all_delayed").orderBy(DELAY)


# ------------------------------------------------------- A-03, A-04, A-09
def delay_trend(orders: DataFrame, grain: str = "month") -> DataFrame:
    """A-03 (month) and its day/week variants: volume, late count and rate."""
    key = trunc_ts(grain, PURCHASE).alias(f"order_{grain}")
    names = ["total_orders", "delayed_orders", "delay_rate_pct", "avg_delay_days_delayed"]
    out = _agg(population(orders, PURCHASE), [key], delay_metrics(coalesce_late=True), names)
    return out.orderBy(f"order_{grain}")


def delay_by_dow(orders: DataFrame) -> DataFrame:
    """A-04: delay rate by purchase weekday, 0 = Sunday."""
    names = ["total_orders", "delayed_orders", "delay_rate_pct"]
    out = _agg(population(orders, PURCHASE), [day_of_week(PURCHASE).alias("day_of_week")], delay_metrics(), names)
    return out.orderBy("day_of_week")


def monthly_trend(orders: DataFrame) -> DataFrame:
    """A-09: A-03 plus average promised window and share of it used."""
    pop = population(orders, EST, PURCHASE)
    m = delay_metrics(coalesce_late=True)
    avg_est, avg_delay = F.avg(EST), F.avg(DELAY)
    m["avg_estimated_delivery_days"] = dp(avg_est)
    m["pct_of_window_used"] = dp((avg_est + avg_delay) / F.nullif(avg_est, F.lit(0.0)) * 100)
    names = [
        "total_orders",
        "delayed_orders",
        "delay_rate_pct",
        "avg_delay_days_delayed",
        "avg_delay_days_all",
        "avg_estimated_delivery_days",
        "pct_of_window_used",
    ]
    return _agg(pop, [trunc_ts("month", PURCHASE).alias("order_month")], m, names).orderBy("order_month")


# ------------------------------------------------------------ A-05..A-07
def volume_delay_corr(orders: DataFrame, grain: str = "month", nd: int = 3) -> DataFrame:
    """A-05/06/07: Pearson correlation of per-period volume and delay rate."""
    per_period = population(orders, PURCHASE).groupBy(trunc_ts(grain, PURCHASE).alias("period")).agg(
        F.count(F.lit(1)).alias("orders"),
        (_late_count().cast("double") * 100.0 / F.count(F.lit(1))).alias("delay_rate"),
    )
    return per_period.agg(dp(safe_corr("orders", "delay_rate"), nd).alias("correlation_coefficient"))


# ------------------------------------------------------------------ A-08
def monthly_estimated_window(orders: DataFrame) -> DataFrame:
    """A-08: average promised delivery window by purchase month.

    Population differs from A-03: the delay may be null here.
    """
    pop = delivered(orders, EST, PURCHASE)
    return (
        pop.groupBy(trunc_ts("month", PURCHASE).alias("order_month"))
        .agg(dp(F.avg(EST)).alias("avg_estimated_delivery_days"))
        .orderBy("order_month")
    )


# ------------------------------------------------------------------ A-10
def delay_by_state(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """A-10: delay by customer state (inner join: unknown customers drop)."""
    late = F.when(is_late(DELAY), F.col(DELAY))
    # One row a customer before the join: a customer with a third of all
    # orders is combined map-side. Whole days add up exactly.
    each = population(orders).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(late).alias("n_late"),
        F.sum(late).alias("late_days"),
        F.sum(DELAY).alias("days"),
    )
    j = each.join(customers.select("customer_id", "customer_state"), "customer_id")
    n, n_late = F.sum("n"), F.sum("n_late")
    return (
        j.groupBy("customer_state")
        .agg(
            n.alias("total_orders"),
            n_late.alias("delayed_orders"),
            pct(n_late, n).alias("delay_rate_pct"),
            dp(F.sum("late_days") / F.nullif(n_late, F.lit(0))).alias("avg_delay_days_delayed"),
            dp(F.sum("days") / n).alias("avg_delay_days_all"),
        )
        .orderBy(F.desc_nulls_first("delay_rate_pct"))
    )


# ------------------------------------------------------------------ A-11
def seller_distribution_by_state(sellers: DataFrame) -> DataFrame:
    """A-11: sellers per state and share of all sellers."""
    counts = sellers.groupBy("seller_state").agg(F.count(F.lit(1)).alias("seller_count"))
    return share_of_total(counts, "seller_count", "pct_of_all_sellers").orderBy(F.desc("seller_count"))


# ------------------------------------------------------------ A-12, A-13
def item_states(order_items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Items as (order_id, seller_state). An order's few items seldom share a
    state, so reducing them here would only add a shuffle."""
    states = sellers.select("seller_id", "seller_state")
    return order_items.select("order_id", "seller_id").join(states, "seller_id").select("order_id", "seller_state")


def _orders_with_state(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return population(orders).select("order_id", "customer_id", DELAY).join(
        customers.select("customer_id", "customer_state"), "customer_id"
    )


def _shipping_summary(per_order: DataFrame, late_avg: Column) -> DataFrame:
    n = F.count(F.lit(1))
    return (
        per_order.groupBy("shipping_type")
        .agg(
            n.alias("total_orders"),
            _late_count().alias("delayed_orders"),
            pct(_late_count(), n).alias("delay_rate_pct"),
            dp(late_avg).alias("avg_delay_days_delayed"),
        )
        .orderBy(F.desc_nulls_first("delay_rate_pct"))
    )


def shipping_type_any_cross(
    orders: DataFrame, customers: DataFrame, order_items: DataFrame, sellers: DataFrame
) -> DataFrame:
    """A-12: one row per order; Cross State if any item ships across states.

    ``bool_or(seller_state != customer_state)`` is null when every
    comparison is null, and null falls to 'Same State' as in the reference.
    """
    # The regrouping by order reuses the partitioning of the join on it.
    j = _orders_with_state(orders, customers).join(item_states(order_items, sellers), "order_id")
    per_order = j.groupBy("order_id", DELAY).agg(
        F.bool_or(F.col("seller_state") != F.col("customer_state")).alias("any_cross")
    )
    per_order = per_order.withColumn(
        "shipping_type", F.when(F.col("any_cross"), F.lit(CROSS)).otherwise(F.lit(SAME))
    )
    return _shipping_summary(per_order, _late_avg())


def same_vs_cross_state(
    orders: DataFrame, customers: DataFrame, order_items: DataFrame, sellers: DataFrame
) -> DataFrame:
    """A-13 (export variant): item grain, an order can count in both groups.

    Counts are distinct orders per group; the late average is weighted by
    items. A null state compares unequal, so it lands in 'Cross State'.
    Written as two regular aggregations (order x type, then type) instead
    of COUNT(DISTINCT ...) FILTER, which Spark would plan with an Expand
    that doubles the joined rows.
    """
    # The regrouping by order reuses the partitioning of the join on it.
    j = _orders_with_state(orders, customers).join(item_states(order_items, sellers), "order_id")
    same = F.coalesce(F.col("seller_state") == F.col("customer_state"), F.lit(False))
    j = j.withColumn("shipping_type", F.when(same, F.lit(SAME)).otherwise(F.lit(CROSS)))
    per_order = j.groupBy("order_id", DELAY, "shipping_type").agg(F.count(F.lit(1)).alias("n_items"))
    late = is_late(DELAY)
    weighted_late_avg = F.sum(F.when(late, F.col(DELAY) * F.col("n_items"))) / F.sum(
        F.when(late, F.col("n_items"))
    )
    return _shipping_summary(per_order, weighted_late_avg)


# ------------------------------------------------------------ A-14..A-16
SCORES = (1, 2, 3, 4, 5)


def review_histogram(order_reviews: DataFrame) -> DataFrame:
    """Reviews reduced to one row per order: rows, scored rows, score sum, n1..n5."""
    s = F.col("review_score")
    return order_reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count(s).alias("n_scored"),
        F.sum(s).alias("score_sum"),
        *[F.count_if(s == k).alias(f"n_{k}") for k in SCORES],
    )


def _reviewed_orders(orders: DataFrame, order_reviews: DataFrame) -> DataFrame:
    return population(orders).select("order_id", DELAY).join(review_histogram(order_reviews), "order_id")


def _avg_score() -> Column:
    return dp(F.sum("score_sum") / F.sum("n_scored"))


def review_counts_by_status(orders: DataFrame, order_reviews: DataFrame) -> DataFrame:
    """A-14: review rows, average score and score counts, Delayed vs On Time."""
    j = _reviewed_orders(orders, order_reviews)
    return (
        j.groupBy(status_label(DELAY).alias("delivery_status"))
        .agg(
            F.sum("n_reviews").alias("total_orders"),
            _avg_score().alias("avg_review_score"),
            *[F.sum(f"n_{k}").alias(f"score_{k}") for k in SCORES],
        )
        .orderBy(F.desc("delivery_status"))
    )


def review_score_by_delay_bucket(orders: DataFrame, order_reviews: DataFrame) -> DataFrame:
    """A-15: review rows and average score per delay-severity bucket."""
    j = _reviewed_orders(orders, order_reviews)
    out = j.groupBy(severity_bucket(DELAY).alias("delay_bucket")).agg(
        F.sum("n_reviews").alias("total_orders"),
        _avg_score().alias("avg_review_score"),
        F.min(DELAY).alias("_min_delay"),
    )
    return out.orderBy("_min_delay").drop("_min_delay")


def review_score_pct_by_status(orders: DataFrame, order_reviews: DataFrame) -> DataFrame:
    """A-16: share of each star rating within Delayed and On Time."""
    j = _reviewed_orders(orders, order_reviews)
    total = F.sum("n_reviews")
    return (
        j.groupBy(status_label(DELAY).alias("delivery_status"))
        .agg(total.alias("total_orders"), *[pct(F.sum(f"n_{k}"), total).alias(f"pct_score_{k}") for k in SCORES])
        .orderBy(F.desc("delivery_status"))
    )


__all__ = [
    "BUCKET_LABELS",
    "overview_kpi",
    "delay_days_distribution",
    "delay_trend",
    "delay_by_dow",
    "volume_delay_corr",
    "monthly_estimated_window",
    "monthly_trend",
    "delay_by_state",
    "seller_distribution_by_state",
    "shipping_type_any_cross",
    "same_vs_cross_state",
    "review_counts_by_status",
    "review_score_by_delay_bucket",
    "review_score_pct_by_status",
    "share_of_total",
    "item_states",
    "review_histogram",
]
