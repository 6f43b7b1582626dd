"""DQ-8: totals are exact, so the order of addition decides nothing."""

import itertools

import pytest

from ordermart.operators import quality as Q


def mismatches(spark, paid, sold, tol=1.0, parts=1):
    payments = spark.createDataFrame([(k, v) for k, some in paid.items() for v in some], "order_id long, payment_value double")
    items = spark.createDataFrame([(k, v, f) for k, some in sold.items() for v, f in some], "order_id long, price double, freight_value double")
    return sorted(r.order_id for r in Q.reconcile(payments.repartition(parts), items.repartition(parts), tol=tol).collect())


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_totals_exactly_the_tolerance_apart(spark, parts):
    cents = [0.1, 0.2, 0.3, 0.7, 1.1, 33.33, 1e6 + 0.01]
    paid, sold = {}, {}
    for k, order in enumerate(itertools.islice(itertools.permutations(cents), 60)):
        paid[k] = order
        sold[k] = [(v, 0.0) for v in reversed(order)] + [(0.9, 0.1)]  # exactly 1.00 more
        paid[1000 + k], sold[1000 + k] = order, [*sold[k], (0.01, 0.0)]  # 1.01 more
    assert mismatches(spark, paid, sold, parts=parts) == [1000 + k for k in range(60)]


def test_sides_nulls_and_strange_numbers(spark):
    nan, inf = float("nan"), float("inf")
    paid = {1: [5.0], 2: [5.0], 3: [None, 2.0], 4: [nan], 5: [inf], 6: [1e15, 0.3]}
    sold = {1: [(4.0, 0.0)], 3: [(None, 1.0), (2.0, 0.5)], 4: [(1.0, 0.0)], 5: [(inf, 0.0)], 6: [(1e15, 1.4)], 7: [(9.0, 9.0)]}
    assert mismatches(spark, paid, sold) == [4, 5, 6]
    assert mismatches(spark, paid, sold, tol=0.25) == [1, 3, 4, 5, 6]
