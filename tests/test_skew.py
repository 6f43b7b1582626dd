"""Hot keys: one order owns a third of all items and reviews, one seller a
third of all items. Results must equal a pandas brute force on the fixture."""

import datetime as dt

import pandas as pd
import pytest

from ordermart.operators import analytics as A

N_ORDERS = 60


@pytest.fixture(scope="module")
def fixture(spark):
    orders, items, reviews = [], [], []
    for o in range(N_ORDERS):
        delay = float((o * 7) % 23 - 11)
        orders.append((o, o % 9, "delivered" if o % 5 else "shipped", delay))
        n_items = 120 if o == 0 else 1 + o % 3  # order 0 is hot
        for i in range(n_items):
            seller = 0 if i % 2 == 0 else 1 + (o + i) % 6  # seller 0 is hot
            items.append((o, i + 1, seller))
            reviews.append((o * 1000 + i, o, 1 + (o + i) % 5))
    customers = [(c, f"S{c % 4}") for c in range(9)]
    sellers = [(s, f"S{s % 3}" if s != 4 else None) for s in range(7)]
    frames = {
        "orders": (orders, "order_id long, customer_id long, order_status string, delivery_delay_days double"),
        "order_items": (items, "order_id long, order_item_id long, seller_id long"),
        "order_reviews": (reviews, "review_id long, order_id long, review_score long"),
        "customers": (customers, "customer_id long, customer_state string"),
        "sellers": (sellers, "seller_id long, seller_state string"),
    }
    return {k: (spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]))
            for k, (rows, schema) in frames.items()}


def _rate(late, n):
    return round(late * 100 / n, 2)


def test_any_cross_with_hot_order_and_seller(fixture):
    s = {k: v[0] for k, v in fixture.items()}
    p = {k: v[1] for k, v in fixture.items()}
    got = {r.shipping_type: (r.total_orders, r.delayed_orders, r.delay_rate_pct)
           for r in A.shipping_type_any_cross(s["orders"], s["customers"], s["order_items"], s["sellers"]).collect()}
    o = p["orders"][(p["orders"].order_status == "delivered") & p["orders"].delivery_delay_days.notna()]
    j = o.merge(p["customers"], on="customer_id").merge(p["order_items"], on="order_id").merge(p["sellers"], on="seller_id")
    j["cross"] = (j.seller_state != j.customer_state) & j.seller_state.notna() & j.customer_state.notna()
    per = j.groupby(["order_id", "delivery_delay_days"], as_index=False)["cross"].any()
    per["t"] = per.cross.map({True: "Cross State", False: "Same State"})
    want = {t: (len(g), int((g.delivery_delay_days > 0).sum()), _rate((g.delivery_delay_days > 0).sum(), len(g)))
            for t, g in per.groupby("t")}
    assert got == want


def test_item_grain_with_hot_order_and_seller(fixture):
    s = {k: v[0] for k, v in fixture.items()}
    p = {k: v[1] for k, v in fixture.items()}
    got = {r.shipping_type: (r.total_orders, r.delayed_orders, r.avg_delay_days_delayed)
           for r in A.same_vs_cross_state(s["orders"], s["customers"], s["order_items"], s["sellers"]).collect()}
    o = p["orders"][(p["orders"].order_status == "delivered") & p["orders"].delivery_delay_days.notna()]
    j = o.merge(p["customers"], on="customer_id").merge(p["order_items"], on="order_id").merge(p["sellers"], on="seller_id")
    j["t"] = (j.seller_state == j.customer_state).map({True: "Same State", False: "Cross State"})
    want = {}
    for t, g in j.groupby("t"):
        late = g[g.delivery_delay_days > 0]
        want[t] = (g.order_id.nunique(), late.order_id.nunique(),
                   round(late.delivery_delay_days.mean(), 2) if len(late) else None)
    assert got == want


def test_review_histogram_with_hot_order(fixture):
    s = {k: v[0] for k, v in fixture.items()}
    p = {k: v[1] for k, v in fixture.items()}
    got = {r.delivery_status: (r.total_orders, r.avg_review_score, r.score_1, r.score_5)
           for r in A.review_counts_by_status(s["orders"], s["order_reviews"]).collect()}
    o = p["orders"][(p["orders"].order_status == "delivered") & p["orders"].delivery_delay_days.notna()]
    j = o.merge(p["order_reviews"], on="order_id")
    j["st"] = (j.delivery_delay_days > 0).map({True: "Delayed", False: "On Time"})
    want = {k: (len(g), round(g.review_score.mean() + 1e-12, 2), int((g.review_score == 1).sum()),
                int((g.review_score == 5).sum())) for k, g in j.groupby("st")}
    assert got == want
