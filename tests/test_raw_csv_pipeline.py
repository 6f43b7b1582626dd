"""The pipeline on raw CSV files, as a user of the reference would start:
nine headered files -> typed raw tables -> cleaning -> questions and checks."""

import textwrap

import pytest

from ordermart.operators import analytics as A
from ordermart.operators import clean
from ordermart.operators import quality as Q
from ordermart.operators.repair import repair_tables
from ordermart.plans.export import export_csv
from ordermart.plans.mart import LoadedMart, Mart
from ordermart.sources.io import read_raw_dir

FILES = {
    "orders": """\
        order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date
        o1,c1,delivered,2018-01-01 10:00:00,2018-01-01 11:00:00,2018-01-03 09:00:00,2018-01-12 12:00:00,2018-01-10 00:00:00
        o2,c1,delivered,2018-01-02 10:00:00,2018-01-02 11:00:00,2018-01-04 09:00:00,2018-01-08 12:00:00,2018-01-10 00:00:00
        o3,c2,delivered,2018-01-03 10:00:00,2018-01-03 11:00:00,,2018-01-09 12:00:00,2018-01-10 00:00:00
        o4,c2,shipped,2018-01-04 10:00:00,2018-01-04 11:00:00,2018-01-05 09:00:00,,2018-01-20 00:00:00
        """,
    "customers": """\
        customer_id,customer_unique_id,customer_zip_code_prefix,customer_state
        c1,u1,01037,SP
        c2,u2,20000,RJ
        """,
    "order_items": """\
        order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value
        o1,1,p1,s1,2018-01-02 00:00:00,50.0,5.0
        o1,2,p2,s2,2018-01-02 00:00:00,40.0,5.0
        o2,1,p1,s1,2018-01-03 00:00:00,30.0,2.0
        o9,1,p1,s1,2018-01-03 00:00:00,10.0,1.0
        """,
    "sellers": """\
        seller_id,seller_zip_code_prefix,seller_state
        s1,01000,SP
        s2,20000,RJ
        """,
    "order_payments": """\
        order_id,payment_sequential,payment_type,payment_installments,payment_value
        o1,1,credit_card,1,100.0
        o1,2,voucher,1,0
        o2,1,not_defined,1,32.0
        """,
    "order_reviews": '''\
        review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp
        r1,o1,1,NA,"late ""again""",2018-01-13 00:00:00,2018-01-14 00:00:00
        r1,o2,5,,,2018-01-09 00:00:00,2018-01-10 00:00:00
        r2,o2,4,ok,"line one
        line two",2018-01-09 00:00:00,2018-01-10 00:00:00
        ''',
    "products": """\
        product_id,product_category_name,product_weight_g
        p1,cat_a,500
        p2,NA,
        """,
    "category_translation": """\
        product_category_name,product_category_name_english
        cat_b,B
        """,
    "geolocation": """\
        geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state
        01037,1.0,-1.0,,SP
        01037,3.0,-3.0,x,SP
        01037,5.0,-5.0,y,SP
        ,9.0,9.0,z,RJ
        """,
}


@pytest.fixture(scope="module")
def mart(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    paths = {}
    for name, text in FILES.items():
        p = root / f"{name}.csv"
        p.write_text(textwrap.dedent(text))
        paths[name] = str(p)
    return Mart.from_raw(spark, read_raw_dir(spark, paths))


def test_cleaning(mart):
    assert sorted(r.order_id for r in mart.orders.collect()) == ["o1", "o2", "o4"]  # o3 dropped
    delays = {r.order_id: r.delivery_delay_days for r in mart.orders.collect()}
    assert delays == {"o1": 2.0, "o2": -2.0, "o4": None}
    assert sorted((r.order_id, r.payment_type) for r in mart.order_payments.collect()) == [("o1", "credit_card")]
    reviews = {r.review_id: (r.order_id, r.review_comment_title, r.review_comment_message) for r in mart.order_reviews.collect()}
    assert reviews == {"r1": ("o1", None, 'late "again"'), "r2": ("o2", "ok", "line one\nline two")}
    geo = mart.geolocation.collect()
    assert [(g.geolocation_zip_code_prefix, g.geolocation_lat, g.geolocation_city) for g in geo] == [("01037", 3.0, "x")]
    assert mart.customers.where("customer_id = 'c1'").first().customer_zip_code_prefix == "01037"


def test_questions(mart):
    kpi = A.overview_kpi(mart.orders).first()
    assert (kpi.total_orders, kpi.delayed_orders, kpi.delay_rate_pct) == (2, 1, 50.0)
    ship = {r.shipping_type: r.total_orders for r in
            A.shipping_type_any_cross(mart.orders, mart.customers, mart.order_items, mart.sellers).collect()}
    assert ship == {"Cross State": 1, "Same State": 1}


def test_checks(mart):
    summary = {(r.check_name, r.table_name, r.key_columns): r.issues for r in Q.dq_summary(mart.tables()).collect()}
    assert summary[("orphans", "order_items", "order_id")] == 1  # o9
    assert summary[("missing_translation", "products", "product_category_name")] == 1  # cat_a
    assert summary[("duplicate_keys", "order_reviews", "review_id")] == 0  # deduplicated
    assert summary[("summary", None, None)] == sum(v for k, v in summary.items() if k[0] != "summary")


def test_file_order_over_several_files(spark, tmp_path):
    # Spark packs larger files first; the small first file must still win.
    header = "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
    (tmp_path / "part-0.csv").write_text(header + "r1,first,1,,,,\n")
    (tmp_path / "part-1.csv").write_text(header + "r1,second,2,,,,\n" + "".join(f"x{k},o,3,,pad,,\n" for k in range(3000)))
    raw = read_raw_dir(spark, {"order_reviews": str(tmp_path)})["order_reviews"]
    kept = clean.clean_order_reviews(raw).filter("review_id = 'r1'").collect()
    assert [r.order_id for r in kept] == ["first"]


def test_other_column_order_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("seller_id,seller_state\ns1,SP\n")
    (tmp_path / "b.csv").write_text("seller_state,seller_id\nSP,s2\n" * 1)
    with pytest.raises(Exception, match="(?i)header"):
        read_raw_dir(spark, {"sellers": str(tmp_path)})["sellers"].collect()


def test_loaded_mart_keeps_its_raw_tables(mart):
    one, two = LoadedMart.build(mart), LoadedMart.build(mart)
    assert one.paths != two.paths
    assert one.raw.order_reviews.count() == 3 and mart.raw.order_reviews.count() == 3
    assert A.overview_kpi(one.orders).first().total_orders == 2
    assert Q.conflicting_parents(one.raw.order_reviews, "review_id", "order_id").first().conflicting_ids == 1
    one.unload()
    assert A.overview_kpi(two.orders).first().total_orders == 2


def test_export_of_user_files(mart, tmp_path):
    report = {r.file_name: r.rows for r in export_csv(LoadedMart.build(mart), str(tmp_path)).collect()}
    assert report["overview_kpi"] == 1 and len(report) == 9


def test_given_translations_and_failing_keys(mart):
    def names(tables):
        return {r.product_category_name: r.product_category_name_english for r in tables["category_translation"].collect()}

    assert names(repair_tables(mart.tables(), {"cat_a": "A"})) == {"cat_b": "B", "cat_a": "A"}
    plain = repair_tables(mart.tables())
    assert names(plain) == {"cat_b": "B", "cat_a": None}
    Q.assert_keys(plain)
    with pytest.raises(Q.KeyViolation, match="fk_order_items_order"):
        Q.assert_keys(mart.tables())
