"""Row operators and data-quality semantics."""

from pyspark.sql import functions as F

from ordermart.operators import quality as Q
from ordermart.operators.clean import clean_geolocation, inconsistent_delivered_masks
from ordermart.operators.rows import drop_if_any, keep_first


def test_mask_keeps_null_status(spark):
    # Pandas keeps a row whose status is null; only row 2 is removed.
    df = spark.createDataFrame(
        [(1, None, None), (2, "delivered", None), (3, "delivered", "x"), (4, "x", None)],
        "id int, order_status string, d string",
    ).withColumns({"order_approved_at": F.col("d"), "order_delivered_carrier_date": F.lit("c"),
                   "order_delivered_customer_date": F.lit("c")})
    kept = drop_if_any(df, *inconsistent_delivered_masks())
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]


def test_geolocation_first_non_null_and_null_keys(spark):
    # Null keys dropped; 'first' skips nulls in file order.
    df = spark.createDataFrame(
        [("1", None, None, None, "s", 1), ("1", 2.0, 2.0, "b", "t", 2), (None, 9.0, 9.0, "z", "u", 3)],
        "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double, "
        "geolocation_city string, geolocation_state string, src_order int",
    )
    out = clean_geolocation(df).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.geolocation_zip_code_prefix, r.geolocation_city, r.geolocation_lat) == ("1", "b", 2.0)
    assert r.geolocation_state == "s"


def test_keep_first_null_keys_group_together(spark):
    # Dedupe keeps one row per key with nulls equal; distinct ignores null.
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("a", 3, "c")], "k string, o int, v string")
    out = keep_first(df, ["k"], ["o"])
    assert sorted((r.k or "", r.v) for r in out.collect()) == [("", "a"), ("a", "c")]
    assert df.select(F.count_distinct("k")).first()[0] == 1
    # idempotent
    again = keep_first(out, ["k"], ["o"])
    assert again.count() == out.count()


def _ids(df, col="c"):
    return sorted((r[col] is None, r[col]) for r in df.collect())


def test_delete_not_in_null_aware(spark):
    # Survivors of DELETE ... WHERE c NOT IN (parent).
    child = spark.createDataFrame([(1,), (2,), (None,)], "c int")
    p1 = spark.createDataFrame([(1,), (9,)], "p int")
    p2 = spark.createDataFrame([(1,), (None,)], "p int")
    p3 = spark.createDataFrame([], "p int")
    assert _ids(Q.delete_not_in(child, "c", p1, "p")) == [(False, 1), (True, None)]
    assert _ids(Q.delete_not_in(child, "c", p2, "p")) == [(False, 1), (False, 2), (True, None)]
    assert Q.delete_not_in(child, "c", p3, "p").count() == 0


def test_delete_not_in_matches_spark_sql_not_in(spark):
    child = spark.createDataFrame([(1,), (2,), (None,), (5,)], "c int")
    for rows in ([(1,), (9,)], [(1,), (None,)], []):
        parent = spark.createDataFrame(rows, "p int")
        child.createOrReplaceTempView("t_child")
        parent.createOrReplaceTempView("t_parent")
        sql = spark.sql("SELECT c FROM t_child WHERE (c NOT IN (SELECT p FROM t_parent)) IS NOT TRUE")
        assert _ids(sql) == _ids(Q.delete_not_in(child, "c", parent, "p"))


def test_orphan_check_vs_fk(spark):
    # The orphan check counts a null child key; S10: the FK lets it pass.
    child = spark.createDataFrame([(1,), (2,), (None,)], "c int")
    parent = spark.createDataFrame([(1,)], "p int")
    assert Q.orphan_count(child, "c", parent, "p").first().issues == 2
    assert Q.fk_violations(child, "c", parent, "p").count() == 1


def test_duplicate_metrics(spark):
    # Keys a x3, b x2, c x1 -> 2 duplicate keys, 3 extra rows.
    df = spark.createDataFrame([(k,) for k in "aaabbc"], "k string")
    r = Q.duplicate_key_stats(df, ["k"]).first()
    assert (r.duplicate_keys, r.duplicate_rows) == (2, 3)


def test_reconcile_inner_join(spark):
    # Only orders on both sides can mismatch.
    pay = spark.createDataFrame([(1, 10.0), (3, 5.0), (4, 20.0)], "order_id int, payment_value double")
    itm = spark.createDataFrame(
        [(2, 1.0, 0.0), (3, 4.5, 0.0), (4, 10.0, 1.0)], "order_id int, price double, freight_value double"
    )
    assert Q.reconcile_count(pay, itm, tol=1.0).first().mismatched_orders == 1


def test_append_missing_is_idempotent(spark):
    lookup = spark.createDataFrame([("a", "A")], "k string, v string")
    rows = spark.createDataFrame([("a", "X"), ("b", "B")], "k string, v string")
    once = Q.append_missing(lookup, rows, "k")
    twice = Q.append_missing(once, rows, "k")
    assert sorted(tuple(r) for r in twice.collect()) == [("a", "A"), ("b", "B")]


def test_pk_report_counts_null_and_duplicate_keys(spark):
    # Null keys group together (GROUP BY semantics), so the null group of two
    # rows is also a duplicate key group.
    t = spark.createDataFrame([(None,), (None,), ("a",), ("a",), ("b",)], "customer_id string")
    r = Q.pk_report({"customers": t}, pks=(Q.PrimaryKey("customers", ("customer_id",)),)).first()
    assert (r.null_keys, r.duplicate_keys, r.violations, r.status) == (2, 2, 4, "violated")


def test_repair_counts_one_pass(spark):
    # SNK-5 for the S8 cases: before / after / removed from one aggregate.
    child = spark.createDataFrame([(1,), (2,), (None,)], "c int")
    cases = {
        "plain": ([(1,), (9,)], (3, 2, 1)),
        "null_parent": ([(1,), (None,)], (3, 3, 0)),
        "empty_parent": ([], (3, 0, 3)),
    }
    for name, (rows, want) in cases.items():
        parent = spark.createDataFrame(rows, "p int")
        r = Q.repair_counts(child, "c", parent, "p", name).first()
        assert (r.rows_before, r.rows_after, r.rows_removed) == want, name
