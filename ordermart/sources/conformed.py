"""Conformed e-commerce model over the driver's TPC-H-style tables.

The reference works on nine raw marketplace tables (orders, order_items,
order_payments, order_reviews, customers, sellers, products,
category_translation, geolocation). The driver ships TPC-H-style tables
instead, so this module derives the nine *raw* tables from them with
deterministic integer arithmetic (FIXTURES.md §3). Every table is a lazy
DataFrame; nothing is collected, and Catalyst prunes what a query does not
use (A-11 never touches lineitem, for example).

The driver's tables have no defects, so the mapping makes some, as shares of
the rows: child keys without a parent, null keys, states, scores and statuses,
review ids over several orders, and delays beyond 30 days either way.

The same mapping is written independently in DuckDB SQL in
``ordermart.plans.oracle`` so the two engines can be compared.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.sources.driver import DriverTables

# Status codes and labels of the mapping.
STATUS_MAP = {"F": "delivered", "O": "shipped"}  # anything else -> "canceled"
DELIVERED = "delivered"
CANCELED = "canceled"
RETURNED = 'returned, "as is"\nsecond line'  # quotes, a comma and a newline for the CSV paths
PAYMENT_NOT_DEFINED_LINE = 7
PAYMENT_BY_FLAG = {"A": "credit_card", "N": "voucher"}  # anything else -> "boleto"
NO_CATEGORY_TYPE = "PROMO"          # becomes a null product category
UNTRANSLATED_TYPE = "ECONOMY"       # has no row in category_translation


def _hours(c):
    return F.make_dt_interval(hours=c.cast("int"))


def _days(c):
    return F.make_dt_interval(days=c.cast("int"))


def _unless(orphan, key: str):
    """The key, or one that no parent has."""
    return F.when(orphan, -1 - F.col(key)).otherwise(F.col(key))


class Conformed:
    """The nine raw tables of the reference's model, derived lazily."""

    def __init__(self, tables: DriverTables):
        self.t = tables

    # ------------------------------------------------------------- dims
    @cached_property
    def _nation_names(self) -> DataFrame:
        # 25 rows by the TPC-H definition; the planner broadcasts it by size.
        return self.t.nation.select("n_nationkey", "n_name")

    @cached_property
    def customers(self) -> DataFrame:
        c = self.t.customer
        return c.join(self._nation_names, c.c_nationkey == F.col("n_nationkey"), "left").select(
            F.col("c_custkey").alias("customer_id"),
            (F.col("c_custkey") - F.col("c_custkey") % 3).alias("customer_unique_id"),
            F.when(F.col("c_custkey") % 53 != 7, F.col("n_name")).alias("customer_state"),
        )

    @cached_property
    def sellers(self) -> DataFrame:
        s = self.t.supplier
        return s.join(self._nation_names, s.s_nationkey == F.col("n_nationkey"), "left").select(
            F.col("s_suppkey").alias("seller_id"),
            F.when(F.col("s_suppkey") % 29 != 5, F.col("n_name")).alias("seller_state"),
        )

    @cached_property
    def products(self) -> DataFrame:
        p = self.t.part
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.nullif(F.col("p_type"), F.lit(NO_CATEGORY_TYPE)).alias("product_category_name"),
            F.col("p_size").cast("double").alias("product_weight_g"),
        )

    @cached_property
    def category_translation(self) -> DataFrame:
        p = self.t.part
        return (
            p.select("p_type")
            .where(~F.col("p_type").isin(NO_CATEGORY_TYPE, UNTRANSLATED_TYPE))
            .distinct()
            .select(
                F.col("p_type").alias("product_category_name"),
                F.lower("p_type").alias("product_category_name_english"),
            )
        )

    @cached_property
    def geolocation(self) -> DataFrame:
        """Many coordinate rows per zip prefix; ``src_order`` is the file order."""
        c = self.t.customer
        return c.select(
            F.col("c_nationkey").cast("string").alias("geolocation_zip_code_prefix"),
            F.col("c_acctbal").alias("geolocation_lat"),
            (-F.col("c_acctbal")).alias("geolocation_lng"),
            F.col("c_name").alias("geolocation_city"),
            F.col("c_mktsegment").alias("geolocation_state"),
            F.col("c_custkey").alias("src_order"),
        )

    # ------------------------------------------------------------ facts
    @cached_property
    def orders(self) -> DataFrame:
        """Raw orders: five timestamps, no derived metrics yet."""
        o = self.t.orders
        last_ship = self.t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("max_ship"))
        j = o.join(last_ship, o.o_orderkey == last_ship.l_orderkey, "left")
        status = F.col("o_orderstatus")
        order_status = F.lit(CANCELED)
        for code, label in reversed(list(STATUS_MAP.items())):
            order_status = F.when(status == code, F.lit(label)).otherwise(order_status)
        order_status = F.when(F.col("o_orderkey") % 101 != 3, order_status)
        purchase = F.col("o_orderdate") + _hours(F.col("o_orderkey") % 24)
        estimated = F.col("o_orderdate") + _days(F.lit(10) + F.col("o_custkey") % 20)
        delay_hours = (
            F.pmod(F.datediff("max_ship", "o_orderdate") * 24 + F.col("o_orderkey") % 24, F.lit(1440))
            - 960
            + F.when(F.col("o_orderkey") % 89 == 3, F.lit(960)).otherwise(F.lit(0))
        )
        has_lines = F.col("max_ship").isNotNull()
        return j.select(
            F.col("o_orderkey").alias("order_id"),
            _unless(F.col("o_custkey") % 97 == 11, "o_custkey").alias("customer_id"),
            order_status.alias("order_status"),
            purchase.alias("order_purchase_timestamp"),
            F.when(has_lines, purchase + _hours(F.lit(1))).alias("order_approved_at"),
            F.col("max_ship").alias("order_delivered_carrier_date"),
            (estimated + _hours(delay_hours)).alias("order_delivered_customer_date"),
            estimated.alias("order_estimated_delivery_date"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        li = self.t.lineitem
        order_id = F.when(F.col("l_partkey") % 127 != 9, _unless(F.col("l_partkey") % 113 == 5, "l_orderkey"))
        return li.select(
            order_id.alias("order_id"),
            F.col("l_linenumber").cast("bigint").alias("order_item_id"),
            _unless(F.col("l_orderkey") % 137 == 17, "l_partkey").alias("product_id"),
            _unless(F.col("l_partkey") % 131 == 7, "l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
        )

    @cached_property
    def order_payments(self) -> DataFrame:
        li = self.t.lineitem
        flag = F.col("l_returnflag")
        ptype = F.lit("boleto")
        for code, label in reversed(list(PAYMENT_BY_FLAG.items())):
            ptype = F.when(flag == code, F.lit(label)).otherwise(ptype)
        ptype = F.when(F.col("l_linenumber") == PAYMENT_NOT_DEFINED_LINE, F.lit("not_defined")).otherwise(ptype)
        value = F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(
            F.col("l_extendedprice") * (F.lit(1.0) + F.col("l_tax"))
        )
        return li.select(
            _unless(F.col("l_partkey") % 109 == 6, "l_orderkey").alias("order_id"),
            F.col("l_linenumber").cast("bigint").alias("payment_sequential"),
            ptype.alias("payment_type"),
            (F.col("l_quantity").cast("int") % 6).cast("bigint").alias("payment_installments"),
            value.alias("payment_value"),
        )

    @cached_property
    def order_reviews(self) -> DataFrame:
        """Raw reviews, duplicates included; ``src_order`` is the file order."""
        li = self.t.lineitem
        score = F.when(F.col("l_partkey") % 103 != 8, (F.lit(1) + F.col("l_quantity").cast("int") % 5).cast("bigint"))
        # Every 61st part's reviews carry an id of the first order of their block of 32.
        order = F.col("l_orderkey") - F.when(F.col("l_partkey") % 61 == 2, F.col("l_orderkey") % 32).otherwise(F.lit(0))
        return li.select(
            (order * 10 + F.col("l_linenumber")).alias("review_id"),
            _unless(F.col("l_partkey") % 107 == 4, "l_orderkey").alias("order_id"),
            score.alias("review_score"),
            F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1), F.lit("first")).alias("review_comment_title"),
            F.when(F.col("l_returnflag") == "R", F.lit(RETURNED)).alias("review_comment_message"),
            F.col("l_shipdate").alias("review_creation_date"),
            (F.col("l_shipdate") + _days(F.lit(1))).alias("review_answer_timestamp"),
            F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity").alias("src_order"),
        )
