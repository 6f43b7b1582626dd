"""Declared types of the nine raw marketplace tables (SRC-1, PRJ-8).

Only the columns the analysis names are declared; any other column in a raw
file passes through as a string. Keys are strings in the raw files; the
driver's mapped tables use bigint keys, and no operator assumes either.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


S, L, D, T = StringType(), LongType(), DoubleType(), TimestampNTZType()

RAW_SCHEMAS: dict[str, StructType] = {
    "orders": _schema(
        ("order_id", S),
        ("customer_id", S),
        ("order_status", S),
        ("order_purchase_timestamp", T),
        ("order_approved_at", T),
        ("order_delivered_carrier_date", T),
        ("order_delivered_customer_date", T),
        ("order_estimated_delivery_date", T),
    ),
    "order_items": _schema(
        ("order_id", S),
        ("order_item_id", L),
        ("product_id", S),
        ("seller_id", S),
        ("shipping_limit_date", T),
        ("price", D),
        ("freight_value", D),
    ),
    "order_payments": _schema(
        ("order_id", S),
        ("payment_sequential", L),
        ("payment_type", S),
        ("payment_installments", L),
        ("payment_value", D),
    ),
    "order_reviews": _schema(
        ("review_id", S),
        ("order_id", S),
        ("review_score", L),
        ("review_comment_title", S),
        ("review_comment_message", S),
        ("review_creation_date", T),
        ("review_answer_timestamp", T),
    ),
    "customers": _schema(("customer_id", S), ("customer_unique_id", S), ("customer_state", S)),
    "sellers": _schema(("seller_id", S), ("seller_state", S)),
    "products": _schema(("product_id", S), ("product_category_name", S), ("product_weight_g", D)),
    "category_translation": _schema(("product_category_name", S), ("product_category_name_english", S)),
    "geolocation": _schema(
        ("geolocation_zip_code_prefix", S),
        ("geolocation_lat", D),
        ("geolocation_lng", D),
        ("geolocation_city", S),
        ("geolocation_state", S),
    ),
}

# Tables whose cleaning keeps "the first row in file order"; reading them from
# CSV adds this column (see ``io.read_raw_csv(order_column=...)``).
FILE_ORDER_COLUMN = "src_order"
FILE_ORDER_TABLES = ("order_reviews", "geolocation")
# Tables whose free text may hold quoted newlines.
MULTI_LINE_TABLES = ("order_reviews",)
