"""Table-cleaning jobs ETL-1..ETL-9: raw DataFrame in, cleaned DataFrame out.

Each job is one lazy plan; the write (or the caller's action) is the only
action. The inspection prints of the reference are available separately as
report DataFrames in ``operators.profile`` and ``operators.quality``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.functions.columns import dp, whole_days
from ordermart.operators.rows import drop_if_any, first_non_null, keep_first, to_timestamps

ORDER_DATE_COLUMNS = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
# A delivered order must have every one of these (DQ-13).
DELIVERED_REQUIRED = (
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
)
REVIEW_DATE_COLUMNS = ("review_creation_date", "review_answer_timestamp")


def inconsistent_delivered_masks(status: str = "order_status"):
    """The three DQ-13 masks: delivered but a required date is missing."""
    delivered = F.col(status) == "delivered"
    return [delivered & F.col(c).isNull() for c in DELIVERED_REQUIRED]


def clean_orders(raw: DataFrame) -> DataFrame:
    """ETL-1: drop inconsistent delivered orders, type dates, derive metrics.

    ``delivery_delay_days`` = floor days(delivered − estimated), positive is
    late, null when not delivered; ``estimated_delivery_days`` = floor
    days(estimated − purchase).
    """
    df = drop_if_any(raw, *inconsistent_delivered_masks())
    df = to_timestamps(df, ORDER_DATE_COLUMNS)
    return df.withColumns(
        {
            "delivery_delay_days": whole_days(
                "order_delivered_customer_date", "order_estimated_delivery_date"
            ).cast("double"),
            "estimated_delivery_days": whole_days(
                "order_estimated_delivery_date", "order_purchase_timestamp"
            ),
        }
    )


def clean_order_items(raw: DataFrame) -> DataFrame:
    """ETL-2: type the shipping limit date. Zero freight / cheap items are kept."""
    return to_timestamps(raw, ["shipping_limit_date"])


def invalid_payment_masks():
    """The three DQ-14 masks (a ``not_defined`` type is invalid at any value)."""
    ptype = F.col("payment_type")
    return [
        (ptype == "credit_card") & (F.col("payment_installments") == 0),
        (ptype == "voucher") & (F.col("payment_value") == 0),
        ptype == "not_defined",
    ]


def clean_order_payments(raw: DataFrame) -> DataFrame:
    """ETL-3: remove invalid payment rows."""
    return drop_if_any(raw, *invalid_payment_masks())


def clean_order_reviews(
    raw: DataFrame, order_by: Sequence[str] = ("src_order",), drop: Sequence[str] = ("src_order",)
) -> DataFrame:
    """ETL-4: keep the first row per ``review_id`` (file order), type dates."""
    df = keep_first(raw, ["review_id"], list(order_by), drop)
    return to_timestamps(df, REVIEW_DATE_COLUMNS)


def clean_passthrough(raw: DataFrame) -> DataFrame:
    """ETL-5..8 (customers, sellers, products, category_translation).

    The reference only probes keys and nulls on these and writes them
    unchanged; the probes live in ``operators.profile``.
    """
    return raw


clean_customers = clean_sellers = clean_products = clean_category_translation = clean_passthrough


def clean_geolocation(
    raw: DataFrame,
    order_by: str = "src_order",
    key: str = "geolocation_zip_code_prefix",
    decimals: int | None = None,
) -> DataFrame:
    """ETL-9: one row per zip prefix: mean lat/lng, first city/state.

    pandas ``groupby`` drops null keys and its ``'first'`` skips nulls in file
    order; both are reproduced. ``decimals`` optionally rounds the means.
    """
    lat = F.avg("geolocation_lat")
    lng = F.avg("geolocation_lng")
    if decimals is not None:
        lat, lng = dp(lat, decimals), dp(lng, decimals)
    return (
        raw.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            lat.alias("geolocation_lat"),
            lng.alias("geolocation_lng"),
            first_non_null("geolocation_city", order_by).alias("geolocation_city"),
            first_non_null("geolocation_state", order_by).alias("geolocation_state"),
        )
    )
