"""Named-query registry: ``name -> (spark, sf_dir) -> DataFrame``.

One entry per operator of SURVEY §2 that produces a result. Each callable
builds a ``Mart`` over the driver tables in ``sf_dir``, applies the operator
and returns the DataFrame. Checks and questions read the loaded mart, which the
first of them writes; a few I/O queries write tables while they are built.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ordermart.functions.columns import dp
from ordermart.operators import analytics as A
from ordermart.operators import clean as C
from ordermart.operators import profile as P
from ordermart.operators import quality as Q
from ordermart.operators import repair as R
from ordermart.operators.profile import union_all
from ordermart.plans.mart import TABLES, Mart
from ordermart.session import discard, shared_dir
from ordermart.sources import io
from ordermart.sources.schemas import MULTI_LINE_TABLES
from ordermart.sources.dialect import run_warehouse_sql
from ordermart.sources.views import run_sql

QueryFn = Callable[[SparkSession, str], DataFrame]


def _on_mart(fn: Callable[[Mart], DataFrame], loaded: bool) -> QueryFn:
    """Bind an operator to the mart: the loaded one for checks and questions,
    a fresh one (cleaning jobs run from the raw tables) for ETL and I/O."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Mart.shared(spark, sf_dir) if loaded else Mart(spark, sf_dir))

    run.__doc__ = fn.__doc__
    return run


ANALYTICS: dict[str, Callable[[Mart], DataFrame]] = {
    "a01_overview_kpi": lambda m: A.overview_kpi(m.orders),
    "a02_delay_days_distribution": lambda m: A.delay_days_distribution(m.orders),
    "a03_monthly_delay_rate": lambda m: A.delay_trend(m.orders, "month"),
    "a04_delay_by_dow": lambda m: A.delay_by_dow(m.orders),
    "a05_corr_monthly": lambda m: A.volume_delay_corr(m.orders, "month"),
    "a06_corr_weekly": lambda m: A.volume_delay_corr(m.orders, "week"),
    "a07_corr_daily": lambda m: A.volume_delay_corr(m.orders, "day"),
    "a08_monthly_estimated_window": lambda m: A.monthly_estimated_window(m.orders),
    "a09_monthly_trend": lambda m: A.monthly_trend(m.orders),
    "a10_delay_by_state": lambda m: A.delay_by_state(m.orders, m.customers),
    "a11_seller_distribution_by_state": lambda m: A.seller_distribution_by_state(m.sellers),
    "a12_shipping_type_any_cross": lambda m: A.shipping_type_any_cross(
        m.orders, m.customers, m.order_items, m.sellers
    ),
    "a13_same_vs_cross_state": lambda m: A.same_vs_cross_state(m.orders, m.customers, m.order_items, m.sellers),
    "a14_review_counts_by_status": lambda m: A.review_counts_by_status(m.orders, m.order_reviews),
    "a15_review_score_by_delay_bucket": lambda m: A.review_score_by_delay_bucket(m.orders, m.order_reviews),
    "a16_review_score_pct_by_status": lambda m: A.review_score_pct_by_status(m.orders, m.order_reviews),
}


# ------------------------------------------------------------- profiling
# Key probes of the nine notebooks: every primary key plus the second
# customer id and the raw geolocation zip prefix.
KEY_PROBES = tuple((pk.table, pk.columns) for pk in Q.PRIMARY_KEYS) + (
    ("customers", ("customer_unique_id",)),
    ("geolocation_raw", ("geolocation_zip_code_prefix",)),
)


def _probe_tables(m: Mart) -> dict:
    t = m.tables()
    t["geolocation_raw"] = m.raw.geolocation.drop("src_order")
    return t


def _stages(m: Mart) -> list[tuple[str, str, DataFrame]]:
    """Every raw table, then every cleaned one: (stage, name, table)."""
    raw = {n: getattr(m.raw, n) for n in m.tables()}
    raw = {n: df.drop("src_order") for n, df in raw.items()}
    return [(stage, n, df) for stage, some in (("raw", raw), ("clean", m.tables())) for n, df in some.items()]


def _profile(m: Mart, one: Callable[[DataFrame, str], DataFrame], wanted: Callable[[DataFrame], list] = lambda df: [1]) -> DataFrame:
    """One report over all tables of both stages. Some build with a few jobs of
    their own, so several tables are worked on at once."""
    tables = [x for x in _stages(m.load_raw()) if wanted(x[2])]
    with ThreadPoolExecutor(max_workers=4) as pool:
        parts = list(pool.map(lambda x: one(x[2], x[1]).select(F.lit(x[0]).alias("stage"), "*"), tables))
    return union_all(parts)


def _text_summary(m: Mart) -> DataFrame:
    """All text columns of both stages, counted together."""
    names = {f"{stage}.{n}": df for stage, n, df in _stages(m.load_raw()) if P.text_columns(df)}
    out = P.text_summaries(names)
    both = F.split("table_name", "[.]")
    return out.select(both[0].alias("stage"), both[1].alias("table_name"), *out.columns[1:])


PROFILING: dict[str, Callable[[Mart], DataFrame]] = {
    "prf_shape": lambda m: _profile(m, P.shape),
    "prf_null_counts": lambda m: _profile(m, P.null_counts),
    "prf_numeric_summary": lambda m: _profile(m, lambda df, n: P.numeric_summary(df, name=n), P.numeric_columns),
    "prf_text_summary": lambda m: _text_summary(m),
    "prf_value_counts": lambda m: P.value_counts(m.raw.orders, "order_status"),
    "prf_value_pct": lambda m: P.value_counts(m.raw.order_payments, "payment_type", normalize=True),
    "prf_conditional_counts": lambda m: P.conditional_counts(
        m.raw.orders, {c: F.col(c).isNull() for c in C.DELIVERED_REQUIRED}, "order_status"
    ),
    # PRF-9 / PRF-10: how often each suspicious payment, price or product occurs.
    "prf_payment_masks": lambda m: P.conditional_counts(
        m.raw.order_payments,
        {"zero_installments": F.col("payment_installments") == 0, "zero_value": F.col("payment_value") == 0},
        "payment_type",
    ),
    "prf_condition_counts": lambda m: union_all(
        [
            P.conditional_count(getattr(m.raw, t), mask).select(F.lit(t).alias("table_name"), F.lit(name).alias("mask"), "n")
            for t, name, mask in (
                ("order_items", "zero_freight", F.col("freight_value") == 0),
                ("order_items", "price_below_1000", F.col("price") < 1000),
                ("products", "no_category", F.col("product_category_name").isNull()),
                ("products", "no_weight", F.col("product_weight_g").isNull()),
            )
        ]
    ),
    "prf_key_uniqueness": lambda m: union_all(
        [P.key_uniqueness(_probe_tables(m)[t], keys, name=t) for t, keys in KEY_PROBES]
    ),
    "prf_dup_rows": lambda m: P.duplicate_rows(m.raw.order_reviews.drop("src_order"), ["review_id"]),
    # PRF-14 / SRT-5: the first duplicated reviews by id, then file order.
    "prf_dup_preview": lambda m: P.preview(
        P.duplicate_rows(m.raw.order_reviews, ["review_id"]), ["review_id", "src_order"], 10
    ).drop("src_order"),
    # PRF-11: describe() of voucher payment values only.
    "prf_filtered_summary": lambda m: P.numeric_summary(
        m.raw.order_payments.where(F.col("payment_type") == "voucher"), ["payment_value"], name="voucher"
    ),
    # PRF-13: show the rows matching a predicate in full.
    "prf_matching_rows": lambda m: m.raw.order_payments.where(F.col("payment_type") == "not_defined"),
    # FLT-7 / JN-6: every payment row of orders that carry a zero-value voucher.
    "prf_semi_join": lambda m: m.raw.order_payments.join(
        m.raw.order_payments.where((F.col("payment_type") == "voucher") & (F.col("payment_value") == 0)).select(
            "order_id"
        ).distinct(),
        "order_id",
        "left_semi",
    ),
}

# --------------------------------------------------------------- quality
#: The literal row that the lookup lacks, as a repair script would insert it.
TRANSLATIONS = {"ECONOMY": "economy"}

QUALITY: dict[str, Callable[[Mart], DataFrame]] = {
    "dq_orphan_counts": lambda m: Q.orphan_report(m.tables()),
    "dq_orphan_repair_null_aware": lambda m: union_all(
        [Q.repair_counts(m.tables()[t], "order_id", m.orders, "order_id", t) for t in R.REPAIRED_CHILDREN]
    ),
    # SNK-5: rows before and after the two cleaning steps that merge rows.
    "dq_dedupe_report": lambda m: union_all(
        [Q.repair_report(getattr(m.raw, t), getattr(m, t), t) for t in ("order_reviews", "geolocation")]
    ),
    "dq_lookup_missing": lambda m: Q.missing_codes(
        m.products, "product_category_name", m.category_translation, "product_category_name"
    ),
    "dq_lookup_repair": lambda m: R.repair_tables(m.tables(), TRANSLATIONS, persist=False)["category_translation"],
    "dq_duplicate_keys": lambda m: Q.duplicate_report(m.tables()).drop("duplicate_rows"),
    "dq_duplicate_rows": lambda m: Q.duplicate_report(m.tables()).drop("duplicate_keys"),
    "dq_reconcile_totals": lambda m: Q.reconcile_count(m.order_payments, m.order_items, tol=1.0),
    "dq_summary": lambda m: Q.dq_summary(m.tables()),
    "dq_pk_report": lambda m: Q.pk_report(m.tables()),
    "dq_fk_report": lambda m: Q.fk_report(m.tables()),
    "dq_constraint_list": lambda m: Q.constraint_list(m.tables()),
    "dq_conflicting_parent": lambda m: Q.conflicting_parents(m.raw.order_reviews, "review_id", "order_id"),
    "dq_extremes": lambda m: Q.extremes(m.orders, "delivery_delay_days", -30, 30),
    "dq_null_delay_by_status": lambda m: Q.null_metric_by_status(m.orders),
    "dq_inconsistent_delivered": lambda m: Q.flagged_count(m.raw.orders, C.inconsistent_delivered_masks()),
    "dq_invalid_payments": lambda m: Q.flagged_count(m.raw.order_payments, C.invalid_payment_masks()),
}

# ------------------------------------------------------------ cleaning
CLEANING: dict[str, Callable[[Mart], DataFrame]] = {
    "etl_orders": lambda m: m.orders,
    "etl_order_items": lambda m: m.order_items,
    "etl_order_payments": lambda m: m.order_payments,
    "etl_order_reviews": lambda m: m.order_reviews,
    "etl_customers": lambda m: m.customers,
    "etl_sellers": lambda m: m.sellers,
    "etl_products": lambda m: m.products,
    "etl_category_translation": lambda m: m.category_translation,
    # The table keeps its means; two engines' sums agree to so many places only.
    "etl_geolocation": lambda m: m.geolocation.withColumns({c: dp(c, 6) for c in ("geolocation_lat", "geolocation_lng")}),
}
# ETL-11 runs on the loaded tables, like the reference's constraint script.
QUALITY["etl_cross_repair"] = lambda m: R.cross_repair(m.tables(), TRANSLATIONS, paths=m.paths)


def _repair_by_file(m: Mart) -> DataFrame:
    """SNK-6: what is left of each stored child after the delete by file."""
    kept = R.repair_tables(m.tables(), TRANSLATIONS, paths=m.paths)
    return union_all(
        [
            kept[t].agg(
                F.lit(t).alias("table_name"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count("order_id").alias("n_with_order"),
                F.count_distinct("order_id").alias("n_orders"),
                F.coalesce(F.sum("order_id"), F.lit(0)).alias("order_id_sum"),
            )
            for t in R.REPAIRED_CHILDREN
        ]
    )


QUALITY["etl_delete_by_file"] = _repair_by_file


def _csv_round_trip(m: Mart) -> DataFrame:
    df = m.order_reviews
    return io.materialize(df, fmt="csv")


def _load_report(m: Mart) -> DataFrame:
    return io.load_report(m.spark, m.tables())


#: Bytes of text a raw CSV file has on average, files of a table at least, and
#: at most (Spark numbers them by five digits, and their names are their order).
FILE_BYTES, FILES, MOST_FILES = 32 << 20, 5, 100_000
#: Rows of a compressed file whose text isn't measured, if the table hasn't more
#: than so many files; tables beyond so many rows have files one at a time.
FILE_ROWS, ALONE_ROWS = 1 << 16, 1 << 21
#: At the library's own level a write takes twice the time for a seventh less.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def _n_files(size: int) -> int:
    """Files for so many bytes of text, so that none of them grows with it."""
    return int(min(MOST_FILES, max(FILES, size // FILE_BYTES + 1)))


def _measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text of a table; one narrow scan."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 1 for c in df.columns), F.lit(0))
    rows, total = df.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return rows, total or 0


def _file_rows(df: DataFrame, multi_line: bool) -> int:
    """Rows of a file where each task writes its own files."""
    if not multi_line:
        return max(FILE_ROWS, df.count() // MOST_FILES + 1)
    rows, size = _measured(df)
    return rows // _n_files(size) + 1


def _raw_csv(
    df: DataFrame, multi_line: bool, order_by: str | None = None, text: tuple[str, ...] = (), split: bool = False, infer: bool = False, path: str | None = None
) -> DataFrame:
    """A raw table written as several CSV files in file order and read back the
    way a user's files are: by header, with NA strings, file order kept. A file
    is one task where quoted newlines are, so their number follows the size.

    Files whose types are inferred are gzipped, as text is ten times the rows'
    Parquet. Their rows stay in the tasks that have them, which begin a new file
    every so many rows."""
    path = path or shared_dir(df.sparkSession)
    plain = df.drop(order_by) if order_by else df
    options = {}
    if order_by:
        laid = df.repartitionByRange(_n_files(_measured(plain)[1]), order_by).sortWithinPartitions(order_by)
    elif infer:
        laid = df
        options = GZIP | {"maxRecordsPerFile": _file_rows(df, multi_line)}
    else:
        # Files without quoted newlines are split where they are read.
        laid = df.repartition(_n_files(_measured(df)[1])) if multi_line else df.hint("rebalance")
    io.write_table(laid.select(*plain.columns), path, "csv", **options)
    schema = StructType([StructField(f.name, StringType() if f.name in text else f.dataType) for f in plain.schema])
    schema = None if infer else schema
    return io.read_raw_csv(df.sparkSession, path, schema, order_column=order_by, multi_line=multi_line, split=split)


def _inferred(m: Mart) -> DataFrame:
    """SRC-1: all nine raw tables read back without a schema: the type found
    for each column, its rows and its gaps.

    A table is read for its files alone, so it has no Parquet copy, and the
    files go once they are counted."""
    alone = Lock()

    def counted(name: str, raw: DataFrame) -> DataFrame:
        path = shared_dir(m.spark)
        try:
            df = _raw_csv(raw, name in MULTI_LINE_TABLES, infer=True, path=path)
            types = F.create_map(*[F.lit(v) for pair in df.dtypes for v in pair])
            rows = df.agg(*[F.struct(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null")).alias(c) for c in df.columns])
            tidy = rows.unpivot([], df.columns, "column_name", "n")
            return io.materialize(tidy.select(F.lit(name).alias("table_name"), "column_name", types[F.col("column_name")].alias("data_type"), "n.n_rows", "n.n_null"))
        finally:
            discard(m.spark, path)

    def one(name: str) -> DataFrame:
        raw = getattr(m.raw, name).drop("src_order")
        with alone if raw.count() > ALONE_ROWS else nullcontext():
            return counted(name, raw)

    with ThreadPoolExecutor(max_workers=4) as pool:
        return union_all(list(pool.map(one, TABLES)))


def _export_report(m: Mart) -> DataFrame:
    from ordermart.plans.export import export_csv

    return export_csv(m, shared_dir(m.spark))


# SRC-3: a user's own SQL over the loaded tables, by their names.
WAREHOUSE_TEXT = """
SELECT customer_state AS "state", EXTRACT(DOW FROM order_purchase_timestamp) AS day_number,
       COUNT(*) FILTER (WHERE delivery_delay_days > 0) AS late,
       ROUND(AVG(delivery_delay_days)::numeric, 2)::double precision AS mean_delay,
       RANK() OVER (PARTITION BY customer_state ORDER BY SUM(delivery_delay_days) DESC)::int8 AS place
FROM orders o JOIN customers c ON c.customer_id = o.customer_id
GROUP BY 1, 2 ORDER BY 1, 2;
"""
SQL_TEXT = """
SELECT c.customer_state, count(*) FILTER (WHERE o.order_status = 'delivered') AS delivered,
       count(DISTINCT o.customer_id) AS customers, max(o.order_purchase_timestamp)::date AS last_day
FROM orders o LEFT JOIN customers c ON c.customer_id = o.customer_id
GROUP BY c.customer_state
"""

SOURCES_SINKS: dict[str, Callable[[Mart], DataFrame]] = {
    "io_csv_round_trip": _csv_round_trip,
    "io_load_report": _load_report,
    # SRC-1 then ETL-4 and ETL-9: the first row by file order, over several files.
    "io_raw_reviews": lambda m: C.clean_order_reviews(_raw_csv(m.raw.order_reviews, True, "src_order")),
    # The same with the files split by blocks, quoted newlines and all.
    "io_raw_reviews_split": lambda m: C.clean_order_reviews(_raw_csv(m.raw.order_reviews, True, "src_order", split=True)),
    "io_raw_geolocation": lambda m: C.clean_geolocation(_raw_csv(m.raw.geolocation, False, "src_order"), decimals=6),
    # PRJ-7 / SCL-9: dates come as strings and the cleaning types them.
    "io_raw_orders": lambda m: C.clean_orders(_raw_csv(m.raw.orders, False, text=C.ORDER_DATE_COLUMNS)),
    "io_raw_inferred": _inferred,
}
ON_LOADED: dict[str, Callable[[Mart], DataFrame]] = {
    "io_export_report": _export_report,
    "io_sql_text": lambda m: run_sql(m.spark, m.tables(), SQL_TEXT),
    "io_warehouse_sql": lambda m: run_warehouse_sql(m.spark, m.tables(), WAREHOUSE_TEXT),
}


def queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    for group, loaded in (
        (ANALYTICS, True),
        (PROFILING, True),
        (QUALITY, True),
        (CLEANING, False),
        (SOURCES_SINKS, False),
        (ON_LOADED, True),
    ):
        for name, fn in group.items():
            out[name] = _on_mart(fn, loaded)
    return out


def oracle_sql() -> dict[str, str]:
    from ordermart.plans import oracle

    out: dict[str, str] = {}
    for group in (oracle.ANALYTICS_SQL, oracle.PROFILING_SQL, oracle.QUALITY_SQL, oracle.CLEANING_SQL, oracle.IO_SQL):
        out.update(group)
    return out
