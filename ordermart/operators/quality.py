"""Data-quality and integrity operators DQ-1..DQ-17.

Every check returns a DataFrame (usually one row, or one row per check) so
that many checks union into one report and run under one action. Joins are
plain equi-joins (``left_anti`` / ``left_semi`` / ``left``); the planner and
AQE decide between broadcast and shuffle from measured sizes, so nothing here
broadcasts a parent table whose size grows with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermart.operators.profile import union_all


# ------------------------------------------------------------- registry
@dataclass(frozen=True)
class PrimaryKey:
    table: str
    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.table}_pkey"


@dataclass(frozen=True)
class ForeignKey:
    name: str
    table: str
    column: str
    parent: str
    parent_column: str


# The reference's declared keys (8 primary, 7 foreign).
PRIMARY_KEYS = (
    PrimaryKey("customers", ("customer_id",)),
    PrimaryKey("sellers", ("seller_id",)),
    PrimaryKey("products", ("product_id",)),
    PrimaryKey("category_translation", ("product_category_name",)),
    PrimaryKey("orders", ("order_id",)),
    PrimaryKey("order_items", ("order_id", "order_item_id")),
    PrimaryKey("order_reviews", ("review_id",)),
    PrimaryKey("order_payments", ("order_id", "payment_sequential")),
)
FOREIGN_KEYS = (
    ForeignKey("fk_orders_customer", "orders", "customer_id", "customers", "customer_id"),
    ForeignKey("fk_order_items_order", "order_items", "order_id", "orders", "order_id"),
    ForeignKey("fk_order_items_seller", "order_items", "seller_id", "sellers", "seller_id"),
    ForeignKey("fk_order_items_product", "order_items", "product_id", "products", "product_id"),
    ForeignKey("fk_order_reviews_order", "order_reviews", "order_id", "orders", "order_id"),
    ForeignKey("fk_order_payments_order", "order_payments", "order_id", "orders", "order_id"),
    ForeignKey(
        "fk_products_category", "products", "product_category_name", "category_translation", "product_category_name"
    ),
)
# (child, column, parent, column) pairs of the orphan scan (DQ-1): every
# foreign key but the category's, whose missing codes are listed by DQ-4.
ORPHAN_CHECKS = tuple(
    (fk.table, fk.column, fk.parent, fk.parent_column) for fk in FOREIGN_KEYS if fk.parent != "category_translation"
)


def _keys(parent: DataFrame, parent_col: str) -> DataFrame:
    """Distinct parent keys (combining aggregate: the join side is unique)."""
    return parent.select(F.col(parent_col).alias("_pk")).distinct()


# ------------------------------------------------------------ DQ-1/2
def orphan_rows(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Child rows with no parent; a null child key counts (LEFT JOIN ... IS NULL)."""
    return child.join(_keys(parent, parent_col), child[child_col] == F.col("_pk"), "left_anti")


def orphan_count(
    child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, null_keys: bool = True
) -> DataFrame:
    """Number of child rows without a parent, null keys counted or not.

    Rows are reduced to one per key before they meet the parent, so a key (or
    the null key) with a third of all rows is combined map-side.
    """
    keys = child.groupBy(F.col(child_col).alias("_ck")).agg(F.count(F.lit(1)).alias("_n"))
    if not null_keys:
        keys = keys.where("_ck IS NOT NULL")
    lost = keys.join(_keys(parent, parent_col), F.col("_ck") == F.col("_pk"), "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("issues"))


def orphan_report(tables: Mapping[str, DataFrame], checks=ORPHAN_CHECKS) -> DataFrame:
    """DQ-1: one row per (child, column, parent, column) with the orphan count."""
    frames = []
    for child, ccol, parent, pcol in checks:
        frames.append(
            orphan_count(tables[child], ccol, tables[parent], pcol).select(
                F.lit("orphans").alias("check_name"),
                F.lit(child).alias("table_name"),
                F.lit(ccol).alias("key_columns"),
                F.lit(parent).alias("parent_table"),
                "issues",
            )
        )
    return union_all(frames)


# -------------------------------------------------------------- DQ-3
def flag_not_in(
    child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, flag: str = "_keep"
) -> DataFrame:
    """``child`` plus a boolean ``flag``: does the row survive
    ``DELETE FROM child WHERE k NOT IN (SELECT pk FROM parent)``?

    SQL's NOT IN is null-aware: a null anywhere in the parent keys deletes
    nothing, an empty parent deletes everything (null child keys too), and
    otherwise a null child key survives. Spark plans NOT IN as a broadcast
    null-aware anti join whatever the parent's size, so this is the scale
    form: two facts about the parent (one scalar subquery) plus a left join
    against its distinct keys, all regular shuffle-or-broadcast plans.
    """
    facts = parent.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(parent_col).isNull()).alias("nulls"))
    ).scalar()
    n_parent, n_null = facts["n"], facts["nulls"]
    keys = _keys(parent, parent_col).where(F.col("_pk").isNotNull()).withColumn("_hit", F.lit(True))
    decided = F.when(n_parent == 0, F.lit(False)).when(n_null > 0, F.lit(True))
    # Null keys never meet the parent: the two facts decide them where they are.
    named = child.where(F.col(child_col).isNotNull()).join(keys, F.col(child_col) == F.col("_pk"), "left")
    named = named.select(*child.columns, decided.otherwise(F.col("_hit").isNotNull()).alias(flag))
    return named.unionAll(child.where(F.col(child_col).isNull()).select("*", decided.otherwise(F.lit(True)).alias(flag)))


def delete_not_in(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """DQ-3 / SNK-6: the rows that survive the null-aware NOT IN delete."""
    return flag_not_in(child, child_col, parent, parent_col, "_keep").where("_keep").drop("_keep")


def repair_counts(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, name: str) -> DataFrame:
    """SNK-5 for the NOT IN repair: rows before / after / removed in one pass
    over the child's keys (one row per key before the join)."""
    keys = child.groupBy(child_col).agg(F.count(F.lit(1)).alias("_n"))
    flagged = flag_not_in(keys, child_col, parent, parent_col, "_keep")
    return flagged.agg(
        F.lit(name).alias("table_name"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.when(F.col("_keep"), F.col("_n"))), F.lit(0)).alias("rows_after"),
    ).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def repair_report(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """SNK-5: rows before and after a cleaning or repair step."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return b.select(
        F.lit(name).alias("table_name"),
        "rows_before",
        a.scalar().alias("rows_after"),
    ).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


# ------------------------------------------------------------ DQ-4/5
def missing_codes(df: DataFrame, col: str, lookup: DataFrame, lookup_col: str) -> DataFrame:
    """DQ-4: distinct non-null codes of ``df.col`` absent from the lookup."""
    codes = df.where(F.col(col).isNotNull()).select(col).distinct()
    return codes.join(_keys(lookup, lookup_col), F.col(col) == F.col("_pk"), "left_anti")


def append_missing(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """DQ-5 / SNK-7: append ``rows`` whose key is not already present (idempotent)."""
    new = rows.join(_keys(df, key), rows[key] == F.col("_pk"), "left_anti")
    return df.unionByName(new.select(*df.columns))


# ------------------------------------------------------------ DQ-6/7
def key_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key value (nulls group together, as GROUP BY does)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def duplicate_key_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: duplicate key groups (DQ-6) and extra rows (DQ-7)."""
    g = key_groups(df, keys)
    return g.agg(
        F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("duplicate_rows"),
    )


def duplicate_report(tables: Mapping[str, DataFrame], pks=PRIMARY_KEYS) -> DataFrame:
    """DQ-6/7 for every primary key: (table, key, duplicate_keys, duplicate_rows)."""
    frames = [
        duplicate_key_stats(tables[pk.table], pk.columns).select(
            F.lit(pk.table).alias("table_name"),
            F.lit(",".join(pk.columns)).alias("key_columns"),
            "duplicate_keys",
            "duplicate_rows",
        )
        for pk in pks
    ]
    return union_all(frames)


# -------------------------------------------------------------- DQ-8
def reconcile(
    payments: DataFrame, items: DataFrame, key: str = "order_id", tol: float = 1.0
) -> DataFrame:
    """DQ-8: orders whose payment total and item total differ by more than ``tol``.

    Both sides are aggregated first (map-side combine), then joined on the
    aggregate key: orders present on only one side are not mismatches. Totals
    are exact decimals, so that one exactly ``tol`` apart is no mismatch in
    whatever order its rows are added.
    """
    pay = payments.groupBy(key).agg(*_exact_total("total_payment", "payment_value"))
    itm = items.groupBy(key).agg(*_exact_total("total_items", "price", "freight_value"))
    apart = F.abs(F.col("total_payment") - F.col("total_items")) > F.lit(str(tol)).cast(MONEY)
    both = pay.join(itm, key).where(F.col("total_payment_odd") | F.col("total_items_odd") | apart)
    return both.select(key, *[F.when(~F.col(f"{c}_odd"), F.col(c)).otherwise(F.lit(float("nan"))).cast("double").alias(c) for c in ("total_payment", "total_items")])


#: Amounts as exact decimals: sums then don't depend on the order of addition.
MONEY = "decimal(38,10)"


def _exact_total(name: str, *cols: str) -> list[Column]:
    """The sum of amounts by the decimals that the numbers are printed as, and
    whether one of them is not finite (such a total differs from any other).
    A row with a null amount adds nothing, as SQL's sum of a sum."""
    whole, odd = F.lit(0).cast(MONEY), F.lit(False)
    for c in cols:
        value = F.col(c).cast("double")
        strange = F.isnan(value) | (F.abs(value) == float("inf"))
        whole, odd = whole + F.when(~strange, value).try_cast(MONEY), odd | F.coalesce(strange, F.lit(False))
    return [F.sum(whole.cast(MONEY)).alias(name), F.bool_or(odd).alias(f"{name}_odd")]


def reconcile_count(payments: DataFrame, items: DataFrame, tol: float = 1.0) -> DataFrame:
    return reconcile(payments, items, tol=tol).agg(F.count(F.lit(1)).alias("mismatched_orders"))


# ------------------------------------------------------------- DQ-9
def dq_summary(tables: Mapping[str, DataFrame], tol: float = 1.0) -> DataFrame:
    """DQ-9: the 16 cross-table checks with status and a grand total row.

    Orphans (6) and duplicate keys (8) add their counts; missing lookup
    codes add the number of codes; reconciliation adds mismatched orders.
    """
    orphans = orphan_report(tables)
    missing = missing_codes(
        tables["products"], "product_category_name", tables["category_translation"], "product_category_name"
    ).agg(
        F.lit("missing_translation").alias("check_name"),
        F.lit("products").alias("table_name"),
        F.lit("product_category_name").alias("key_columns"),
        F.lit("category_translation").alias("parent_table"),
        F.count(F.lit(1)).alias("issues"),
    )
    dups = duplicate_report(tables).select(
        F.lit("duplicate_keys").alias("check_name"),
        "table_name",
        "key_columns",
        F.lit(None).cast("string").alias("parent_table"),
        F.col("duplicate_keys").alias("issues"),
    )
    rec = reconcile_count(tables["order_payments"], tables["order_items"], tol).select(
        F.lit("payment_vs_items").alias("check_name"),
        F.lit("order_payments").alias("table_name"),
        F.lit("order_id").alias("key_columns"),
        F.lit("order_items").alias("parent_table"),
        F.col("mismatched_orders").alias("issues"),
    )
    checks = union_all([orphans, missing, dups, rec])
    checks = checks.withColumn("status", F.when(F.col("issues") == 0, F.lit("ok")).otherwise(F.lit("warn")))
    total = checks.agg(
        F.lit("summary").alias("check_name"),
        F.lit(None).cast("string").alias("table_name"),
        F.lit(None).cast("string").alias("key_columns"),
        F.lit(None).cast("string").alias("parent_table"),
        F.sum("issues").alias("issues"),
    )
    total = total.withColumn("status", F.when(F.col("issues") == 0, F.lit("ok")).otherwise(F.lit("warn")))
    return checks.unionByName(total)


# ------------------------------------------------------------ DQ-10..12
def pk_report(tables: Mapping[str, DataFrame], pks=PRIMARY_KEYS) -> DataFrame:
    """DQ-10: a primary key holds when no key column is null and keys are unique.

    One grouped pass per table: rows with a null key column fall into their
    own groups, so null keys and duplicate keys both come from the counts.
    """
    frames = []
    for pk in pks:
        any_null = F.lit(False)
        for c in pk.columns:
            any_null = any_null | F.col(c).isNull()
        g = key_groups(tables[pk.table], pk.columns).withColumn("_null", any_null)
        frames.append(
            g.agg(
                F.lit(pk.table).alias("table_name"),
                F.lit(pk.name).alias("constraint_name"),
                F.lit(",".join(pk.columns)).alias("key_columns"),
                F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).alias("null_keys"),
                F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
            )
        )
    out = union_all(frames).withColumn("violations", F.col("null_keys") + F.col("duplicate_keys"))
    return out.withColumn("status", F.when(F.col("violations") == 0, F.lit("ok")).otherwise(F.lit("violated")))


def fk_violations(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """DQ-11: non-null child keys without a parent (a null child passes)."""
    return orphan_rows(child.where(F.col(col).isNotNull()), col, parent, parent_col)


def fk_report(tables: Mapping[str, DataFrame], fks=FOREIGN_KEYS) -> DataFrame:
    frames = [
        orphan_count(tables[fk.table], fk.column, tables[fk.parent], fk.parent_column, null_keys=False).select(
            F.lit(fk.table).alias("table_name"),
            F.lit(fk.name).alias("constraint_name"),
            F.lit(fk.column).alias("column_name"),
            F.lit(fk.parent).alias("parent_table"),
            F.lit(fk.parent_column).alias("parent_column"),
            F.col("issues").alias("violations"),
        )
        for fk in fks
    ]
    out = union_all(frames)
    return out.withColumn("status", F.when(F.col("violations") == 0, F.lit("ok")).otherwise(F.lit("violated")))


def constraint_list(tables: Mapping[str, DataFrame], pks=PRIMARY_KEYS, fks=FOREIGN_KEYS) -> DataFrame:
    """DQ-12: (table, constraint, type, column, violations), one row per key column.

    The listing comes from the declared registry; violations are measured on
    the data. Sorted by table, type and constraint like the catalog query.
    """
    pk = pk_report(tables, pks).select(
        "table_name",
        "constraint_name",
        F.lit("PRIMARY KEY").alias("constraint_type"),
        F.explode(F.split("key_columns", ",")).alias("column_name"),
        "violations",
    )
    fk = fk_report(tables, fks).select(
        "table_name", "constraint_name", F.lit("FOREIGN KEY").alias("constraint_type"), "column_name", "violations"
    )
    return pk.unionByName(fk).orderBy("table_name", "constraint_type", "constraint_name", "column_name")


class KeyViolation(ValueError):
    """A declared key does not hold."""


def assert_keys(tables: Mapping[str, DataFrame], pks=PRIMARY_KEYS, fks=FOREIGN_KEYS) -> None:
    """DQ-10/11 as a gate: raises at the first violated keys, as a database
    does when a constraint is added to data that breaks it."""
    bad = constraint_list(tables, pks, fks).where("violations > 0").collect()  # a row a declared key column
    if bad:
        raise KeyViolation("; ".join(f"{r.constraint_name}({r.column_name}): {r.violations}" for r in bad))


# ------------------------------------------------------------ DQ-13..17
def flagged_count(df: DataFrame, masks: Sequence[Column]) -> DataFrame:
    """DQ-13/14 report: rows, rows matching any mask, rows kept."""
    from ordermart.operators.rows import any_mask

    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(any_mask(*masks)).alias("rows_removed"),
    ).withColumn("rows_after", F.col("rows_before") - F.col("rows_removed"))


def null_metric_by_status(orders: DataFrame, metric: str = "delivery_delay_days") -> DataFrame:
    """DQ-15: statuses of rows whose metric is null (expected: not delivered)."""
    return (
        orders.where(F.col(metric).isNull() & F.col("order_status").isNotNull())
        .groupBy("order_status")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"))
    )


def extremes(df: DataFrame, col: str, low: float = -30, high: float = 30) -> DataFrame:
    """DQ-16: counts below ``low`` and above ``high`` (reported, not removed)."""
    return df.agg(
        F.count_if(F.col(col) < low).alias("extremely_early"),
        F.count_if(F.col(col) > high).alias("extremely_late"),
    )


def conflicting_parents(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """DQ-17: ids that occur more than once, and those mapped to >1 parent."""
    per_id = df.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_n"), F.min(parent_col).alias("_low"), F.max(parent_col).alias("_high")
    )
    return per_id.agg(
        F.count_if(F.col("_n") > 1).alias("duplicated_ids"),
        F.count_if(F.col("_low") < F.col("_high")).alias("conflicting_ids"),
    )
