"""ETL-11: cross-table repair, then key validation, in the reference's order.

1. delete orphan order_items, order_reviews, order_payments (null-aware
   NOT IN semantics, DQ-3);
2. append category codes missing from the translation lookup (DQ-4/5);
3. validate primary keys, then foreign keys, and list every constraint with
   its violation count (DQ-10..12).

Repaired tables are written to the shared folder and read back before the
checks, so each check starts from a short lineage and a lost executor only
recomputes from the written copy.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermart.operators import quality as Q
from ordermart.session import shared_dir
from ordermart.sources import io, versions

#: Doomed keys that are broadcast; more of them meet the rows by a shuffle.
BROADCAST_KEYS = 4_000_000


def delete_by_file(spark: SparkSession, path: str, child_col: str, parent: DataFrame, parent_col: str) -> list[str]:
    """DQ-3 / SNK-6 on a stored table: the null-aware NOT IN delete by
    copy-on-write. Only files that hold doomed rows are read whole and written
    anew; their names are returned. One row a key and file meets the parent; the
    rows then meet the doomed keys alone, which are few as a rule."""
    doomed: list[DataFrame] = []

    def touched(table: DataFrame, file: str) -> DataFrame:
        keys = table.groupBy(child_col, file).agg(F.count(F.lit(1)).alias("_n"))
        flagged = Q.flag_not_in(keys, child_col, parent, parent_col, "_keep").where(~F.col("_keep"))
        doomed.append(io.materialize(flagged.select(child_col, file)))
        return doomed[0]

    def survivors(rows: DataFrame) -> DataFrame:
        gone = doomed[0].select(F.col(child_col).alias("_gone"))
        n, nulls = gone.agg(F.count(F.lit(1)), F.count_if(F.col("_gone").isNull())).first()
        gone = gone.distinct()
        kept = rows.join(F.broadcast(gone) if n <= BROADCAST_KEYS else gone, rows[child_col] == F.col("_gone"), "left_anti")
        # Null keys meet no key: they go where the check found them doomed.
        return kept.where(F.col(child_col).isNotNull()) if nulls else kept

    return versions.rewrite(spark, path, touched, survivors)


REPAIRED_CHILDREN = ("order_items", "order_reviews", "order_payments")


def repair_tables(
    tables: Mapping[str, DataFrame],
    translations: Mapping[str, str] | None = None,
    persist: bool = True,
    paths: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """``translations``: names for codes that the lookup lacks. A missing code
    without one is appended with a null name; none is made up.

    ``paths``: where the tables are stored (``LoadedMart.paths``). The children
    are then repaired file by file, in clones that share all other files; the
    stored tables themselves stay as they are."""
    out = dict(tables)
    orders = tables["orders"]
    spark = orders.sparkSession
    if paths and persist:
        root = shared_dir(spark)

        def repaired(child: str) -> DataFrame:
            versions.clone(spark, paths[child], f"{root}/{child}")
            delete_by_file(spark, f"{root}/{child}", "order_id", orders, "order_id")
            return versions.read(spark, f"{root}/{child}")

        with ThreadPoolExecutor(max_workers=len(REPAIRED_CHILDREN)) as pool:
            out |= dict(zip(REPAIRED_CHILDREN, pool.map(repaired, REPAIRED_CHILDREN), strict=True))
    else:
        for child in REPAIRED_CHILDREN:
            out[child] = Q.delete_not_in(tables[child], "order_id", orders, "order_id")
    lookup = tables["category_translation"]
    missing = Q.missing_codes(tables["products"], "product_category_name", lookup, "product_category_name")
    code = F.col("product_category_name")
    name = F.lit(None).cast("string")
    for given, english in (translations or {}).items():
        name = F.when(code == given, F.lit(english)).otherwise(name)
    rows = missing.select(code, name.alias("product_category_name_english"))
    out["category_translation"] = Q.append_missing(lookup, rows, "product_category_name")
    if persist:
        # independent writes: submitted together, then read back (lineage cut)
        names = ("category_translation",) if paths else (*REPAIRED_CHILDREN, "category_translation")
        changed = {name: out[name] for name in names}
        for name, path in io.load_tables(changed).items():
            out[name] = io.read_table(out[name].sparkSession, path, schema=changed[name].schema)
    return out


def cross_repair(
    tables: Mapping[str, DataFrame],
    translations: Mapping[str, str] | None = None,
    persist: bool = True,
    paths: Mapping[str, str] | None = None,
) -> DataFrame:
    """Repair, then the constraint listing with violations after repair."""
    return Q.constraint_list(repair_tables(tables, translations, persist, paths))
