"""SRC-3 / SRC-4: SQL text over the loaded tables.

``register_views`` exposes the nine cleaned tables as temporary views under
their reference names, so analysis SQL written for the warehouse runs with
``spark.sql`` unchanged where the dialects agree (COUNT(*) FILTER, ``::``
casts, DATE_TRUNC, window shares). Known dialect differences are listed in
the README; the library's DataFrame operators already account for them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def register_views(tables: Mapping[str, DataFrame], prefix: str = "") -> list[str]:
    names = []
    for name, df in tables.items():
        view = f"{prefix}{name}"
        df.createOrReplaceTempView(view)
        names.append(view)
    return names


def run_sql(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """Register ``tables`` as views and run ``sql`` (a lazy DataFrame)."""
    register_views(tables)
    return spark.sql(sql)
