"""ordermart: a Spark-first toolkit for order-delivery operations data.

Layers:

* ``sources``   — typed readers and writers (CSV / Parquet), the conformed
                   view over the driver's TPC-H-style tables.
* ``functions`` — column expressions shared by every operator (whole-day
                   differences, percentages, severity buckets, safe corr).
* ``operators`` — DataFrame -> DataFrame building blocks: profiling, data
                   quality, cleaning jobs, cross-table repair, analytics.
* ``plans``     — the named-query registry (Spark side and DuckDB oracle)
                   and the batch CSV exporter.
"""

from ordermart.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
