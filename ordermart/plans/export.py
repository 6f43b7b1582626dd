"""SNK-3: batch export of the dashboard questions, one CSV folder per query.

The exported set and file names follow the reference's exporter: nine
questions, eight identical to the analysis files and the item-grain
same/cross-state variant (A-13). Results are a handful of rows, so each is
coalesced to a single CSV part; the queries themselves run distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ordermart.plans import registry
from ordermart.plans.mart import Mart
from ordermart.sources.io import write_counted

# Exported file names and the question behind each.
EXPORTS = {
    "overview_kpi": "a01_overview_kpi",
    "delay_days_distribution": "a02_delay_days_distribution",
    "monthly_trend": "a09_monthly_trend",
    "delay_by_dow": "a04_delay_by_dow",
    "delay_by_state": "a10_delay_by_state",
    "seller_distribution_by_state": "a11_seller_distribution_by_state",
    "same_vs_cross_state": "a13_same_vs_cross_state",
    "review_score_by_delay_bucket": "a15_review_score_by_delay_bucket",
    "review_score_pct_by_status": "a16_review_score_pct_by_status",
}


def export_csv(mart: Mart, out_dir: str, exports: dict[str, str] = EXPORTS) -> DataFrame:
    """Write each export of a mart to ``<out_dir>/<name>.csv/``; report
    (file_name, rows), as the write jobs counted them."""
    counts = [
        (name, write_counted(registry.ANALYTICS[query](mart).coalesce(1), f"{out_dir.rstrip('/')}/{name}.csv", "csv"))
        for name, query in exports.items()
    ]
    return mart.spark.createDataFrame(counts, "file_name string, rows long")


if __name__ == "__main__":
    # python -m ordermart.plans.export <sf_dir> <out_dir>
    import sys

    from ordermart.session import get_spark

    if len(sys.argv) != 3:
        raise SystemExit("usage: python -m ordermart.plans.export <sf_dir> <out_dir>")
    spark = get_spark(scale=True)
    for row in export_csv(Mart.shared(spark, sys.argv[1]), sys.argv[2]).collect():
        print(f"Exported: {sys.argv[2].rstrip('/')}/{row.file_name}.csv ({row.rows} rows)")
    spark.stop()
