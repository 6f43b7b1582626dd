"""SNK-3: the nine exports land as headered CSV with the query's row count."""

import __spark_entry__ as E
from ordermart.plans.export import EXPORTS, export_csv
from ordermart.plans.mart import Mart

SF = "/root/testdata/sf0.001"


def test_export_row_counts(spark, tmp_path):
    report = {r.file_name: r.rows for r in export_csv(Mart.shared(spark, SF), str(tmp_path)).collect()}
    assert set(report) == set(EXPORTS)
    qs = E.queries()
    for name in ("overview_kpi", "delay_by_dow", "same_vs_cross_state"):
        assert report[name] == qs[EXPORTS[name]](spark, SF).count()
    header = next((tmp_path / "overview_kpi.csv").glob("part-*.csv")).read_text().splitlines()[0]
    assert header == "total_orders,delayed_orders,delay_rate_pct,avg_delay_days_all,avg_delay_days_delayed"
