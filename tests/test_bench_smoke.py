"""bench.py contract: one JSON line on stdout with the expected keys."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(
        os.environ,
        BENCH_SF_DIR="/root/testdata/sf0.001",
        BENCH_ONLY="a01_overview_kpi,a11_seller_distribution_by_state",
        BENCH_WARM="none",
        BENCH_CPUS="2",
    )
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        env=env, capture_output=True, text=True, timeout=600, check=True,
    ).stdout
    lines = [line for line in out.splitlines() if line.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["metric"] == "total_query_seconds"
    assert set(d["queries"]) == {"etl_load_mart", "a01_overview_kpi", "a11_seller_distribution_by_state"}
    assert d["value"] > 0
