"""A query loads the tables it reads; rows meet the doomed keys alone."""

import pytest
from pyspark.sql import functions as F

from ordermart.operators import quality as Q
from ordermart.operators import repair as R
from ordermart.operators.rows import keep_first
from ordermart.plans import registry
from ordermart.plans.mart import TABLES, LoadedMart, Mart
from ordermart.sources import io, versions

SF = "/root/testdata/sf0.001"


def test_a_query_writes_only_what_it_reads(spark):
    mart = LoadedMart(Mart(spark, SF))
    registry.PROFILING["prf_dup_rows"](mart).count()
    assert not mart.paths
    registry.PROFILING["prf_conditional_counts"](mart).count()
    assert set(mart.paths) == {"raw_orders"}
    registry.ANALYTICS["a11_seller_distribution_by_state"](mart).count()
    assert set(mart.paths) == {"raw_orders", "sellers"}
    before = dict(mart.paths)
    assert set(mart.tables()) == set(TABLES) and set(mart.paths) == {*TABLES, "raw_orders"}
    assert before.items() <= mart.paths.items()
    assert mart.load_raw().raw.orders is mart.raw.orders
    mart.unload()


@pytest.mark.parametrize("limit", [0, 4_000_000])
def test_the_rewrite_shuffles_no_rows_for_few_doomed_keys(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(R, "BROADCAST_KEYS", limit)
    rows = spark.range(200).select((F.col("id") % 23).alias("k"), "id").union(spark.createDataFrame([(None, 900)], "k long, id long"))
    for at, parent in enumerate((spark.range(20).toDF("pk"), spark.range(0).toDF("pk"), spark.createDataFrame([(1,), (None,)], "pk long"))):
        path, plans = str(tmp_path / f"t{at}"), []
        versions.replace(rows.repartition(3), path)
        rewrite = versions.rewrite

        def seen(spark, path, touched, survivors):
            def noted(some):
                plans.append(survivors(some))
                return plans[-1]

            return rewrite(spark, path, touched, noted)

        monkeypatch.setattr(versions, "rewrite", seen)
        R.delete_by_file(spark, path, "k", parent, "pk")
        monkeypatch.setattr(versions, "rewrite", rewrite)
        want = Q.delete_not_in(rows, "k", parent, "pk")
        assert sorted(io.read_table(spark, path).collect(), key=str) == sorted(want.collect(), key=str)
        for p in plans if limit else []:
            assert "BroadcastHashJoin" in p._jdf.queryExecution().executedPlan().toString()


def test_an_order_that_is_not_kept_travels_once(spark):
    df = spark.range(40).select(F.floor(F.col("id") / 2).alias("k"), "id", F.struct((-F.col("id")).alias("o")).alias("src_order"))
    out = keep_first(df, ["k"], ["src_order"], ["src_order"])
    assert out.columns == ["k", "id"]
    assert sorted(map(tuple, out.collect())) == [(k, 2 * k + 1) for k in range(20)]
