"""Raw tables whose types are inferred: few bytes on disk at a time."""

import os

from pyspark.sql import functions as F

from ordermart.plans import mart as marts
from ordermart.plans import registry
from ordermart.plans.mart import TABLES, Mart
from ordermart.session import discard
from ordermart.sources import infer, io

SAID = 'said, "so"\nthere'


def raw_tables(spark, n):
    """Nine tables of whole numbers, numbers with gaps, numbers and texts."""
    rows = spark.range(n, numPartitions=3).select(
        "id", F.when(F.col("id") % 7 != 3, F.col("id")).alias("gaps"), (F.col("id") / 4).alias("half"), F.lit("plain").alias("text")
    )
    tables = {name: rows for name in TABLES}
    tables["order_reviews"] = rows.withColumns({"text": F.lit(SAID), "src_order": F.col("id")})
    return tables


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_one_table_has_files_at_a_time(spark, monkeypatch):
    tables, n = raw_tables(spark, 3000), 3000
    alive, most, packed, plans = set(), [], [], []
    write = io.write_table

    def written(df, path, fmt="parquet", *args, **options):
        if fmt == "csv":
            alive.add(path)
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = write(df, path, fmt, *args, **options)
        if fmt == "csv":
            most.append(len(alive))
            packed.append(size(path))
        return out

    def discarded(spark, path):
        discard(spark, path)
        assert not os.path.exists(path)
        alive.remove(path)

    monkeypatch.setattr(io, "write_table", written)
    monkeypatch.setattr(registry, "discard", discarded, raising=False)
    monkeypatch.setattr(registry, "ALONE_ROWS", 0, raising=False)
    got = {(r.table_name, r.column_name): (r.data_type, r.n_rows, r.n_null) for r in registry._inferred(Mart.from_raw(spark, tables)).collect()}
    gaps = sum(k % 7 == 3 for k in range(n))
    want = {"id": ("bigint", n, 0), "gaps": ("double", n, gaps), "half": ("double", n, 0), "text": ("string", n, 0)}
    assert got == {(t, c): v for t in TABLES for c, v in want.items()}
    assert len(most) == 9 and max(most) == 1 and not alive
    # Some 20 bytes a row, some 40 of reviews: the files are packed, and no rows are shuffled.
    assert max(packed) < n * 13
    assert not any("Repartition" in p or "Rebalance" in p for p in plans)


def test_files_that_fail_to_be_counted_go(spark, monkeypatch):
    paths = []

    def failing(*args, path, **kwargs):
        paths.append(path)
        os.makedirs(path)
        raise ValueError("no files")

    monkeypatch.setattr(registry, "_raw_csv", failing)
    try:
        registry._inferred(Mart.from_raw(spark, raw_tables(spark, 10)))
    except ValueError as e:
        assert str(e) == "no files"
    assert paths and not any(map(os.path.exists, paths))


def test_compressed_files_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(registry, "FILE_ROWS", 200)
    df = raw_tables(spark, 3000)["orders"]
    back = registry._raw_csv(df, False, infer=True)
    files = back.inputFiles()
    assert len(files) == 15 and all(f.endswith(".csv.gz") for f in files)
    assert back.count() == 3000 and dict(back.dtypes)["gaps"] == "double"
    monkeypatch.setattr(registry, "MOST_FILES", 4)
    assert len(registry._raw_csv(df, False, infer=True).inputFiles()) <= 4 + 2


def test_tables_without_rows(spark):
    got = registry._inferred(Mart.from_raw(spark, raw_tables(spark, 0))).collect()
    assert {(r.data_type, r.n_rows, r.n_null) for r in got} == {("string", 0, 0)} and len(got) == 36


def test_the_query_writes_no_mart(spark, monkeypatch):
    loaded, load = [], io.load_tables
    monkeypatch.setattr(marts, "_LOADED", {})
    monkeypatch.setattr(io, "load_tables", lambda tables, *args: loaded.extend(tables) or load(tables, *args))
    out = registry.queries()["io_raw_inferred"](spark, "/root/testdata/sf0.001")
    assert out.select("table_name").distinct().count() == 9 and not loaded


def test_what_values_can_be(spark):
    whole, both, number = infer.IS_WHOLE | infer.IS_NUMBER, infer.IS_SIGNED | infer.IS_UNSIGNED, infer.IS_NUMBER
    want = {
        "7": whole | both, " +007\t": whole | both, "-0": whole | both, "-7": whole | infer.IS_SIGNED, "7\n": whole | both,
        "9223372036854775808": whole | infer.IS_UNSIGNED, "18446744073709551616": whole, "9" * 50: whole, "0" * 50: whole | both,
        "7\u0085": whole, "7.": number, ".5e-3 ": number, "1E5": number, "-Inf": number, "\tinfinity": number, "ınf": 0,
        "true": infer.IS_TRUTH, "tRue": 0, "1:2": 0, "1d": 0, "2001-03-17T17:00:00.000": 0, "nan": 0, "": 0, "٣": 0, None: None,
    }
    rows = spark.createDataFrame([(v,) for v in want], "v string").select("v", infer._kind(F.col("v")).alias("bits")).collect()
    assert {r.v: r.bits for r in rows} == want
