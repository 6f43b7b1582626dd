"""Profiling semantics and the CSV round trip."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampNTZType

from ordermart.operators import profile as P
from ordermart.sources.io import read_raw_csv, write_table


def test_describe_semantics(spark):
    # Pandas describe of {1, 2, 4, null}: quartiles 1.5 / 2 / 3, std 1.5275.
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    r = P.numeric_summary(df, ["x"]).first()
    assert (r["count"], r.p25, r.p50, r.p75, r["min"], r["max"]) == (3, 1.5, 2.0, 3.0, 1.0, 4.0)
    assert r["std"] == pytest.approx(1.527525, abs=1e-6)


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(7)
    rows = []
    for g in ("a", "b", "c"):
        n = rnd.randint(1, 400)
        # heavy ties in group b: a hot value owns a third of the rows
        rows += [(g, float(rnd.choice([5, 5, 5, 1, 2, 3, 9])) if g == "b" else rnd.gauss(0, 10)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {r.g: (r.q25, r.q50, r.q75) for r in P.exact_quantiles(df, ["g"], partitions=7).collect()}
    for g in ("a", "b", "c"):
        vals = np.array([v for k, v in rows if k == g])
        want = np.percentile(vals, [25, 50, 75])  # linear interpolation, as pandas
        assert got[g] == pytest.approx(tuple(want), abs=1e-9)


def test_text_summary_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "s string")
    r = P.text_summary(df, ["s"]).first()
    assert (r["count"], r.unique, r.top, r.freq) == (5, 3, "a", 2)


def test_value_counts_normalised(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "s string")
    got = {r.s: r.pct for r in P.value_counts(df, "s", normalize=True).collect()}
    assert got == {"x": 66.67, "y": 33.33}


def test_duplicate_rows_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4), ("b", 5)], "k string, v int")
    assert sorted(r.v for r in P.duplicate_rows(df, ["k"]).collect()) == [1, 2, 4, 5]


def test_csv_round_trip_dialect(spark, tmp_path):
    # Quoted newline, doubled quote, NA tokens, leading-zero
    # zip and a null timestamp survive write -> read.
    raw = tmp_path / "raw.csv"
    raw.write_text(
        "zip,msg,score,ts\n"
        '01037,"line one\nline two",1.5,2024-01-02 03:04:05\n'
        '02000,"say ""hi""",NA,\n'
        "03000,null,2.0,2024-02-03 00:00:00\n"
    )
    schema = StructType(
        [
            StructField("zip", StringType()),
            StructField("msg", StringType()),
            StructField("score", DoubleType()),
            StructField("ts", TimestampNTZType()),
        ]
    )
    df = read_raw_csv(spark, str(raw), schema)
    rows = sorted(df.collect(), key=lambda r: r.zip)
    assert [r.zip for r in rows] == ["01037", "02000", "03000"]
    assert rows[0].msg == "line one\nline two" and rows[1].msg == 'say "hi"' and rows[2].msg is None
    assert rows[1].score is None and rows[1].ts is None
    assert rows[0].ts == dt.datetime(2024, 1, 2, 3, 4, 5)
    out = str(tmp_path / "out")
    write_table(df, out, "csv")
    back = sorted(read_raw_csv(spark, out, schema).collect(), key=lambda r: r.zip)
    assert back == rows


def test_write_counted_matches_rows(spark, tmp_path):
    # SNK-4: the row count comes from an Observation on the write itself.
    from ordermart.sources.io import load_report, read_table, write_counted

    df = spark.range(1234).selectExpr("id", "id % 7 AS k")
    assert write_counted(df.where("k = 3"), str(tmp_path / "a")) == df.where("k = 3").count()
    report = {r.table_name: r.n_rows for r in load_report(spark, {"x": df, "y": df.limit(5)}, str(tmp_path / "load")).collect()}
    assert report == {"x": 1234, "y": 5}
    assert read_table(spark, str(tmp_path / "load" / "x")).count() == 1234


def test_text_summary_all_null_column(spark):
    df = spark.createDataFrame([("x", None), ("y", None), ("x", None)], "a string, b string")
    got = {r.column_name: (r["count"], r.unique, r.top, r.freq) for r in P.text_summary(df, ["a", "b"]).collect()}
    assert got == {"a": (3, 2, "x", 2), "b": (0, 0, None, None)}


def test_conditional_count_and_schema_report(spark):
    # PRF-10: rows matching a predicate (a null comparison counts as False).
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.0,), (-40.0,), (None,), (35.0,)], "d double")
    assert P.conditional_count(df, F.col("d") < -30, "early").first().early == 1
    # PRF-2/3: column names and types, in order.
    rows = [(r.position, r.column_name, r.data_type) for r in P.schema_report(spark, df, "t").collect()]
    assert rows == [(0, "d", "double")]


def test_conditional_counts_semantics(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [("a", None, 1), ("a", 1, None), ("b", None, None), (None, None, None), ("c", 1, 1)],
        "s string, x int, y int",
    )
    got = sorted(tuple(r) for r in P.conditional_counts(df, {"x": F.col("x").isNull(), "y": F.col("y").isNull()}, "s").collect())
    assert got == [("x", "a", 1), ("x", "b", 1), ("y", "a", 1), ("y", "b", 1)]


def test_text_summary_of_long_texts(spark):
    """Against plain counts, with every length of prefix and texts around it."""
    import random
    from collections import Counter

    rng = random.Random(5)
    stock = ["", "a", "ab", "abc", "abcd", "abcde", "abcdé", "abcdef" * 50, "abcdef" * 49 + "z", "ébc" * 9, "\U0001f600" * 5, "abcd\x00"]
    rows = [(rng.choice([None, *stock]), rng.choice(stock[6:]), f"{'same start ' * 3}{k}", None) for k in range(300)]
    rows += [(None, "abcdef" * 50, "x", None)] * 2
    df = spark.createDataFrame(rows, "a string, `b.c` string, `count` string, d string")
    for prefix in (1, 3, 4, 5, 32, 1000):
        got = {r.column_name: (r["count"], r.unique, r.top, r.freq) for r in P.text_summary(df, prefix=prefix).collect()}
        for i, c in enumerate(df.columns):
            counts = Counter(r[i] for r in rows if r[i] is not None)
            top = min(((-n, v.encode()) for v, n in counts.items()), default=(None, None))
            want = (sum(counts.values()), len(counts), top[1] and top[1].decode(), top[0] and -top[0])
            if top[1] == b"":
                want = (*want[:2], "", want[3])
            assert got[c] == want, (prefix, c)


def test_text_summary_of_unique_long_texts_and_no_rows(spark):
    df = spark.createDataFrame([("x" * 60 + str(k),) for k in range(50)], "s string")
    r = P.text_summary(df, name="t").first()
    assert (r.table_name, r["count"], r.unique, r.top, r.freq) == ("t", 50, 50, "x" * 60 + "0", 1)
    assert P.text_summary(df.limit(0)).count() == 0
    both = P.text_summaries({"t": df, "u": df.selectExpr("'y' as s", "1 as n")})
    assert sorted((r.table_name, r.top, r.freq) for r in both.collect()) == [("t", "x" * 60 + "0", 1), ("u", "y", 50)]
