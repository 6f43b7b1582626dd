"""SRC-1: types by pandas' rules, and files with quoted newlines in many tasks."""

import io as buffers
import random

import pandas as pd
import pytest

from ordermart.sources import infer, records
from ordermart.sources.io import PANDAS_NA_STRINGS, read_raw_csv

COLUMNS = {
    "whole": ["1", "-2", "+3", "007"],
    "gaps": ["1", "", "3", "NA"],
    "floats": ["1.5", "2", ".5", "1e3"],
    "dots": ["5.", "6", "7", "-0.0"],
    "endless": ["inf", "-Infinity", "1", "2"],
    "truth": ["True", "false", "TRUE", "False"],
    "truth_gaps": ["True", "", "True", "False"],
    "mixed": ["True", "1", "0", "False"],
    "text": ["a", "1", "", "2.5"],
    "nothing": ["", "NA", "null", "nan"],
    "large": ["9223372036854775807", "-9223372036854775808", "0", "1"],
    "unsigned": ["18446744073709551615", "1", "2", "3"],
    "unsigned_signed": ["18446744073709551615", "-1", "2", "3"],
    "unsigned_gaps": ["18446744073709551615", "", "2", "3"],
    "huge": ["99999999999999999999999999", "1", "2", "3"],
    "beyond": ["9" * 50, "1", "2", "3"],
    "dates": ["2024-01-01", "2024-01-02 03:04:05", "", "2024"],
    "spaces": [" 1", "2 ", " 3 ", "4"],
    "suffix": ["1d", "2f", "3", "4"],
    "underscore": ["1_000", "2", "3", "4"],
    "hex": ["0x10", "1", "2", "3"],
}
SPARK = {"int64": "bigint", "float64": "double", "bool": "boolean", "uint64": "decimal(20,0)"}


def test_types_equal_pandas(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(",".join(COLUMNS) + "\n" + "".join(",".join(r) + "\n" for r in zip(*COLUMNS.values(), strict=True)))
    theirs = pd.read_csv(path)
    df = read_raw_csv(spark, str(path))
    want = {c: SPARK.get(str(t), "string") for c, t in theirs.dtypes.items()}
    assert dict(df.dtypes) == want
    rows = df.collect()
    for c in ("whole", "floats", "dots", "endless", "large", "spaces", "truth"):
        assert [r[c] for r in rows] == theirs[c].tolist(), c
    assert [r["gaps"] for r in rows] == [1.0, None, 3.0, None]


def test_types_of_a_table_without_rows(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert infer.infer_schema(df).simpleString() == "struct<a:string,b:int>"
    assert infer.infer_schema(spark.createDataFrame([(None, 1)], "a string, b int")).simpleString() == "struct<a:double,b:int>"


def text_of(rnd, n, end="\n"):
    """A CSV text with quoted newlines, quotes, separators and empty fields."""
    bits = ["a", "é", ",", '""', "\n", "\n\n", "line", " ", "'", "x" * 20, "\r\n"]
    out = ["id,msg,other"]
    for k in range(n):
        message = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))
        other = rnd.choice(["", "plain", '"quoted"', '"two\nlines"'])
        out.append(f'{k},"{message}",{other}' if rnd.random() < 0.8 else f"{k},,{other}")
    return end.join(out) + (end if rnd.random() < 0.5 else "")


def rows_of(rows):
    """Spark's multi-line reader makes line ends inside quotes newlines."""
    return sorted((tuple(v.replace("\r\n", "\n") if isinstance(v, str) else v for v in tuple(r)[:3]) for r in rows), key=str)


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_split_files_equal_the_multi_line_reader(spark, tmp_path, size):
    rnd = random.Random(size)
    for k, end in enumerate(["\n", "\r\n", "\n"]):
        (tmp_path / f"part-{k}.csv").write_bytes(text_of(rnd, 40, end).encode())
    long = '"' + "no end of record\n" * 20 + '"'  # spans several blocks
    (tmp_path / "part-9.csv").write_bytes(f'id,msg,other\n1000,{long},x\n\n1001,"{"y" * 300}",z\n'.encode())
    options = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 0}
    before = {k: spark.conf.get(k) for k in options}
    whole = rows_of(read_raw_csv(spark, str(tmp_path)).collect())
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        df = read_raw_csv(spark, str(tmp_path), split=True, order_column="place")
        got = df.collect()
        assert df.dtypes[:2] == [("id", "bigint"), ("msg", "string")]
        blocks = records.records(spark, str(tmp_path)).select("no").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows_of(got) == whole
    assert (blocks > 20) == (size == 150)
    # File order: ids rise inside each file, and files come in order of name.
    order = [r.id for r in sorted(got, key=lambda r: tuple(r.place))]
    falls = sum(b < a for a, b in zip(order, order[1:], strict=False))
    assert falls == 2 and order[-1] == 1001


def test_blocks_that_meet_by_a_shuffle(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text(text_of(random.Random(1), 40))
    whole = rows_of(read_raw_csv(spark, str(tmp_path)).collect())
    monkeypatch.setattr(records, "BROADCAST_BLOCKS", 0)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
    try:
        assert rows_of(read_raw_csv(spark, str(tmp_path), split=True).collect()) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_split_rows_equal_pandas(spark, tmp_path):
    text = text_of(random.Random(3), 200)
    (tmp_path / "a.csv").write_text(text)
    theirs = pd.read_csv(buffers.StringIO(text), dtype=str, keep_default_na=False)
    mine = {r.id: r for r in read_raw_csv(spark, str(tmp_path / "a.csv"), split=True).collect()}
    na = set(PANDAS_NA_STRINGS)
    for r in theirs.itertuples():
        for column in ("msg", "other"):
            value = getattr(r, column)
            assert mine[int(r.id)][column] == (None if value in na else value), r.id


def test_headers_that_differ_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(Exception, match="header"):
        read_raw_csv(spark, str(tmp_path), split=True).collect()
