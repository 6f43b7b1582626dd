"""Readers and writers (SRC-1/2, SNK-1..5).

Raw CSV is read with an explicit schema and the dialect pandas accepts
(quoted newlines, doubled quotes), then converted to Parquet once; every
later stage reads typed, column-pruned Parquet. Spark's reader gives a file with
quoted newlines to one task; ``split=True`` reads such files by blocks.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ordermart.session import shared_dir
from ordermart.sources import versions
from ordermart.sources.infer import infer_schema
from ordermart.sources.records import read_split

CSV_READ_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "mode": "FAILFAST",
    "nullValue": "",
    "enforceSchema": "false",  # a header that differs from the columns raises
}
CSV_WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "nullValue": ""}

# The strings pandas ``read_csv`` treats as missing by default.
PANDAS_NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_raw_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    na_strings=PANDAS_NA_STRINGS,
    order_column: str | None = None,
    multi_line: bool = True,
    split: bool = False,
) -> DataFrame:
    """SRC-1: read a headered CSV with pandas' missing-value rules, then type it.

    Columns are matched by header name (never by position): every column is
    read as a string, the NA tokens become null, the declared columns get
    their types with ANSI casts (a malformed value raises, as
    ``pd.to_datetime`` does) and undeclared columns pass through as strings.
    String keys keep their leading zeros. Without ``schema`` each column gets
    the narrowest type that its values have, as pandas does (``infer``; one
    more scan).

    ``multi_line=False`` lets Spark split large files without quoted newlines;
    ``split=True`` splits files that have them (``records``): it reads the text
    twice and writes the records once, but a large file is many tasks.

    ``order_column`` adds the row's place in the input, which the keep-first
    cleaning steps order by: file name, block of the file, then the order in
    which the one task that reads the block meets the rows. It holds whatever
    way Spark packs files into tasks.
    """
    options = CSV_READ_OPTIONS | {"multiLine": str(multi_line).lower(), "inferSchema": "false"}
    if split:
        df = read_split(spark, path, options | {"multiLine": "true"}, order_column)
    else:
        df = spark.read.options(**options).csv(path)
    if schema is None:
        text = [c for c in df.columns if c != order_column or not split]
        gaps = df.select(*[F.when(~F.col(f"`{c}`").isin(list(na_strings)), F.col(f"`{c}`")).alias(c) for c in text])
        schema = infer_schema(gaps)
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    declared = {f.name: f.dataType for f in schema.fields}
    na = list(na_strings)
    cols = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if split and name == order_column:
            cols.append(c)
            continue
        c = F.when(c.isin(na), F.lit(None)).otherwise(c)
        cols.append(c.cast(declared[name]).alias(name) if name in declared else c.alias(name))
    if order_column and not split:
        place = ("_metadata.file_path", "_metadata.file_block_start")
        cols.append(F.struct(*(F.col(c) for c in place), F.monotonically_increasing_id().alias("row")).alias(order_column))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options: str | int) -> str:
    """SNK-1/2: write a table (types kept in Parquet, header in CSV)."""
    w = df.write.mode(mode).options(**options)
    if fmt == "csv":
        w.options(**CSV_WRITE_OPTIONS).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """SNK-2: make ``df`` the table at ``path`` as one step (``versions``): until
    the new rows are whole, and if their write fails, readers see the old ones.
    A CSV folder, which other programs read, is written in place."""
    if fmt == "parquet":
        versions.replace(df, path)
    else:
        write_table(df, path, fmt)
    return path


def write_counted(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> int:
    """SNK-1 + SNK-4 in one pass: write and return the rows written.

    The count is an ``Observation`` metric collected by the write job
    itself, so the data is not scanned a second time to report it.
    """
    obs = Observation("rows_written")
    counted = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    if mode == "overwrite":
        replace_table(counted, path, fmt)
    else:
        write_table(counted, path, fmt, mode)
    return int(obs.get["rows"])


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """SRC-2: read a cleaned table back, its present version if it has any."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV tables are read with an explicit schema")
        return spark.read.options(**CSV_READ_OPTIONS).schema(schema).csv(path)
    if fmt == "parquet" and (table := versions.read(spark, path)) is not None:
        return table
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def materialize(df: DataFrame, name: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Write ``df`` under the cluster's shared folder and read it back.

    Cuts lineage with a reliable copy (survives executor loss) instead of
    ``localCheckpoint``; the folder comes from ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    write_table(df, path, fmt)
    return read_table(spark, path, fmt, schema=df.schema if fmt == "csv" else None)


def load_tables(
    tables: Mapping[str, DataFrame], root: str | None = None, fmt: str = "parquet", concurrency: int = 4
) -> dict[str, str]:
    """ETL-10 / SNK-2: replace each table at ``<root>/<name>``, each as one step;
    returns paths for ``read_table``.

    The writes are independent jobs, so up to ``concurrency`` of them are
    submitted at once (Spark schedules concurrent jobs from several threads);
    small tables then no longer leave the cluster idle between big ones.
    """
    if not tables:
        return {}
    first = next(iter(tables.values()))
    base = (root or shared_dir(first.sparkSession)).rstrip("/")
    targets = {name: f"{base}/{name}" for name in tables}
    if concurrency <= 1 or len(tables) == 1:
        return {name: replace_table(df, targets[name], fmt) for name, df in tables.items()}
    with ThreadPoolExecutor(max_workers=concurrency) as pool:
        futures = {name: pool.submit(replace_table, df, targets[name], fmt) for name, df in tables.items()}
        return {name: f.result() for name, f in futures.items()}


def read_raw_dir(spark: SparkSession, files: Mapping[str, str]) -> dict[str, DataFrame]:
    """SRC-1 x 9: read each raw table (name -> CSV path) with its declared schema.

    Tables whose cleaning keeps the first row in file order get the
    ``src_order`` position column.
    """
    from ordermart.sources.schemas import FILE_ORDER_COLUMN, FILE_ORDER_TABLES, MULTI_LINE_TABLES, RAW_SCHEMAS

    return {
        name: read_raw_csv(
            spark,
            path,
            RAW_SCHEMAS[name],
            order_column=FILE_ORDER_COLUMN if name in FILE_ORDER_TABLES else None,
            multi_line=name in MULTI_LINE_TABLES,
        )
        for name, path in files.items()
    }


def load_report(spark: SparkSession, tables: Mapping[str, DataFrame], root: str | None = None) -> DataFrame:
    """SNK-4: write every table and report (table_name, n_rows). The counts are
    those of the write jobs, so nothing is read again."""
    base = (root or shared_dir(spark)).rstrip("/")
    with ThreadPoolExecutor(max_workers=4) as pool:
        counts = list(pool.map(lambda x: (x[0], write_counted(x[1], f"{base}/{x[0]}")), tables.items()))
    return spark.createDataFrame(counts, "table_name string, n_rows long")
