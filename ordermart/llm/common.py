"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermart.session import shared_dir

#: A word is a run of anything but space, tab, newline, vertical tab, form
#: feed and carriage return, for every operator here.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six separators as literal characters.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the id, the text (null: empty) and the named columns, so that a
    caller's extra columns can never clash with an operator's own."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text, *more)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, so that lost
    executors never force the work before it to run again."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int = 1, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of text, and one row at least,
    so that what a task holds beside the batch doesn't grow with its rows."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths, dtype=np.int64) - lengths) // size
    starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.array([], np.int64)
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        yield batch.slice(a, b - a)
