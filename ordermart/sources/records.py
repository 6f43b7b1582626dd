"""CSV records out of text that Spark has split (SRC-1 with quoted newlines).

A quoted field may hold newlines, so a line of a CSV file needn't be a record,
and Spark's multi-line reader gives each file to one task. Here files are read
as lines, which Spark splits by blocks. A line ends a record if the quotes
before its end, from the start of its file, are even in number (a doubled
quote counts two). So:

1. one pass counts each block's quotes; their running parity over a file's
   blocks tells each block whether it begins inside a quoted field;
2. a second pass joins the lines of each block to records, in streams of Arrow
   batches, and marks what a block's border cuts: a head, a tail, or a block
   without any record's end;
3. those few pieces, two a block at most, are joined in file order.

Parsing stays with Spark's ``from_csv``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks whose parities are broadcast (some 40 bytes each); beyond, blocks
#: meet their parity by a shuffle that keeps a block's lines together.
BROADCAST_BLOCKS = 500_000

WHOLE, HEAD, TAIL, MIDDLE = range(4)
SCHEMA = "no long, row long, kind int, text string"


class _Block:
    """Lines of one block as they stream by."""

    def __init__(self, no: int, odd: bool):
        self.no, self.odd = no, int(odd)
        self.begun = odd  # what is held began in an earlier block
        self.held: list[str] = []
        self.row = self.line = 0

    def take(self, lines: pa.Array) -> pa.RecordBatch | None:
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        inside = (self.odd + np.cumsum(quotes)) & 1
        ends = np.flatnonzero(inside == 0) + 1
        self.odd = int(inside[-1])
        if not len(ends):
            if not self.held:
                self.row = self.line
            self.held += lines.to_pylist()
            self.line += len(lines)
            return None
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), lines), "\n")
        rows = self.line + np.array([0, *ends[:-1]])
        kinds = np.full(len(ends), WHOLE, np.int32)
        if self.held:
            joined = pa.concat_arrays([pa.array(["\n".join([*self.held, joined[0].as_py()])]), joined[1:]])
            rows[0] = self.row
        if self.begun:
            kinds[0] = HEAD
        self.begun, self.held = False, lines[int(ends[-1]) :].to_pylist()
        self.row = self.line + int(ends[-1])
        self.line += len(lines)
        return self._batch(rows, kinds, joined)

    def rest(self) -> pa.RecordBatch | None:
        if not self.held:
            return None
        kind = MIDDLE if self.begun else TAIL
        return self._batch([self.row], np.array([kind], np.int32), pa.array(["\n".join(self.held)]))

    def _batch(self, rows, kinds, texts: pa.Array) -> pa.RecordBatch:
        no = pa.array(np.full(len(texts), self.no, np.int64))
        return pa.RecordBatch.from_arrays([no, pa.array(np.asarray(rows, np.int64)), pa.array(kinds), texts.cast(pa.string())], names=["no", "row", "kind", "text"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = None
    for batch in batches:
        numbers = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(numbers, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(numbers)], strict=True):
            if block is None or block.no != numbers[a]:
                if block is not None and (out := block.rest()) is not None:
                    yield out
                block = _Block(int(numbers[a]), batch.column(1)[a].as_py())
            if (out := block.take(batch.column(2).slice(a, b - a))) is not None:
                yield out
    if block is not None and (out := block.rest()) is not None:
        yield out


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``no, row, first, text``: every record of the CSV files, header records
    included (``first``: the first of its file). ``(no, row)`` is file order:
    the block's number over all files by name, then the line in it.

    Line ends inside quotes stay as they are, as in pandas (Spark's multi-line
    reader makes them newlines in files with carriage returns); those at a
    record's end are gone. A quoted field left open runs to the end of its file.
    Empty lines between records are no records.
    """
    from ordermart.sources import io

    text = spark.read.option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = text.select(*place, F.col("value"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("odd"))
    # One row a block: small whatever the files hold, so one order over all is.
    blocks = blocks.withColumn("no", F.row_number().over(Window.orderBy("file", "start")).cast("long"))
    blocks = io.materialize(blocks)
    n = blocks.count()
    if n <= BROADCAST_BLOCKS:
        met = lines.join(F.broadcast(blocks), ["file", "start"])
    else:
        numbered = lines.withColumn("at", F.monotonically_increasing_id()).join(blocks, ["file", "start"])
        met = numbered.repartition("no").sortWithinPartitions("no", "at")
    pieces = io.materialize(met.select("no", "odd", "value").mapInArrow(_assemble, SCHEMA))
    # A cut record: its tail, then blocks without an end, then a head.
    cut = pieces.where(F.col("kind") != WHOLE).join(blocks.select("no", "file"), "no")
    order = Window.partitionBy("file").orderBy("no", "row").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    cut = cut.groupBy("file", "record").agg(F.min(F.struct("no", "row")).alias("place"), F.sort_array(F.collect_list(F.struct("no", "row", "text"))).alias("parts"))
    cut = cut.select("place.no", "place.row", F.array_join(F.col("parts.text"), "\n").alias("text"))
    firsts = blocks.groupBy("file").agg(F.min("no").alias("no")).select("no", F.lit(0).cast("long").alias("row"), F.lit(True).alias("first"))
    whole = pieces.where(F.col("kind") == WHOLE).select("no", "row", "text").unionByName(cut)
    whole = whole.join(F.broadcast(firsts) if n <= BROADCAST_BLOCKS else firsts, ["no", "row"], "left")
    text = F.regexp_replace("text", "\r$", "")
    return whole.select("no", "row", F.coalesce("first", F.lit(False)).alias("first"), text.alias("text")).where((F.col("text") != "") | F.col("first"))


def read_split(spark: SparkSession, path: str | list[str], options: Mapping[str, str], order_column: str | None = None) -> DataFrame:
    """All columns of headered CSV files as text, split by blocks.

    The files must have one header, as Spark's own reader demands.
    """
    names = spark.read.options(**options).csv(path).columns
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    opts = {k: v for k, v in options.items() if k in ("quote", "escape", "mode", "nullValue")} | {"multiLine": "true", "header": "false"}
    found = records(spark, path)
    parsed = found.select("no", "row", "first", F.from_csv("text", schema, opts).alias("c"))
    heads = F.array(*[F.col(f"c.`{c}`") for c in names])
    same = F.transform(heads, lambda v: F.regexp_replace(v, "^﻿", "")) == F.array(*map(F.lit, names))
    # One predicate, so that header records can't be filtered before they are looked at.
    differs = F.raise_error(F.lit(f"headers differ in {path}")).cast("boolean")
    rows = parsed.where(F.when(~F.col("first"), F.lit(True)).when(same, F.lit(False)).otherwise(differs))
    out = [F.col(f"c.`{c}`").alias(c) for c in names]
    if order_column:
        out.append(F.struct("no", "row").alias(order_column))
    return rows.select(*out)
