"""Types of untyped columns, by the rules of pandas' ``read_csv`` (SRC-1).

A column's type is the narrowest that all its values have: whole numbers,
numbers, truth values, else text. Whole numbers with gaps become floating
numbers, as a column of numbers has no other missing value there; truth values
with gaps stay text; a column without any value is floating. Dates stay text,
which the cleaning steps type.

What a value can be is a set of bits, and a column's bits are those that all its
values share: a lattice whose meet is a combining ``bit_and``. So one aggregate
over one scan types every column, and the driver sees a few numbers a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DecimalType, DoubleType, LongType, StringType, StructField, StructType

#: What pandas reads as numbers and as truth values. A number
#: without a point or an exponent is whole.
NUMBER = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$"
INFINITE = r"^[ \t]*[+-]?(?i:inf|infinity)[ \t]*$"
TRUTHS = ("True", "TRUE", "true", "False", "FALSE", "false")


#: What a value can be: whole (and signed, or unsigned, of 64 bits), a number, a truth.
IS_WHOLE, IS_SIGNED, IS_UNSIGNED, IS_NUMBER, IS_TRUTH = (1 << k for k in range(5))


def _kind(value: Column) -> Column:
    """The bits of a text; null for a missing value. Patterns cost most, so a
    text meets one only if its first letter and a few others allow a match."""
    exact = F.trim(F.translate(value, "\t", " ")).try_cast("decimal(38,0)")  # null beyond 38 digits

    def within(low: int, high: int, bit: int) -> Column:
        ends = (F.lit(str(v)).cast("decimal(38,0)") for v in (low, high))
        return F.when(exact.between(*ends), bit).otherwise(0)

    whole = F.lit(IS_WHOLE | IS_NUMBER)
    large = whole.bitwiseOR(within(-(1 << 63), (1 << 63) - 1, IS_SIGNED)).bitwiseOR(within(0, (1 << 64) - 1, IS_UNSIGNED))
    long = value.try_cast("bigint")
    # Signs, points, blanks and digits come before the colon, which times have.
    number = (value < ":") & ~value.contains(":") & value.rlike(NUMBER)
    infinite = (value.contains("n") | value.contains("N")) & value.rlike(INFINITE)
    return (
        F.when(
            number,
            F.when(value.contains(".") | value.contains("e") | value.contains("E"), IS_NUMBER)
            .when(long >= 0, whole.bitwiseOR(IS_SIGNED | IS_UNSIGNED))
            .when(long < 0, whole.bitwiseOR(IS_SIGNED))
            .otherwise(large),
        )
        .when(infinite, IS_NUMBER)
        .when(value.isin(*TRUTHS), IS_TRUTH)
        .when(value.isNotNull(), 0)
    )


def _found(value: Column) -> Column:
    """Of a text column with nulls for missing values: how many values and gaps
    it has, and the bits that all values share."""
    return F.struct(F.count(value).alias("values"), F.count_if(value.isNull()).alias("gaps"), F.bit_and(_kind(value)).alias("bits"))


def _type(found) -> DataType:
    if not found["values"]:
        return DoubleType() if found["gaps"] else StringType()
    bits, gaps = found["bits"], found["gaps"]
    if bits & IS_WHOLE:
        if bits & IS_SIGNED:
            return DoubleType() if gaps else LongType()
        # Beyond 64 signed bits: unsigned without gaps, else left as it is.
        return DecimalType(20, 0) if bits & IS_UNSIGNED and not gaps else StringType()
    if bits & IS_NUMBER:
        return DoubleType()
    return BooleanType() if bits & IS_TRUTH and not gaps else StringType()


def infer_schema(df: DataFrame, cols: Sequence[str] | None = None) -> StructType:
    """The types of text columns whose missing values are null, in one scan.

    A table without rows has text columns. Columns that aren't text keep their
    type.
    """
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    some = [c for c in (df.columns if cols is None else cols) if c in text]
    found = df.agg(*[_found(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(some)]).first() if some else []
    types = {c: _type(x) for c, x in zip(some, found, strict=True)}
    return StructType([StructField(f.name, types.get(f.name, f.dataType), True) for f in df.schema.fields])


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns with their inferred types; every value fits."""
    wanted = {f.name: f.dataType for f in schema.fields}
    cols = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        number = isinstance(f.dataType, StringType) and not isinstance(wanted[f.name], StringType)
        cols.append((F.trim(F.translate(value, "\t", " ")).cast(wanted[f.name]) if number else value).alias(f.name))
    return df.select(*cols)
