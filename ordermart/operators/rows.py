"""Row-level building blocks: mask removal, keep-first dedupe, first non-null.

All of them are single DataFrame expressions. Keep-first dedupe is written
as a ``min_by`` aggregate rather than a ``row_number`` window: the aggregate
combines map-side, so a key that owns a third of all rows is collapsed
inside each map task before anything is shuffled, and no window partition
ever holds a whole key group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def any_mask(*masks: Column) -> Column:
    """OR of masks where a null mask counts as False (pandas semantics)."""
    out = F.lit(False)
    for m in masks:
        out = out | F.coalesce(m, F.lit(False))
    return out


def drop_if_any(df: DataFrame, *masks: Column) -> DataFrame:
    """Remove rows matching any mask; rows whose masks are null are kept.

    pandas evaluates ``NaN == 'x'`` as False, so ``df[~(m1 | m2)]`` keeps a
    row with a null status. A plain Spark ``~(m1 | m2)`` would be null there
    and drop it; coalescing each mask reproduces the pandas result.
    """
    return df.where(~any_mask(*masks))


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], drop: Sequence[str] = ()) -> DataFrame:
    """One row per key: the row that comes first by ``order_by``.

    Equivalent to pandas ``drop_duplicates(subset=keys, keep='first')`` when
    ``order_by`` is the file order. Null keys form one group, as in pandas.
    The ordering must be unique within a key for a deterministic result.
    The whole row travels as one struct, so the partial aggregate keeps a
    single (row, ordering) pair per key and map task. Columns named in ``drop``
    are left out of it: an ordering that isn't kept travels once.
    """
    keys = list(keys)
    kept = [c for c in df.columns if c in keys or c not in drop]
    rest = [c for c in kept if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    first = df.select(order[0]).schema[0]
    alone = len(order) == 1 and isinstance(first.dataType, StructType) and not first.nullable
    order = order[0] if alone else F.struct(*order)
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return picked.select(*keys, "_first.*").select(*kept)


def first_non_null(value: str | Column, order_by: str | Column) -> Column:
    """Aggregate: the first non-null ``value`` by ``order_by`` (pandas 'first')."""
    v = F.col(value) if isinstance(value, str) else value
    o = F.col(order_by) if isinstance(order_by, str) else order_by
    return F.min_by(v, F.when(v.isNotNull(), o))


def to_timestamps(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Convert string columns to timestamp_ntz; typed columns pass through.

    The conversion is an ANSI cast, so a malformed value raises instead of
    silently turning into null (as ``pd.to_datetime`` raises).
    """
    types = dict(df.dtypes)
    out = df
    for c in cols:
        if types.get(c) == "string":
            out = out.withColumn(c, F.col(c).cast("timestamp_ntz"))
        elif types.get(c) == "timestamp":
            out = out.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return out
