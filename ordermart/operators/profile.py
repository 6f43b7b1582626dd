"""Profiling operators PRF-1..PRF-14 as tidy report DataFrames.

The reference prints pandas inspections; here each one is a DataFrame so a
notebook can ``show()`` it and a job can write it. Every report is computed
in as few passes as possible (one aggregate with many columns, then an
unpivot), and none gathers a whole column into a single task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ordermart.functions.columns import dp


# ------------------------------------------------------------ PRF-1/2/3
def shape(df: DataFrame, name: str) -> DataFrame:
    """PRF-1: one row (table_name, n_rows, n_columns)."""
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
    )


def schema_report(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """PRF-2/3: (table_name, position, column_name, data_type) from metadata."""
    rows = [(name, i, c, t) for i, (c, t) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- PRF-4
def null_counts(df: DataFrame, name: str | None = None) -> DataFrame:
    """PRF-4: (column_name, null_count) for every column, in one scan."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    tidy = wide.unpivot([], df.columns, "column_name", "null_count")
    if name is not None:
        tidy = tidy.select(F.lit(name).alias("table_name"), "*")
    return tidy


# ---------------------------------------------------------------- PRF-5
QUARTILES = (0.25, 0.5, 0.75)


def value_counts_ranked(long: DataFrame, by: Sequence[str], value: str = "value",
                        partitions: int | None = None) -> DataFrame:
    """(group..., v, c, pid): equal values collapsed, range-partitioned, written.

    Equal values collapse with a combining aggregate (a hot value is one
    row); the rows are range-partitioned by (group, v) and written, with the
    partition id, to the shared folder so the ids stay stable between the
    uses that follow and lineage is cut. Without an explicit count AQE may
    merge adjacent ranges, which keeps the ids in rank order.
    """
    from ordermart.sources.io import materialize

    by = list(by)
    vc = (
        long.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    ranged = vc.repartitionByRange(partitions, *by, "v") if partitions else vc.repartitionByRange(*by, "v")
    return materialize(ranged.withColumn("pid", F.spark_partition_id()))


def exact_quantiles(
    long: DataFrame | None, by: Sequence[str], value: str = "value", qs: Sequence[float] = QUARTILES,
    partitions: int | None = None, ranked_values: DataFrame | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group (pandas ``describe``).

    ``percentile`` keeps every distinct value of a group in one final task,
    which does not survive a continuous column at terabyte scale. Instead:

    1. ``value_counts_ranked``: collapse equal values, range-partition them,
       write them with their partition id;
    2. totals per (group, partition) give each partition's rank offset
       inside its group; a window inside each partition gives running counts;
    3. the value at a 0-based rank k is the one whose rank range covers k;
       one grouped aggregate picks both neighbours of every requested rank.

    Returns one row per group with columns ``q<pct>`` (q25, q50, q75).
    """
    by = list(by)
    vc = ranked_values if ranked_values is not None else value_counts_ranked(long, by, value, partitions)
    # (group, partition) totals: at most groups x partitions rows.
    per = vc.groupBy(*by, "pid").agg(F.sum("c").alias("pc"))
    before = Window.partitionBy(*by).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *by, "pid",
        F.coalesce(F.sum("pc").over(before), F.lit(0)).alias("off"),
        F.sum("pc").over(Window.partitionBy(*by)).alias("n"),
    )
    ranked = vc.join(per, [*by, "pid"]).withColumn(
        "end", F.col("off") + F.sum("c").over(Window.partitionBy(*by, "pid").orderBy("v"))
    )
    ranked = ranked.withColumn("start", F.col("end") - F.col("c"))  # ranks [start, end)
    aggs = []
    for q in qs:
        pos = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)

        def at(k):
            return F.max(F.when((F.col("start") <= k) & (k < F.col("end")), F.col("v")))

        v_lo, v_hi = at(lo), at(hi)
        aggs.append((v_lo + (v_hi - v_lo) * F.max(pos - lo)).alias(f"q{int(round(q * 100))}"))
    return ranked.groupBy(*by).agg(*aggs)


def moments_from_counts(vc: DataFrame, by: Sequence[str]) -> DataFrame:
    """count, mean, std (sample), min, max per group from (group, v, c) rows.

    Two passes over the collapsed values: the mean first, then the squared
    deviations from it, which is the numerically stable form of the sample
    variance. Both passes read distinct values only, not the raw rows.
    """
    by = list(by)
    first = vc.groupBy(*by).agg(
        F.sum("c").alias("count"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    dev = vc.join(first.select(*by, "mean", "count"), by).groupBy(*by).agg(
        F.sqrt(
            F.sum(F.col("c") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean")))
            / F.nullif(F.first("count") - 1, F.lit(0))
        ).alias("std")
    )
    return first.join(dev, by)


def to_long(df: DataFrame, cols: Sequence[str], name: str | None = None) -> DataFrame:
    """Numeric columns as (table_name?, column_name, value double) rows.

    A union of one-column projections rather than an unpivot: no input row
    is copied once per column, and each branch scans only its own column.
    """
    head = [F.lit(name).alias("table_name")] if name is not None else []
    return union_all(
        [df.select(*head, F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols]
    )


def numeric_summary_long(long: DataFrame, by: Sequence[str], exact: bool = True, nd: int = 6,
                         accuracy: int = 10000) -> DataFrame:
    """PRF-5 over a long (group..., value) frame: one row per group.

    count, mean, std (sample), min, 25%, 50%, 75%, max; rounded to ``nd``.
    ``exact=False`` uses ``percentile_approx`` (one pass, bounded memory,
    rank error 1/accuracy) instead of the exact distributed quantiles.
    """
    by = list(by)
    x = F.col("value")
    if exact:
        # One full pass: everything below reads the collapsed, written values.
        vc = value_counts_ranked(long, by)
        stats = moments_from_counts(vc, by).join(exact_quantiles(None, by, ranked_values=vc), by)
        stats = stats.select(
            *by, "count", dp("mean", nd).alias("mean"), dp("std", nd).alias("std"), "min", "max", "q25", "q50", "q75"
        )
        quart = [dp(F.col(f"q{p}"), nd).alias(f"p{p}") for p in (25, 50, 75)]
    else:
        stats = long.groupBy(*by).agg(
            F.count(x).alias("count"),
            dp(F.avg(x), nd).alias("mean"),
            dp(F.stddev_samp(x), nd).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.percentile_approx(x, list(QUARTILES), accuracy).alias("_qa"),
        )
        quart = [dp(F.col("_qa")[i], nd).alias(f"p{p}") for i, p in enumerate((25, 50, 75))]
    return stats.select(*by, "count", "mean", "std", "min", *quart, "max")


#: Values that one aggregate may hold for a quantile; more are bracketed again.
BRACKET = 50_000
#: Compression of the approximate quantiles that choose the brackets.
SKETCH = 10_000
#: One row in so many goes into the first of them, and how far from a quantile
#: its bracket can reach. They decide how fast the selection ends, not its result.
EVERY, REACHES = 16, (0.0003, 0.001, 0.004, 0.016, 0.064)


def _inside(x: Column, low: float | None, high: float | None) -> Column:
    """``x`` strictly between two values (None: no bound), else null."""
    if low is None and high is None:
        return x
    return F.when((F.lit(True) if low is None else x > F.lit(low)) & (F.lit(True) if high is None else x < F.lit(high)), x)


def _region_counts(df: DataFrame, x: Mapping[str, Column], cuts: Mapping[str, Sequence[float]]) -> dict[str, dict[int, int]]:
    """Rows by column and region: with sorted cuts c0 < c1 < ..., region 2k lies
    below ck (and above the cut before it), region 2k + 1 is ck itself.

    A union of one-column projections and one combining aggregate."""
    parts = []
    for k, (c, some) in enumerate(cuts.items()):
        region = F.lit(0)
        for cut in some:
            region = region + F.when(x[c] > F.lit(cut), 2).when(x[c] == F.lit(cut), 1).otherwise(0)
        parts.append(df.where(x[c].isNotNull()).select(F.lit(k).alias("c"), region.alias("region")))
    names, counts = list(cuts), {c: {} for c in cuts}
    for r in union_all(parts).groupBy("c", "region").agg(F.count(F.lit(1)).alias("n")).collect():  # a few a cut
        counts[names[r.c]][r.region] = r.n
    return counts


def _values_at(df: DataFrame, x: Mapping[str, Column], wanted: Mapping[tuple[str, int], tuple]) -> dict[tuple[str, int], float]:
    """The value of each (column, rank), given its open interval (low, high)
    and the rows below it. Each interval holds few rows."""
    places: dict[tuple, list[int]] = {}
    for (c, r), (low, high, below, _) in wanted.items():
        places.setdefault((c, low, high, below), []).append(r)
    keys, numbers = list(places), {}
    for k, (c, low, high, _) in enumerate(keys):  # a column's intervals don't overlap
        numbers[c] = F.when(_inside(x[c], low, high).isNotNull(), k).otherwise(numbers.get(c, F.lit(None)))
    parts = [df.select(number.alias("k"), x[c].alias("v")).where("k is not null") for c, number in numbers.items()]
    ranked = union_all(parts).groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("v"))
    at = F.lit(None)
    for k, some in enumerate(places.values()):
        at = F.when(F.col("k") == k, F.array(*[F.get("v", F.lit(r - keys[k][3])) for r in some])).otherwise(at)
    return {(keys[row.k][0], r): v for row in ranked.select("k", at.alias("at")).collect() for r, v in zip(places[keys[row.k]], row["at"], strict=True)}


def _select_ranks(df: DataFrame, cols: Sequence[str], qs: Sequence[float], most: int) -> dict[tuple[str, float], float | None]:
    """The exact quantiles of each column.

    Three-way selection. A rank's value is looked for among the values strictly
    inside an interval. Two values near the rank, from mergeable approximate
    quantiles, cut the interval, and one pass counts the rows between the cuts
    and those equal to each. A rank that falls on a cut is found, however often
    that value occurs; otherwise it goes on between two cuts. Cuts are values
    of the column and no longer inside, so every round removes at least one
    distinct value, mostly all but some thousandths of the rows. Intervals of at
    most ``most`` rows are ranked by one aggregate at the end.

    The passes take all columns together; no row is sorted or written, what is
    shuffled is a few counts a task, and the driver sees a few numbers a column.
    The first pass counts all rows and brackets by one in ``EVERY``.
    """
    x = {c: F.col(c).cast("double") for c in cols}
    reach = sorted({s * r for r in REACHES for s in (-1, 1)})
    marks = F.array(*[F.lit(min(1.0, max(0.0, q + r))) for q in qs for r in reach])
    thin = df.select(*[x[c].alias(f"c{k}") for k, c in enumerate(cols)], (F.rand(17) * EVERY < 1).alias("some"))
    start = thin.agg(*[F.struct(F.count(f"c{k}"), F.percentile_approx(F.when(F.col("some"), F.col(f"c{k}")), marks, SKETCH)) for k in range(len(cols))]).first()
    n = {c: start[k][0] for k, c in enumerate(cols)}
    ranks = {(c, q): sorted({int((n[c] - 1) * q), -int(-(n[c] - 1) * q // 1)}) for c in cols for q in qs if n[c]}
    # Of each wanted rank: the open interval, the rows below it and inside it.
    todo = {(c, r): (None, None, 0, n[c]) for (c, _), wanted in ranks.items() for r in wanted}
    brackets: dict[tuple[str, int], Sequence[float]] = {}
    for k, c in enumerate(cols):
        for j, q in enumerate(qs):
            if start[k][1] is not None and n[c]:
                near = start[k][1][j * len(reach) : (j + 1) * len(reach)]
                away = next((i for i, r in enumerate(REACHES) if r * r * n[c] > 4 * EVERY), len(REACHES) - 1)  # four deviations
                for r in ranks[c, q]:
                    brackets[c, r] = (near[len(REACHES) - 1 - away], near[len(REACHES) + away])
    value: dict[tuple[str, int], float] = {}
    small = {}
    while True:
        small |= {key: state for key, state in todo.items() if state[3] <= most}
        todo = {key: state for key, state in todo.items() if key not in small}
        if not todo:
            break
        missing = {key: state for key, state in todo.items() if key not in brackets}
        if missing:
            wanted = {}
            for (c, r), (low, high, below, size) in missing.items():
                room = 2 * size / SKETCH + 2
                ends = [max(0.0, (r - below - room) / size), min(1.0, (r - below + room) / size)]
                wanted[c, r] = F.percentile_approx(_inside(x[c], low, high), ends, SKETCH)
            got = df.agg(*[e.alias(f"b{k}") for k, e in enumerate(wanted.values())]).first()
            brackets |= dict(zip(wanted, got, strict=True))
        cuts: dict[str, set[float]] = {}
        for key, (low, high, _, _) in todo.items():
            cuts.setdefault(key[0], set()).update(v for v in (low, high, *brackets.pop(key)) if v is not None)
        # One NaN, the largest value; zeros of both signs are one value in a set.
        ordered = {c: [*sorted(v for v in some if v == v), *[v for v in some if v != v][:1]] for c, some in cuts.items()}
        counts = _region_counts(df, x, ordered)
        after = {}
        for c, r in todo:
            below, region = 0, 0
            while r >= below + counts[c].get(region, 0):
                below += counts[c].get(region, 0)
                region += 1
            at, equal = divmod(region, 2)
            if equal:
                value[c, r] = ordered[c][at]
            else:
                after[c, r] = (ordered[c][at - 1] if at else None, ordered[c][at] if at < len(ordered[c]) else None, below, counts[c][region])
        todo = after
    if small:
        value |= _values_at(df, x, small)
    found = {}
    for c in cols:
        for q in qs:
            if not n[c]:
                found[c, q] = None
                continue
            at = (n[c] - 1) * q
            a, b = value[c, ranks[c, q][0]], value[c, ranks[c, q][-1]]
            found[c, q] = a if a == b else a + (b - a) * (at - int(at))
    return found


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that ``describe`` takes, by type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None, name: str | None = None, exact: bool = True,
                    nd: int = 6, most: int | None = None) -> DataFrame:
    """PRF-5: a row for each of the columns (default: every numeric one).

    count, mean, std (sample), min, quartiles, max, rounded to ``nd``: one
    aggregate over the wide table, after the few that bracket the quartiles.
    ``most`` bounds the values that it ranks for one quartile.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    x = {c: F.col(c).cast("double") for c in cols}
    if exact:
        quart = _select_ranks(df, cols, QUARTILES, BRACKET if most is None else most)
        quart = {key: F.lit(v).cast("double") for key, v in quart.items()}
    else:
        quart = {(c, q): F.percentile_approx(x[c], q, 10_000) for c in cols for q in QUARTILES}
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(x[c]).alias("count"),
            dp(F.avg(x[c]), nd).alias("mean"),
            dp(F.stddev_samp(x[c]), nd).alias("std"),
            F.min(x[c]).alias("min"),
            *[dp(quart[c, q], nd).alias(f"p{int(100 * q)}") for q in QUARTILES],
            F.max(x[c]).alias("max"),
        )
        for c in cols
    ]
    out = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return out if name is None else out.select(F.lit(name).alias("table_name"), "*")


# ---------------------------------------------------------------- PRF-6
def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


#: Characters of a text that stand for it while values are counted; longer
#: texts are told apart by a 128-bit digest.
PREFIX = 32


def text_summary(df: DataFrame, cols: Sequence[str] | None = None, name: str | None = None, prefix: int | None = None) -> DataFrame:
    """PRF-6: count, unique, top, freq per text column (default: every one; nulls ignored).

    As ``text_summaries`` of one table."""
    out = text_summaries({name or "": df if cols is None else df.select(*cols)}, prefix)
    return out.drop("table_name") if name is None else out


def text_summaries(tables: Mapping[str, DataFrame], prefix: int | None = None) -> DataFrame:
    """(table_name, column_name, count, unique, top, freq) for every text column
    of several tables. A tie for the most frequent value goes to the smallest;
    a column without a value has count and unique 0 and no top.

    One shuffle counts all columns. No long text takes part: a value of up to
    ``prefix`` characters stands for itself, a longer one for its beginning and
    a 128-bit digest, so the key is short, a frequent value is one row a map
    task, and unequal texts count as one only if their digests are equal. The
    smallest of the most frequent keys is the top. Where that is a beginning, a
    second scan reads the column's texts that begin so (a filter the scan can
    use), keeps those with as many copies, and takes the least of them.
    """
    prefix = PREFIX if prefix is None else prefix
    columns = [(t, c) for t, df in tables.items() for c in text_columns(df)]
    parts = []
    for t, c in columns:
        v = F.col(f"`{c}`")
        parts.append(tables[t].select(
            F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.left(v, F.lit(prefix)).alias("start"), _beyond(v, prefix).alias("rest")
        ))
    vc = union_all(parts).groupBy("table_name", "column_name", "start", "rest").agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("start").isNotNull()
    order = F.struct((-F.col("n")).alias("neg_n"), F.col("start"), F.col("rest").isNotNull().alias("long"))
    best = vc.groupBy("table_name", "column_name").agg(
        F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("count"),
        F.count_if(seen).alias("unique"),
        F.min(F.when(seen, order)).alias("top"),
    )
    # One row a column, short texts only.
    found = {(r.table_name, r.column_name): r for r in best.collect()}
    rows, frames = [], []
    schema = "table_name string, column_name string, count bigint, unique bigint, top string, freq bigint"
    for t, c in columns:
        r = found.get((t, c))  # no row: an empty table
        total, unique, top = (r["count"], r.unique, r.top) if r else (0, 0, None)
        freq = -top.neg_n if top else None
        if top and top.long:
            said = _least_of(tables[t].select(F.col(f"`{c}`").alias("v")), top.start, freq, prefix)
            frames.append(said.select(
                F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.lit(total).cast("bigint").alias("count"),
                F.lit(unique).cast("bigint").alias("unique"), "top", F.lit(freq).cast("bigint").alias("freq"),
            ))
        elif r:
            rows.append((t, c, total, unique, top.start if top else None, freq))
    spark = next(iter(tables.values())).sparkSession
    return union_all([spark.createDataFrame(rows, schema), *frames])


def _beyond(v: Column, prefix: int) -> Column:
    """Digest of a text of more than ``prefix`` characters, else null."""
    return F.when(F.length(v) > prefix, F.unhex(F.md5(v.cast("binary"))))


def _least_of(texts: DataFrame, start: str, freq: int, prefix: int) -> DataFrame:
    """(top): the least long text that begins with ``start`` and occurs ``freq`` times."""
    v = F.col("v")
    some = texts.where(v.startswith(start) & (F.length(v) > prefix))
    if freq > 1:
        some = some.withColumn("rest", _beyond(v, prefix))
        often = some.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == freq)
        some = some.join(often, "rest", "left_semi")
    return some.agg(F.min(v).alias("top"))


# ------------------------------------------------------------ PRF-7/8
def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """PRF-7/8: frequency of each non-null value, most frequent first.

    With ``normalize`` the share is ``round(n / total, 4) * 100`` as pandas
    prints it; the total is a scalar subquery, so groups stay distributed.
    """
    vc = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = vc.agg(F.sum("count")).scalar()
        share = dp(F.col("count").cast("double") / total, 4)
        vc = vc.select(col, dp(share * 100, 2).alias("pct"))
        return vc.orderBy(F.desc("pct"), col)
    return vc.orderBy(F.desc("count"), col)


# ---------------------------------------------------------------- PRF-9
def conditional_counts(df: DataFrame, masks: Mapping[str, Column], by: str) -> DataFrame:
    """PRF-9: for each named mask, row counts by ``by`` among matching rows.

    One pass with one ``count_if`` per mask, grouped by ``by``; only the
    small grouped result is unpivoted, so no row of the input is duplicated.
    Null ``by`` values and zero counts are dropped, as ``value_counts`` does.
    """
    names = list(masks)
    wide = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        *[F.count_if(F.coalesce(m, F.lit(False))).alias(n) for n, m in masks.items()]
    )
    long = wide.unpivot([by], names, "mask", "n").where(F.col("n") > 0)
    return long.select("mask", by, "n").orderBy("mask", F.desc("n"))


def conditional_count(df: DataFrame, mask: Column, name: str = "n") -> DataFrame:
    """PRF-10: number of rows matching a predicate (nulls count as False)."""
    return df.agg(F.count_if(F.coalesce(mask, F.lit(False))).alias(name))


# --------------------------------------------------------------- PRF-12
def key_uniqueness(df: DataFrame, keys: Sequence[str], name: str | None = None) -> DataFrame:
    """PRF-12: rows versus distinct non-null key values."""
    keys = list(keys)
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(*[F.col(k) for k in keys]).alias("n_distinct"),
    ).select(F.lit(",".join(keys)).alias("key_columns"), "n_rows", "n_distinct")
    if name is not None:
        out = out.select(F.lit(name).alias("table_name"), "*")
    return out


# ---------------------------------------------------------- PRF-13/14
def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """WIN-3 / PRF-14: every row whose key occurs more than once.

    Keys that repeat are found with a combining aggregate, then matched back
    with a null-safe semi join (pandas treats NaN keys as equal). No window
    is partitioned by the key, so a hot key is not sorted in one task.
    """
    keys = list(keys)
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(dup[k])
        cond = c if cond is None else cond & c
    return df.join(dup, cond, "left_semi")


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """SRT-5/6: first ``n`` rows by an explicit order (top-k, not a sample)."""
    return df.orderBy(*order_by).limit(n)
