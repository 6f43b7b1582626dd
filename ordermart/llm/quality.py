"""Quality rules: fixed limits, then robust multivariate outliers.

Every text gets a vector of shape statistics. Within each language and source
the centre and scatter of the vectors are estimated by minimum covariance
determinant: the estimate of the h vectors whose scatter has the smallest
determinant, reached by concentration steps (estimate, take the h vectors
nearest by Mahalanobis distance, estimate again, which never raises the
determinant) from two deterministic starts. Vectors far from the estimate are
rejected. Junk can thus make up a quarter of a group without moving the limits.

Only DataFrame functions: the statistics are array expressions within the row,
and estimates are grouped aggregates over one narrow written table, joined
back by group. A group that holds a third of the rows is combined map-side;
its rows are never brought together.

Defined cases: a null or empty text has no words, so the fixed limits fail it.
Null languages and sources form groups of their own. The texts of a group with
fewer than ``min_group`` texts that pass the fixed limits are judged by the
estimate of their language, those of a language with fewer by one of all rows,
in which each text's word length is taken relative to the median of its
language (else every text of a rare language with long words were an outlier).
So every text that passes the fixed limits has a distance. Repeated rows are
judged each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import written

WORD_CUT = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
STATS = ("x0", "x1", "x2", "x3")
#: The median of a chi-squared variable with as many degrees of freedom as STATS.
CHI2_MEDIAN = 3.356694
#: Smallest scale of each statistic: what a text of usual length varies by
#: chance. It keeps a group whose texts agree exactly from having none.
FLOORS = (0.05, 0.10, 0.10, 0.15)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the text."""

    def windows(w: Column) -> Column:
        n = F.size(w)
        three = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(n >= 4, let(three, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))).otherwise(F.lit(0).cast("long"))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ranked, lambda s: union(F.sort_array(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), same(s, x, k).alias("d"))), lambda y: y["d"]), lambda y: y["i"]))))

    def same(s: Column, x: Column, k: Column) -> Column:
        near = [F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]]
        return F.coalesce(near[0] == x["h"], F.lit(False)) | F.coalesce(near[1] == x["h"], F.lit(False))

    def union(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    return windows(words)


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id``, the group columns, the counts, ``base_failed`` and x0..x3."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = [F.col(c).cast("string").alias(f"g{k}") for k, c in enumerate(group_cols)]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), *groups, text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", WORD_CUT), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_BLANK)))
    rows = rows.select(
        "doc_id",
        *(f"g{k}" for k in range(len(groups))),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated(F.col("words")).alias("n_repeat_words"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    return rows.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
            "x1": F.sqrt(F.col("n_symbols") / n),
            "x2": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            "x3": F.sqrt(F.col("n_repeat_words") / n),
        }
    )


#: Groups whose estimates go to every task; above it, rows are salted instead.
BROADCAST = 50_000
SALT = 64


def _attach(rows: DataFrame, groups: DataFrame, on: list[str], x: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Joins a written table with one row a group to its rows. A group may hold
    a third of the rows, so they never meet by group: the small side is
    broadcast after its size is checked, or repeated for salts of the rows."""
    if groups.count() <= BROADCAST:
        return rows.join(F.broadcast(groups), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*x), F.lit(SALT)))
    each = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.join(each, [*on, "_salt"], how).drop("_salt")


def _distance(x: tuple[str, ...]) -> Column:
    """Squared Mahalanobis distance to columns m0.. with the Cholesky factor in
    columns c00, c10, ...: the squared length of the forward-substituted
    difference."""
    solved: list[Column] = []
    for i, name in enumerate(x):
        rest = reduce(lambda a, j: a - F.col(f"c{i}{j}") * solved[j], range(i), F.col(name) - F.col(f"m{i}"))
        solved.append(rest / F.col(f"c{i}{i}"))
    return reduce(lambda a, z: a + z * z, solved, F.lit(0.0))


def _factored(groups: DataFrame, p: int) -> DataFrame:
    """Adds the Cholesky factor of the scatter s00, s10, ... and ``log_det``."""
    for i in range(p):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"c{i}{k}") * F.col(f"c{j}{k}"), range(j), F.col(f"s{i}{j}"))
            groups = groups.withColumn(f"c{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"c{j}{j}"))
    return groups.withColumn("log_det", reduce(lambda a, i: a + 2 * F.log(F.col(f"c{i}{i}")), range(p), F.lit(0.0)))


def _estimate(rows: DataFrame, by: list[str], x: tuple[str, ...], floors: tuple[float, ...]) -> DataFrame:
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]
    scatter = [(F.covar_pop(a, x[j]) + F.lit(floors[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i, a in enumerate(x) for j in range(i + 1)]
    return _factored(rows.groupBy(*by).agg(*means, *scatter), len(x))


def robust_scatter(
    rows: DataFrame,
    by: str,
    x: tuple[str, ...],
    floors: tuple[float, ...],
    share: float = 0.75,
    steps: int = 3,
    min_group: int = 20,
) -> DataFrame:
    """One row for each value of ``by`` with enough rows: the minimum
    covariance determinant estimate (m0.., c00.., log_det) and ``scale``, which
    makes the median squared distance that of a chi-squared variable.

    ``share`` is h as a share of the group. Quantiles are mergeable summaries
    (relative rank error 1/10000), so no group is sorted in one place.
    """
    quantile = lambda c, q: F.percentile_approx(c, F.lit(q), F.lit(10_000))
    middle = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(quantile(c, 0.5).alias(f"m{i}") for i, c in enumerate(x)))
    middle = written(middle.filter(F.col("n") >= min_group).drop("n"))
    spread = _attach(rows, middle, [by], x).groupBy(by).agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(len(x))), *(quantile(F.abs(F.col(c) - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i, c in enumerate(x)))
    # Two starts: each statistic scaled by its own median deviation, and by its floor alone.
    spread = spread.select(by, *(f"m{i}" for i in range(len(x))), *(F.array(F.greatest(1.4826 * F.col(f"d{i}"), F.lit(floors[i])), F.lit(floors[i])).alias(f"d{i}") for i in range(len(x))))
    starts = spread.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    zero = {f"c{i}{j}": (F.get(f"d{i}", F.col("start")) if i == j else F.lit(0.0)) for i in range(len(x)) for j in range(i + 1)}
    now = written(starts.withColumns(zero).select(by, "start", *(f"m{i}" for i in range(len(x))), *zero))
    for _ in range(steps + 1):
        far = _attach(rows, now, [by], x).select(by, "start", *x, _distance(x).alias("dist"))
        limit = written(far.groupBy(by, "start").agg(quantile("dist", share).alias("limit")))
        near = _attach(far, limit, [by, "start"], x).filter(F.col("dist") <= F.col("limit"))
        now = written(_estimate(near, [by, "start"], x, floors))
    best = now.groupBy(by).agg(F.min_by(F.struct(*[c for c in now.columns if c != by]), F.struct("log_det", "start")).alias("b")).select(by, "b.*").drop("start")
    best = written(best)
    half = _attach(rows, best, [by], x).groupBy(by).agg(quantile(_distance(x), 0.5).alias("half"))
    return best.join(half, by).withColumn("scale", F.greatest(F.col("half") / CHI2_MEDIAN, F.lit(1.0))).drop("half")


def _plan(passing: DataFrame, keys: list[str], min_group: int) -> DataFrame:
    """``keys`` and ``key`` of each group: the first of its keys, from fine to
    coarse, that ``min_group`` rows have, or else the last one."""
    sizes = written(passing.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    plan, enough = sizes, [F.when(F.col("n") >= min_group, F.col(keys[0]))]
    for k in keys[1:-1]:
        plan = _attach(plan, written(sizes.groupBy(k).agg(F.sum("n").alias(f"n_{k}"))), [k], (keys[0],))
        enough.append(F.when(F.col(f"n_{k}") >= min_group, F.col(k)))
    return written(plan.select(*keys, F.coalesce(*enough, F.col(keys[-1])).alias("key")))


def _group_estimates(passing: DataFrame, keys: list[str], min_group: int) -> DataFrame:
    """``keys[0]`` of each group with the estimate that judges it."""
    plan = _plan(passing, keys, min_group)
    needed = written(plan.select("key").distinct())
    middle = None
    if len(keys) > 1 and not needed.join(plan.select(F.col(keys[-1]).alias("key")), "key", "left_semi").isEmpty():
        middle = written(passing.groupBy(keys[-2]).agg(F.percentile_approx("x0", F.lit(0.5), F.lit(10_000)).alias("middle")))
    parts = []
    for k in keys:
        part = passing
        if k == keys[-1] and middle is not None:
            part = _attach(passing, middle, [keys[-2]], STATS).withColumn("x0", F.col("x0") - F.col("middle"))
        parts.append(_attach(part.select(F.col(k).alias("key"), *STATS), needed, ["key"], STATS))
    estimates = written(robust_scatter(written(reduce(DataFrame.unionAll, parts)), "key", STATS, FLOORS, min_group=1))
    found = _attach(plan, estimates, ["key"], (keys[0],))
    if middle is not None:
        shift = F.when(F.col("key") == F.col(keys[-1]), F.col("middle")).otherwise(0.0)
        found = _attach(found, middle, [keys[-2]], (keys[0],)).withColumn("m0", F.col("m0") + shift)
    return written(found.select(keys[0], *(c for c in estimates.columns if c != "key")))


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_cols: tuple[str, ...] = ("lang", "source"),
    cutoff: float = 40.0,
    min_group: int = 20,
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance``.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated
    windows of three. ``distance`` is the squared Mahalanobis distance within the group,
    or within a coarser one if the group is small (the first column of
    ``group_cols`` counts as the language); it is null only for base failures
    whose group has no other texts. ``kept`` is false for base failures and for
    distances over ``cutoff`` (a chi-squared variable with four degrees of
    freedom exceeds 40 once in 20 million).
    """
    names = [f"g{k}" for k in range(len(group_cols))]
    each = range(len(names), -1, -1)
    keys = [f"at{k}" for k in each]
    rows = statistics(df, id_col, text_col, group_cols).withColumns({f"at{k}": F.to_json(F.struct(F.lit(k).alias("of"), *names[:k])) for k in each}).drop(*names)
    rows = written(rows)
    estimates = _group_estimates(rows.filter(~F.col("base_failed")).select(*keys, *STATS), keys, min_group)
    judged = _attach(rows, estimates, keys[:1], STATS, "left").withColumn("distance", _distance(STATS) / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
