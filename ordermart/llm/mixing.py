"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source lie in shards, in a seeded order of its documents, and
are cut into blocks of equally many words. Blocks are seats: sources get theirs
by highest quotients ``target / (2 k + 1)``, a source's shards get theirs by
highest quotients of their sizes, and in a shard a seeded choice takes exactly
its quota: a stretch of blocks from a seeded place on. As the documents lie in
seeded order, that is a random choice of documents, all but its ends whole. A
document's share of the mix is what its blocks have.

Nothing is listed block by block. Of the quotients only those are made that
may decide: with W the sum of the weights and n of them, the divisors
W / (seats - n/2) and W / (seats + n/2) give each weight seats that are surely
won and seats that surely suffice; they differ by two a weight on average.

Texts never move: only (source, id, size) rows are shuffled, by shards of a
bounded number of words, so a source with a third of all rows is many shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermart.llm.common import WORD, slices, written

#: Words a block has, and words a shard should have.
BLOCK, SHARD = 64, 1 << 21
#: Equal rows that are laid as one at most, and characters handed on at once.
COPIES, HANDED = 1000, 1 << 22
#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``source, source_size`` (one row a source).

    Sources in code-point order, null last, get the weights in turn. The
    targets share ``total_share`` of all sizes by weight, none above ``most``
    times its source's size. Handing the excess on by weight until none is
    above ends at targets min(cap, level * weight); the level follows from the
    sources in order of cap / weight. One row a source, so its two windows
    order a dimension, not documents. All empty: targets 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    some = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), k.cast("int")))
    some = some.withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    asked = total_share * F.sum("source_size").over(everything)
    level = (asked - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    some = some.withColumn("level", level).withColumn("fits", F.col("cap") > F.col("level") * F.col("weight"))
    # The first source that isn't capped sets the level for all from it on.
    some = some.withColumn("level", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return some.select("source", "source_size", "weight", target.alias("target"))


def apportion(rows: DataFrame, by: list[str], weight: str, seats: str, key: list[str]) -> DataFrame:
    """Adds ``quota``: the seats of each group of ``by`` (column ``seats``,
    equal in the group) shared among its rows by highest quotients
    ``weight / (2 k + 1)``. Ties go to the smaller ``key``. Weights of 0 win
    nothing; if no weight is above 0, all quotas are 0."""
    rows = rows.withColumn("_w", F.col(weight).cast("double"))
    group = Window.partitionBy(*by)
    n, total = F.sum((F.col("_w") > 0).cast("long")).over(group), F.sum("_w").over(group)
    rows = rows.withColumns({"_n": n, "_total": F.when(total > 0, total)})
    sure = F.col(seats) - F.col("_n") / 2
    # Seats won at a divisor d: those with w / (2k + 1) >= d / 2, i.e. round(w / d).
    low = F.when(sure > 0, F.ceil(F.col("_w") * sure / F.col("_total") - 0.5)).otherwise(0)
    high = F.floor(F.col("_w") * (F.col(seats) + F.col("_n") / 2) / F.col("_total") + 0.5)
    none = (F.col("_w") <= 0) | (F.col(seats) <= 0)
    rows = rows.withColumns({"_low": F.when(none, 0).otherwise(F.greatest(low - 1, F.lit(0))).cast("long"), "_high": F.when(none, 0).otherwise(high + 1).cast("long")})
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    tried = rows.filter(F.col("_high") > F.col("_low")).withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
    best = Window.partitionBy(*by).orderBy(F.desc(F.col("_w") / (2 * F.col("_k") + 1)), *[F.col(c).asc_nulls_last() for c in key], "_k")
    won = tried.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= F.col("_left"))
    same = [*by, *[c for c in key if c not in by]]
    won = won.groupBy(*same).agg(F.count(F.lit(1)).alias("_won"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"q.{c}")) for c in same]
    joined = rows.alias("r").join(won.alias("q"), on, "left")
    kept = [F.col(f"r.{c}") for c in rows.columns if c not in ("_w", "_n", "_total", "_low", "_high", "_left")]
    return joined.select(*kept, (F.col("r._low") + F.coalesce(F.col("q._won"), F.lit(0))).alias("quota"))


def plan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: str | None = None,
    **options,
) -> DataFrame:
    """The mix of all documents: ``doc_id, source, size, source_size, target,
    taken, first, shard_quota, shard_blocks, shift`` (one row a row of ``df``).

    ``taken`` is the number of words the mix takes from the document, repeats
    counted: at most ``most`` times its size for a whole ``most``. The last
    four say which: word ``first + j`` of the shard is the document's word j,
    and ``passes`` gives the times a block is taken. A null text has no words;
    texts without words lie in no shard (zeros); a null source is a source;
    repeated rows each take part. The same input gives the same mix in any
    partitioning (rows alike in id, source and text are interchangeable). The
    column ``keep`` comes last. Options are those of ``laid``.
    """
    rows = laid(df, id_col, text_col, source_col, keep=keep, **options)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.withColumn("first", F.col("first") + F.col("copy") * F.col("size"))
    block = options.get("block", BLOCK)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken(block).alias("taken"), "first", "shard_quota", "shard_blocks", "shift", *([keep] if keep else []))


def laid(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = 1.5,
    most: float = 2.0,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = 42,
    keep: str | None = None,
) -> DataFrame:
    """As ``plan``, but with up to ``COPIES`` equal rows (id, source, text) as
    one: ``copies`` documents, one after another from word ``first`` on.

    Equal rows are counted in the map tasks, and their bundles lie in shards by
    hash of id, text and bundle: neither null ids nor repeated rows fill one
    shard beyond its words.
    """
    text, id_ = F.col(text_col), F.col(id_col).cast("long")
    kept = [keep] if keep else []
    rows = df.select(id_.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), id_, F.xxhash64(text)).alias("mixed"), *kept)
    rows = written(rows.groupBy("doc_id", "source", "size", "mixed", *kept).agg(F.count(F.lit(1)).alias("n")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(sizes, weights, total_share, most).withColumns({"all": F.lit(0), "shards": F.ceil(F.col("source_size") / shard).cast("long")})
    goals = goals.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy("all")) / block).cast("long"))
    goals = written(apportion(goals, ["all"], "target", "seats", ["source"]).drop("all", "seats"))

    def with_goals(x: DataFrame, *wanted: str) -> DataFrame:
        g = goals.select(F.col("source").alias("g_source"), *wanted)
        return x.join(g, F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_source")

    each = F.least(F.lit(COPIES), F.greatest(F.lit(1), F.floor(shard / F.greatest(F.col("size"), F.lit(1))))).cast("long")
    bundles = rows.withColumn("each", each).withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("each")))))
    bundles = bundles.withColumns({"copies": F.least(F.col("each"), F.col("n") - F.col("bundle") * F.col("each")), "mixed": F.xxhash64("mixed", "bundle")}).drop("n", "each")
    blank = with_goals(bundles.filter("size = 0"), "source_size", "target")
    dealt = with_goals(bundles.filter("size > 0"), "shards").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "mixed"), F.greatest(F.col("shards"), F.lit(1)))).drop("shards")
    dealt = written(dealt)
    shards = dealt.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("shard_size"))
    shards = with_goals(shards, "source_size", "target", "quota").withColumnRenamed("quota", "seats")
    shards = apportion(shards, ["source"], "shard_size", "seats", ["source", "shard"])
    blocks = F.ceil(F.col("shard_size") / block).cast("long")
    shards = shards.withColumns({"shard_blocks": blocks, "shard_quota": F.least(F.col("quota"), F.lit(int(most)) * blocks)})
    shards = shards.withColumn("shift", F.pmod(F.xxhash64(F.lit(seed + 2), F.coalesce(F.col("source"), F.lit("")), "shard"), F.greatest(F.col("shard_blocks"), F.lit(1))))
    shards = written(shards.select(F.col("source").alias("s_source"), F.col("shard").alias("s_shard"), "source_size", "target", "shard_blocks", "shard_quota", "shift"))
    before = Window.partitionBy("source", "shard").orderBy("mixed", "doc_id", "size", "bundle", *kept).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("first", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0)))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")), "left")
    columns = ["doc_id", "source", "size", "copies", "source_size", "target", "first", "shard_quota", "shard_blocks", "shift", *kept]
    zeros = {c: F.lit(0).cast("long") for c in ("first", "shard_quota", "shard_blocks", "shift")}
    return placed.select(columns).unionByName(blank.withColumns(zeros).select(columns))


def passes(b: Column) -> Column:
    """Times block ``b`` of its shard is taken: the quota's whole multiple of
    the blocks, and once more in the seeded stretch, which has exactly the rest
    of the quota."""
    n = F.col("shard_blocks")
    rest = F.col("shard_quota") % n
    return F.floor(F.col("shard_quota") / n).cast("long") + ((b + F.col("shift")) % n < rest).cast("long")


def taken(block: int) -> Column:
    first, end = F.col("first"), F.col("first") + F.col("size")
    mine = F.sequence(F.floor(first / block).cast("long"), F.floor((end - 1) / block).cast("long"))
    part = lambda b: (F.least(end, (b + 1) * block) - F.greatest(first, b * block)) * passes(b)
    whole = F.aggregate(mine, F.lit(0).cast("long"), lambda a, b: a + part(b))
    return F.when((F.col("size") > 0) & (F.col("shard_quota") > 0), whole).otherwise(F.lit(0).cast("long"))


def _parts(text: str, first: int, quota: int, blocks: int, shift: int, block: int) -> list[str]:
    """What each pass over the mix takes of a text: all of it as it is, or the
    stretches of its words that are taken, a line each."""
    words = [m.span() for m in re.finditer(WORD, text)]
    if not words or not quota:
        return []
    base, rest = divmod(quota, blocks)
    times = [base + ((b + shift) % blocks < rest) for b in range(first // block, (first + len(words) - 1) // block + 1)]
    out = []
    for turn in range(1, max(times) + 1):
        if min(times) >= turn:
            out.append(text)
            continue
        lines, open_at = [], None
        for k, (start, end) in enumerate(words):
            if times[(first + k) // block - first // block] >= turn:
                open_at = start if open_at is None else open_at
                last = end
            elif open_at is not None:
                lines.append(text[open_at:last])
                open_at = None
        out.append("\n".join(lines + ([text[open_at:last]] if open_at is not None else [])))
    return out


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, **options) -> DataFrame:
    """The mix itself, in the columns of ``df``: a row for each time a document
    is taken, with the words taken. All but the ends of a shard's stretch are
    whole texts. Documents of which nothing is taken go; so do those without a
    word. Rows equal in id and text are one row here, with their shares added.
    A column ``n_chars`` follows the text."""
    shares = laid(df.withColumn("_of", F.xxhash64(text_col)), id_col, text_col, source_col, block=block, keep="_of", **options)
    # An entry for up to COPIES equal rows.
    shares = shares.filter("shard_quota > 0").groupBy("doc_id", "_of").agg(F.collect_list(F.struct("first", "copies", "size", "shard_quota", "shard_blocks", "shift")).alias("_shares"))
    shares = shares.select(F.col("doc_id").alias("_id"), F.col("_of").alias("_key"), "_shares")
    own = df.withColumn("_of", F.xxhash64(text_col))
    own = own.join(shares, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_key"))).dropDuplicates(["_id", "_key"])
    own = own.select(*df.columns, "_shares")
    names = df.columns
    at, n = names.index(text_col), len(names)
    chars = names.index("n_chars") if "n_chars" in names else None

    def handed(part: pa.RecordBatch, rows: list[int], texts: list[str]) -> pa.RecordBatch:
        some = part.take(pa.array(rows, pa.int64()))
        columns = [some.column(k) for k in range(n)]
        columns[at] = pa.array(texts, pa.string())
        if chars is not None:
            columns[chars] = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays(columns, names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                rows, texts, held = [], [], 0
                for k in range(part.num_rows):
                    text = part.column(at)[k].as_py()
                    for s in part.column(n)[k].as_py():
                        for copy in range(s["copies"]):
                            some = _parts(text, s["first"] + copy * s["size"], s["shard_quota"], s["shard_blocks"], s["shift"], block)
                            texts += some
                            rows += [k] * len(some)
                            held += sum(map(len, some))
                            if held > HANDED:
                                yield handed(part, rows, texts)
                                rows, texts, held = [], [], 0
                yield handed(part, rows, texts)

    return own.mapInArrow(work, df.withColumn("n_chars", F.col("n_chars").cast("long")).schema if chars is not None else df.schema)
