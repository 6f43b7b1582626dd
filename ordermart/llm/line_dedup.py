"""Boilerplate lines by the number of distinct sites that carry them.

Every line's hash gets a HyperLogLog sketch of its sites; sketches merge by
aggregation, map-side first, so a line on a third of all documents is a few
sketches. Lines whose estimate is clearly under or over the threshold are
decided by it; those near it get an exact distinct count, for which (line,
site) pairs are reduced before they move. What reaches the threshold is
boilerplate and is removed from the documents.

A document without a line of its own is no page with boilerplate but a copy
of one that is spread over sites; its lines stay, for near-duplicate removal
to judge it whole. From every other document all boilerplate goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import written

#: log2 of a sketch's registers: a relative standard error of 1.04 / 2^(k/2), 6.5 %.
LOG_REGISTERS = 8
#: Estimates within this share of the threshold are counted exactly (four standard errors).
NEAR = 0.26
#: Sites from which a line is boilerplate.
SITES = 5
BLANK_ENDS = " \t\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Two hashes of the line without blanks at its ends."""
    bare = F.btrim(line, F.lit(BLANK_ENDS))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(7), bare).alias("b"))


def _lines(df: DataFrame) -> DataFrame:
    """One row a line that isn't blank: document, site, position, key."""
    each = df.select("row", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = F.btrim("line", F.lit(BLANK_ENDS))
    return each.filter(bare != "").select("row", "site", "pos", line_key(F.col("line")).alias("key"))


def boilerplate(lines: DataFrame, sites: int = SITES, near: float = NEAR) -> DataFrame:
    """The keys of lines on at least ``sites`` distinct sites (null is one).

    ``lines``: ``key, site``. Estimates beyond ``near`` of the threshold decide;
    an estimate is wrong by more than that once in 15,000 lines, and sketches
    of a few sites are all but exact.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col("site")), F.lit("n"))
    sketched = lines.groupBy("key").agg(F.hll_sketch_agg(site, F.lit(LOG_REGISTERS)).alias("sketch"))
    sized = sketched.select("key", F.hll_sketch_estimate("sketch").alias("estimate"))
    sized = written(sized.filter(F.col("estimate") >= sites * (1 - near)))
    unsure = sized.filter(F.col("estimate") <= sites * (1 + near)).select("key")
    pairs = lines.join(unsure, "key", "left_semi").select("key", site.alias("site")).distinct()
    exact = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= sites).select("key")
    return sized.filter(F.col("estimate") > sites * (1 + near)).select("key").unionAll(exact)


def line_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    sites: int = SITES,
    near: float = NEAR,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, text, n_lines, n_removed, removed_chars, all_shared`` of every row.

    ``text`` is the whole text without its boilerplate lines (the rest joined
    by newlines as before); ``n_lines`` counts lines that aren't blank. Blank
    lines always stay. If all other lines are boilerplate, nothing is removed
    and ``all_shared`` is true. A null text counts as empty: no lines. A null site is a site. Repeated rows are
    treated alike, and count as one site. The columns ``carry`` come last.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    more = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.col(site_col).cast("string").alias("site"), more.alias("more"))
    # Equal rows are interchangeable, so a row is known by its id and text.
    docs = docs.withColumn("row", F.struct(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("id"), F.xxhash64("text").alias("of"), F.col("doc_id").isNull().alias("unnamed")))
    lines = _lines(docs)
    keys = written(boilerplate(lines.select("key", "site"), sites, near))
    hit = lines.select("row", "pos", "key").join(keys, "key")
    found = hit.groupBy("row").agg(F.collect_set("pos").alias("at"))
    joined = docs.join(found, "row", "left").withColumn("split", F.split("text", "\n"))
    joined = joined.withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    size = lambda only: F.aggregate(F.transform("split", lambda x, k: F.when(only(x, k), F.length(x)).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    joined = joined.withColumns(
        {
            "n_lines": F.size(F.filter("split", lambda x: F.btrim(x, F.lit(BLANK_ENDS)) != "")).cast("long"),
            "shared": F.when(F.size("at") > 0, size(lambda x, k: F.array_contains("at", k))).otherwise(F.lit(0).cast("long")),
        }
    )
    alone = (F.size("at") > 0) & (F.size("at") == F.col("n_lines"))
    cut = (F.size("at") > 0) & ~alone
    rest = F.array_join(F.filter("split", lambda x, k: ~F.array_contains("at", k)), "\n")
    return joined.select(
        "doc_id",
        F.when(cut, rest).otherwise(F.col("text")).alias("text"),
        "n_lines",
        F.when(cut, F.size("at")).otherwise(0).cast("long").alias("n_removed"),
        F.when(cut, F.col("shared")).otherwise(0).cast("long").alias("removed_chars"),
        alone.alias("all_shared"),
        *(F.col("more")[c].alias(c) for c in carry),
    )


def oracle(table: str = "documents", sites: int = SITES) -> str:
    """The same in DuckDB SQL, by exact distinct counts."""
    blanks = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM {table}),
each AS (
    SELECT r, source, i AS pos, string_split(text, chr(10))[i] AS line
    FROM (SELECT r, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs)
),
bare AS (SELECT *, trim(line, {blanks}) AS key FROM each),
wide AS (
    SELECT key FROM bare WHERE key <> '' GROUP BY key
    HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= {sites}
),
marked AS (SELECT b.*, w.key IS NOT NULL AS hit FROM bare b LEFT JOIN wide w USING (key)),
sums AS (
    SELECT r, count(*) FILTER (key <> '') AS n_lines,
        count(*) FILTER (hit) AS hits, coalesce(sum(length(line)) FILTER (hit), 0) AS shared,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS rest
    FROM marked GROUP BY r
)
SELECT d.doc_id, CASE WHEN hits > 0 AND hits < n_lines THEN rest ELSE d.text END AS text,
    CAST(n_lines AS BIGINT) AS n_lines,
    CAST(CASE WHEN hits < n_lines THEN hits ELSE 0 END AS BIGINT) AS n_removed,
    CAST(CASE WHEN hits < n_lines THEN shared ELSE 0 END AS BIGINT) AS removed_chars,
    hits > 0 AND hits = n_lines AS all_shared
FROM docs d JOIN sums USING (r)
"""
