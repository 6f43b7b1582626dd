"""Near duplicates by SimHash, compared exactly in tiles.

A text's fingerprint has bit b set if over half of its shingles' hashes have.
Equal fingerprints are one class first; the classes are laid out in tiles by
population count (the number of set bits). Two fingerprints that differ in at
most r bits have counts that differ by at most r, so a pair of tiles beyond
that is never formed, and inside a pair the counts of both halves skip blocks
in the same way. What is left is compared with exclusive-or and bit counts in
numpy. A task hands on a star of links for each local group, never all pairs,
and components are joined up over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import documents, slices, written
from ordermart.llm.components import connected_components, local_labels

#: Fingerprints a tile has at most, on average: 0.5 MB.
TILE = 1 << 16
#: Links a task gathers before it turns them into stars.
HELD = 1 << 20


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six blanks alone
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32).tolist()
    starts = [0, *[g + 1 for g in gaps[: n - 1]]]
    ends = [*gaps[shingle - 1 :], len(flat)]
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(flat[a:b], seed) for a, b in zip(starts, ends[-n:], strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, bits`` (the fingerprint as a signed long) of every row, then
    the columns ``carry`` (longs)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(t.as_py(), shingle, seed) for t in part.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), *part.columns[2:]], names=["doc_id", "bits", *carry])

    return documents(df, id_col, text_col, *carry).mapInArrow(work, ", ".join(f"{c} long" for c in ("doc_id", "bits", *carry)))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by the count of the upper half; that count; where each begins."""
    high = np.bitwise_count(x >> np.uint64(32)).astype(np.int64)
    order = np.argsort(high, kind="stable")
    return x[order], high[order], np.searchsorted(high[order], np.arange(34))


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (into a and b) that differ in at most ``radius``
    bits; ``a`` and ``b`` hold one population count each and are in the order
    of ``_halves``."""
    if not len(a) or not len(b):
        return
    more = int(np.bitwise_count(b[0])) - int(np.bitwise_count(a[0]))
    _, _, at = _halves(b)
    _, high, begins = _halves(a)
    for h in range(33):
        lo, hi = begins[h], begins[h + 1]
        reach = [g for g in range(33) if abs(g - h) + abs(more - (g - h)) <= radius]
        if lo == hi or not reach:
            continue
        first, last = at[reach[0]], at[reach[-1] + 1]
        for j in range(first, last, 4096):
            some = b[j : min(j + 4096, last)]
            for i in range(lo, hi, 32):
                near = np.bitwise_count(a[i : min(i + 32, hi), None] ^ some) <= radius
                if near.any():
                    x, y = np.nonzero(near)
                    yield x + i, y + j


def _stars(tile: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint with the first of its group in this pair of tiles."""
    a, _, _ = _halves(tile.view(np.uint64))
    b, _, _ = _halves(other.view(np.uint64))
    n = len(a) + len(b)
    u, v, held = [np.array([], np.int64)], [np.array([], np.int64)], 0
    for x, y in near_pairs(a, b, radius):
        u.append(x)
        v.append(y + len(a))
        held += len(x)
        if held > HELD:
            label = local_labels(np.concatenate(u), np.concatenate(v), n)
            linked = np.flatnonzero(label != np.arange(n))
            u, v, held = [linked], [label[linked]], len(linked)
    label = local_labels(np.concatenate(u), np.concatenate(v), n)
    linked = np.flatnonzero(label != np.arange(n))
    both = np.concatenate([a, b]).view(np.int64)
    return both[linked], both[label[linked]]


def links(classes: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """``u, v``: stars that connect exactly the fingerprints (distinct ``bits``)
    that chains of at most ``radius`` differing bits connect."""
    spark = classes.sparkSession
    counted = classes.select("bits", F.bit_count("bits").alias("ones"))
    sizes = dict(counted.groupBy("ones").count().collect())  # 65 rows at most
    parts = {p: -(-n // tile) for p, n in sizes.items()}
    if not parts:
        return spark.createDataFrame([], "u long, v long")
    split = F.get(F.array(*(F.lit(parts.get(p, 1)) for p in range(65))), F.col("ones"))
    tiles = counted.groupBy("ones", F.pmod(F.xxhash64("bits"), split).alias("part")).agg(F.collect_list("bits").alias("tile"))
    tiles = written(tiles)
    pairs = _partners(spark, parts, radius)
    n_pairs = sum(k * parts.get(q, 0) for p, k in parts.items() for q in range(p, p + radius + 1))
    left = tiles.select("ones", "part", F.col("tile").alias("a"))
    right = tiles.select(F.col("ones").alias("other_ones"), F.col("part").alias("other_part"), F.col("tile").alias("b"))
    both = pairs.join(left, ["ones", "part"]).join(right, ["other_ones", "other_part"]).select("a", "b")
    both = both.repartition(min(n_pairs, 1 << 15))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                u, v = _stars(batch.column(0)[k].values.to_numpy(), batch.column(1)[k].values.to_numpy(), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return both.mapInArrow(work, "u long, v long")


def _partners(spark, parts: dict[int, int], radius: int) -> DataFrame:
    """The pairs of tiles to compare, spelled out by Spark from the 65 counts."""
    counts = spark.createDataFrame([(p, k) for p, k in parts.items()], "p int, parts long")
    other = counts.select(F.col("p").alias("q"), F.col("parts").alias("other_parts"))
    near = counts.withColumn("q", F.explode(F.sequence(F.col("p"), F.col("p") + radius))).join(other, "q")
    each = near.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    each = each.withColumn("other_part", F.explode(F.sequence(F.when(F.col("p") == F.col("q"), F.col("part")).otherwise(F.lit(0).cast("long")), F.col("other_parts") - 1)))
    return each.select(F.col("p").alias("ones"), "part", F.col("q").alias("other_ones"), "other_part")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = 4,
    seed: int = 42,
    tile: int = TILE,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``component_id`` is the smallest doc_id whose fingerprint can be reached
    over links of at most ``radius`` differing bits. A null, empty or blank
    text has fingerprint zero and is linked like any other; fewer words than a
    shingle are one shingle. Repeated rows are equal fingerprints. A row
    without doc_id belongs to its group but gives it no id (null if none has).
    """
    marked = written(fingerprints(df, id_col, text_col, shingle, seed))
    classes = written(marked.groupBy("bits").agg(F.min("doc_id").alias("first")))
    groups = connected_components(links(classes, radius, tile)).select(F.col("node").alias("bits"), "component")
    named = classes.join(groups, "bits", "left").select("bits", "first", F.coalesce("component", "bits").alias("component"))
    named = written(named)
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(firsts, "component").select("bits", "component_id")
    return marked.join(ids, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = 4,
    seed: int = 42,
    tile: int = TILE,
) -> DataFrame:
    """One row of ``df`` of each group of near duplicates.

    It is the row of the smallest id; rows without id come after all others.
    Unlike rows may share an id (or have none): of these, a hash of the whole
    row decides, so the choice is the same in any partitioning. Every row is
    compared by its own text. Rows alike in every column are one row. Columns
    of a map type can't be hashed.
    """
    whole = [x for c in df.columns for x in (F.col(c), F.col(c).isNull())]
    keyed = df.withColumns({"_a": F.xxhash64(*whole), "_b": F.xxhash64(F.lit(7), *whole)})
    marked = written(fingerprints(keyed, id_col, text_col, shingle, seed, ("_a", "_b")))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_a", "_b")
    classes = written(marked.groupBy("bits").agg(F.min(order).alias("row")))
    groups = connected_components(links(classes, radius, tile)).select(F.col("node").alias("bits"), "component")
    named = classes.join(groups, "bits", "left").select("row", F.coalesce("component", "bits").alias("component"))
    first = written(named.groupBy("component").agg(F.min("row").alias("row")).select("row._a", "row._b"))
    # Repeated rows are combined in the map tasks, before texts move.
    return keyed.dropDuplicates(["_a", "_b"]).join(first, ["_a", "_b"], "left_semi").select(*df.columns)
