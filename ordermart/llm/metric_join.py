"""Near-duplicate embeddings by an exact metric range join.

Cosine c between unit vectors is the distance sqrt(2 - 2 c), a metric. Pivots
partition the vectors into cells by nearest pivot. If u lies in pivot q's cell
and d(u, v) <= r, the triangle inequality gives d(v, q) <= d(v, p) + 2 r for
v's own pivot p; only to cells that satisfy it is v replicated. A pair of two
cells is compared in the one of the lower pivot, so replicas go one way. Cells
join independently; a large cell is split into tiles, and inside a tile blocks
whose distances to the pivot differ by more than r are skipped by the same
inequality. Equal vectors are one class first, and a task hands on counts and
a star of links for each vector, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import written
from ordermart.llm.components import connected_components, local_labels

#: Pivots at least (if there are so many vectors) and at most; between, their
#: number follows the root of the vectors' number. The driver holds the pivots.
FEW, PIVOTS = 20, 4096
#: Distances to pivots that are held at once.
HELD = 1 << 22
#: Vectors of a cell that meet in one task, from each side.
TILE = 4096
#: Added to every bound on distances: rounding must never lose a pair.
SLACK = 1e-6


def _unit(column: pa.Array) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(vec: str):
    """Not null, no null or non-finite component, not zero (or without length)."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _measurable(vec: str):
    """The vector, or where its squares would leave the range of doubles, the
    same direction with a largest component of 1."""
    squares = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x)
    largest = F.array_max(F.transform(vec, F.abs))
    return F.when(squares.between(1e-250, 1e250), F.col(vec)).otherwise(F.transform(vec, lambda x: x / largest))


def classes(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as ``vec_id, vec, ok``; the distinct valid vectors as
    ``vec, rep`` (smallest id), ``copies``."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("ok", _valid("vec"))
    rows = rows.withColumn("vec", F.when(F.col("ok"), _measurable("vec")))
    return rows, rows.filter("ok").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def n_pivots(n: int, most: int = PIVOTS) -> int:
    """Pivots, and so cells, for ``n`` vectors."""
    return max(1, min(n, most, max(FEW, math.isqrt(n) // 8)))


def range_join(points: DataFrame, cosine: float = 0.9, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """``rep, linked, star`` rows whose sums by ``rep`` are the number of linked
    copies of other vectors and whose ``rep - star`` edges connect what is
    linked. ``points``: ``vec`` (distinct, valid, of one length), ``rep``
    (unique), ``copies``."""
    spark = points.sparkSession
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    n = points.count()
    k = n_pivots(n, pivots)
    sample = points.orderBy(F.xxhash64("rep"), "rep").limit(k).select("vec").collect()  # at most PIVOTS vectors
    if not sample:
        return spark.createDataFrame([], "rep long, linked long, star long")
    centres = np.array([r.vec for r in sample], np.float64)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, HELD // len(centres))
            for part in (batch.slice(a, step) for a in range(0, batch.num_rows, step)):
                far = np.sqrt(np.maximum(0, 2 - 2 * (_unit(part.column(0)) @ centres.T)))
                home = far.argmin(axis=1)
                near = far <= far.min(axis=1, keepdims=True) + 2 * radius + SLACK
                near &= np.arange(len(centres)) <= home[:, None]  # replicas go to lower pivots
                row, cell = np.nonzero(near)
                some = part.take(pa.array(row))
                extra = [pa.array(cell.astype(np.int32)), pa.array(cell == home[row]), pa.array(far[row, cell])]
                yield pa.RecordBatch.from_arrays([*some.columns, *extra], names=["vec", "rep", "copies", "cell", "home", "far"])

    placed = points.select("vec", "rep", "copies").mapInArrow(place, "vec array<double>, rep long, copies long, cell int, home boolean, far double")
    placed = written(placed)
    # Tiles of a cell: its own vectors in chunks i, against its own chunks j >= i and the visiting chunks.
    counts = {(r.cell, r.home): r["count"] for r in placed.groupBy("cell", "home").count().collect()}  # two rows a pivot
    chunks = [[-(-counts.get((c, h), 0) // tile) for c in range(k)] for h in (True, False)]

    def of(values: list[int]):
        return F.get(F.array(*map(F.lit, values)), F.col("cell")).cast("long")

    own, guests = of(chunks[0]), of(chunks[1])
    chunk = F.pmod(F.xxhash64("rep"), F.greatest(F.when(F.col("home"), own).otherwise(guests), F.lit(1)))
    sides = placed.withColumn("chunk", chunk)
    zero = F.lit(0).cast("long")
    # A home chunk is side a of (i, j >= i) and of all (i, guests), and side b of (i < j, j).
    as_a = sides.filter("home").withColumn("to", F.explode(F.array_union(
        F.transform(F.sequence(F.col("chunk"), own - 1), lambda j: F.struct(F.col("chunk").alias("i"), j.alias("j"), F.lit(True).alias("within"))),
        F.when(guests > 0, F.transform(F.sequence(zero, guests - 1), lambda j: F.struct(F.col("chunk").alias("i"), j.alias("j"), F.lit(False).alias("within")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,within:boolean>>")),
    ))).withColumn("side", F.lit(0))
    as_b = sides.filter("home").filter("chunk > 0").withColumn("to", F.explode(F.transform(F.sequence(zero, F.col("chunk") - 1), lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j"), F.lit(True).alias("within"))))).withColumn("side", F.lit(1))
    visiting = sides.filter("not home").filter(own > 0).withColumn("to", F.explode(F.transform(F.sequence(zero, own - 1), lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j"), F.lit(False).alias("within"))))).withColumn("side", F.lit(1))
    keys = ["cell", "i", "j", "within"]
    tiles = as_a.unionByName(as_b).unionByName(visiting).select("cell", F.col("to.i").alias("i"), F.col("to.j").alias("j"), F.col("to.within").alias("within"), "side", "vec", "rep", "copies", "far")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[pdf["side"] == 0].sort_values("far")
        same = bool(pdf["within"].iloc[0]) and pdf["i"].iloc[0] == pdf["j"].iloc[0]
        return _compare(a, a if same else pdf[pdf["side"] == 1].sort_values("far"), same, cosine, radius)

    return tiles.groupBy(*keys).applyInPandas(compare, "rep long, linked long, star long")


def _compare(a: pd.DataFrame, b: pd.DataFrame, same: bool, cosine: float, radius: float, block: int = 512) -> pd.DataFrame:
    n, m = len(a), len(b)
    if not n or not m:
        return pd.DataFrame({"rep": [], "linked": [], "star": []}).astype("int64")
    x, y = np.stack(a["vec"].to_numpy()).astype(np.float64), np.stack(b["vec"].to_numpy()).astype(np.float64)
    x_length, y_length = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    # Single precision finds candidates with room for its rounding; double decides.
    x32, y32 = (x / x_length[:, None]).astype(np.float32), (y / y_length[:, None]).astype(np.float32)
    far_a, far_b, w_a, w_b = (df[c].to_numpy() for c in ("far", "copies") for df in (a, b))
    linked_a, linked_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
    offset = 0 if same else n
    u, v, held = [np.array([], np.int64)], [np.array([], np.int64)], 0
    for i in range(0, n, block):
        ends = min(i + block, n)
        lo = np.searchsorted(far_b, far_a[i] - radius)
        hi = np.searchsorted(far_b, far_a[ends - 1] + radius, side="right")
        for j in range(max(lo, i) if same else lo, hi, block):
            p, q = np.nonzero(x32[i:ends] @ y32[j : min(j + block, hi)].T >= cosine - 1e-4)
            p, q = p + i, q + j
            if same:
                p, q = p[p < q], q[p < q]
            good = np.einsum("ij,ij->i", x[p], y[q]) / (x_length[p] * y_length[q]) >= cosine
            p, q = p[good], q[good]
            if not len(p):
                continue
            np.add.at(linked_a, p, w_b[q])
            np.add.at(linked_b, q, w_a[p])
            u.append(p)
            v.append(q + offset)
            held += len(p)
            if held > 1 << 20:
                label = local_labels(np.concatenate(u), np.concatenate(v), offset + m)
                some = np.flatnonzero(label != np.arange(offset + m))
                u, v, held = [some], [label[some]], len(some)
    label = local_labels(np.concatenate(u), np.concatenate(v), offset + m)
    if same:
        linked, reps = linked_a + linked_b, a["rep"].to_numpy()
    else:
        linked, reps = np.concatenate([linked_a, linked_b]), np.concatenate([a["rep"].to_numpy(), b["rep"].to_numpy()])
    some = np.flatnonzero(linked)
    return pd.DataFrame({"rep": reps[some], "linked": linked[some], "star": reps[label[some]]})


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    ``n_links`` is the number of other rows at cosine ``cosine`` or more (in
    double precision), ``component_id`` the smallest vec_id reachable by links
    and ``kept`` says that this is the row's own. A vector that is null, empty,
    zero, or holds null or non-finite components links with nothing, so its
    component is itself. Vectors of different lengths don't link. Repeated rows
    count as copies of each other; a row without vec_id is counted but gives a
    group no id (null if none has) and isn't kept.
    """
    rows, points = classes(df, id_col, vec_col)
    # Ids may be null or shared by different vectors: number the classes for the join.
    numbered = written(points.withColumns({"size": F.size("vec"), "number": F.monotonically_increasing_id()}))
    found = None
    for (size,) in numbered.select("size").distinct().orderBy("size").collect():  # one length, as a rule
        some = numbered.filter(F.col("size") == size).select("vec", F.col("number").alias("rep"), "copies")
        part = range_join(some, cosine, pivots, tile)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "rep long, linked long, star long")
    found = written(found)
    linked = found.groupBy(F.col("rep").alias("number")).agg(F.sum("linked").alias("linked"))
    groups = connected_components(found.select(F.col("rep").alias("u"), F.col("star").alias("v")))
    named = numbered.select("number", "vec", "rep", "copies").join(linked, "number", "left").join(groups.withColumnRenamed("node", "number"), "number", "left")
    named = named.select("vec", "rep", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "number").alias("label"))
    named = written(named)
    ids = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    full = named.join(ids, "label").select("vec", "n_links", "component_id")
    good = rows.filter("ok").join(full, "vec").select("vec_id", "n_links", "component_id")
    bad = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionAll(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle(table: str = "embeddings", cosine: float = 0.9) -> str:
    """The same in DuckDB SQL by comparing all pairs; ids must be unique."""
    return f"""
WITH RECURSIVE part AS (
    SELECT vec_id, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i,
        CAST(embedding[unnest(range(1, len(embedding) + 1))] AS DOUBLE) AS x
    FROM {table}
),
good AS (
    SELECT vec_id, n, sqrt(sum(x * x)) AS length FROM part GROUP BY vec_id, n
    HAVING count(x) = count(*) AND bool_and(isfinite(x)) AND sum(x * x) > 0
),
vec AS (SELECT vec_id, n, length, CAST(embedding AS DOUBLE[]) AS e FROM good JOIN {table} USING (vec_id)),
link AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM vec a JOIN vec b ON a.n = b.n AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.length * b.length) >= {cosine}
),
reach(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v),
least AS (SELECT u, min(v) AS v FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT t.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, least(t.vec_id, coalesce(m.v, t.vec_id)) AS component_id,
    t.vec_id <= coalesce(m.v, t.vec_id) AS kept
FROM {table} t LEFT JOIN degree d ON d.u = t.vec_id LEFT JOIN least m ON m.u = t.vec_id
"""
