"""Hard negatives: other-label rows that score nearly as high as a positive.

The score of two integer vectors is their inner product. Cut into segments
with means m and deviations d (root sums of squares about the mean, means
scaled by the root of the segment's length), it lies within

    sum over segments of  m_x m_y  -  d_x d_y   and   m_x m_y  +  d_x d_y

These summaries are stored with each vector for 1, 4 and 16 segments. A pair
goes on to finer segments only while its bounds still meet what is wanted, and
only pairs that no level excludes are scored exactly.

Anchors and rows are dealt to blocks and tiles of bounded size; each block
meets each tile once, in a task of its own, and hands on its best few only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermart.llm.common import written

#: Segments of each level.
LEVELS = (1, 4, 16)
#: Rows of a tile and anchors of a block: what one task holds.
TILE, BLOCK = 16384, 8192
#: Added to bounds, relative to both lengths: rounding must never lose a pair.
SLACK = 1e-9
LOW = -(1 << 63) + 1


def summaries(x: np.ndarray) -> np.ndarray:
    """Scaled means and deviations of all levels, side by side."""
    n, size = x.shape
    found = []
    for level in LEVELS:
        starts = np.unique(np.arange(level) * size // level)
        starts = starts[starts < size]
        lengths = np.diff(np.append(starts, size))
        if not len(starts):
            found += [np.zeros((n, level)), np.zeros((n, level))]
            continue
        mean = np.add.reduceat(x, starts, axis=1) / lengths
        spread = np.sqrt(np.add.reduceat((x - np.repeat(mean, lengths, axis=1)) ** 2, starts, axis=1))
        empty = np.zeros((n, level - len(starts)))
        found += [mean * np.sqrt(lengths), empty, spread, empty]
    return np.concatenate(found, axis=1)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for vec in batch.column(batch.num_columns - 1):
            x = np.array(vec.as_py(), np.int64)
            out.append((len(x), x.tobytes(), summaries(x.astype(np.float64)[None])[0].tobytes()))
        dims, vecs, sums = zip(*out, strict=True) if out else ((), (), ())
        extra = [pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array(sums, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=["id", "unnamed", "label", "anchor", "key", "dim", "vec", "summary"])


def rows_of(df: DataFrame, id_col: str, vec_col: str, label_col: str, anchor: Column) -> DataFrame:
    """All rows that take part, once each, with their summaries.

    ``vec_col`` holds whole numbers. Left out are rows with a null label or
    vector, with a null component, and those whose product with themselves is
    no 64-bit number (no score could then be promised to be one).
    """
    rows = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("id"),
        F.col(id_col).isNull().alias("unnamed"),
        F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(vec_col).cast("array<long>").alias("vec"),
    )
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rows = rows.filter(F.col("label").isNotNull() & F.forall("vec", lambda v: v.isNotNull()) & (square < float(1 << 62))).distinct()
    rows = rows.withColumn("key", F.xxhash64("id", "unnamed", "label", "vec")).select("id", "unnamed", "label", "anchor", "key", "vec")
    return rows.mapInArrow(_summarise, "id long, unnamed boolean, label long, anchor boolean, key long, dim int, vec binary, summary binary")


class Side:
    """Vectors of one side of a group as matrices."""

    def __init__(self, pdf: pd.DataFrame):
        n = len(pdf)
        self.id, self.unnamed, self.label, self.key = (pdf[c].to_numpy() for c in ("id", "unnamed", "label", "key"))
        self.ints = np.frombuffer(b"".join(pdf["vec"]), np.int64).reshape(n, -1)
        self.x = self.ints.astype(np.float64)
        sums = np.frombuffer(b"".join(pdf["summary"]), np.float64).reshape(n, -1)
        self.length = np.linalg.norm(self.x, axis=1)
        self.levels, at = [], 0
        for level in LEVELS:
            self.levels.append((sums[:, at : at + level], sums[:, at + level : at + 2 * level]))
            at += 2 * level


def search(a: Side, b: Side, low: np.ndarray, high: np.ndarray, k: int, alike: bool, some: int = 256, many: int = 4096) -> tuple[np.ndarray, ...]:
    """Anchor, goal, row and score of the first ``k`` rows of ``b`` for every
    anchor of ``a`` and each of its goals: scores from ``low`` to ``high``,
    labels alike (and not the anchor itself) or not alike. Higher scores come
    first, then smaller ids, null ids last."""
    n, goals = low.shape
    exact = float(a.length.max(initial=0)) * float(b.length.max(initial=0)) < 2.0**53
    floor = low.copy()  # scores below can't be among the first k any more
    best = np.full((n, goals, k), LOW)
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(b.id), many):
        r = slice(at, at + many)
        for start in range(0, n, some):
            q = slice(start, min(start + some, n))
            wanted = (a.label[q, None] == b.label[None, r]) == alike
            if alike:
                wanted &= (a.key[q, None] != b.key[None, r]) | (a.id[q, None] != b.id[None, r])
            least, most = floor[q].min(axis=1).astype(np.float64), high[q].max(axis=1).astype(np.float64)
            least, most = least - np.abs(least) * SLACK, most + np.abs(most) * SLACK
            i = j = None  # pairs left, once they are few
            for (am, ad), (bm, bd) in zip(a.levels, b.levels, strict=True):
                if i is None:
                    slack = SLACK * a.length[q, None] * b.length[None, r] + 1e-6
                    middle, room = am[q] @ bm[r].T, ad[q] @ bd[r].T + slack
                    wanted &= (middle + room >= least[:, None]) & (middle - room <= most[:, None])
                    if np.count_nonzero(wanted) * 16 < wanted.size:
                        i, j = np.nonzero(wanted)
                elif len(i):
                    middle, room = np.einsum("pd,pd->p", am[q][i], bm[r][j]), np.einsum("pd,pd->p", ad[q][i], bd[r][j])
                    room += SLACK * a.length[q][i] * b.length[r][j] + 1e-6
                    left = (middle + room >= least[i]) & (middle - room <= most[i])
                    i, j = i[left], j[left]
            if i is not None:
                if not len(i):
                    continue
                x, y = (a.x, b.x) if exact else (a.ints, b.ints)
                scores = np.einsum("pd,pd->p", x[q][i], y[r][j]).astype(np.int64)
            else:
                whole = (a.x[q] @ b.x[r].T).astype(np.int64) if exact else a.ints[q] @ b.ints[r].T
                whole = np.where(wanted, whole, LOW)
                if whole.shape[1] > 4 * k:  # the kth highest of a goal bounds what can matter
                    for g in range(goals):
                        fits = np.where(whole <= high[q, g, None], whole, LOW)
                        kth = np.partition(fits, -k, axis=1)[:, -k]
                        floor[q, g] = np.maximum(floor[q, g], kth)
                i, j = np.nonzero((whole >= floor[q].min(axis=1)[:, None]) & (whole > LOW))
                scores = whole[i, j]
            for g in range(goals):
                fits = (scores >= floor[q, g][i]) & (scores <= high[q, g][i])
                if not fits.any():
                    continue
                p, row, score = i[fits], j[fits] + at, scores[fits]
                order = np.lexsort((b.id[row], b.unnamed[row], -score, p))
                p, row, score = p[order], row[order], score[order]
                place = np.arange(len(p)) - np.searchsorted(p, p)
                first = place < k
                p, row, score, place = p[first], row[first], score[first], place[first]
                fresh = np.full((len(best[q]), k), LOW)
                fresh[p, place] = score
                best[q, g] = np.sort(np.concatenate([best[q, g], fresh], axis=1), axis=1)[:, -k:]
                floor[q, g] = np.maximum(floor[q, g], best[q, g, 0])
                found.append((p + start, np.full(len(p), g), row, score))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    p, g, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((b.id[row], b.unnamed[row], -score, g, p))
    p, g, row, score = p[order], g[order], row[order], score[order]
    group = p * goals + g
    first = np.arange(len(p)) - np.searchsorted(group, group) < k
    return p[first], g[first], row[first], score[first]


FOUND = "anchor_id long, anchor_key long, goal int, id long, unnamed boolean, score long"


def _found(a: Side, b: Side, low: np.ndarray, high: np.ndarray, k: int, alike: bool) -> pd.DataFrame:
    p, g, row, score = search(a, b, low, high, k, alike)
    return pd.DataFrame({"anchor_id": a.id[p], "anchor_key": a.key[p], "goal": g.astype(np.int32), "id": b.id[row], "unnamed": b.unnamed[row], "score": score})


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor's goal over all tiles, with their rank."""
    order = Window.partitionBy("anchor_id", "anchor_key", "goal").orderBy(F.col("score").desc(), "unnamed", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _meet(anchors: DataFrame, pool: DataFrame, by: list[str], tile: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``tile`` and ``block``: of the rows that agree in
    ``by``, each block of anchors meets each tile of the pool."""
    sizes = pool.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    blocks = anchors.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    sizes = sizes.join(blocks, by)

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))

    mine = anchors.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks"))).withColumn("tile", every("tiles"))
    theirs = pool.join(sizes, by).withColumn("tile", F.pmod(F.xxhash64("id", "key"), F.col("tiles"))).withColumn("block", every("blocks"))
    return mine.drop("tiles", "blocks"), theirs.drop("tiles", "blocks")


def mine(
    df: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    lowest: int = 80,
    tile: int = TILE,
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its first ``positives`` other rows of its label;
    for each, the first ``negatives`` rows of other labels that score at most
    as high as it and at least ``lowest`` percent of it. ``vec_col`` holds
    whole numbers (see ``rows_of`` for the rows that take part). Rows alike in
    id, label and vector are one row; another row of the anchor's id may be its
    positive. A row without id may be found, after all others of its score.
    Only vectors of one length have a score with each other. An empty table,
    or one without anchors, gives no rows.

    Of rows with one label and vector only as many as could ever be returned
    take part, those with the smallest ids: they tie in every score.
    """
    rows = written(rows_of(df, id_col, vec_col, label_col, anchor))
    anchors = rows.filter("anchor")
    k = max(positives + 1, negatives)
    ties = Window.partitionBy("dim", "label", "vec").orderBy("unnamed", "id")
    pool = rows.withColumn("tie", F.row_number().over(ties)).filter(F.col("tie") <= k)
    pool = written(pool.select("id", "unnamed", "label", "key", "dim", "vec", "summary"))
    anchors = anchors.select("id", "unnamed", "label", "key", "dim", "vec", "summary")

    def alike(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ("anchor_id", "anchor_key", "goal", "id", "unnamed", "score")})
        low, high = np.full((len(a), 1), LOW + 1), np.full((len(a), 1), -LOW)
        return _found(Side(a), Side(b), low, high, positives, True)

    left, right = _meet(anchors, pool, ["dim", "label"], tile, block)
    keys = ["dim", "label", "tile", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(alike, FOUND)
    chosen = written(_first(found, positives).select("anchor_id", "anchor_key", "rank", F.col("id").alias("positive"), F.col("unnamed").alias("positive_unnamed"), F.col("score").alias("positive_score")))

    goals = chosen.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("goals"))  # a few an anchor
    seekers = anchors.join(goals, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key"))).select(*anchors.columns, F.col("goals.positive_score").alias("goals"))

    def unlike(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ("anchor_id", "anchor_key", "goal", "id", "unnamed", "score")})
        low, high = np.full((len(a), positives), -LOW), np.full((len(a), positives), LOW + 1)
        for row, scores in enumerate(a["goals"]):
            for g, score in enumerate(map(int, scores)):
                low[row, g], high[row, g] = -(-lowest * score // 100), score
        return _found(Side(a), Side(b), low, high, negatives, False)

    left, right = _meet(seekers, pool, ["dim"], tile, block)
    keys = ["dim", "tile", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(unlike, FOUND)
    best = _first(found, negatives)
    both = chosen.withColumn("goal", F.col("rank") - 1).drop("rank").join(best, ["anchor_id", "anchor_key", "goal"])
    return both.select(
        "anchor_id",
        F.when(~F.col("positive_unnamed"), F.col("positive")).alias("positive_id"),
        "rank",
        F.when(~F.col("unnamed"), F.col("id")).alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def prepared(df: DataFrame, scale: int = 256, every: int = 7, labels: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, embedding, label``: components as whole numbers of 1/``scale``
    (null where one is null, not finite or beyond 64 bits), labels of ids
    divisible by ``every`` moved on by one."""
    number = F.col(vec_col).cast("array<double>")
    fine = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float((1 << 62) // scale)))
    moved = F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))
    return df.select(F.col(id_col).alias("vec_id"), F.when(fine, F.transform(number, lambda x: F.floor(x * scale))).alias("embedding"), moved.alias("label"))


def oracle(table: str = "embeddings") -> str:
    """The registered query in DuckDB SQL, all anchors against all rows."""
    return f"""
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM {table}
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.alike
  AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
