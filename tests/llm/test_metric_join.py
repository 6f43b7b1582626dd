import numpy as np
import pytest

from ordermart.llm import metric_join


def brute(rows):
    ids = [r[0] for r in rows]
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(n):
        for b in range(a + 1, n):
            if good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float64), np.array(rows[b][1], np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9:
                    links[a] += 1
                    links[b] += 1
                    parent[find(b)] = find(a)
    first = {}
    for k in range(n):
        if ids[k] is not None:
            first[find(k)] = min(first.get(find(k), ids[k]), ids[k])
    return sorted((ids[k] if ids[k] is not None else -1, links[k], first.get(find(k), -1)) for k in range(n))


@pytest.mark.parametrize(("pivots", "tile"), [(64, 4096), (7, 20), (64, 5)])
def test_equals_all_pairs(spark, pivots, tile):
    rnd = np.random.default_rng(3)
    f32 = lambda v: [float(x) for x in np.asarray(v, np.float32)]
    rows = [(k, f32(v)) for k, v in enumerate(rnd.normal(size=(120, 6)))]
    centre = rnd.normal(size=6)
    rows += [(200 + k, f32(centre + 0.12 * rnd.normal(size=6))) for k in range(60)]
    rows += [(300 + k, rows[4][1]) for k in range(25)] + [(5, rows[5][1]), (None, rows[6][1])]
    rows += [(400, None), (401, [0.0] * 6), (402, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf")] + [0.0] * 5), (405, []), (406, [1.0, 0.0]), (407, [2.0, 0.1]), (408, [x * 3 for x in rows[7][1]])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, rep string, kept string")
    got = metric_join.near_duplicates(df, pivots=pivots, tile=tile).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_vectors_whose_squares_leave_the_range(spark):
    rows = [(1, [1e300, 2e300]), (2, [1e-300, 2e-300]), (3, [1.0, 2.1]), (4, [-1e300, 1e300]), (5, [5e-324, 0.0]), (6, [1e200, 0.0]), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert metric_join.near_duplicates(df).count() == 0


def test_cells_at_every_size(spark):
    assert [metric_join.n_pivots(n) for n in (1, 7, 500, 2000, 10**6, 10**9, 10**12)] == [1, 7, 20, 20, 125, 3952, 4096]
    rnd = np.random.default_rng(4)
    vectors = rnd.normal(size=(600, 8))
    vectors[300:] = vectors[:300] + rnd.normal(size=(300, 8)) * 0.1
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert {r.vec_id: r.n_links for r in metric_join.near_duplicates(df).collect()} == dict(enumerate(links.tolist()))
