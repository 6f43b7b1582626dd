import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordermart.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, score int, id string, tile long"


def brute(rows, every=100):
    """All scores of all anchors."""
    taken = {(i, label, tuple(v)) for i, v, label in rows if label is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)}
    taken = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, tuple(int(np.floor(256 * x)) for x in v)) for i, label, v in taken]
    taken = list(set(taken))
    out = []
    for anchor in taken:
        if anchor[0] is None or anchor[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(anchor[2], r[2], strict=True)), r[0] is None, r[0] or 0, r[0], r[1]) for r in taken if r is not anchor and len(r[2]) == len(anchor[2])]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == anchor[1]][:5]:
            fits = [s for s in scored if s[4] != anchor[1] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]]
            out += [(anchor[0], p[3], rank + 1, s[3], -p[0], -s[0]) for rank, s in enumerate(fits[:5])]
    return sorted(out, key=str)


def run(spark, rows, every=100, **how):
    df = spark.createDataFrame([(*r, 0, "x", 5) for r in rows], SCHEMA)
    got = H.mine(H.prepared(df), F.col("vec_id") % every == 0, **how)
    return sorted(map(tuple, got.collect()), key=str)


def vectors(n, dim, rnd, labels=4, spread=0.4):
    centres = rnd.normal(size=(labels, dim))
    return [(i, (centres[i % labels] * 0.2 + rnd.normal(size=dim) * spread + 0.3).tolist(), int(rnd.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("dim", "how"), [(16, {}), (5, {"tile": 40, "block": 3}), (1, {"tile": 64}), (70, {"tile": 100, "block": 2})])
def test_equals_brute_force(spark, dim, how):
    rows = vectors(300, dim, np.random.default_rng(dim))
    got = run(spark, rows, 20, **how)
    assert got == brute(rows, 20) and got


def test_nulls_ties_copies_and_lengths(spark):
    rnd = np.random.default_rng(1)
    rows = vectors(80, 4, rnd, labels=2)
    same = [0.5, 0.5, 0.25, 1.0]
    rows += [(1000 + i, same, i % 3) for i in range(60)]  # ties in groups above what is returned
    rows += [rows[0]] * 3 + [(0, same, 1), (0, same, 0), (100, [0.1] * 4, 0), (100, [0.1] * 4, 0)]
    rows += [(None, same, 1), (None, same, 0), (5, None, 1), (6, [None, 1.0, 1.0, 1.0], 1), (8, [float("nan")] * 4, 1), (9, [float("inf")] * 4, 1), (10, same, None)]
    rows += [(200, [], 0), (201, [], 0), (202, [], 1), (300, [1.0, 2.0], 3), (301, [1.0, 2.0], 3), (302, [1.0, 1.9], 4), (400, [0.0] * 4, 5), (401, [0.0] * 4, 5)]
    got = run(spark, rows, 50, tile=32, block=2)
    assert got == brute(rows, 50) and got


def test_large_components_are_exact(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, (rnd.normal(size=6) * 1e6 + 2e6).tolist(), i % 2) for i in range(60)]
    rows.append((61, [1e300] * 6, 1))  # its scores would be no 64-bit numbers
    assert run(spark, rows, 10) == brute(rows[:-1], 10)


def test_bounds_hold():
    rnd = np.random.default_rng(3)
    for dim in (1, 3, 16, 50):
        x, y = rnd.normal(size=(30, dim)) * 100, rnd.normal(size=(40, dim)) * 100 + 30
        true, at = x @ y.T, 0
        a, b = H.summaries(x), H.summaries(y)
        width = np.inf
        for level in H.LEVELS:
            middle = a[:, at : at + level] @ b[:, at : at + level].T
            room = a[:, at + level : at + 2 * level] @ b[:, at + level : at + 2 * level].T
            assert (true <= middle + room + 1e-6).all() and (true >= middle - room - 1e-6).all()
            assert room.mean() <= width + 1e-9
            width, at = room.mean(), at + 2 * level


def test_pairs_are_left_out_before_scoring():
    rnd = np.random.default_rng(4)
    x = np.repeat(rnd.normal(size=(50, 16)), 4, axis=1) + rnd.normal(size=(50, 64)) * 0.05
    y = np.repeat(rnd.normal(size=(3000, 16)), 4, axis=1) + rnd.normal(size=(3000, 64)) * 0.05
    a, b = H.summaries(x), H.summaries(y)
    middle, room = a[:, 10:26] @ b[:, 10:26].T, a[:, 26:42] @ b[:, 26:42].T
    kth = np.sort(x @ y.T, axis=1)[:, -5]
    assert (middle + room >= kth[:, None]).mean() < 0.05


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (3, [1.0], 2)]) == []
