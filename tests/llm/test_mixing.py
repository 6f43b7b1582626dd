import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ordermart.llm import mixing


def brute_seats(weights, seats):
    won = dict.fromkeys(weights, 0)
    if not any(w > 0 for w in weights.values()):
        return won
    for _ in range(seats):
        best = min((k for k in weights if weights[k] > 0), key=lambda k: (-weights[k] / (2 * won[k] + 1), k))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_apportion_equals_seat_by_seat(spark, seed):
    rnd = random.Random(seed)
    rows, expected = [], {}
    for g in range(12):
        n, seats = rnd.randint(1, 15), rnd.choice([0, 1, 2, 7, 40, 333])
        weights = {k: rnd.choice([0.0, 1.0, 1.0, 2.5, rnd.uniform(0, 100), 1000.0]) for k in range(n)}
        expected |= {(g, k): v for k, v in brute_seats(weights, seats).items()}
        rows += [(g, k, w, seats) for k, w in weights.items()]
    df = spark.createDataFrame(rows, "g int, k int, weight double, seats long")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(df, ["g"], "weight", "seats", ["k"]).collect()}
    assert got == expected


def brute_targets(sizes):
    """Hand the excess on by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    rest, free, goal = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            goal |= {s: level * weight[s] for s in free}
            break
        goal |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2 * sizes[s] for s in over)
        free -= over
    return goal


def corpus(rnd, n=600):
    sources = ["a", "b", "é", "Z", "", None, "src10", "src2", "tiny"]
    rows = []
    for k in range(n):
        source = "a" if k % 3 == 0 else rnd.choice(sources[:-1])
        rows.append((k, " \t".join(["w\xa0x"] * rnd.choice([0, 1, 30, 200])), source, "x"))
    rows += [(n, None, "tiny", "x"), (n + 1, "", "tiny", "x"), (n + 2, "one\ntwo", "tiny", "x"), (n + 3, "word " * 20_000, "b", "x"), (5, rows[5][1], rows[5][2], "x"), (None, "no id", "b", "x")]
    return rows


def test_plan(spark):
    rows = corpus(random.Random(3))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.plan(df, shard=5000).cache()
    out = got.collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for _, text, source, _ in rows:
        sizes[source] += size(text)
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    goals = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(goals[s], abs=1e-6)
        shards = sizes[s] // 5000 + 1
        assert abs(taken[s] - target[s]) <= mixing.BLOCK * (1 + shards)
    again = mixing.plan(df.repartition(7), shard=5000)
    cols = ["doc_id", "source", "size", "taken"]
    assert got.select(cols).exceptAll(again.select(cols)).isEmpty()


def test_empty_and_all_blank(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan(df).count() == 0
    blank = df.sparkSession.createDataFrame([(1, None, None), (2, " ", "a")], df.schema)
    assert [(r.taken, r.target) for r in mixing.plan(blank).collect()] == [(0, 0.0)] * 2


def test_block_choice_is_exact(spark):
    for n, q in [(10, 3), (7, 7), (13, 20), (100, 199)]:
        one = spark.range(n).select(F.col("id").alias("b"), F.lit(n).cast("long").alias("shard_blocks"), F.lit(q).cast("long").alias("shard_quota"), F.lit(n // 2).cast("long").alias("shift"))
        assert one.select(F.sum(mixing.passes(F.col("b")))).first()[0] == q


def test_hot_keys_are_spread(spark):
    """Null ids, empty texts and repeated rows, each a third of a source."""
    rows = [(None, f"null id {k} " + "w " * 40, "a") for k in range(400)] + [(k, "", "a") for k in range(400)] + [(7777, "same row " + "w " * 40, "a")] * 400
    rows += [(10_000 + k, "other " * 42, "b") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    some = mixing.laid(df, shard=500).filter("source = 'a' AND size > 0")
    blocks = some.groupBy("shift", "shard_blocks").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    assert len(blocks) > 20
    assert max(r.n for r in blocks) < 8 * 500
    assert some.agg(F.max("copies")).first()[0] <= 500 // 42
    out = mixing.plan(df, shard=500).collect()
    assert len(out) == len(rows)
    assert all(r.taken == 0 and r.shard_blocks == 0 for r in out if not r.size)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    of = defaultdict(int)
    for r in out:
        of[r.source] += r.taken
    for source, target in {(r.source, r.target) for r in out}:
        assert abs(of[source] - target) <= mixing.BLOCK * (2 + len(blocks))
    again = mixing.plan(df.repartition(5), shard=500).groupBy("doc_id", "size", "taken").count()
    assert sorted(map(repr, again.collect())) == sorted(map(repr, mixing.plan(df, shard=500).groupBy("doc_id", "size", "taken").count().collect()))


def test_mixed_has_the_planned_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    monkeypatch.setattr(mixing, "HANDED", 300)
    rows = [(1, "same text " * 9, "a", 3)] * 40 + [(k, f"text {k} " * 11, "ab"[k % 2], 3) for k in range(2, 60)] + [(None, "no id " * 5, "b", 3), (90, None, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    planned, got = defaultdict(int), defaultdict(int)
    for r in mixing.plan(df, shard=400).collect():
        planned[r.doc_id] += r.taken
    for r in mixing.mixed(df, shard=400).collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == {k: n for k, n in planned.items() if n}
