import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ordermart.llm import simhash
from ordermart.llm.components import connected_components, local_labels


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", " \t\n", "one", "One TWO", "a b c", "a b c d", "É é\xa0x Ünd b c d e", "x " * 40_000, "a b c d e f g h " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    pairs = [(k, k + 1) for k in range(60)] + [(1000, 1001 + k) for k in range(200)] + [(rnd.randint(2000, 2300), rnd.randint(2000, 2300)) for _ in range(180)] + [(5, 5), (-3, 70), (70, -9)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == groups(nodes, [p for p in pairs if p[0] != p[1]])
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    u, v = np.array([3, 1, 5]), np.array([1, 0, 4])
    assert local_labels(u, v, 7).tolist() == [0, 0, 2, 0, 4, 4, 6]


def test_links_equal_all_pairs(spark):
    rnd = random.Random(4)
    bits = {0, (1 << 64) - 1, 1, 3}
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            bits.add(x)
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << b
    bits = sorted(bits)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in bits]
    df = spark.createDataFrame(signed, "bits long")
    linked = [(a, b) for a in bits for b in bits if a < b and (a ^ b).bit_count() <= 4]
    expected = sorted(Counter(groups(bits, linked).values()).values())
    for tile in (8, 1 << 16):
        got = connected_components(simhash.links(df, 4, tile))
        sizes = sorted(r["count"] for r in got.groupBy("component").count().collect())
        assert sizes == [n for n in expected if n > 1]


def test_near_duplicates(spark):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(150)) for _ in range(6)]
    rows = [(k, t, "x") for k, t in enumerate(base)]
    rows += [(10 + k, base[k % 6].upper() + rnd.choice(["", " tail", " other end"]), "x") for k in range(40)]
    rows += [(100, None, "x"), (101, "", "x"), (102, " \n", "x"), (103, "hi", "x"), (104, "hi", "x"), (104, "hi", "x"), (None, "HI", "x"), (105, "long word " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(df).collect()
    prints = {(i, t): plain_fingerprint(t) for i, t, _ in rows}
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1 if i is not None else -1, f"{prints[i, t]:016x}") if i != 0 else (-1, f"{prints[i, t]:016x}") for i, t, _ in rows)
    values = sorted(set(prints.values()))
    label = groups(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])
    first = {}
    for (i, _), f in prints.items():
        if i is not None:
            first[label[f]] = min(first.get(label[f], i), i)
    for r in got:
        assert r.component_id == first[label[int(r.fingerprint, 16)]]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_bounded_links_in_a_task(monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 3)
    a = np.array([1 << k for k in range(60)], np.int64)
    u, v = simhash._stars(a, a, 4)
    assert len(set(v.tolist())) <= 2 and len(u) >= 59
    assert F is not None


def test_representatives(spark):
    """Unlike texts under one id, rows without id, repeated rows: by brute force."""
    rnd = random.Random(8)
    prose = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rnd.randint(0, 99)) for _ in range(n))
    base = [prose(60) for _ in range(12)]
    rows = [(k, t, "x") for k, t in enumerate(base)]
    rows += [(3, base[7], "y"), (3, prose(50), "x"), (3, prose(50), "x"), (None, base[2], "x"), (None, prose(40), "x"), (None, prose(40), None), (None, None, "x"), (None, "", "x"), (40, base[4] + " tail", "x")]
    rows += [(5, base[5], "x")] * 30 + [(None, "the same words here and there", "x")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, _x string").withColumnRenamed("_x", "row")
    got = sorted(map(tuple, simhash.representatives(df).collect()), key=repr)
    again = sorted(map(tuple, simhash.representatives(df.repartition(7)).collect()), key=repr)
    assert got == again
    prints = {r: plain_fingerprint(r[1]) for r in set(rows)}
    values = sorted(set(prints.values()))
    label = groups(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])
    assert sorted(label[prints[r]] for r in got) == sorted(set(label.values()))
    for r in got:
        ids = [x[0] for x in prints if label[prints[x]] == label[prints[r]]]
        assert r[0] == min((k for k in ids if k is not None), default=None)
    assert len(got) == len(set(got))
    assert simhash.representatives(df.limit(0)).count() == 0
