import hashlib
import random

import numpy as np
import pytest
import xxhash

from ordermart.llm import suffix_dedup as S


def brute(rows, size):
    """Every window in corpus order against all that were seen before it."""
    out, seen = {}, {}
    for doc, text in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - size + 1):
            w = data[s : s + size]
            if w in seen:
                gone[s : s + size] = True
            else:
                seen[w] = True
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc, text] = (len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(30) for _ in range(5)]
    rows = []
    for k in range(n):
        parts = [prose(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            parts.append(rnd.choice(shared)[rnd.randint(0, 20) : rnd.randint(60, 400)])
            parts.append(prose(rnd.randint(0, 20)))
        rows.append((k * 7 % n, " ".join(parts)))
    text = rows[3][1]
    rows += [(n + 1, text), (n + 2, text + "!"), (n + 3, "a" * 3000), (n + 4, "ab" * 700 + "c"), (n + 5, None), (n + 6, ""), (n + 7, text[:99]), (n + 8, text * 2), (None, text), (n + 2, text + "!")]
    rows += [(n + 10 + k, text[: 200 + k] + str(k) * 5 + text[220 + k :]) for k in range(25)]
    return rows


def hashed(text):
    """Spark's hash of a text, signed."""
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)


def test_rows_without_an_id_of_their_own(spark):
    rnd = random.Random(9)
    shared = ["".join(rnd.choice("abcdef ") for _ in range(40)) for _ in range(6)]
    texts = list({"".join(rnd.choice("ghijk ") for _ in range(rnd.randint(0, 30))) + rnd.choice(shared) + str(k) for k in range(6000)})
    rows = [((None, 5, k)[k % 3 if k % 100 else 2], t) for k, t in enumerate(texts)]
    rows += rows[:50] + [(None, None), (None, ""), (7, None)]
    got = S.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=30).collect()
    order = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, hashed(r[1])))
    seen, expected = set(), {}
    for doc, text in order:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 29):
            if data[s : s + 30] in seen:
                gone[s : s + 30] = True
            seen.add(data[s : s + 30])
        expected[doc, text] = (len(data), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    want = sorted((str(d), *expected[d, t or ""]) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == want


def test_equal_keys_of_24_bits_no_longer_merge(spark):
    # Two texts whose hashes agree in their last 24 bits, each with 280 bytes of the other's.
    common, seen = "common words of both texts " * 12, {}
    for k in range(40_000):
        text = f"{k} {common}{k}"
        low = int(hashed(text)) & 0xFFFFFF
        if low in seen:
            break
        seen[low] = text
    pair = [seen[low], text]
    removed = []
    for ids in ([1, 2], [None, None], [3, 3]):
        got = S.digests(spark.createDataFrame(list(zip(ids, pair, strict=True)), "doc_id long, text string")).collect()
        removed.append(sum(r.n_removed for r in got))
    assert removed[0] > 280 and abs(removed[1] - removed[0]) <= 8 and abs(removed[2] - removed[0]) <= 8


@pytest.mark.parametrize(("seed", "size", "bucket", "crowd"), [(1, 100, 1 << 21, 10_000), (2, 100, 4000, 10_000), (3, 100, 4000, 3), (4, 40, 3000, 10_000)])
def test_equals_brute_force(spark, seed, size, bucket, crowd):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, place int").repartition(5)
    expected = brute(rows, size)
    got = S.digests(df, size=size, bucket=bucket, crowd=crowd).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((d or -1, *expected[d, t or ""]) for d, t in rows)
    whole = S.substring_dedup(df, size=size, bucket=bucket, crowd=crowd).collect()
    assert sorted(hashlib.sha256(r.kept).hexdigest() for r in whole) == sorted(r.kept_sha256 for r in got)


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(6000))
    rows = [(1, text), (2, text[1000:4000] + "z" + text[2000:5000])]
    got = {r.doc_id: r for r in S.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (d, _), e in brute(rows, 100).items():
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == e


def test_interval_classes():
    rnd = np.random.default_rng(3)
    for size in (3, 5, 9):
        parts = [rnd.integers(97, 99, rnd.integers(size, 60), dtype=np.uint8).tobytes() for _ in range(12)]
        codes = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int64), 256 + k) for k, p in enumerate(parts)])
        classes = S.interval_classes(codes, size)
        strings = [tuple(codes[k : k + size].tolist()) for k in range(len(codes) - size)]
        assert len(set(strings)) == len(set(zip(strings, classes.tolist(), strict=False))) == len(set(classes[: len(strings)].tolist()))


def test_anchors_depend_on_the_window_alone():
    rnd = np.random.default_rng(4)
    text = rnd.integers(97, 101, 2000, dtype=np.uint8)
    for data in (text, np.concatenate([text[500:], text])):
        start, n, (anchor, at) = S.segments(data, np.array([len(data)]), 100)
        assert n.sum() == len(data) - 99 and (np.diff(start) == n[:-1]).all()
        h = S.gram_hashes(data)
        for s, k, a, p in zip(start, n, anchor, at, strict=True):
            for w in (s, s + k - 1):
                assert h[w : w + 101 - S.GRAM].argmin() + w == p and h[p].view(np.int64) == a


def test_empty(spark):
    assert S.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
