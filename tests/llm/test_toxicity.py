import itertools
import math
import random
import zlib

import numpy as np
import pytest

from ordermart.llm import toxicity as T


def brute_marginals(chain, potentials):
    """Sum over all labellings of a chain of words."""
    a, b, c = chain.steps
    step = {(0, 0): 0.0, (0, 1): a, (1, 0): b, (1, 1): c}
    total, toxic = 0.0, [0.0] * len(potentials)
    for states in itertools.product((0, 1), repeat=len(potentials)):
        w = math.exp(sum(p for s, p in zip(states, potentials) if s) + sum(step[x] for x in itertools.pairwise(states)))
        total += w
        for k, s in enumerate(states):
            toxic[k] += w * s
    return [t / total for t in toxic]


def test_marginals_with_unmarked_stretches():
    chain = T.Chain({"=bad": 5.0}, -2.0, (-0.7, 0.4, 1.1))
    full = [-2.0, 3.0, -2.0, -2.0, -2.0, 3.0, -2.0, -2.0, 1.0]
    expected = brute_marginals(chain, full)
    got = chain.marginals([full[k] for k in (0, 1, 5, 8)], [0, 3, 2])
    assert got == pytest.approx([expected[k] for k in (0, 1, 5, 8)])
    assert chain.marginals(full, [0] * 8) == pytest.approx(expected)


def test_tag_equals_whole_chain():
    chain = T.Chain({"=bad": 6.0, "awfu-": 4.0}, -3.0, (-0.5, 0.2, 0.9))
    text = "fine words, here BAD! bad, fine words again and awfully nice \xa0 x"
    words = text.split(" ")
    words = [w for w in words if w]
    potentials = [chain.marked([w]).get(w, chain.bias) for w in words]
    expected = brute_marginals(chain, potentials)
    score, spans = chain.tag(text)
    assert score == pytest.approx(max(expected))
    assert [text[a:b] for a, b, _ in spans] == ["BAD! bad,"] or max(expected[-4:]) >= 0.5
    assert chain.tag("") == (0.0, []) and chain.tag(" \n") == (0.0, [])
    assert chain.tag("x " * 100_000 + "bad")[1][0][:2] == (200_000, 200_003)


@pytest.mark.parametrize("blank", ["\u00a0", "\u3000", "\u2009", "\x1c", "\x85"])
def test_blanks_within_words(blank):
    chain = T.Chain({"=bad": 9.0}, -3.0, (-0.5, 0.2, 0.9))
    plain = chain.tag("some words bad thing here")
    text = f"some words{blank}x bad{blank}thing here"
    score, spans = chain.tag(text)
    assert score >= 0.9 and plain[0] >= 0.9
    assert [text[a:b] for a, b, _ in spans] == [f"bad{blank}thing"]
    assert chain.tag(f"thing{blank}BAD!")[0] == chain.tag("bad")[0]


def test_gradient_fit_separates():
    rnd = np.random.default_rng(1)
    y = (rnd.random((400, 9)) < 0.2).astype(int)
    x = np.where(y[..., None] == 1, rnd.integers(0, 3, (400, 9, 1)), -1)
    chain = T.fit(x, y, ["=a", "=b", "=c"])
    assert min(chain.weights.values()) > 3 and chain.bias < -2


def corpus():
    rnd = random.Random(8)
    clean = ["".join(rnd.choice("aeioutnrs") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for k in range(900):
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 120))]
        toxic = k % 5 == 0
        for _ in range(rnd.randint(1, 3) if toxic else 0):
            words[rnd.randrange(len(words))] = rnd.choice(["Zbad!", "zawful", "zvile" + rnd.choice(clean)])
        docs.append((k, " ".join(words), "en"))
        labels.append((k, int(toxic), "x"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    docs += [(5000, None, None), (5001, "", "en"), (5001, "", "en"), (None, "zbad zawful", "en"), (5002, "so " * 50_000 + "zbad", "en")]
    labels += [(7, None, "x"), (None, 1, "x"), (99999, 1, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = T.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int, text string")).collect()
    assert len(got) == len(docs)
    truth = {k: t for k, t, _ in labels[:900]}
    by = {r.doc_id: r for r in got}
    wrong = [k for k, t in truth.items() if by[k].held_out and by[k].predicted != t]
    assert len(wrong) <= 3
    assert all(by[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in truth)
    assert by[5000].score == by[5001].score == 0.0 and by[5002].predicted == 1 and by[None].predicted == 1 and not by[None].held_out
    # A held-out label changes nothing.
    flipped = [(k, 1 - t if k is not None and t is not None and zlib.crc32(str(k).encode()) % 3 == 1 else t, x) for k, t, x in labels]
    again = T.toxicity(d, spark.createDataFrame(flipped, "doc_id long, toxic int, text string")).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in got}


def test_all_marked_words_have_windows():
    marked = [0, 3, 8, 9, 30, 44, 49]
    found = T.places(marked, 12)
    assert 12 in found
    for k in marked:
        assert any(a <= max(0, k - T.BESIDE) and k + T.BESIDE < a + T.WIDTH for a in found)


def test_padding_has_no_part_in_the_fit():
    rnd = np.random.default_rng(3)
    y = (rnd.random((300, 6)) < 0.3).astype(int)
    x = np.where(y[..., None] == 1, rnd.integers(0, 2, (300, 6, 1)), -1)
    wide = [np.concatenate([a, np.full((300, 9, *a.shape[2:]), -1)], axis=1) for a in (x, y)]
    short, padded = T.fit(x, y, ["=a", "=b"]), T.fit(*wide, ["=a", "=b"])
    assert padded.weights == pytest.approx(short.weights)
    assert (padded.bias, *padded.steps) == pytest.approx((short.bias, *short.steps))
    twice = T.fit(np.concatenate([x, x]), np.concatenate([y, y]), ["=a", "=b"])
    assert T.fit(x, y, ["=a", "=b"], times=np.full(300, 2)).weights == pytest.approx(twice.weights)


def test_short_texts(spark):
    rnd = random.Random(4)
    clean = ["".join(rnd.choice("aeioutnrs") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for k in range(600):
        words = [rnd.choice(clean) for _ in range(rnd.randint(3, 10) if k % 4 == 0 else rnd.randint(3, 60))]
        if k % 4 == 0:
            words[-1 if k % 8 else rnd.randrange(len(words))] = rnd.choice(["zbad", "zawful!"])
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    got = T.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert [r.doc_id for r in got if r.predicted != (r.doc_id % 4 == 0)] == []


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in T.toxicity(d, none).collect()] == [0, 0]
    assert T.toxicity(d.limit(0), none).count() == 0


def test_repeated_ids_are_one_row_of_the_sample(spark):
    rows = [(2, "a b", 1)] * 500 + [(2, f"other {k}", 1) for k in range(20)] + [(4, "c", 1)] * 3 + [(k, f"clean {k}", 1) for k in range(5, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    labels = spark.createDataFrame([(k, int(k < 5)) for k in range(60)] * 2, "doc_id long, toxic int")
    got = T.labelled_sample(T.documents(docs), labels, (5, 8))
    out = got.collect()
    assert len({r.doc_id for r in out}) == len(out) <= 13
    again = T.labelled_sample(T.documents(docs.repartition(9)), labels, (5, 8)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
