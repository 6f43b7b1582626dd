import random
import re
from collections import Counter

import numpy as np
import pytest

from ordermart.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    times = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def corpus():
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    rows = []
    for k in range(400):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(60, 300))]
        if k % 20 == 7:
            words = [w + rnd.choice("#$%") for w in words]
        text = "".join(w + rnd.choice([" ", " ", " ", "\n", "\t"]) for w in words)
        rows.append((k, text, "en" if k % 3 else None, "s", "x"))
    few = " ".join(rnd.choice(vocabulary[:4]) for _ in range(90))
    return rows + [
        (900, None, "en", "s", "x"), (901, "", "en", None, "x"), (902, " \n\x0b", None, None, "x"), (903, "a b", "en", "s", "x"),
        (904, "a b c a b c a b", "de", "s", "x"), (905, few, "de", "s", "x"), (906, "one two three " * 40_000, "en", "s", "x"),
        (907, "line\nline\n\nline \nline", "en", "s", "x"), (908, "a a a a a " + few, "en", "t", "x"), (0, rows[0][1], None, "s", "x"), (None, few, "en", "s", "x"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, x0 string")


@pytest.fixture(scope="module")
def judged(docs):
    return Q.judge(docs).collect()


def test_counts_equal_brute_force(judged):
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged)
    assert got == sorted((d if d is not None else -1, *brute(t)) for d, t, *_ in corpus())


def test_outliers_go_and_the_rest_stay(judged):
    by = {r.doc_id: r for r in judged}
    odd = [k for k in range(400) if k % 20 == 7]
    assert not any(by[k].kept for k in odd)
    assert all(by[k].kept for k in range(400) if k % 20 != 7)
    assert not any(r.kept for r in judged if r.base_failed)
    assert by[905].distance is None and by[905].kept == (not by[905].base_failed)  # a small group


def test_salted_form_is_the_same(docs, judged, monkeypatch):
    monkeypatch.setattr(Q, "BROADCAST", 0)
    again = Q.judge(docs.repartition(7)).collect()
    key = lambda rows: sorted((str(r.doc_id), r.n_words, r.kept, round(r.distance or -1, 6)) for r in rows)
    assert key(again) == key(judged)


def test_concentration_lowers_the_determinant(spark):
    rng = np.random.default_rng(2)
    good, bad = rng.normal(size=(300, 4)), rng.normal(8, 0.1, size=(60, 4))
    rows = [("g", *map(float, v)) for v in np.vstack([good, bad])]
    est = Q.robust_scatter(spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double"), "g", Q.STATS, (0.01,) * 4).first()
    assert abs(est.m0) < 0.4 and est.log_det < np.linalg.slogdet(np.cov(np.vstack([good, bad]).T))[1]


def small_groups(rnd, vocabularies):
    """200 sources of five rows, one in ten of all rows junk; and rare languages."""
    def text(words, junk):
        some = [rnd.choice(words) for _ in range(rnd.randint(80, 200))]
        return " ".join(w + rnd.choice("#$%") if junk else w for w in some)

    rows = [(k, text(vocabularies[0], k % 10 == 3), "en" if k % 2 else None, f"s{k // 5}", k % 10 == 3) for k in range(1000)]
    # Languages of six texts with words of their own length, one of them junk.
    rows += [(2000 + 10 * v + k, text(words, k == 5), f"rare{v}", "s", k == 5) for v, words in enumerate(vocabularies[1:]) for k in range(6)]
    return rows


@pytest.mark.parametrize("most", [Q.BROADCAST, 0])
def test_small_groups_are_judged(spark, monkeypatch, most):
    monkeypatch.setattr(Q, "BROADCAST", most)
    rnd = random.Random(5)
    words = lambda low, high: ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(low, high))) for _ in range(300)]
    rows = small_groups(rnd, [words(1, 8), words(1, 5), words(12, 30)])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    by = {r.doc_id: r for r in Q.judge(df).collect()}
    assert not any(r.base_failed for r in by.values())
    assert all(r.distance is not None for r in by.values())
    assert [k for k, *_, junk in rows if by[k].kept == junk] == []
    few = {r.doc_id: r for r in Q.judge(df.filter("doc_id >= 2000")).collect()}  # twelve rows in all
    assert len(few) == 12 and all(r.distance is not None for r in few.values())


def test_empty(spark, docs):
    assert Q.judge(docs.limit(0)).count() == 0
