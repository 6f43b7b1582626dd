import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ordermart.llm import alignment

BITS = ["a", "the ", " of", "ing", " ", "  ", "\n", "\t", "é", "é", " ", "　", "▁", "中文", "\U0001f600", "<s>", "</s>", "<0x41>", "<|endoftext|>", "<unk>", "1", "2024", "'s", "...", " .", "\x00", "\x1c", " ", "ﬁ", "word", " word"]


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(*alignment.default_paths())


def plain(v, text):
    """Ids of both sides by the libraries over the whole text."""
    if not text:
        return [], []
    a, b = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
    whole = (" " + text).encode()
    spelled = all(b"".join(names[i] for i in ids) == whole for names, ids in ((v.a_bytes, a), (v.b_bytes, b)))
    return (a, b) if spelled else ([], [])


def plain_groups(v, a, b):
    ends_a, ends_b = np.cumsum(v.a_sizes[a]).tolist() if a else [], np.cumsum(v.b_sizes[b]).tolist() if b else []
    at_a, at_b = ({end: k + 1 for k, end in enumerate(ends)} for ends in (ends_a, ends_b))
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = at_a[cut], at_b[cut]
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return groups


def brute(v, rows):
    found = []
    counts = Counter()
    for doc, text in rows:
        a, b = plain(v, text)
        groups = plain_groups(v, a, b)
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        found.append((doc, len(a), len(b), groups, links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for doc, n_a, n_b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), digest))
    return sorted(out, key=str)


def columns(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_stretches_have_the_tokens_of_their_text(both):
    rnd = random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 12)))
        got = both.encode([text])[0]
        ids = tuple(np.frombuffer(x, np.uint32).tolist() for x in got) if got else ([], [])
        assert ids == plain(both, text), repr(text)


def test_divide_finds_all_shared_cuts():
    rnd = random.Random(4)
    for _ in range(500):
        a, b, a_cuts, b_cuts, base = [], [], [], [], 0
        for _ in range(rnd.randint(1, 4)):
            size = rnd.randint(1, 40)
            for side, cuts in ((a, a_cuts), (b, b_cuts)):
                side += [base + x for x in sorted(rnd.sample(range(1, size), rnd.randint(0, size - 1)))] + [base + size]
                cuts.append(len(side) - 1)
            base += size
        x, y = alignment.divide(np.array(a), np.array(b), np.array(a_cuts), np.array(b_cuts))
        shared = sorted(set(a) & set(b))
        assert [a[i] for i in x] == shared == [b[j] for j in y]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 20, 0])
def test_whole_result_equals_brute_force(spark, both, frequent):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 30)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "same text twice"), (502, "same text twice"), (None, "no id here"), (503, " "), (504, "long " * 30_000 + "x" * 5000)]
    df = spark.createDataFrame([(i, t, 0, "x", 7) for i, t in rows], "doc_id long, text string, pair int, links string, n int")
    got = alignment.scored(df, frequent=frequent)
    assert columns(got) == brute(both, rows)


def test_empty_table_and_texts_without_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert columns(alignment.scored(df)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert alignment.scored(df.limit(0)).count() == 0


def test_groups_are_written_out(spark, both):
    df = spark.createDataFrame([(1, "Tokenizers disagree, frequently.")], "doc_id long, text string")
    row = alignment.align(df).collect()[0]
    groups = plain_groups(both, *plain(both, "Tokenizers disagree, frequently."))
    assert row.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    assert sum(x.times for x in row.links) == row.n_groups


def test_alignment_remembers_a_bounded_number_and_the_frequent(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    monkeypatch.setattr(alignment, "BATCH", 16)
    v, rnd, sent = alignment.Tokenizers(*alignment.default_paths()), random.Random(1), []

    class Library:
        def encode(self, some, **more):
            assert len(some) <= 16
            sent.extend(some)
            return library.encode(some, **more)

    library, v.b = v.b, Library()
    for _ in range(30):
        text = " ".join(["often seen", *("".join(rnd.choice("abcdefgh") for _ in range(6)) + rnd.choice(["", ".", "é"]) for _ in range(50)), "often"])
        (a, b), nothing, seen = v.encode([text, "", "seen often"])
        assert (a.tolist(), b.tolist()) == (v.a.encode(" " + text, add_special_tokens=False).ids, library.encode(text))
        assert nothing is None
        assert seen[1].tolist() == library.encode("seen often")
        assert len(v.numbers) <= 40 + 52
        assert len(v.fits) == len(v.numbers) == len(v.by_a.size) == len(v.by_b.size)
    assert sent.count("often") == sent.count("seen") == 1
