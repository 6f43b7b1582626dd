import hashlib
import random

import pytest

from ordermart.llm import bpe

BITS = ["a", "b", "th", "ing", " ", "'s", "'LL", "é", "é", "Σ", "σ", "İ", "ẞ", " ", "\x1c", "\x85", "1", "½", "ก", "中", "\U0001f600", "‍", "!", "..", "<|endoftext|>", "<|startoftext|>", "<|", "\n", "\x00", "ͅ", "﻿", "가", "x" * 30, "K", "aaa", "==", "____", "word,", "end."]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(bpe.default_path())


def library(v, text):
    ids = v.library.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), v.library.decode(ids, skip_special_tokens=False)


def test_random_texts_equal_the_library(vocabulary):
    rnd = random.Random(5)
    for _ in range(5000):
        text = "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 14)))
        assert vocabulary.encode(text) == library(vocabulary, text), repr(text)


def test_merge_order_inside_long_words(vocabulary):
    rnd = random.Random(6)
    for _ in range(3000):
        word = "".join(rnd.choice("aabcehinorst") for _ in range(rnd.randint(1, 40)))
        assert vocabulary.encode(word) == library(vocabulary, word), word


def test_forgetting_changes_nothing(monkeypatch):
    v = bpe.Vocabulary(bpe.default_path())
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    for text in ["one two three four", "four three, two. one", "five six <|endoftext|> seven", "one two three four"]:
        assert v.encode(text) == library(v, text)


def test_operator_edges(spark, vocabulary):
    rows = [(1, None, 0), (2, "", 0), (3, "The cat's mat.", 0), (3, "The cat's mat.", 0), (None, "x " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids, r.decoded) for r in bpe.encode(df).collect())
    expected = sorted((i or 0, *library(vocabulary, t or "")) for i, t, _ in rows)
    assert got == expected
    digest = {(r.doc_id or 0, r.ids_sha256) for r in bpe.digests(df).collect()}
    assert digest == {(i, hashlib.sha256(ids.encode()).hexdigest()) for i, _, ids, _ in expected}
    assert bpe.encode(df.limit(0)).count() == 0


def test_remembered_words_take_little_memory():
    import tracemalloc

    from ordermart.llm import bpe

    v = bpe.Vocabulary(bpe.default_path())
    tracemalloc.start()
    try:
        for k in range(0, 650_000, 1000):
            v.known.update({f"word{j}.": (3, f"{j} {j + 1} 269", f"wo rd{j}</w> .</w>") for j in range(k, k + 1000)})
            v.encode("one")
        assert len(v.known) + len(v.older) <= 2 * bpe.REMEMBERED + 2000
        assert tracemalloc.get_traced_memory()[0] < 150e6
    finally:
        tracemalloc.stop()
