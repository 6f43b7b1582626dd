import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ordermart.llm import packing
from ordermart.llm.bpe import default_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def cheapest(places, prices, window, short):
    """Least cost over all choices of cuts, by enumeration."""
    n = len(places) - 1
    best = None
    for bits in range(1 << (n - 1)):
        cuts = [0, *[k for k in range(1, n) if bits >> (k - 1) & 1], n]
        sizes = [places[b] - places[a] for a, b in zip(cuts, cuts[1:], strict=False)]
        if max(sizes) > window:
            continue
        cost = sum(prices[k] for k in cuts[1:-1])
        for s in sizes:
            power = s < window and s & (s - 1) == 0
            cost += min(window - s, short) if power else window - s
        best = cost if best is None else min(best, cost)
    return best


def test_cuts_are_the_cheapest():
    rnd = random.Random(1)
    for _ in range(400):
        window = rnd.choice([8, 11, 16])
        steps = [rnd.randint(1, window) for _ in range(rnd.randint(1, 10))]
        places = np.cumsum([0, *steps])
        prices = np.array([rnd.choice([0, 1, 3, 9]) for _ in places])
        cuts, cost = packing.best_cuts(places, prices, window, 2)
        assert cost == cheapest(places.tolist(), prices.tolist(), window, 2)
        assert cuts[-1] == len(places) - 1
        assert (np.diff(places[[0, *cuts]]) <= window).all()


def test_encoder_equals_the_library(library):
    rnd = random.Random(7)
    e = packing.Encoder(default_path())
    bits = [*BITS, "ABC", "abc", "'s", "'LL", "É", "é", "Σ", "İ", "жук", "Ᲊ", "ก", "א", "ẞ", "<|endoftext|>", "<|ENDOFTEXT|>", "...", ",", ";", ";", " ", " ", "", " "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        for text, (ids, ends) in zip(some, e.encode(some, 2), strict=True):
            assert ids.tolist() == ids_of(library, text).tolist(), repr(text)
            assert all(0 < x < len(ids) - 1 for x in ends)


def check(rows, docs, library, window):
    """Every id in one piece, pieces gapless, at most ``window`` a sequence."""
    wanted = Counter()
    for doc, text in docs:
        ids = ids_of(library, text)
        wanted[doc, len(ids)] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    texts = defaultdict(list)
    for doc, text in docs:
        texts[doc].append(ids_of(library, text))
    for doc, some in texts.items():
        left = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc])
        for ids in some:  # take each row's pieces out, from its start on
            at = 0
            while at < len(ids):
                fits = [k for k in left if left[k] and k[0] == at and k[3] == len(ids) and zlib.crc32(ids[at : at + k[1]].tobytes()) == k[2]]
                assert fits, (doc, at)
                left[fits[0]] -= 1
                at += fits[0][1]
            assert at == len(ids)
        assert not +left
    assert set(by_doc) == set(texts)
    used = [sum(r.length for r in p) for p in by_sequence.values()]
    return sum(0 if u & (u - 1) == 0 else window - u for u in used), len(used)


BITS = ["Word ", "and more ", "end. ", "Why? ", "x" * 50 + " ", "<|endoftext|> ", "é", "\n", "3.14 ", "\x1c", "中文。", "stop.) ", "\U0001f600 "]


@pytest.mark.parametrize(("window", "share"), [(16, 1 << 24), (64, 500), (4096, 1 << 24)])
def test_pieces_hold_all_ids(spark, library, window, share):
    rnd = random.Random(2)
    docs = [(i, "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "same. "), (202, "same. "), (202, "other."), (None, "no id."), (None, "no id."), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, start int, sequence_id string")
    rows = packing.pack(df, window=window, share=share).collect()
    padding, sequences = check(rows, docs, library, window)
    assert padding <= sequences * window * (0.2 if window < 4096 else 0.01)


def test_long_documents_stream_through_blocks(spark, library):
    docs = [(1, "A sentence of some words. " * 4000), (2, "y" * 60_000), (3, "word " * 30_000), (4, "tail.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.pack(df, window=256, block=1024).collect()
    padding, sequences = check(rows, docs, library, 256)
    assert padding <= 0.01 * sequences * 256
    assert {(r.doc_id, r.start) for r in rows} >= {(1, 0), (2, 0), (3, 0), (4, 0)}


def test_cuts_prefer_sentence_and_document_ends(spark, library):
    docs = [(i, "One two three four five six. " * 10) for i in range(60)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), window=128).collect()
    check(rows, docs, library, 128)
    ends = {1, *np.flatnonzero(ids_of(library, docs[0][1]) == library.token_to_id(".</w>")).tolist()}
    last = max(r.sequence_id for r in rows) - 4  # the very end may be cut anywhere
    inner = [r.start - 1 for r in rows if r.start and r.sequence_id < last]
    assert inner and set(inner) <= ends


def test_order_is_kept_and_reruns_agree(spark):
    docs = [(i * 7 % 100, f"Text {i}. " * (i % 9)) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.pack(df, window=32).collect()
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)
    again = packing.pack(df.repartition(3), window=32).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df).count() == 0


def test_stretches_are_looked_up_once_for_all_texts():
    import pyarrow as pa

    from ordermart.llm import packing
    from ordermart.llm.bpe import blank_split, default_path

    texts = ["one two one.", "", " \x0b two\tone. ", "a b c", "x\x1cy one", "Straße &&& one###"] * 50
    for some in (texts, [t for t in texts if " " not in t and "\x1c" not in t]):
        found = packing._stretches(pa.array(some, pa.string())).to_pylist()
        assert [[x for x in words if x] for words in found] == [blank_split(t) for t in some]
        encoder, seen = packing.Encoder(default_path()), []

        class Counted(packing.Numbers):
            def __getitem__(self, text):
                seen.append(text)
                return super().__getitem__(text)

        encoder.numbers = Counted()
        got = [ids.tolist() for ids, _ in encoder.encode(pa.array(some, pa.string()), 2)]
        assert got == [[*encoder.library.encode(t, add_special_tokens=False).ids, 2] for t in some]
        assert len(seen) == len(set(seen))


def test_stems_outlive_forgotten_stretches(monkeypatch):
    from ordermart.llm import packing
    from ordermart.llm.bpe import default_path

    monkeypatch.setattr(packing, "REMEMBERED", 10)
    encoder, sent = packing.Encoder(default_path()), []
    codes = encoder.codes
    monkeypatch.setattr(encoder, "codes", lambda words: sent.extend(words) or codes(words))
    text = " ".join(w + m for w in ("one", "Two", "three") for m in (".", ",", "!", "?", ";"))  # 15 stretches, 8 stems
    for _ in range(3):
        ids, ends = next(encoder.encode([text], 2))
        assert ids.tolist() == [*encoder.library.encode(text, add_special_tokens=False).ids, 2]
        assert len(ends) == 9  # behind each . ! and ?
    assert len(sent) == len(set(sent)) == 8
    assert list(encoder.encode([], 2)) == []
