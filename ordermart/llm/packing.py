"""Packing documents into sequences of a fixed number of tokens.

Documents keep their order. Cuts between sequences lie at document ends or, at
a price, at sentence ends, or, at a higher price, inside a sentence too long
to go without one. With cuts p_0 < p_1 < ... the least cost up to a cut is

    best(j) = price(j) + min over i of best(i) + padding(p_j - p_i)

where a sequence of the full length or of a power of two needs no padding, and
any other is filled up. For filled-up sequences the padding is W - p_j + p_i,
so the minimum of best(i) + p_i over the window of the last W tokens is wanted:
a monotone queue gives it in constant time on average. Powers of two are
single further choices.

A partition holds a stretch of the documents' order and is packed as it
streams: blocks of tokens are solved one after another, and what lies beyond
the last settled cut goes on to the next block. So a task holds one block and
one document, and only a partition's end can cost padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.llm.bpe import blank_split, default_path
from ordermart.llm.common import documents, slices
from ordermart.llm.remembered import Numbers, Pool, forget

#: Prices in tokens of padding: a cut at a sentence's end, a cut inside a
#: sentence, and a sequence that is short because it is a power of two.
SENTENCE, INSIDE, SHORT = 4, 64, 32
#: Sentences above this many tokens may be cut inside, every STEP tokens.
LONG, STEP = 256, 32
#: Tokens solved at once.
BLOCK = 1 << 20
#: Bytes of text a partition has on average, and partitions at most.
SHARE, PARTITIONS = 16 << 20, 32768
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
#: Stretches whose ids a worker remembers, and stems: when there are more, the
#: half used most often stays. A worker keeps them after its task.
REMEMBERED = 300_000
#: Stems that the library encodes at once.
BATCH = 4096

#: A run of these behind letters is a piece of its own.
MARKS = ".,!?;:#*$%&~^=+-_/@()[]{}"
#: Blanks beyond the six of ASCII, and those of Python's alone.
RARE_BLANK = "[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SENTENCE_END = re.compile(r"[.!?…。！？।]['\"”’»)\]]*$")
CAN_END = frozenset(".!?…。！？।'\"”’»)]")


class Encoder:
    """Ids of whole texts by the tokenizers library, a stretch without blanks
    at a time (no token crosses a blank there). A stretch is a stem and maybe
    marks behind its letters, and only new stems go to the library; the ids of
    all stretches lie in one array, so that those of many texts are one gather."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.numbers, self.by_stretch = Numbers(), Pool()
        self.ends = np.empty(0, bool)  # of stretches that end a sentence
        self.stems, self.by_stem = Numbers(), Pool()

    def forget(self) -> None:
        """Stretches and stems used seldom, of each kind if it has too many."""
        kept = forget(self.numbers, [self.by_stretch], REMEMBERED)
        if kept is not None:
            self.ends = self.ends[kept]
        forget(self.stems, [self.by_stem], REMEMBERED)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words and how many each has. Words of common letters
        are one word each to the library too, so they are encoded as one text
        and told apart by the tokens that end a word."""
        plain = [_letters(w) and max(w) < "\u0530" for w in words]
        joined = [w for w, p in zip(words, plain, strict=True) if p]
        rest = [w for w, p in zip(words, plain, strict=True) if not p]
        ids = np.array(self.library.encode_batch_fast([" ".join(joined)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(joined) or (len(ends) and ends[-1] != len(ids)):
            plain, rest, ids, ends = [False] * len(words), words, ids[:0], ends[:0]
        others = [np.array(c.ids, "<u4") for c in self.library.encode_batch_fast(rest, add_special_tokens=False)]
        plain, sizes = np.array(plain, bool), np.zeros(len(words), np.int64)
        sizes[plain], sizes[~plain] = np.diff(ends, prepend=0), [len(o) for o in others]
        out, mine = np.empty(int(sizes.sum()), "<u4"), np.repeat(plain, sizes)
        out[mine], out[~mine] = ids, np.concatenate([ids[:0], *others])
        return out, sizes

    def learn(self) -> None:
        """Give ids to all new stretches."""
        new, self.numbers.new = self.numbers.new, []
        words, marks = [], []
        for text in new:
            word = text.rstrip(MARKS)
            mark = text[len(word) :]
            if mark and not _letters(word):
                word, mark = text, ""
            if word.isascii() and "<" not in word:
                word = word.lower()
            words.append(word)
            marks.append(mark)
        parts = np.fromiter(map(self.stems.__getitem__, words + marks), np.int64, 2 * len(new)).reshape(2, -1).T
        unseen, self.stems.new = self.stems.new, []
        for at in range(0, len(unseen), BATCH):  # the library's own results are large
            self.by_stem.add(*self.codes(unseen[at : at + BATCH]))
        self.stems.used(parts.ravel())
        self.by_stretch.add(self.by_stem.ids(parts.ravel()), self.by_stem.size[parts].sum(axis=1))
        self.ends = np.concatenate([self.ends, np.fromiter((t[-1:] in CAN_END and SENTENCE_END.search(t) is not None for t in new), bool, len(new))])

    def encode(self, texts: list[str] | pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, the end id included, and the places behind a
        sentence's end. Each stretch is looked up once for all texts given."""
        self.forget()
        lists = _stretches(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if not len(lists):
            return
        found = lists.flatten().dictionary_encode()
        # to_numpy makes the strings several times faster than to_pylist.
        stretches = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.numbers.__getitem__, stretches), np.int64, len(stretches))
        if self.numbers.new:
            self.learn()
        places = found.indices.to_numpy()
        self.numbers.used(numbers, np.bincount(places, minlength=len(numbers)))
        codes = numbers[places]
        ids = self.by_stretch.ids(codes)
        places = np.concatenate([[0], np.cumsum(self.by_stretch.size[codes])])
        edges = lists.offsets.to_numpy()
        edges = places[edges - edges[0]]
        ends = places[1:][self.ends[codes]]
        bounds = np.searchsorted(ends, edges)
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            some = ends[bounds[k] : bounds[k + 1] + 1] - a
            yield np.append(ids[a:b], np.array(end, "<u4")), some[(some > 0) & (some < b - a)]


def _stretches(texts: pa.Array) -> pa.Array:
    """Lists of stretches without blanks; empty ones, which have no ids, may be
    among them."""
    if pc.any(pc.match_substring_regex(texts, RARE_BLANK)).as_py():
        return pa.array([blank_split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.ascii_split_whitespace(texts)


def _letters(text: str) -> bool:
    """Letters alone, in lower case too (that of one has a combining dot)."""
    return text.isalpha() and "İ" not in text


def best_cuts(places: np.ndarray, prices: np.ndarray, window: int, short: int = SHORT) -> tuple[list[int], int]:
    """Indices of the cheapest cuts, the last place included, and their cost.

    ``places`` start at 0, increase, and lie at most ``window`` apart;
    ``prices`` are those of a cut at each place (the last one's is not paid).
    """
    n = len(places) - 1
    size, ends, starts = 1, [], []
    while size < window:  # places that lie a power of two behind a place
        at = np.searchsorted(places, places - size)
        some = np.flatnonzero(places[at] == places - size)
        ends.append(some)
        starts.append(at[some])
        size *= 2
    ends = np.concatenate([*ends, [n + 1]])
    order = np.argsort(ends, kind="stable")
    ends, starts, k = ends[order].tolist(), np.concatenate([*starts, [0]])[order].tolist(), 0
    p, price = places.tolist(), prices.tolist()
    cost, before = [0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[int, int]] = deque()  # (cost + place, index), increasing in both
    for j in range(1, n + 1):
        key = cost[j - 1] + p[j - 1]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j - 1))
        here = p[j]
        while here - p[queue[0][1]] > window:
            queue.popleft()
        low, choice = queue[0]
        low += window - here
        while ends[k] == j:
            if cost[starts[k]] + short < low:
                low, choice = cost[starts[k]] + short, starts[k]
            k += 1
        cost[j] = low + price[j] if j < n else low
        before[j] = choice
    cuts, at = [], n
    while at:
        cuts.append(at)
        at = before[at]
    return cuts[::-1], cost[n]


def _inner(size: int, ends: np.ndarray, long: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places for cuts inside one document, and whether each ends a sentence."""
    edges = np.concatenate([[0], ends, [size]])
    more = [np.arange(a + step, b, step) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > long]
    if not more:
        return ends, np.ones(len(ends), bool)
    more = np.concatenate(more)
    places = np.concatenate([ends, more])
    order = np.argsort(places)
    return places[order], np.concatenate([np.ones(len(ends), bool), np.zeros(len(more), bool)])[order]


class Packer:
    """Takes the documents of one partition in order, yields their pieces."""

    def __init__(self, window: int, sentence: int, inside: int, short: int, long: int, step: int, block: int, first: int):
        self.window, self.sentence, self.inside, self.short = window, sentence, inside, short
        self.long, self.step = min(long, window), max(1, min(step, window))
        self.block, self.sequence = max(block, 4 * window), first
        self.ids, self.docs, self.places, self.prices, self.held = [], [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        places, whole = _inner(len(ids), ends, self.long, self.step)
        places, prices = np.append(places, len(ids)), np.append(np.where(whole, self.sentence, self.inside), 0)
        start = 0
        while start < len(ids):  # a document may be longer than many blocks
            stop = min(len(ids), start + self.block)
            if stop < len(ids):
                stop = int(places[np.searchsorted(places, stop, "right") - 1])
            some = slice(*np.searchsorted(places, [start, stop], "right"))
            self.docs.append((self.held, doc_id, start, len(ids)))
            self.places.append(places[some] - start + self.held)
            self.prices.append(prices[some])
            self.ids.append(ids[start:stop])
            self.held += stop - start
            start = stop
            if self.held >= self.block:
                yield from self.solve(False)

    def solve(self, last: bool) -> Iterator[tuple]:
        """Pieces of all settled sequences; unless ``last``, the end of what
        is held stays, as later documents may change its cuts."""
        if not self.held:
            return
        ids, places, prices = np.concatenate(self.ids), np.concatenate([[0], *self.places]), np.concatenate([[0], *self.prices])
        if last:  # the very end may be cut anywhere, so that it needs no padding
            tail = np.setdiff1d(np.arange(max(1, self.held - 2 * self.window), self.held), places)
            places, prices = np.concatenate([places, tail]), np.concatenate([prices, np.full(len(tail), self.inside)])
            order = np.argsort(places)
            places, prices = places[order], prices[order]
        chosen, _ = best_cuts(places, prices, self.window, self.short)
        cuts = places[chosen]
        if not last:
            cuts = cuts[cuts <= self.held - 2 * self.window]
        done = int(cuts[-1]) if len(cuts) else 0
        # A document's parts that meet inside a sequence are one piece.
        begins = np.array([d[0] for d in self.docs])
        fresh = np.array([d[0] for k, d in enumerate(self.docs) if not k or d[2] == 0])
        edges = np.union1d(np.concatenate([[0], cuts]), fresh[fresh < done])
        for a, b, doc, seq in zip(edges[:-1].tolist(), edges[1:].tolist(), np.searchsorted(begins, edges[:-1], "right") - 1, np.searchsorted(cuts, edges[:-1], "right"), strict=True):
            begin, doc_id, start, size = self.docs[doc]
            offset = a - (int(cuts[seq - 1]) if seq else 0)
            yield doc_id, start + a - begin, b - a, zlib.crc32(ids[a:b].tobytes()), size, self.sequence + int(seq), offset
        self.sequence += len(cuts)
        open_ = int(np.searchsorted(begins, done, "right") - 1)
        keep = [d for d in self.docs[open_:]] if done < self.held else []
        self.docs = [(max(d[0] - done, 0), d[1], d[2] + max(done - d[0], 0), d[3]) for d in keep]
        rest = (places > done) if not last else np.zeros(len(places), bool)
        self.ids, self.held = [ids[done:]], self.held - done
        self.places, self.prices = [places[rest] - done], [prices[rest]]


def pack(
    df: DataFrame,
    window: int = 4096,
    path: str | None = None,
    end_id: int = 2,
    sentence: int = SENTENCE,
    inside: int = INSIDE,
    short: int = SHORT,
    long: int = LONG,
    step: int = STEP,
    block: int = BLOCK,
    share: int = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``:
    the pieces of all documents in sequences of at most ``window`` tokens.

    A document's tokens are its ids by the tokenizers library without special
    tokens, then ``end_id``; a null or empty text has ``end_id`` alone. Every
    token lies in one piece; a sequence's pieces lie one behind the other from
    offset 0, in the order of doc_id (nulls last; of equal ids by a hash of the
    text). Repeated rows are packed each, an empty table gives no rows.
    ``sequence_id`` is unique, not dense. Documents are dealt to partitions by
    ranges of their order, equal ids by text and row number, so that no id is
    hot; a task reads its documents as a stream.
    """
    path = path or default_path()
    docs = documents(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(min(PARTITIONS, size // share + 1))
    docs = docs.withColumn("text_hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_hash"), F.col("row")]
    dealt = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        packer = Packer(window, sentence, inside, short, long, step, block, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        for some in batches:
            for part in slices(some, size=SLICE):
                for doc_id, (ids, ends) in zip(part.column(0).to_pylist(), encoder.encode(part.column(1), end_id), strict=True):
                    rows += packer.add(doc_id, ids, ends)
                if len(rows) >= 50_000:
                    yield batch(rows)
                    rows = []
        rows += packer.solve(True)
        if rows:
            yield batch(rows)

    return dealt.mapInArrow(work, ", ".join(f"{n} long" for n in names))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
