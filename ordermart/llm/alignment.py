"""Aligning the tokens of two tokenizers over the same texts.

Both token sequences of a text cover the same bytes. Offsets at which a token
of either ends are shared cuts: ``divide`` takes the token in the middle of an
interval, finds the shared cut nearest to it by bisecting the other side's
ends, and goes on in both halves; an interval without a shared cut inside is a
leaf group. All intervals of a batch of texts are halved together, level by
level, so a text of any length takes a number of rounds that grows with its
logarithm.

Texts are read in stretches between single blanks. Neither tokenizer has a
token across such a blank, so a stretch has the same tokens alone as in its
text, and frequent ones are encoded once a worker.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.llm.bpe import byte_letters
from ordermart.llm.common import documents, slices, written
from ordermart.llm.remembered import Numbers, Pool, forget

#: A blank between two other characters: a token never crosses one.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Stretches whose tokens a worker remembers: when there are more, the half used
#: most often stays. A worker keeps them after its task.
REMEMBERED = 200_000
#: Stretches that the libraries encode at once.
BATCH = 4096
#: Most id pairs whose counts are broadcast: about 40 MB.
FREQUENT = 1_000_000


class Tokenizers:
    """Both tokenizers with the bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: bytes([i]) for i, c in enumerate(byte_letters())}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = b"".join([byte[c] if c in byte else c.encode() for c in token])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("only vocabularies without a piece across a blank")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in some], np.int64) for some in (self.a_bytes, self.b_bytes))
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.a_names = np.array([f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)], object)
        self.b_names = np.array([f"{i}," for i in range(m)] + [f"{i};" for i in range(m)], object)
        self.numbers, self.by_a, self.by_b = Numbers(), Pool(), Pool()
        self.fits = np.empty(0, bool)  # of stretches whose tokens spell them out

    def learn(self) -> None:
        """Give tokens to all new stretches; none to one whose tokens don't
        spell it out."""
        new, self.numbers.new = self.numbers.new, []
        for at in range(0, len(new), BATCH):  # the libraries' own results are large
            some = new[at : at + BATCH]
            spaced = [" " + t for t in some]
            a_ids = [x.ids for x in self.a.encode_batch(spaced, add_special_tokens=False)]
            b_ids = self.b.encode(some, num_threads=1)
            fits = [b"".join([self.a_bytes[i] for i in a]) == (full := text.encode()) and b"".join([self.b_bytes[i] for i in b]) == full for text, a, b in zip(spaced, a_ids, b_ids, strict=True)]
            for pool, ids in ((self.by_a, a_ids), (self.by_b, b_ids)):
                sizes = np.fromiter(map(len, compress(ids, fits)), np.int64)
                all_sizes = np.zeros(len(some), np.int64)
                all_sizes[fits] = sizes
                pool.add(np.fromiter(chain.from_iterable(compress(ids, fits)), "<u4", int(sizes.sum())), all_sizes)
            self.fits = np.append(self.fits, fits)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides (32 bits each), for each text; ``None`` for one
        without tokens."""
        kept = forget(self.numbers, [self.by_a, self.by_b], REMEMBERED)
        if kept is not None:
            self.fits = self.fits[kept]
        parts = [CUT.split(t) if t else [] for t in texts]
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        codes = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(parts)), np.int64, int(edges[-1]))
        if self.numbers.new:
            self.learn()
        self.numbers.used(codes)
        misfits = np.concatenate([[0], np.cumsum(~self.fits[codes])])[edges]
        whole = (np.diff(edges) > 0) & (np.diff(misfits) == 0)
        sides = [(pool.ids(codes), np.concatenate([[0], np.cumsum(pool.size[codes])])[edges].tolist()) for pool in (self.by_a, self.by_b)]
        return [tuple(ids[at[k] : at[k + 1]] for ids, at in sides) if whole[k] else None for k in range(len(texts))]


def divide(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that end at shared cuts, in order, on both sides.

    ``a`` and ``b`` are increasing end offsets; ``a_cuts`` and ``b_cuts`` are
    the places of the last token of each text, which end together.
    """
    found = [(a_cuts, b_cuts)]
    a_from, b_from = (np.concatenate([[0], c[:-1] + 1]) if len(c) else c for c in (a_cuts, b_cuts))
    a_to, b_to = a_cuts, b_cuts  # the last token of the interval
    while True:
        open_ = (a_to > a_from) & (b_to > b_from)
        a_from, a_to, b_from, b_to = a_from[open_], a_to[open_], b_from[open_], b_to[open_]
        if not len(a_from):
            break
        middle = (a_from + a_to - 1) // 2
        at, to = middle.copy(), np.full(len(middle), -1)
        # Rightwards: each side's first end at or after the other's, until both agree.
        rest = np.arange(len(middle))
        while len(rest):
            j = np.searchsorted(b, a[at[rest]])
            same = b[j] == a[at[rest]]
            hit = same & (at[rest] < a_to[rest])
            to[rest[hit]] = j[hit]
            rest, j = rest[~same], j[~same]
            at[rest] = np.searchsorted(a, b[j])
        right = to >= 0
        # Leftwards where only the interval's own end was met.
        rest = np.flatnonzero(~right)
        at[rest] = middle[rest]
        while len(rest):
            j = np.searchsorted(b, a[at[rest]], "right") - 1
            inside = j >= b_from[rest]
            rest, j = rest[inside], j[inside]
            same = b[j] == a[at[rest]]
            to[rest[same]] = j[same]
            rest, j = rest[~same], j[~same]
            i = np.searchsorted(a, b[j], "right") - 1
            inside = i >= a_from[rest]
            rest = rest[inside]
            at[rest] = i[inside]
        cut = to >= 0  # the others are leaf groups
        found.append((at[cut], to[cut]))
        both = right  # what lies right of a cut found leftwards has none inside
        a_from, a_to = np.concatenate([a_from[cut], at[both] + 1]), np.concatenate([at[cut], a_to[both]])
        b_from, b_to = np.concatenate([b_from[cut], to[both] + 1]), np.concatenate([to[cut], b_to[both]])
    return tuple(np.sort(np.concatenate(side)) for side in zip(*found, strict=True))


def _aligned(v: Tokenizers, texts: list[str], digest: bool) -> list[pa.Array]:
    """Columns ``n_a, n_b, n_groups, groups, links`` for one slice of texts."""
    coded = v.encode(texts)
    rows = [i for i, c in enumerate(coded) if c is not None]
    a, b = (np.concatenate([coded[i][side] for i in rows] or [[]]).astype(np.int64) for side in (0, 1))
    n_a, n_b, n_groups = (np.zeros(len(texts), np.int64) for _ in range(3))
    n_a[rows] = [len(coded[i][0]) for i in rows]
    n_b[rows] = [len(coded[i][1]) for i in rows]
    groups = [""] * len(texts)
    starts = np.zeros(len(texts) + 1, np.int32)
    pairs = times = np.zeros(0, np.int64)
    if rows:
        # Texts have the same bytes on both sides, so ends run on over all texts.
        a_cuts, b_cuts = divide(np.cumsum(v.a_sizes[a]), np.cumsum(v.b_sizes[b]), np.cumsum(n_a[rows]) - 1, np.cumsum(n_b[rows]) - 1)
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[a_cuts] = b_last[b_cuts] = 1
        # A group's tokens of side A come before its tokens of side B.
        out = np.empty(len(a) + len(b), object)
        group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        out[np.arange(len(a)) + np.concatenate([[0], b_cuts + 1])[group_a]] = v.a_names[a + a_last * len(v.a_bytes)]
        out[np.arange(len(b)) + (a_cuts + 1)[group_b]] = v.b_names[b + b_last * len(v.b_bytes)]
        ends = np.cumsum(n_a[rows] + n_b[rows])
        for row, start, end in zip(rows, [0, *ends[:-1]], ends, strict=True):
            text = "".join(out[start:end].tolist())[:-1]
            groups[row] = hashlib.sha256(text.encode()).hexdigest() if digest else text
        owner = np.repeat(rows, n_a[rows])[a_cuts]
        n_groups[:] = np.bincount(owner, minlength=len(texts))
        pair = a[a_cuts] * len(v.b_bytes) + b[b_cuts]
        order = np.lexsort((pair, owner))
        pair, owner = pair[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])]))
        pairs, times = pair[first], np.diff(np.append(first, len(pair)))
        starts[1:] = np.cumsum(np.bincount(owner[first], minlength=len(texts)))
    links = pa.StructArray.from_arrays([pa.array(pairs), pa.array(times, pa.int64())], names=["pair", "times"])
    return [pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(starts), links)]


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One a Python worker."""
    if (a_path, b_path) not in _TOKENIZERS:
        _TOKENIZERS[a_path, b_path] = Tokenizers(a_path, b_path)
    return _TOKENIZERS[a_path, b_path]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(df: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, links`` of every whole text.

    Side A encodes a blank and the text, side B the text (and adds the blank).
    ``groups`` has A's and B's ids of each leaf group as ``a1,a2|b1;a3|b2,b3``
    (with ``digest`` its SHA-256); ``links`` counts the pairs of tokens that
    end together, ``pair`` being A's id times B's vocabulary size plus B's id.
    Groups and links are as many, as each group ends with one such pair. A
    null or empty text, and one that either side's tokens don't spell out, has
    no tokens: zeros, '' and no links. Repeated rows are aligned each; an
    empty table gives none. One pass, no shuffle.
    """
    a_default, b_default = default_paths()
    a_path, b_path = a_path or a_default, b_path or b_default
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _tokenizers(a_path, b_path)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), *_aligned(v, part.column(1).to_pylist(), digest)], names=names)

    return documents(df, id_col, text_col).mapInArrow(work, "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<struct<pair:long,times:long>>")


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """``pair, n, best``: how many links hold a pair, and whether no other pair
    of its B id is held by more."""
    counts = aligned.select(F.inline("links")).groupBy("pair").agg(F.sum("times").alias("n"))
    counts = written(counts)
    most = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("most"))
    return written(counts.join(most, F.col("pair") % b_size == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def scored(df: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` are the links of a text whose pair is the most frequent of its
    B id in the whole corpus (ties included), ``count_sum`` the sum of their
    pairs' counts. Texts are encoded once and written with their links. The
    counts of at most ``frequent`` pairs, the most frequent ones, are
    broadcast; the rest, none of them hot, meet their links by a shuffle.
    """
    a_default, b_default = default_paths()
    b_size = _piece_count(b_path or b_default)
    aligned = align(df, a_path, b_path, id_col, text_col, digest=True).withColumn("row", F.monotonically_increasing_id())
    aligned = written(aligned)
    counts = pair_counts(aligned, b_size)
    level = F.floor(F.log2("n")).cast("int")
    levels = {r.level: r.pairs for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs")).collect()}  # 64 at most
    total, least = 0, 64
    for at in sorted(levels, reverse=True):
        total += levels[at]
        if total > frequent:
            break
        least = at
    keys = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups"]
    links = aligned.select(*keys, F.inline_outer("links"))
    hot = counts.filter(level >= least).select("pair", "n", "best")
    joined = links.join(F.broadcast(hot), "pair", "left")
    if least > min(levels, default=64):
        rare = links.join(F.broadcast(hot), "pair", "left_anti").filter("pair is not null")
        rare = rare.join(counts.filter(level < least), "pair").select(*joined.columns)
        joined = joined.filter("n is not null or pair is null").unionByName(rare)
        # A text all of whose links are rare still has its row, from `rare`.
    sums = joined.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best"),
        F.coalesce(F.sum(F.col("times") * F.col("n")), F.lit(0)).alias("count_sum"),
    )
    return sums.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def _piece_count(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
