"""Exact substring dedup: bytes in a 100-byte string that also starts earlier.

The corpus is cut by content, so that equal strings meet without a global
suffix array. Each 100-byte window has an anchor, the leftmost least hash among
its 16-byte grams; equal windows have equal anchors. Neighbouring windows with
one anchor form a segment. A segment whose anchor occurs once can hold no
repeat. Equal segments are one class: its first one stands for all, and the
others' windows repeat it. What is left, different segments with an equal
anchor, are the edges of repeats: they are gathered by anchor into buckets of
bounded size, narrowed to windows that share more than the anchor with another
segment, and in each bucket a Burrows-Wheeler transform of the segments is
expanded breadth-first: the intervals of all strings of length l, extended by
one byte to the left, give those of length l + 1, so the common prefixes of
neighbouring suffixes come out by increasing value and the expansion stops at
100. Windows in one interval of length 100 are equal; all but the first repeat.

An anchor with more different segments than a bucket takes is settled window
by window instead, by exact digests combined map-side.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermart.llm.common import slices, written

GRAM = 16
#: Bytes that a task hashes at once, and bytes of segments in a bucket (whose
#: arrays should stay in a processor's cache).
PIECE, BUCKET = 1 << 20, 1 << 18
#: Different segments of one anchor that a bucket takes.
CROWD = 10_000
#: Stands for "no doc_id": such rows come last.
UNNAMED = (1 << 63) - 1

_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the 16 bytes from each position (the last 15: of what wraps)."""
    h = _MIX[data]
    for k in (1, 2, 4, 8):
        h = h * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + np.roll(h, -k)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def segments(data: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces joined in ``data``: start and number of windows of each
    segment, and its anchor's hash and place, for windows of ``size`` bytes."""
    grams = size - GRAM + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    keep = lengths >= size
    n = len(data) - size + 1
    if n <= 0 or not keep.any():
        return np.array([], np.int64), np.array([], np.int64), np.zeros((2, 0), np.int64)
    h = gram_hashes(data)
    least, k = h, 1
    while 2 * k <= grams:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    least = np.minimum(least[:n], least[grams - k : grams - k + n])
    valid = np.zeros(len(data) + 1, np.int64)
    np.add.at(valid, starts[keep], 1)
    np.add.at(valid, ends[keep] - size + 1, -1)
    valid = np.cumsum(valid)[:n] > 0
    enter = np.zeros(n, bool)
    enter[1:] = h[grams : grams + n - 1] < least[:-1]
    change = enter.copy()
    change[1:] |= h[: n - 1] == least[:-1]
    first = np.zeros(n, bool)
    first[starts[keep]] = True
    begin = np.flatnonzero((change | first) & valid)
    at = begin + grams - 1
    search = np.flatnonzero(~(enter[begin] & ~first[begin]))
    view = np.lib.stride_tricks.sliding_window_view(h[: n + grams - 1], grams)
    for k in range(0, len(search), 4096):
        some = search[k : k + 4096]
        at[some] = begin[some] + view[begin[some]].argmin(axis=1)
    stop = np.append(begin[1:], n)
    last = ends[np.searchsorted(ends, begin, side="right")] - size + 1
    return begin, np.minimum(stop, last) - begin, np.stack([h[at].view(np.int64), at])


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, text, key``: ``key`` tells rows with one id but different texts
    apart. Where ids differ it is 0. Otherwise the distinct texts of such ids,
    known by two hashes of 64 bits, are numbered in the order of id and hashes:
    by ranges, so that no id is one task, however many rows have it or none.
    There may be 2^31 of these texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(UNNAMED)).alias("doc"), text.alias("text"))
    names = ["doc", "h", "g"]
    known = docs.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")})
    distinct = known.select(names).distinct()
    shared = distinct.groupBy("doc").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("doc")
    alike = written(distinct.join(shared, "doc", "left_semi"))
    n = alike.count()
    if not n:
        return docs.withColumn("key", F.lit(0).cast("long"))
    if n >= 1 << 31:
        raise ValueError("over 2^31 texts without an id of their own")
    parts = min(1 << 12, n // 100_000 + 1)
    ordered = alike.repartitionByRange(parts, *names).sortWithinPartitions(*names)
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted(ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one a range
    before = np.cumsum([0, *(r.n for r in sizes)]).tolist()
    offsets = df.sparkSession.createDataFrame([(r.part, k) for r, k in zip(sizes, before, strict=False)], "part long, before long")
    numbers = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")  # 4,096 rows at most
    numbers = numbers.select(*names, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("key"))
    return written(known.join(numbers, names, "left").select("doc", "text", F.coalesce("key", F.lit(0)).alias("key")))


def _scan(size: int):
    """Segments of the rows (doc, text, key) as ``anchor, digest, doc, place,
    n``; place is key * 2^32 + start. In each part of a batch only the first of
    equal segments is handed on; stretches of the others come with -n."""

    def pieces(part: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
        for doc, text, key in zip(*part.columns, strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            for a in range(0, max(1, len(data) - size + 1), PIECE):
                if len(data) >= size:
                    yield doc.as_py(), key.as_py(), a, data[a : a + PIECE + size - 1]

    def found(group: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        whole = b"".join(x[3] for x in group)
        lengths = np.array([len(x[3]) for x in group], np.int64)
        start, n, (anchor, at) = segments(np.frombuffer(whole, np.uint8), lengths, size)
        piece = np.searchsorted(np.cumsum(lengths), start, side="right")
        inside = start - (np.cumsum(lengths) - lengths)[piece] + np.array([x[2] for x in group], np.int64)[piece]
        doc = np.array([x[0] for x in group], np.int64)[piece]
        place = (np.array([x[1] for x in group], np.int64)[piece] << 32) + inside
        of = xxhash.xxh3_64_intdigest
        digest = np.array([of(whole[a:b], c) for a, b, c in zip(start.tolist(), (start + n + size - 1).tolist(), (at - start).tolist(), strict=True)], np.uint64).view(np.int64)
        order = np.lexsort((place, doc, digest, anchor))
        again = np.zeros(len(order), bool)
        again[1:] = (anchor[order][1:] == anchor[order][:-1]) & (digest[order][1:] == digest[order][:-1])
        lead = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
        twice = (doc[order] == doc[lead]) & (place[order] == place[lead])  # a repeated row repeats nothing
        kept, rest = order[~again], np.sort(order[again & ~twice])
        # Stretches of repeats that follow one another in a piece are one row.
        joins = np.zeros(len(rest), bool)
        joins[1:] = (rest[1:] == rest[:-1] + 1) & (start[rest[1:]] == start[rest[:-1]] + n[rest[:-1]]) & (piece[rest[1:]] == piece[rest[:-1]])
        heads = np.flatnonzero(~joins)
        total = np.add.reduceat(n[rest], heads) if len(rest) else n[:0]
        rows = np.concatenate([kept, rest[heads]])
        columns = [anchor[rows], digest[rows], doc[rows], place[rows], np.concatenate([n[kept], -total])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "digest", "doc", "place", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, held = [], 0
            for x in (x for part in slices(batch) for x in pieces(part)):
                group.append(x)
                held += len(x[3])
                if held >= PIECE:
                    yield found(group)
                    group, held = [], 0
            if group:
                yield found(group)

    return work


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Suffix array of stretches of bytes, each ended by a code of its own over
    255. Starts with seven codes packed into one key; then doubles, sorting only
    suffixes that are still tied, until none is: within a stretch's length."""
    n = len(codes)
    symbols = np.append(np.where(codes < 256, codes + 1, 0), np.zeros(7, np.int64))
    key, inside = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(7):
        here = np.where(inside, symbols[k : k + n], 0)
        key = key << 9 | here
        inside &= here > 0
    order = np.argsort(key, kind="stable")  # of equal ends the first comes first, at every distance
    # Equal keys that reach an end are different strings: the ends are codes of their own.
    new = np.append(True, (np.diff(key[order]) != 0) | ~inside[order[1:]])
    slots, k = np.arange(n), 7
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    while True:
        last = np.append(new[1:], True)
        tied = ~(new & last)
        slots = slots[tied]
        if not len(slots):
            return order
        some = order[slots]
        pair = rank[some] * (n + 1) + rank[np.minimum(some + k, n)] + 1
        by = np.argsort(pair)
        order[slots] = some[by]
        pair = pair[by]
        new = np.append(True, np.diff(pair) != 0)
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        k *= 2


def interval_classes(codes: np.ndarray, size: int) -> np.ndarray:
    """For each position the class of its first ``size`` codes: equal if and
    only if the strings are. Breadth-first over intervals of the transform."""
    n = len(codes)
    order = suffix_order(codes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = codes[order - 1]  # the transform; position 0 follows the last, a code of its own
    back = place[order - 1]  # rank of the suffix that starts one earlier
    by = np.argsort(back)  # ranks in the order of their extensions: by left code, then rank
    follows, leads = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    same = before[by[1:]] == before[by[:-1]]
    follows[by[:-1][same]] = by[1:][same]  # the next rank with the same left code
    leads[by[1:][same]] = by[:-1][same]
    cut = np.ones(n + 1, bool)  # cut[r]: neighbours r - 1 and r share fewer codes than the level
    cut[1:n] = codes[order[1:]] != codes[order[:-1]]
    edges = np.flatnonzero(cut)
    lo, hi = edges[:-1], edges[1:]
    for _ in range(1, size):
        if not len(lo):
            break
        sizes = hi - lo
        which = np.repeat(np.arange(len(lo)), sizes)
        ranks = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[which]
        ends = np.sort(back[ranks[follows[ranks] >= hi[which]]]) + 1
        starts = np.sort(back[ranks[leads[ranks] < lo[which]]])
        new = ~cut[ends]
        cut[ends[new]] = True
        lo, hi = starts[new], ends[new]
    return (np.cumsum(cut[:n]) - 1)[place]


def repeats(parts: list[bytes], counts: np.ndarray, size: int) -> list[np.ndarray]:
    """For segments in corpus order, the windows (offsets below ``counts``) of
    each that equal an earlier window of any of them."""
    lengths = np.array([len(p) + 1 for p in parts], np.int64)
    starts = np.cumsum(lengths) - lengths
    codes = np.empty(int(lengths.sum()), np.int64)
    flat = np.ones(len(codes), bool)
    flat[starts + lengths - 1] = False
    codes[flat] = np.frombuffer(b"".join(parts), np.uint8)
    codes[~flat] = 256 + np.arange(len(parts))
    classes = interval_classes(codes, size)
    own = np.repeat(starts, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.full(len(codes), len(codes), np.int64)
    np.minimum.at(first, classes[own], own)
    again = own[first[classes[own]] < own]
    which = np.searchsorted(starts, again, side="right") - 1
    at = np.searchsorted(which, np.arange(len(parts) + 1))
    return [again[a:b] - s for a, b, s in zip(at, at[1:], starts, strict=False)]


def narrowed(parts: list[bytes], counts: np.ndarray, anchors: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each segment that can still equal
    another's. Most segments with one anchor share little more than its gram by
    chance. A window holds ``reach`` bytes beside the gram on one of its sides,
    so windows whose side no other segment of the anchor has are left out."""
    grams = size - GRAM + 1
    reach = (size - GRAM) // 2
    lengths = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(lengths) - lengths
    h = gram_hashes(np.frombuffer(b"".join(parts), np.uint8))
    view = np.lib.stride_tricks.sliding_window_view(h, grams)
    at = np.concatenate([view[starts[k : k + 4096]].argmin(axis=1) for k in range(0, len(parts), 4096)])
    of = xxhash.xxh3_64_intdigest
    # Windows from ``turn`` on have at least ``reach`` bytes to the gram's right, the others to its left.
    turn = np.clip(at - reach + 1, 0, counts)
    both = []
    for there, a, b in ((turn > 0, at - reach, at + GRAM), (turn < counts, at, at + GRAM + reach)):
        side = np.array([of(p[i:j]) if t else 0 for p, i, j, t in zip(parts, a.tolist(), b.tolist(), there.tolist(), strict=True)], np.uint64).view(np.int64)
        order = np.lexsort((side, anchors, there))
        equal = (side[order][1:] == side[order][:-1]) & (anchors[order][1:] == anchors[order][:-1]) & there[order][1:] & there[order][:-1]
        shared = np.zeros(len(parts), bool)
        shared[order] = np.append(equal, False) | np.append(False, equal)
        both.append(shared)
    left, right = both
    first = np.where(left, 0, turn)
    return first, np.where(left | right, np.where(right, counts, turn) - first, 0)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Start and length of the runs in sorted numbers."""
    if not len(x):
        return []
    heads = np.flatnonzero(np.diff(x, prepend=x[0] - 2) != 1)
    return list(zip(x[heads].tolist(), np.diff(np.append(heads, len(x))).tolist(), strict=True))


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, bucket: int = BUCKET, crowd: int = CROWD) -> DataFrame:
    """``doc, place, n``: windows ``place .. place + n - 1`` (of the row with
    that key) repeat one that starts earlier."""
    return _windows(_rows(df, id_col, text_col), size, bucket, crowd)


def _windows(docs: DataFrame, size: int, bucket: int, crowd: int) -> DataFrame:
    spark = docs.sparkSession
    scanned = docs.mapInArrow(_scan(size), "anchor long, digest long, doc long, place long, n long")
    shared = scanned.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor")
    some = written(scanned.join(shared, "anchor"))
    del scanned, shared
    release(spark)
    here = some.filter("n < 0").select("doc", "place", (-F.col("n")).alias("n"))
    kept = some.filter("n > 0")
    classes = written(kept.groupBy("anchor", "digest").agg(F.min(F.struct("doc", "place", "n")).alias("first")))
    other = kept.join(classes, ["anchor", "digest"]).filter("doc <> first.doc OR place <> first.place").select("doc", "place", "n")
    variants = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1")
    edges = written(classes.join(variants, "anchor").select("anchor", "first.*", "variants"))
    by_row = edges.withColumn("key", F.shiftright("place", 32)).groupBy("doc", "key").agg(F.collect_list(F.struct("anchor", "place", "n", "variants")).alias("edges"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, text, each in zip(*part.columns, strict=True):
                    data = text.as_py().encode("utf-8", "surrogatepass")
                    for e in each.as_py():
                        a = e["place"] & 0xFFFFFFFF
                        out.append((e["anchor"], doc.as_py(), e["place"], e["n"], e["variants"], data[a : a + e["n"] + size - 1]))
                if out:
                    kinds = [pa.int64()] * 5 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "doc", "place", "n", "variants", "data"])

    cut = docs.join(by_row, ["doc", "key"]).select("doc", "text", "edges").mapInArrow(take, "anchor long, doc long, place long, n long, variants long, data binary")
    cut = written(cut)  # a repeated row brings its segments again: compare and _crowded bear that
    release(spark)
    small = cut.filter(F.col("variants") <= crowd)
    total = small.agg(F.sum(F.length("data") + 1)).first()[0] or 0

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc", "place", "anchor"]).sort_values(["doc", "place"], ignore_index=True)
        first, counts = narrowed(pdf["data"].tolist(), pdf["n"].to_numpy(np.int64), pdf["anchor"].to_numpy(np.int64), size)
        pdf = pdf.assign(first=first, n=counts)[counts > 0]
        if pdf.empty:
            return pd.DataFrame({"doc": [], "place": [], "n": []}).astype("int64")
        parts = [d[a : a + n + size - 1] for d, a, n in zip(pdf["data"], pdf["first"], pdf["n"], strict=True)]
        found = repeats(parts, pdf["n"].to_numpy(np.int64), size)
        rows = [(d, p + f + a, k) for d, p, f, x in zip(pdf["doc"], pdf["place"], pdf["first"], found, strict=True) for a, k in _runs(x)]
        return pd.DataFrame(rows, columns=["doc", "place", "n"]).astype("int64")

    n_buckets = max(1, -(-total // bucket))
    # A partition for each bucket or so: they are equal work, not to be merged by size.
    dealt = small.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(n_buckets))).repartition(min(n_buckets, 1 << 15), "bucket")
    edge = dealt.groupBy("bucket").applyInPandas(compare, "doc long, place long, n long")
    return here.unionAll(other).unionAll(edge).unionAll(_crowded(cut.filter(F.col("variants") > crowd), size))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles behind a written table: it does so once
    nothing on the driver refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _crowded(cut: DataFrame, size: int) -> DataFrame:
    """The same for anchors with too many segments: each window's 128-bit
    digest, its first place by a combined minimum, and a join back."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = xxhash.xxh3_128_digest
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                out = []
                for doc, place, n, data in zip(*batch.slice(k, 1000).columns, strict=True):
                    b, p = data.as_py(), place.as_py()
                    out += [(of(b[i : i + size]), doc.as_py(), p + i) for i in range(n.as_py())]
                kinds = (pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["w", "doc", "place"])

    each = cut.select("doc", "place", "n", "data").mapInArrow(windows, "w binary, doc long, place long")
    first = each.groupBy("w").agg(F.min(F.struct("doc", "place")).alias("first"))
    later = each.join(first, "w").filter("doc <> first.doc OR place <> first.place")
    return later.select("doc", "place", F.lit(1).cast("long").alias("n"))


def _cover(n_bytes: int, starts: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows."""
    step = np.zeros(n_bytes + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + counts + size - 1, -1)
    return [(a, a + k) for a, k in _runs(np.flatnonzero(np.cumsum(step)[:n_bytes] > 0))]


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, bucket: int = BUCKET, crowd: int = CROWD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` of every row: the UTF-8
    bytes, those removed, the maximal removed runs (array of start, end) and
    the bytes that are left, concatenated.

    A byte goes if a ``size``-byte string that also starts earlier (in a
    smaller doc_id, or earlier in the same document) covers it; all is judged
    on the input. Null texts are empty; texts under ``size`` bytes keep all.
    Rows without doc_id come last. Rows equal in id and text are one document;
    rows with one id, or none, and different texts are documents in the order of
    a hash of the texts.
    """
    return _cut(df, id_col, text_col, size, bucket, crowd, False)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, bucket: int = BUCKET, crowd: int = CROWD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return _cut(df, id_col, text_col, size, bucket, crowd, True)


def _cut(df: DataFrame, id_col: str, text_col: str, size: int, bucket: int, crowd: int, digest: bool) -> DataFrame:
    docs = _rows(df, id_col, text_col)
    marks = written(_windows(docs, size, bucket, crowd))
    release(df.sparkSession)
    each = marks.select("doc", F.shiftright("place", 32).alias("key"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("start"), "n")
    by_row = each.groupBy("doc", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    joined = docs.join(by_row, ["doc", "key"], "left").select("doc", "text", "starts", "counts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text, starts, counts in zip(*part.columns, strict=True):
                    data = text.as_py().encode("utf-8", "surrogatepass")
                    spans = _cover(len(data), starts.values.to_numpy(), counts.values.to_numpy(), size) if starts.is_valid else []
                    edges = [0, *(x for s in spans for x in s), len(data)]
                    left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    name = None if doc.as_py() == UNNAMED else doc.as_py()
                    rows.append((name, len(data), len(data) - len(left), *((len(spans), hashlib.sha256(left).hexdigest()) if digest else ([{"start": a, "end": b} for a, b in spans], left))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64()] * 3 + ([pa.int64(), pa.string()] if digest else [spans, pa.binary()])
    names = ["doc_id", "n_bytes", "n_removed"] + (["n_spans", "kept_sha256"] if digest else ["spans", "kept"])
    last = "n_spans long, kept_sha256 string" if digest else "spans array<struct<start long, end long>>, kept binary"
    return joined.mapInArrow(work, f"doc_id long, n_bytes long, n_removed long, {last}")
