"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, words don't, so words are labelled first: a feature of
a word (itself, or its first letters) marks it if it is found in far more
toxic than clean labelled documents, by a likelihood-ratio test that allows for
the number of features tested, and if enough toxic documents have no stronger
one (so the other words of a much copied document mark nothing). A word of a toxic document with a marking
feature is toxic, every other word is clean. A two-state chain is then fitted
to windows of such labelled words by maximum conditional likelihood, with the
marking features as inputs. Forward-backward marginals over a whole text give
the offending spans (marginal 0.5 or more) and, by their maximum, the score.

Words without a marking feature all have the same potential, so a stretch of
them is a power of one 2 x 2 matrix: the recursions run over the marked words,
their neighbours and the ends of the text, and are exact for the whole text.

Fitting uses a bounded sample of labelled rows (``SAMPLE``), by hash of their
ids; scoring is one pass over all documents without a join or a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import WORD, documents, slices, written

#: Labelled documents that are learned from at most: toxic, clean.
SAMPLE = (4000, 8000)
#: Features kept at most, words in a window, windows that are fitted at once.
FEATURES, WIDTH, BLOCK = 4096, 15, 20_000
#: Different windows that are learned from at most, the most frequent ones.
WINDOWS = 250_000
#: Lengths of the first letters that are features of a word.
PREFIXES = (4, 5, 6, 7)
#: Toxic documents without a stronger feature that a feature must have, unless
#: its strength is this share of the greatest.
EXPLAINED, STRONG = 2, 0.3
#: Odds by which a marking feature must be commoner in toxic documents.
RATIO = 20.0
#: Words beside a marked one that the recursions visit one by one.
BESIDE = 3
#: Words without a marking feature that a worker remembers.
REMEMBERED = 500_000

WORDS = re.compile(WORD)
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Blanks that lie within a word as WORD has it; its parts have the features.
INNER = re.compile(r"(?![\x20\x09-\x0D])\s")


def bare(word: str) -> str:
    """Lower case, without marks at its ends."""
    low = word.lower()
    return low if low.isalnum() else EDGES.sub("", low)


def features(word: str) -> list[str]:
    """Of a bare word: itself, and its first four to seven letters."""
    return [f"={word}"] + [f"{word[:k]}-" for k in PREFIXES if len(word) >= k] if word else []


@dataclass
class Chain:
    """Log-potentials: of the toxic state for each feature and for any word,
    of the steps clean-toxic, toxic-clean, toxic-toxic (clean-clean: 0)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    steps: tuple[float, float, float] = (0.0, 0.0, 0.0)
    plain: set[str] = field(default_factory=set)
    powers: dict[int, tuple[float, ...]] = field(default_factory=dict)

    def marked(self, words: Iterable[str]) -> dict[str, float]:
        """Those of the words that have a feature, with their log-potential."""
        found = {}
        for w in set(words) - self.plain:
            some = [self.weights[f] for f in features(bare(w)) if f in self.weights]
            if some:
                found[w] = self.bias + sum(some)
            elif len(w) < 40:
                if len(self.plain) >= REMEMBERED:
                    self.plain.clear()
                self.plain.add(w)
        return found

    def between(self, n: int) -> tuple[float, float, float, float]:
        """Potentials from one state to another with n unmarked words between."""
        n = min(n, 1 << 12)  # the power has long settled
        if n not in self.powers:
            a, b, c = self.steps
            step = np.exp(np.array([[0.0, a], [b, c]]))
            total, one = step, np.diag([1.0, math.exp(self.bias)]) @ step
            for _ in range(n):
                total = total @ one
                total = total / total.max()
            self.powers[n] = tuple(total.ravel().tolist())
        return self.powers[n]

    def marginals(self, potentials: list[float], gaps: list[int]) -> list[float]:
        """Probability of the toxic state at each visited word; ``gaps`` are
        the numbers of unmarked words between them."""
        n = len(potentials)
        up = [math.exp(min(p, 50.0)) for p in potentials]
        ahead = [(1.0, up[0])]
        for k in range(1, n):
            (p, q), (a, b, c, d) = ahead[-1], self.between(gaps[k - 1])
            x, y = p * a + q * c, (p * b + q * d) * up[k]
            ahead.append((x / (x + y), y / (x + y)))
        out, (p, q) = [0.0] * n, (1.0, 1.0)
        for k in range(n - 1, -1, -1):
            x, y = ahead[k][0] * p, ahead[k][1] * q
            out[k] = y / (x + y)
            if k:
                (a, b, c, d), w = self.between(gaps[k - 1]), up[k] * q
                p, q = a * p + b * w, c * p + d * w
                p, q = p / (p + q), q / (p + q)
        return out

    def tag(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The score and the offending spans (start, end, marginal)."""
        marked = self.marked(text.split())
        at = list(WORDS.finditer(text)) if marked else None
        n = len(at) if at is not None else len(WORDS.findall(text))
        if not n:
            return 0.0, []
        hits: dict[int, float] = {}
        if at:
            inner = INNER.search(text) is not None
            for k, m in enumerate(at):
                first = next((w for w in m[0].split() if w in marked), None) if inner else m[0]
                if first in marked:
                    hits[k] = marked[first]
        visit = sorted({0, n - 1} | {j for k in hits for j in range(max(0, k - BESIDE), min(n, k + BESIDE + 1))})
        potentials = [hits.get(k, self.bias) for k in visit]
        chances = self.marginals(potentials, [b - a - 1 for a, b in zip(visit, visit[1:], strict=False)])
        spans: list[tuple[int, int, float]] = []
        last = -2
        for k, p in zip(visit, chances, strict=True):
            if p >= 0.5 and at:
                start, end = at[k].span()
                if last == k - 1:
                    start, p = spans[-1][0], max(p, spans.pop()[2])
                spans.append((start, end, p))
                last = k
        return min(1.0, max(chances)), spans


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """``doc_id, text, toxic`` of the learned rows: whole texts, at most
    ``sample`` ids of either class and one row an id (of unlike texts one, by
    hash), none held out. Ids that are labelled both ways count as toxic; null
    labels and ids are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    each = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, sample[0]), (0, sample[1]))]
    # The ids are bounded by ``sample``, so the texts needn't move to meet them.
    found = docs.join(F.broadcast(each[0].unionAll(each[1])), "doc_id")
    return written(found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")))


def marking_features(sample: DataFrame, ratio: float = RATIO, most: int = FEATURES) -> list[str]:
    """Features of words that mark toxic documents, strongest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(), Counter()
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                words = {bare(w) for w in text.as_py().split()}
                found[toxic.as_py() == 1].update({f for w in words for f in features(w)})
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in found)], names=["feature", "clean", "toxic"])

    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return []
    each = sample.select("text", "toxic").mapInArrow(count, "feature string, clean long, toxic long")
    each = each.groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    each = written(each.filter("t >= 3"))
    tested = each.count()
    total = F.col("t") + F.col("c")
    gain = lambda n, share: F.when(n > 0, n * F.log(n / (total * share))).otherwise(0.0)
    strength = 2 * (gain(F.col("t"), bad / (bad + good)) + gain(F.col("c"), good / (bad + good)))
    odds = ((F.col("t") + 0.5) / bad) / ((F.col("c") + 0.5) / good)
    rows = each.withColumn("g", strength).filter((F.col("g") > 2 * math.log(max(tested, 2)) + 4) & (odds > ratio))
    ranked = rows.orderBy(F.desc("g"), "feature").limit(most).collect()
    names, strong = [r.feature for r in ranked], [r.g >= STRONG * ranked[0].g for r in ranked]
    place = {f: k for k, f in enumerate(names)}

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [{place[f] for w in {bare(x) for x in text.as_py().split()} for f in features(w) if f in place} for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in each if x], pa.int64())], names=["place"])

    first = sample.filter("toxic = 1").select("text").mapInArrow(strongest, "place long").groupBy("place").count()
    explained = {r.place for r in first.filter(F.col("count") >= EXPLAINED).collect()}
    return [f for k, f in enumerate(names) if strong[k] or k in explained]


def places(marked: list[int], extra: int, width: int = WIDTH, beside: int = BESIDE) -> list[int]:
    """Starts of windows: ``extra``, and so many that each marked word has
    ``beside`` words of the text to either side in its window."""
    out: list[int] = []
    for k in marked:
        if not out or k + beside >= out[-1] + width:
            out.append(max(0, k - width // 2))
    return sorted({*out, extra})


def windows(sample: DataFrame, names: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (index, -1: none; windows x width x features of a word), labels
    and numbers of the different windows: around all marked words, and one a
    document at a place set by its id. Past the end of a text labels are -1."""
    index = {f: k for k, f in enumerate(names)}
    each = 1 + len(PREFIXES)

    def own(word: str) -> list[int]:
        """Of the word's first part between any blanks that has some, as in ``tag``."""
        return next((some for w in word.split() if (some := [index[f] for f in features(bare(w)) if f in index])), [])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for key, text, toxic in zip(*batch.columns, strict=True):
                words = [own(w) for w in WORDS.findall(text.as_py())]
                if not words:
                    continue
                marked = [k for k, f in enumerate(words) if f]
                for k in places(marked, key.as_py() * 7919 % max(1, len(words) - width), width):
                    some = words[k : k + width]
                    past = width - len(some)
                    x = [i for f in some for i in (f + [-1] * each)[:each]] + [-1] * (past * each)
                    y = [int(bool(f) and toxic.as_py() == 1) for f in some] + [-1] * past
                    found[tuple(x), tuple(y)] += 1
            xs, ys = [list(x) for x, _ in found], [list(y) for _, y in found]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.int32())), pa.array(ys, pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], names=["x", "y", "n"])

    cuts = sample.select("doc_id", "text", "toxic").mapInArrow(cut, "x array<int>, y array<int>, n long")
    rows = cuts.groupBy("x", "y").agg(F.sum("n").alias("n"))
    rows = rows.orderBy(F.desc("n"), F.xxhash64("x", "y")).limit(WINDOWS).toArrow()
    shape = (rows.num_rows, width)
    values = [c.combine_chunks() for c in rows.columns]
    x, y = (v.flatten().to_numpy(zero_copy_only=False) for v in values[:2])
    return x.reshape(*shape, each), y.reshape(shape), values[2].to_numpy(zero_copy_only=False)


def _slopes(at: np.ndarray, y: np.ndarray, times: np.ndarray, weights: np.ndarray, bias: float, steps: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Slopes of the log-likelihood of windows by weights, bias and (less the
    counted pairs) steps. Places past the end of a text have no part in it."""
    n, width, each = at.shape
    real = y >= 0
    up = bias + weights[at].sum(axis=2)
    emit = np.stack([np.zeros_like(up), up], axis=2)
    step = np.exp(steps)
    scores = np.exp(emit - emit.max(axis=2, keepdims=True))
    ahead, behind = np.empty((n, width, 2)), np.ones((n, width, 2))
    ahead[:, 0] = scores[:, 0] / scores[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, width):
        a = (ahead[:, t - 1] @ step) * scores[:, t]
        ahead[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(width - 2, -1, -1):
        b = (behind[:, t + 1] * scores[:, t + 1]) @ step.T
        behind[:, t] = np.where(real[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
    both = ahead * behind
    toxic = both[:, :, 1] / both.sum(axis=2)
    joint = ahead[:, :-1, :, None] * step * (scores * behind)[:, 1:, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    wrong = np.where(real, y - toxic, 0.0) * times[:, None]
    moves = (joint * (times[:, None] * real[:, 1:])[:, :, None, None]).sum(axis=(0, 1))
    return np.bincount(at.ravel(), np.repeat(wrong.ravel(), each), len(weights)), wrong.sum(), moves


def fit(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 200, ridge: float = 0.02, times: np.ndarray | None = None) -> Chain:
    """Maximum conditional likelihood by scaled gradient steps, ``ridge`` on
    all weights. ``times`` are the numbers of the windows (else each is one);
    equal windows are one with a weight. Forward and backward run over blocks
    of windows at once."""
    if not len(y) or not names:
        return Chain()
    width, each = x.shape[1:]
    counts = np.ones(len(y)) if times is None else times
    rows, same = np.unique(np.concatenate([x.reshape(len(x), -1), y], axis=1), axis=0, return_inverse=True)
    times = np.bincount(same.ravel(), counts, len(rows))
    x, y = rows[:, : width * each].reshape(-1, width, each), rows[:, width * each :]
    weights, bias, steps = np.zeros(len(names) + 1), -2.0, np.zeros((2, 2))
    speed = {"w": np.full(len(names) + 1, 1e-8), "b": 1e-8, "s": np.full((2, 2), 1e-8)}
    at = np.where(x < 0, len(names), x)
    pairs = np.array([[(((y[:, :-1] == a) & (y[:, 1:] == b)).sum(axis=1) * times).sum() for b in (0, 1)] for a in (0, 1)])
    for _ in range(rounds):
        weights[-1] = 0.0
        parts = [_slopes(at[k : k + BLOCK], y[k : k + BLOCK], times[k : k + BLOCK], weights, bias, steps) for k in range(0, len(y), BLOCK)]
        slope_w = sum(p[0] for p in parts) - ridge * weights
        slope_b = sum(p[1] for p in parts) - ridge * bias
        slope_s = pairs - sum(p[2] for p in parts) - ridge * steps
        slope_s[0, 0] = 0.0
        speed["w"] += slope_w**2
        speed["b"] += slope_b**2
        speed["s"] += slope_s**2
        weights += 0.5 * slope_w / np.sqrt(speed["w"])
        bias += 0.5 * slope_b / math.sqrt(speed["b"])
        steps += 0.5 * slope_s / np.sqrt(speed["s"])
    return Chain(dict(zip(names, weights[:-1].tolist(), strict=True)), float(bias), (float(steps[0, 1]), float(steps[1, 0]), float(steps[1, 1])))


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Chain:
    """The chain fitted to the labelled rows that aren't held out."""
    some = labelled_sample(docs, labels, sample)
    names = marking_features(some)
    if not names:
        return Chain()
    x, y, times = windows(some, names)
    return fit(x, y, names, times=times)


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted, spans`` of every row; ``spans`` is an array
    of (start, end, marginal) in code points. Texts without a word, null ones
    included, score 0. Repeated rows are scored each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
        for batch in batches:
            for part in slices(batch):
                scores, spans = zip(*[chain.tag(t.as_py()) for t in part.column(1)], strict=True)
                rows = [[{"start": a, "end": b, "marginal": p} for a, b, p in s] for s in spans]
                verdicts = pa.array([int(s >= threshold) for s in scores], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), verdicts, pa.array(rows, kind)], names=["doc_id", "score", "predicted", "spans"])

    return documents(df, id_col, text_col).mapInArrow(work, "doc_id long, score double, predicted int, spans array<struct<start long, end long, marginal double>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans``: learned from ``labels``
    (``doc_id, toxic``), applied to all of ``docs`` (``doc_id, text``). Without
    a labelled document of either class nothing is learned and scores are near 0."""
    chain = learn(documents(docs), labels, sample)
    return score(docs, chain, threshold=threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    chain = learn(documents(docs), labels, sample)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                clean = [chain.tag(t.as_py() or "")[0] < threshold for t in part.column(at)]
                yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
