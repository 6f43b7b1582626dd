"""Byte-pair encoding and decoding by a dynamic programme over prefixes.

For every prefix of a word there is exactly one last token in its encoding.
A token that is a suffix of the prefix is that last token if and only if it
and the last token of what is left in front of it form a compatible pair, i.e.
encoding the two strings together gives the two tokens back. So one pass over
the matches of an automaton of the vocabulary (for every prefix, all tokens
that are suffixes of it) fills the table of last tokens, and following it from
the end gives the ids. No merge loop runs over the text.

The vocabulary is a file of the tokenizers library whose words end in a
suffix mark; its path is a parameter and the file must be readable on every
executor (it is part of the installed tokenizers there).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ordermart.llm.common import documents, slices

INFINITE = 1 << 60
#: Words whose codes a worker remembers, in two generations: when the young one
#: is full it replaces the old one, so frequent words stay and memory is bounded.
#: A worker keeps them after its task, so later work in it pays for them too.
REMEMBERED = 150_000


class Vocabulary:
    """Tokens as strings over an alphabet in which "character at a word's end"
    is a letter of its own, so that a word's end needs no special case."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.end = model.get("end_of_word_suffix") or ""
        if not self.end or model.get("continuing_subword_prefix") or model.get("byte_fallback") or data.get("decoder"):
            raise ValueError("only vocabularies with a word-end suffix, no subword prefix, no byte fallback and no decoder")
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.marker = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(merges):
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = k
            self.parts.setdefault(made, (*pair, k))
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._pairs: dict[int, bool] = {}
        self.matches = ahocorasick.Automaton()
        self.singles: set[str] = set()
        for text, i in vocab.items():
            letters = self.letters(text)
            if len(letters) == 1:
                self.singles.add(letters)
            if self._reachable(i, len(letters)):
                self.matches.add_word(letters, (len(letters), i))
        self.matches.make_automaton()
        self.known = Known(self)
        self.older: dict[str, tuple[int, str, str]] = {}
        self.byte_letters = byte_letters()

    def letters(self, token: str) -> str:
        if token.endswith(self.end) and token != self.end:
            token = token[: -len(self.end)]
            return token[:-1] + chr(0xF0000 + ord(token[-1]))
        return token

    def right(self, token: int) -> list[tuple[int, int]]:
        """The token and all that end it while it is built, each with the rank
        of the merge in which it disappears."""
        if token not in self._right:
            found, until, now = [(token, INFINITE)], INFINITE, token
            while now in self.parts:
                _, now, until = self.parts[now]
                found.append((now, until))
            self._right[token] = found
        return self._right[token]

    def left(self, token: int) -> list[tuple[int, int]]:
        """The same for all that begin it."""
        if token not in self._left:
            found, now = [(token, INFINITE)], token
            while now in self.parts:
                now, _, until = self.parts[now]
                found.append((now, until))
            self._left[token] = found
        return self._left[token]

    def _crosses(self, a: int, b: int, until: int) -> bool:
        """Whether some merge before rank ``until`` joins the end of ``a`` to
        the start of ``b``. A merge's rank is above those of its parts, so x
        and y meet exactly if neither has disappeared by the rank of (x, y);
        of equal merges the leftmost is first."""
        for x, x_until in self.right(a):
            for y, y_until in self.left(b):
                r = self.rank.get((x, y))
                if r is not None and r < until and r < x_until and r <= y_until:
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        """Whether the strings of ``a`` and ``b`` together are encoded as both."""
        if len(self._pairs) > 1_000_000:
            self._pairs.clear()
        found = self._pairs[a << 32 | b] = not self._crosses(a, b, INFINITE)
        return found

    def _reachable(self, token: int, length: int) -> bool:
        """Whether the token's own string is encoded as the token."""
        if length == 1:
            return True
        if token not in self.parts:
            return False
        todo = [token]
        while todo:
            t = todo.pop()
            if t in self.parts:
                a, b, r = self.parts[t]
                if self._crosses(a, b, r):
                    return False
                todo += [a, b]
        return True

    def word(self, text: str) -> list[int]:
        """Ids of one word in the byte-level alphabet, by prefixes."""
        n = len(text)
        letters = text[:-1] + chr(0xF0000 + ord(text[-1]))
        if not self.singles.issuperset(letters):  # the library leaves out what it has no letter for
            kept = [c for c in letters if c in self.singles]
            letters, n = "".join(kept), len(kept)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        pairs, compatible = self._pairs, self.compatible
        for at, (size, token) in self.matches.iter(letters):
            end = at + 1
            if last[end] < 0:
                front = end - size
                if front:
                    before = last[front]
                    if before < 0:
                        continue
                    fits = pairs.get(before << 32 | token)
                    if fits is None:
                        fits = compatible(before, token)
                    if not fits:
                        continue
                last[end], start[end] = token, front
        ids, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError("a prefix without a last token: the merges aren't in order of rank")
            ids.append(last[at])
            at = start[at]
        return ids[::-1]

    def chunk(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids and tokens of a stretch without blanks."""
        if text.isalpha():
            pieces = [text if text.isascii() else "".join([self.byte_letters[b] for b in text.encode()])]
        else:
            pieces = [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        ids = [i for piece in pieces for i in self.word(piece)]
        return len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, the ids and the decoded text of a whole text."""
        if self.marker is None or "<" not in text:
            return self._plain(text)
        parts, at = [], 0
        for m in self.marker.finditer(text):
            parts += [self._plain(text[at : m.start()]), (1, str(self.special[m[0]]), m[0])]
            at = m.end()
        parts = [p for p in (*parts, self._plain(text[at:])) if p[0]]
        return sum(p[0] for p in parts), " ".join(p[1] for p in parts), " ".join(p[2] for p in parts)

    def _plain(self, text: str) -> tuple[int, str, str]:
        if len(self.known) >= REMEMBERED:
            self.older, self.known = dict(self.known), Known(self)
        found = [x for x in map(self.known.__getitem__, blank_split(normalised(text))) if x[0]]
        if not found:
            return 0, "", ""
        counts, ids, names = zip(*found, strict=True)
        return sum(counts), " ".join(ids), " ".join(names)


class Known(dict):
    """Codes by stretch; what is missing is encoded and, if short, kept."""

    def __init__(self, owner: Vocabulary):
        super().__init__()
        self.owner = owner

    def __missing__(self, text: str) -> tuple[int, str, str]:
        word, tail = text[:-1], text[-1]
        if tail in ".,!?;:" and word.isalpha():  # letters, then one mark: two pieces
            (n, a, x), (m, b, y) = self[word], self[tail]
            return n + m, f"{a} {b}", f"{x} {y}"
        found = self.owner.older.get(text) or self.owner.chunk(text)
        if len(text) <= 64:
            self[text] = found
        return found


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


#: Python's split() also cuts at these four, which are no Unicode white space.
NOT_BLANK = re.compile("[\x1c-\x1f]")
UNICODE_BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")


def normalised(text: str) -> str:
    """Composed and in lower case, letter by letter (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def blank_split(text: str) -> list[str]:
    if NOT_BLANK.search(text):
        return [x for x in UNICODE_BLANK.split(text) if x]
    return text.split()


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per Python worker: batches and tasks in it share the automaton."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every whole text.

    ``ids`` are decimal ids joined by one space and ``decoded`` is the text
    that the ids decode to, special tokens included. No special tokens are
    added; their strings in a text become their ids. A null or empty text has
    no ids (0, "", ""). Rows keep their number: repeated rows are encoded each.
    One pass, no shuffle; a task holds one Arrow batch, one automaton and at
    most ``REMEMBERED`` words.
    """
    return _run(df, path, id_col, text_col, False)


def digests(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ``encode`` with SHA-256
    digests (hex) in place of the long strings, taken before rows leave the task."""
    return _run(df, path, id_col, text_col, True)


def _run(df: DataFrame, path: str | None, id_col: str, text_col: str, digest: bool) -> DataFrame:
    path = path or default_path()

    def coded(v: Vocabulary, text: str) -> tuple[int, str, str]:
        n, a, b = v.encode(text)
        return (n, hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest()) if digest else (n, a, b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for part in slices(batch):
                counts, ids, decoded = zip(*[coded(v, x.as_py()) for x in part.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=names)

    names = ["doc_id", "n_tokens"] + (["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])
    schema = f"doc_id long, n_tokens long, {names[2]} string, {names[3]} string"
    return documents(df, id_col, text_col).mapInArrow(work, schema)
