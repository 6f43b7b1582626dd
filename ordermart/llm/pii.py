"""Personal data found by anchor expansion.

One Aho-Corasick pass over a text reports its anchors: at-signs, plus signs,
digits, schemes of addresses and identifier cues. Around each anchor a small
deterministic parser reads left and right as far as the kind's grammar allows
and validates what it has read (domain labels, octets, Luhn, number of digits,
mod-97). No pattern is tried at positions without an anchor.

Base kinds, leftmost and non-overlapping per kind, failing ones dropped:

* ``email``  local part, at-sign, two domain labels at least;
* ``ip``     four groups of digits, each at most 255;
* ``card``   digits with single blanks or hyphens, 16 to 19, Luhn;
* ``phone``  plus sign, 8 to 15 digits with blanks, brackets, dots, hyphens.

Added kinds: ``url`` (scheme or www., up to the next blank, quote or bracket,
closing punctuation left out), ``iban`` (cue IBAN, then a country code and a
number passing mod-97) and ``account`` (an identifier cue such as "account no",
"ssn" or "passport", then a token with at least four digits).

A null or empty text has no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ordermart.llm.common import documents, slices

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "iban", "account")

#: What each anchor starts. Cues are matched in any case.
SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = ("account number", "account no", "acct", "ssn", "social security", "passport", "driver license", "tax id", "customer id")
IBAN_CUE = "iban"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Local parsers: each is applied at one position only.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE_TAIL = re.compile(r"[0-9][\x20().0-9-]+")
URL_TAIL = re.compile(r"[^\s\"'<>()\[\]{}]+")
AFTER_CUE = re.compile(r"[\x20]{0,2}(?:number|no|num|#)?[.:#\x20]{0,3}")
IDENTIFIER = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}")

Span = tuple[str, int, int]
_AUTOMATA: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    """The anchors, built once for each Python worker."""
    if not _AUTOMATA:
        found = ahocorasick.Automaton()
        for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789")):
            for w in words:
                found.add_word(w, (kind, 1))
        for kind, words in (("url", SCHEMES), ("account", CUES), ("iban", (IBAN_CUE,))):
            for w in words:
                found.add_word(w, (kind, len(w)))
        found.make_automaton()
        _AUTOMATA.append(found)
    return _AUTOMATA[0]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def lowered(text: str) -> str:
    """Lower case of A-Z alone, which never changes an offset."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate({k: k + 32 for k in range(65, 91)})


def spans(text: str) -> list[Span]:
    """All spans by kind as listed, then start."""
    found: dict[str, list[Span]] = {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}
    done = dict.fromkeys(found, 0)  # per kind: up to where the text is used up

    def add(kind: str, start: int, end: int, good: bool) -> None:
        done[kind] = end
        if good:
            found[kind].append((kind, start, end))

    def email(at: int) -> None:
        start = at
        while start > done["email"] and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            add("email", start, m.end(), True)

    def digits(at: int) -> None:
        if at >= done["ip"]:
            chain = NUMBER_CHAIN.match(text, at)
            parts, start = chain[0].split("."), at
            for k in range(0, len(parts) - 3, 4):  # whole groups of four
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                add("ip", start, end, all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in four))
                start = end + 1
            done["ip"] = chain.end()
        if at >= done["card"]:
            m = DIGIT_CHAIN.match(text, at)
            only = m[0].replace(" ", "").replace("-", "")
            add("card", at, m.end(), 16 <= len(only) <= 19 and luhn(only))

    def phone(at: int) -> None:
        if at < done["phone"] or not (m := PHONE_TAIL.match(text, at + 1)):
            return
        end = m.end()
        while text[end - 1] not in "0123456789":
            end -= 1
        if end - at >= 4:  # plus, digit, something between, digit
            add("phone", at, end, 8 <= sum(map(text.count, "0123456789", [at] * 10, [end] * 10)) <= 15)

    def url(at: int) -> None:
        if at >= done["url"] and (m := URL_TAIL.match(text, at)):
            end = at + len(m[0].rstrip(".,;:!?"))
            add("url", at, end, "." in text[at:end].removeprefix("www.") or "://" in text[at:end] and end > text.index("://", at) + 3)

    def after_cue(at: int) -> int:
        return AFTER_CUE.match(low, at).end()

    def iban(end: int) -> None:
        if m := IBAN.match(text, after_cue(end)):
            whole = m[0]
            while len(whole) > 15 and not mod97(whole.replace(" ", "")):  # a word after it may have been read too
                whole = whole[: whole.rfind(" ")] if " " in whole else ""
            if len(whole) >= 15 and m.start() >= done["iban"]:
                add("iban", m.start(), m.start() + len(whole), True)

    def account(end: int) -> None:
        at = after_cue(end)
        if at >= done["account"] and (m := IDENTIFIER.match(text, at)):
            add("account", at, m.end(), sum(c in "0123456789" for c in m[0]) >= 4)

    low = lowered(text)
    for last, (kind, length) in automaton().iter(low):
        at = last - length + 1
        if kind == "0":
            digits(at)
        elif kind == "@":
            email(at)
        elif kind == "+":
            phone(at)
        elif kind == "url":
            if at == 0 or not text[at - 1].isalnum():
                url(at)
        elif at == 0 or not text[at - 1].isalnum():
            (iban if kind == "iban" else account)(last + 1)
    return [x for k in found for x in found[k]]


def joined(some: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in some])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` of every whole text; ``spans`` is an array of
    (kind, start, end). A null or empty text has an empty array; repeated rows
    are searched each. One pass, no shuffle, one Arrow batch in memory."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch):
                each = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t.as_py())] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(each, kind)], names=["doc_id", "spans"])

    return documents(df, id_col, text_col).mapInArrow(work, "doc_id long, spans array<struct<kind string, start long, end long>>")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: counts
    of base spans, the digest of their ``kind:start:end`` list, and the list of
    all spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for t in part.column(1):
                    all_spans = spans(t.as_py())
                    base = [x for x in all_spans if x[0] in BASE_KINDS]
                    rows.append((*(sum(x[0] == k for x in base) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans)))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return documents(df, id_col, text_col).mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
