import random
import re

import pytest

from ordermart.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    """Brute force: every pattern over the whole text."""

    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def found(text):
    return [x for x in pii.spans(text) if x[0] in pii.BASE_KINDS]


def test_random_texts_equal_the_patterns():
    rnd = random.Random(7)
    bits = ["a", "b.c", "@", ".", "-", "+", "+1", " ", "  ", "(", ")", "1", "12", "255", "256", "0255", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "x@y.z", "é", "İ", "@b.co", "%", "_", "\n", "٣", "5555", "+49 (30) 555-0100"]
    for _ in range(30_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
        assert found(text) == base(text), repr(text)


def test_long_text_and_chains():
    text = "1.2.3.4.5.6.7.8 " * 3000 + "a@b.c@d.e f@g " + "9" * 50_000
    assert found(text) == base(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("see https://example.com/a?b=1.", "url", "https://example.com/a?b=1"),
        ("IBAN: DE89 3704 0044 0532 0130 00 ok", "iban", "DE89 3704 0044 0532 0130 00"),
        ("account no. 00123456, thanks", "account", "00123456"),
    ],
)
def test_added_kinds(text, kind, part):
    assert [text[a:b] for k, a, b in pii.spans(text) if k == kind] == [part]


def test_report_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "me@x.org +49 30 5550100", "x"), (3, "me@x.org +49 30 5550100", "x"), (None, "é 10.0.0.1", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_phone, r.spans) for r in pii.report(df).collect())
    assert got == [(0, 0, 1, 0, "ip:2:10"), (1, 0, 0, 0, ""), (2, 0, 0, 0, ""), *[(3, 1, 0, 1, "email:0:8,phone:9:23")] * 2]
    assert pii.report(df.limit(0)).count() == 0
    assert pii.find(df).filter("size(spans) = 2").count() == 2
