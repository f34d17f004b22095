from __future__ import annotations

import datetime
import random
import re

import pytest
from palimpsest.llm import pseudonyms as op

from .helpers import ODD, clashing, docs


def passes(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    f = op.Feistel(b"k", "t", n)
    assert sorted(map(f, range(n))) == list(range(n)) and all(f.back(f(x)) == x for x in range(n))


def shape(text):
    return re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", text)))


VALUES = {
    "card": ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"],
    "account": ["9807915762804491", "1234 5678 9012 3456"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "ssn": ["123-45-6789", "899-01-0001"],
    "date": ["2024-02-29", "31.12.1999", "12/25/2001", "25/12/2001", "1.2.1950"],
    "ip": ["10.1.2.3", "255.255.255.255"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0100", "212-555-0100", "+442079460123"],
    "email": ["anna.b+7@mail.example.com", "X.99@a-b.org"],
}


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_formats_stay_and_come_back(kind, value):
    text = f"é {value}, end."
    new, counts = op.Pseudonyms(b"key")(text)
    assert counts == {k: int(k == kind) for k in op.KINDS} and new != text
    if value != "25/12/2001":  # day first shows only in values over 12, which the pseudonym may lack
        assert op.Pseudonyms(b"key", backwards=True)(new)[0] == text
    body = new[2:-6]
    if kind == "ip":
        assert all(0 <= int(p) <= 255 for p in body.split("."))
    elif kind == "date":
        assert shape(body) == shape(value) or value == "1.2.1950"
        assert any(_dated(body, f) for f in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"))
    else:
        assert shape(body.split("@")[0]) == shape(value.split("@")[0])
    digits = "".join(c for c in body if c.isdigit())
    if kind in ("card", "account"):
        assert passes(digits) == (kind == "card")
    if kind == "iban":
        c = body.replace(" ", "")
        assert int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1
    if kind == "email":
        assert body.split("@")[1] == value.split("@")[1]
    assert op.Pseudonyms(b"other")(text)[0] != new


def _dated(text, form):
    try:
        return datetime.datetime.strptime(text, form)
    except ValueError:
        return None


def test_equal_values_stay_linked_across_layouts():
    p = op.Pseudonyms()
    card = {re.sub(r"\D", "", p(t)[0]) for t in ("4111 1111 1111 1111", "4111-1111-1111-1111", "pay 4111111111111111 now")}
    day = {_dated(p("2001-12-25")[0], "%Y-%m-%d"), _dated(p("25.12.2001")[0], "%d.%m.%Y"), _dated(p("12/25/2001")[0], "%m/%d/%Y")}
    assert len(card) == len(day) == 1


@pytest.mark.parametrize("text", ["2023-02-30", "000-12-3456", "666-12-3456", "999.1.1.1", "version 1.2.3", "12 34 56", "a@b", "1234567", "99.99.1999", "DE00 3704 0044 0532 0130 00 x"])
def test_what_is_not_valid_stays(text):
    new, counts = op.Pseudonyms()(text)
    assert new == text and not any(counts.values())


def test_no_two_values_share_a_pseudonym():
    p, draw = op.Pseudonyms(), random.Random(1)
    values = {f"{draw.randrange(1, 600):03d}-{draw.randrange(1, 100):02d}-{draw.randrange(1, 10000):04d}" for _ in range(2000)}
    assert len({p(v)[0] for v in values}) == len(values)


def test_table(spark):
    rows = list(enumerate(ODD)) + [(30, "call 212-555-0100"), (31, "or 212-555-0100 now"), (30, "call 212-555-0100"), (None, "4111 1111 1111 1111")]
    got = op.pseudonymise(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows) and got[0].__fields__[:2] == ["doc_id", "text"]
    p = op.Pseudonyms()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(((d, p(t)[0]) for d, t in rows), key=str)
    assert op.pseudonymise(docs(spark, [])).collect() == []
    assert {r["text"] for r in op.pseudonymise(op.pseudonymise(docs(spark, rows)), undo=True).collect()} == {t for _, t in rows}
