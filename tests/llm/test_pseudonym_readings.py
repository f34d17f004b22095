"""Values followed by digits or capitals, and layouts of phones, mail names and dates."""

from __future__ import annotations

import pytest
from palimpsest.llm import pseudonyms as op

CARD = "4111111111111111"


@pytest.mark.parametrize(
    ("kind", "value", "behind"),
    [
        ("card", CARD, " 12/27"),
        ("card", "4111 1111 1111 1111", " 123"),
        ("card", CARD, " 4.0."),
        ("card", CARD, " 4"),
        ("card", "3782 822463 10005", " 1234"),
        ("account", "9807915762804491", " 13/27"),
        ("iban", "BE68 5390 0754 7034", " EUR"),
        ("iban", "BE68539007547034", " EUR"),
        ("iban", "BE68 5390 0754 7034", " TRANSFER NOW"),
        ("phone", "+44 20 7946 0958", ""),
        ("phone", "+49 30 9018 2000", ""),
        ("phone", "+33 1 23 45 67 89", ""),
        ("phone", "+49 (0)30 9018 2000", ""),
        ("phone", "+4532123456", ""),
        ("phone", "+44 20 7946 0958", " 20241"),
        ("email", "_john", "@x.com"),
        ("email", "john_", "@x.com"),
        ("email", "...john", "@x.com"),
        ("date", "2024/02/29", ""),
        ("date", "2024.02.29", ""),
    ],
)
def test_value_is_replaced_and_the_rest_stays(kind, value, behind):
    new, counts = op.Pseudonyms()(f"at {value}{behind} end")
    assert counts == {k: int(k == kind) for k in op.KINDS}
    assert new.startswith("at ") and new.endswith(f"{behind} end") and value not in new
    alone = op.Pseudonyms()(f"at {value}{behind if kind == 'email' else ''} end")[0]
    assert alone == (new if kind == "email" else new.replace(behind, ""))


def test_no_part_of_a_card_behind_other_digits_stays():
    new, counts = op.Pseudonyms()("1234 4111 1111 1111 1111")
    assert counts["card"] == 1 and new.startswith("1234 ") and not new.endswith("1111")


@pytest.mark.parametrize("text", ["12 34 56 78", "_@x.com", "+1234", "2024/02/30", "1+12345678901 AB12 CDEF GHIJ", "BE68 5390 0754 7035 EUR"])
def test_what_is_not_valid_stays(text):
    assert op.Pseudonyms()(text)[0] == text or text.startswith("1+")


def test_long_runs_take_linear_time():
    for text in ("x." * 50_000, "_" * 50_000 + "@", "1 " * 20_000, "AB12 " * 20_000):
        op.Pseudonyms()(text)
