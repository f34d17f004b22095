"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Each value is found by its format, validated, turned into an index among all
valid values of that format, and the index is permuted by a keyed Feistel
network. The new index is written back in the old format: separators, letter
case and checksums stay. A permutation maps equal values to equal pseudonyms and
different ones to different ones, whatever document or separator they stand in,
so records stay linked without a table of values.

| kind | validated by | what is permuted |
|-|-|-|
| iban | mod 97 | letters and digits after the check digits, which are made anew |
| card | 13 to 19 digits, a checksum (mod 10) | all digits but the last, which is made anew |
| ssn | no area 000, 666, 9xx, group 00, serial 0000 | the place among all valid numbers |
| date | calendar, years 1900 to 2099 | the day; its format stays |
| ip | four numbers to 255 | the 32-bit number |
| phone | + and 8 to 15 digits, or 10 digits in a phone's layout | the digits after the country code |
| email | local part with a letter or digit, domain with a dot | letters among letters, digits among digits of the local part |
| account | 16 digits in the layout of a card that fail its checksum | all digits; the result fails it too |

The Feistel network works on any number of values: it permutes the next larger
square and walks on until it is back inside. Rounds are keyed BLAKE2b. The key
is a parameter; whoever has it can take pseudonyms back (`undo`), but for dates
with slashes whose day came first: the pseudonym may look as if its month did.

Defined results: null stays null, an empty text empty. Text outside found values
is untouched. Overlapping finds: the earlier start, then the order above.
Of a card, IBAN or phone followed by further groups the longest valid reading
counts; an account gives way to a card that starts within it and ends behind it.
As a pseudonym may be valid together with the group behind it, such a value may
not come back by `undo`.
Repeated rows are treated one by one. Only doc_id and text are read.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import small_batches

KEY = b"change this key for every release"
ROUNDS = 10
KINDS = ("iban", "card", "ssn", "date", "ip", "phone", "email", "account")
#: Pseudonyms that a task remembers.
REMEMBERED = 200_000

_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST + 1

_FOUND = re.compile(
    r"""
    (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<email>(?<![A-Za-z0-9.+_%-])(?=[.+_%-]*[A-Za-z0-9])[A-Za-z0-9.+_%-]++(?=@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}))
    |(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))
    |(?P<date>(?<![0-9])(?:(?:19|20)[0-9]{2}(?P<mark>[./-])[0-9]{1,2}(?P=mark)[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\g{-1}(?:19|20)[0-9]{2})(?![0-9]))
    |(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
    |(?P<phone>(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)\ ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])|\+[0-9]{11,13}(?![0-9])
      |(?<![A-Za-z0-9])\+(?!(?:19|20)[0-9]{2}[./-])[0-9]{1,3}[ .-]?\(?[0-9]{1,5}\)?(?:[ .-]?[0-9]{2,5}){1,5}(?![0-9]))
    |(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))
    """.replace(r"\g{-1}", "(?P=sep)").replace("([./-])", "(?P<sep>[./-])"),
    re.VERBOSE,
)
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")
#: What parts the groups of a value that may be read shorter.
_BORDERS = {"iban": " ", "card": " -", "phone": " .-"}
#: Country codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: A text without one of these holds nothing to find.
_HINT = re.compile(r"[0-9]{2}|@")


class Feistel:
    """A keyed permutation of 0 … n - 1."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.n, self.side = n, isqrt(n - 1) + 1
        self.keys = [hashlib.blake2b(f"{kind}:{n}:{r}".encode(), key=key[:64], digest_size=16).digest() for r in range(ROUNDS)]

    def _mixed(self, r: int, half: int) -> int:
        raw = half.to_bytes(self.side.bit_length() // 8 + 1, "little")
        return int.from_bytes(hashlib.blake2b(raw, key=self.keys[r], digest_size=24).digest(), "little") % self.side

    def __call__(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.side)
            for r in range(ROUNDS):
                a, b = b, (a + self._mixed(r, b)) % self.side
            x = a * self.side + b
            if x < self.n:
                return x

    def back(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.side)
            for r in reversed(range(ROUNDS)):
                a, b = (b - self._mixed(r, a)) % self.side, a
            x = a * self.side + b
            if x < self.n:
                return x


def _check_digit(digits: str) -> int:
    """The digit that makes `digits` and it pass the mod 10 checksum."""
    twice = [int(d) * 2 for d in digits[::-2]]
    return -(sum(t - 9 * (t > 9) for t in twice) + sum(map(int, digits[-2::-2]))) % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _filled(shape: str, chars: str) -> str:
    """`chars` in place of the letters and digits of `shape`."""
    new = iter(chars)
    return "".join(next(new) if c.isalnum() else c for c in shape)


class Pseudonyms:
    """Texts with their personal values replaced, and how many of each kind there were."""

    def __init__(self, key: bytes = KEY, backwards: bool = False):
        self.key, self.backwards = key, backwards
        self.networks: dict[tuple[str, int], Feistel] = {}
        self.known: dict[tuple[str, str], tuple[str, str] | None] = {}

    def _moved(self, kind: str, x: int, n: int) -> int:
        network = self.networks.get((kind, n))
        if network is None:
            network = self.networks[kind, n] = Feistel(self.key, kind, n)
        return network.back(x) if self.backwards else network(x)

    def _digits(self, kind: str, digits: str) -> str:
        return str(self._moved(kind, int(digits), 10 ** len(digits))).zfill(len(digits))

    def _classes(self, kind: str, chars: str) -> str:
        """Digits among digits and letters among letters of the same case, as one number of mixed base."""
        x, n = 0, 1
        bases = [10 if c.isdigit() else 26 for c in chars]
        for c, base in zip(chars, bases, strict=True):
            x, n = x * base + (int(c) if base == 10 else ord(c.lower()) - 97), n * base
        x, out = self._moved(f"{kind}:{''.join('d' if b == 10 else 'l' for b in bases)}", x, n), []
        for c, base in zip(reversed(chars), reversed(bases), strict=True):
            x, v = divmod(x, base)
            out.append(str(v) if base == 10 else chr(v + (65 if c.isupper() else 97)))
        return "".join(reversed(out))

    def _iban(self, text: str) -> str | None:
        chars = text.replace(" ", "")
        if not 15 <= len(chars) <= 34 or _mod97(chars[4:] + chars[:4]) != 1:
            return None
        rest = self._classes("iban", chars[4:])
        return _filled(text, f"{chars[:2]}{98 - _mod97(rest + chars[:2] + '00'):02d}{rest}")

    def _card(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        if not 13 <= len(digits) <= 19 or _check_digit(digits[:-1]) != int(digits[-1]):
            return None
        body = self._digits("card", digits[:-1])
        return _filled(text, f"{body}{_check_digit(body)}")

    def _account(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        if len(digits) != 16:
            return None
        # the nine last digits that fail the checksum, by their place after the one that passes
        place = (int(digits[-1]) - _check_digit(digits[:-1])) % 10 - 1
        x = self._moved("account", int(digits[:-1]) * 9 + place, 9 * 10**15)
        body = str(x // 9).zfill(15)
        return _filled(text, f"{body}{(_check_digit(body) + x % 9 + 1) % 10}")

    def _ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self._moved("ssn", x, 898 * 99 * 9999), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _date(self, text: str) -> str | None:
        sep = next(c for c in text if not c.isdigit())
        parts = text.split(sep)
        year_first = len(parts[0]) == 4
        year, one, two = map(int, parts if year_first else (parts[2], parts[0], parts[1]))
        # day and month: month first after a year, and with slashes where it can be a month
        month_first = year_first or sep == "/" and one <= 12
        try:
            day = datetime.date(year, one if month_first else two, two if month_first else one).toordinal() - _FIRST
        except ValueError:
            return None
        new = datetime.date.fromordinal(self._moved("date", day, _DAYS) + _FIRST)
        wide = 1 + all(len(p) >= 2 for p in parts)
        if year_first:
            return f"{new.year}{sep}{new.month:0{wide}d}{sep}{new.day:0{wide}d}"
        first, second = (new.month, new.day) if month_first else (new.day, new.month)
        return f"{first:0{wide}d}{sep}{second:0{wide}d}{sep}{new.year}"

    def _ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255:
            return None
        return ".".join(map(str, self._moved("ip", int.from_bytes(bytes(parts)), 1 << 32).to_bytes(4)))

    def _phone(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        code = len(digits) - 10
        if text[0] == "+":
            if not 8 <= len(digits) <= 15:
                return None
            code = 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGITS else 3
        return _filled(text, digits[:code] + self._digits("phone", digits[code:]))

    def _email(self, text: str) -> str | None:
        return _filled(text, self._classes("email", "".join(c for c in text if c.isalnum())))

    def of(self, kind: str, text: str) -> tuple[str, str] | None:
        """Kind and pseudonym of a value in its format; None if it isn't valid."""
        if (kind, text) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            new = getattr(self, f"_{kind}")(text)
            self.known[kind, text] = None if new is None else (kind, new)
        return self.known[kind, text]

    def __call__(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)
        if not text or not _HINT.search(text):
            return text, counts
        out, done, at, refused = [], 0, 0, 0
        while found := _FOUND.search(text, at):
            kind = next(k for k in ("iban", "email", "ip", "date", "ssn", "phone", "card") if found[k] is not None)
            start, new, end = found.start(), *self._read(kind, found[0])
            if not new and kind == "card":
                new, end = self._read("account", found[0])
                # the numbers of an IBAN that isn't valid are no account with something behind it
                if new and (start < refused and end < len(found[0]) or self._card_across(text, start, start + end)):
                    new = None
            if not new and kind == "iban":
                refused = found.end()
            # what isn't valid may still begin with, or hold, another kind of value
            at = start + end if new else _next_start(text, found)
            if new:
                counts[new[0]] += 1
                out += (text[done:start], new[1])
                done = at
        return "".join([*out, text[done:]]), counts

    def _read(self, kind: str, text: str) -> tuple[tuple[str, str] | None, int]:
        """The longest valid reading of `text` that ends with one of its groups, and its length."""
        borders = _BORDERS.get("card" if kind == "account" else kind, "")
        for end in range(len(text), 0, -1):
            if (end == len(text) or text[end] in borders) and (new := self.of(kind, text[:end])):
                return new, end
        return None, 0

    def _card_across(self, text: str, start: int, end: int) -> bool:
        """Whether a valid card starts with a later group of text[start:end] and ends behind it."""
        for at in range(start + 1, end):
            if text[at - 1] in _BORDERS["card"] and (found := _CARD.match(text, at)) and at + self._read("card", found[0])[1] > end:
                return True
        return False


def _next_start(text: str, found: re.Match) -> int:
    """After a find that isn't valid: the end of the run of letters or digits it starts with."""
    at = found.start() + 1
    while at < found.end() and text[at].isalnum():
        at += 1
    return at


def pseudonymise(docs: DataFrame, key: bytes = KEY, undo: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of values of each kind, for every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = Pseudonyms(key, undo)
        for batch in small_batches(batches):
            found = [replace(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([c[k] for _, c in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), *counts], ["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
