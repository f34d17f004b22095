from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from palimpsest.llm import phrase_dedup as op

from .helpers import ODD, clashing, docs, prose


def brute(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, length):
    got = op.summary(op.deduplicated(clashing(docs(spark, rows)), length)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def mosaic(seed, n, passages, sizes):
    """Texts of fresh prose with passages put in whole, cut short, or changed by a letter."""
    draw, out = random.Random(seed), []
    for i in range(n):
        parts = []
        for _ in range(draw.randrange(1, 6)):
            parts.append(prose(draw.randrange(10**9), draw.randrange(1, 60), 10**6))
            p = draw.choice(passages)
            a = draw.randrange(len(p))
            p = draw.choice((p, p[a : a + draw.choice(sizes)], p[:a] + "#" + p[a + 1 :]))
            parts.append(p)
        out.append((i, "é".join(parts)))
    return out


@pytest.mark.parametrize(("seed", "length"), [(1, 400), (2, 400), (3, 100), (4, 48)])
def test_same_as_a_count_of_all_strings(spark, seed, length):
    passages = [prose(seed * 100 + k, 150, 10**5) for k in range(5)] + ["ab " * 300, "=" * 900, prose(7, 12, 50) * 30]
    rows = mosaic(seed, 60, passages, (length - 1, length, length + 1, length + 40))
    check(spark, rows + [(90, rows[3][1]), (91, rows[3][1][5:]), (3, rows[3][1]), (4, "unlike " + rows[4][1]), (None, passages[0]), (None, passages[1])], length)


def test_odd_texts(spark):
    odd = [t if t is None or len(t) < 5000 else t[:5000] for t in ODD]
    check(spark, list(enumerate(odd)) + [(50 + i, t) for i, t in enumerate(odd)], 400)


def test_folds_in_many_steps(spark, monkeypatch):
    monkeypatch.setattr(op, "FOLD", 50)
    check(spark, mosaic(5, 40, [prose(k, 120) for k in range(3)], (399, 400)), 400)


def test_empty_table(spark):
    check(spark, [], 400)


def test_one_letter_runs(spark):
    check(spark, [(1, "a" * 399), (2, "a" * 400), (3, "b" * 401), (4, "b" * 399 + "c"), (5, "x" + "b" * 399)], 400)
    check(spark, [(1, "a" * 399), (2, "a" * 400)], 400)
