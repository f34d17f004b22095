from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from palimpsest.llm import periodic_runs as op
from palimpsest.llm import queries

from .helpers import ODD, clashing, docs, prose


def plain_lyndon(codes):
    def longest(i):
        n = len(codes)
        return max(k for k in range(1, n - i + 1) if all(codes[i : i + k] < codes[i + s : i + k] for s in range(1, k)))

    return [longest(i) for i in range(len(codes))]


def smallest_period(codes):
    return next(q for q in range(1, len(codes) + 1) if all(a == b for a, b in zip(codes, codes[q:], strict=False)))


def plain_runs(codes, least=24, times=3):
    out, n = [], len(codes)
    for q in range(1, n // times + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and codes[end] == codes[end - q]:
                end += 1
            if end - start >= max(least, times * q) and smallest_period(codes[start:end]) == q:
                out.append((start, end - start, q))
            start = max(start + 1, end - q + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_texts():
    """Repetitive sequences: Fibonacci and Thue-Morse words, powers, powers in powers, noise between."""
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 250:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    morse = [bin(i).count("1") % 2 for i in range(256)]
    out = [[], [0], fibonacci[-1], [1 - x for x in fibonacci[-1]], morse, [0] * 100, [0, 1] * 40, ([0, 1] * 20 + [2]) * 4, ([0] * 30 + [1]) * 5]
    for seed in range(60):
        draw = random.Random(seed)
        seq = []
        while len(seq) < 150:
            root = [draw.randrange(draw.choice([1, 2, 3, 9])) for _ in range(draw.randrange(1, 14))]
            power = root * draw.randrange(1, 12)
            seq += power[: len(power) - draw.randrange(len(root))] + [draw.randrange(40) for _ in range(draw.randrange(3))]
        out.append(seq)
    return out


@pytest.mark.parametrize("seq", made_texts()[:40])
def test_lyndon_arrays(seq):
    short = seq[:80]
    assert op.lyndon_array(short) == plain_lyndon(short)
    top = max(short, default=0)
    assert op.lyndon_array([top - x for x in short]) == plain_lyndon([top - x for x in short])


@pytest.mark.parametrize("seq", made_texts())
@pytest.mark.parametrize(("least", "times"), [(24, 3), (2, 2), (5, 3)])
def test_runs_against_brute_force(seq, least, times):
    got = [tuple(r) for r in op.runs_of(np.array(seq, np.int64), least, times).tolist()]
    assert got == plain_runs(seq, least, times)


def test_hashes_do_not_deceive_here(monkeypatch):
    monkeypatch.setattr(op, "_extended_plainly", None)
    for seq in [*made_texts(), [bin(i).count("1") % 2 for i in range(1 << 13)]]:
        op.runs_of(np.array(seq, np.int64), 4, 2)


def test_deceiving_hashes_are_found_out(monkeypatch):
    honest = op._equal_length
    monkeypatch.setattr(op, "_equal_length", lambda *a: np.minimum(honest(*a) + 1, a[3]))
    for seq in made_texts()[:20]:
        assert [tuple(r) for r in op.runs_of(np.array(seq, np.int64)).tolist()] == plain_runs(seq)


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    head = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (doc_id, len(runs), *head, digest(told), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_on_small_tables(spark, tmp_path):
    rows = [(1000 + i, t if t is None or len(t) < 20_000 else t[:2000]) for i, t in enumerate(ODD)] + [(None, "a b " * 30), (5, "x y z " * 9), (5, "x y z " * 9)]
    rows += [(i, prose(i, 150 + i, 40 if i % 2 else 4000)) for i in range(60)]
    rows += [(2000 + i, " ".join(f"t{c}" for c in seq)) for i, seq in enumerate(made_texts()[:30])]
    clashing(docs(spark, rows)).withColumn("words", op.F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    want = [plain_row(*r) for r in rows]
    assert sum(r[1] > 0 for r in want) > 30
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_very_long_run_and_empty_table(spark):
    long_text = "word " * 200_000
    row = op.collapsed(docs(spark, [(1, long_text)])).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 200_000, 1)] and row["text"] == "word"
    assert op.summary(op.collapsed(docs(spark, []))).collect() == []
