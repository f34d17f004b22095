from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from palimpsest.llm import line_index as op

from .helpers import ODD, clashing, docs


def key_of(line):
    bare = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return re.sub("[A-Z]", lambda m: m[0].lower(), bare)


def brute(rows):
    order = lambda d: (d is None, d or 0)
    holder = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 10:
                holder.setdefault(key_of(line), set()).add(order(d))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key_of(x)) >= 10 and min(holder[key_of(x)]) < order(d))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **sizes):
    found = op.summary(op.deduplicated(clashing(docs(spark, rows)), **sizes))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_odd_texts_ties_and_repeats(spark):
    rows = [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, t) for i, t in enumerate(ODD)]
    rows += [(7, "Common line here\nown line of seven"), (7, "Common line here\nown line of seven"), (None, "common LINE here\nonly null holds this"), (None, "only null holds this")]
    rows += [(8, "  common line here\t\n\n\nÉÉÉÉÉÉÉÉÉÉ\nééééééééé"), (9, "ÉÉÉÉÉÉÉÉÉÉ \nééééééééé\n123456789\n1234567890"), (10, "1234567890\n123456789\nÉÉÉÉÉÉÉÉÉÉ")]
    rows += [(11, "same line twice\nsame line twice\nother"), (12, "same line twice"), (13, "\x1cseparators stay\x1c"), (14, "separators stay")]
    check(spark, rows)


@pytest.mark.parametrize("sizes", [{}, {"fold": 3, "shard_keys": 4, "asked": 5}])
def test_hot_line_over_folds_shards_and_copies(spark, sizes):
    draw = random.Random(5)
    rows = []
    for i in range(400):
        lines = [f"line number {draw.randrange(300)} of the pool" for _ in range(draw.randrange(6))]
        rows.append((i * 3 % 1201, "\n".join(lines + ["the line that is everywhere"] * (i % 3 == 0))))
    check(spark, rows, **sizes)


def test_empty_table(spark):
    assert op.deduplicated(docs(spark, [])).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_perfect_hash_is_minimal(n):
    draw = np.random.default_rng(n)
    h1 = draw.integers(-(1 << 63), (1 << 63) - 1, n)
    h2 = draw.integers(-(1 << 63), (1 << 63) - 1, n)
    h1[: n // 3] = h1[:1]  # equal halves must still be told apart
    hashed = op.PerfectHash.of(h1, h2)
    assert sorted(hashed.places(h1, h2).tolist()) == list(range(n))


def test_keys_that_no_level_parts_are_listed(monkeypatch):
    monkeypatch.setattr(op, "LEVELS", 1)
    h = np.arange(1000) * 7919
    hashed = op.PerfectHash.of(h, h[::-1].copy())
    assert len(hashed.rest) and sorted(hashed.places(h, h[::-1].copy()).tolist()) == list(range(1000))


def test_unknown_lines_are_told_by_their_fingerprint(spark):
    known = op.folded(op.texts(docs(spark, [(i, f"known line {i}\nheld by all of them") for i in range(200)])))
    index = op.cut(op.build(known, 3))
    asked = op.folded(op.texts(docs(spark, [(1000, "\n".join(f"unknown line {i}" for i in range(5000))), (1001, "known line 7\nheld by all of them")])))
    got = sorted((r["holders"], r["smallest"]) for r in op.probe(index, asked, 3).collect())
    assert got[-2:] == [(1, 7), (200, 0)] and got[:5000] == [(0, op.NO_ID)] * 5000
    shards = index.collect()
    assert sum(r["keys"] for r in shards) == 201 and all(len(r["marks"]) == 8 * r["keys"] and len(r["counts"]) == 4 * r["keys"] for r in shards)
