from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from palimpsest.llm import simhash as op

from .helpers import ODD, clashing, docs, prose


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, linked):
    at = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]) and at[i] != at[j]:
                at = [min(at[i], at[j]) if x in (at[i], at[j]) else x for x in at]
    return at


def near(a, b):
    return (a ^ b).bit_count() <= 4


def check(spark, rows):
    fps = [plain_simhash(t) for _, t in rows]
    at = roots(fps, near)
    least = {r: min((rows[i][0] for i in range(len(rows)) if at[i] == r and rows[i][0] is not None), default=None) for r in set(at)}
    want = sorted(((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, fps, at, strict=True)), key=str)
    assert sorted((tuple(r) for r in op.near_groups(clashing(docs(spark, rows))).collect()), key=str) == want


def test_odd_texts_and_near_copies(spark):
    rows = [(100 + i, t) for i, t in enumerate(ODD)] + [(None, ""), (7, "A"), (7, "A")]
    for k in range(12):
        words = prose(k, 220).split()
        for j in range(6):
            copy = list(words)
            for _ in range(j):
                copy[random.Random(k * 10 + j).randrange(len(copy))] = "CHANGED"
            rows.append((1000 + 10 * k + j, " ".join(copy)))
    check(spark, rows)


def test_empty_table(spark):
    assert op.near_groups(docs(spark, [])).collect() == []


def fingerprint_sample(seed, n):
    draw = random.Random(seed)
    out = {draw.getrandbits(64) for _ in range(n // 3)}
    while len(out) < n:  # chains and balls around some of them
        f = draw.choice(list(out)[:40])
        for _ in range(draw.randrange(1, 6)):
            f ^= 1 << draw.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("n", [3, 64, 65, 130, 300])
def test_tiles_find_every_link(n):
    fps = fingerprint_sample(n, n)
    a, b = op.clusters(np.array(fps, np.uint64))
    index = {f: i for i, f in enumerate(fps)}
    pairs = [(index[int(x)], index[int(y)]) for x, y in zip(a, b, strict=True)]
    assert roots(range(n), lambda i, j: (i, j) in pairs or (j, i) in pairs) == roots(fps, near)


@pytest.mark.parametrize("radius", [0, 2, 4, 7])
def test_two_sides_and_radius(radius):
    fps = fingerprint_sample(radius, 200)
    left, right = np.array(fps[::2], np.uint64), np.array(fps[1::2], np.uint64)
    where, within = op.near(left, right, False, radius)
    got = {(int(i), int(j)) for i, w in zip(where, within, strict=True) for j in np.flatnonzero(np.unpackbits(w.view(np.uint8), bitorder="little"))}
    assert got == {(i, j) for i in range(len(left)) for j in range(len(right)) if (int(left[i]) ^ int(right[j])).bit_count() <= radius}


def test_longer_keys_lose_no_link():
    fps = [random.Random(i).getrandbits(64) for i in range(300)]
    for distinct in (10**3, 10**7, 10**9, 10**11):
        masks = op.plan_keys(distinct)
        for i, f in enumerate(fps):
            g = f
            for b in random.Random(i).sample(range(64), 4):
                g ^= 1 << b
            assert any(f & m == g & m for m in masks)
    assert len(op.plan_keys(10**3)) == 5 < len(op.plan_keys(10**11))


def test_chunked_groups(spark):
    fps = fingerprint_sample(5, 300)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = op.components(op.links(spark.createDataFrame(signed, "fp long"), tile=7)).collect()
    root = {r["node"]: r["root"] for r in got}
    want = roots(fps, near)
    mine = [root.get(s, s) for (s,) in signed]
    assert [[m == n for n in mine] for m in mine] == [[w == x for x in want] for w in want]
