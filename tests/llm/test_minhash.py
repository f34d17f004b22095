from __future__ import annotations

import hashlib
import random

import pytest
from palimpsest.llm import minhash as op
from pyspark.sql import functions as F

from .helpers import ODD, clashing, docs, prose


def jaccard(a, b):
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def mixed(a, b, share):
    """b with the first `share` of its words taken from a."""
    x, y = a.split(), b.split()
    n = round(len(x) * share)
    return " ".join(x[:n] + y[n:])


def test_likeness_follows_resemblance(spark):
    errors = []
    rows = []
    for words in (8, 30, 120, 600, 3000):
        for k in range(40):
            a, b = prose(words * 100 + k, words), prose(10**6 + words * 100 + k, words)
            rows.append((a, mixed(a, b, k / 40), words))
    df = spark.createDataFrame(rows, "a string, b string, words int")
    df = op.fingerprints(op.fingerprints(df, "a", "x"), "b", "y").withColumn("near", op.likeness(F.col("x"), F.col("y")))
    for r in df.collect():
        assert len(r["x"]) == op.BINS * op.BITS // 64
        errors.append((r["words"], r["near"] - jaccard(r["a"], r["b"])))
    for words in (120, 600, 3000):
        own = [e for w, e in errors if w == words]
        assert abs(sum(own) / len(own)) < 0.02
        assert max(map(abs, own)) < 0.13
    assert max(abs(e) for w, e in errors) < 0.5


def next_of(rows):
    places = sorted({(d, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for d, t in rows}, key=lambda p: (p[0] is not None, p[0] or 0, p[1]), reverse=True)
    return {p[:2]: places[(i + 1) % len(places)][2] for i, p in enumerate(places)}


def check(spark, rows):
    ahead = next_of(rows)
    got = op.edited_fingerprints(clashing(docs(spark, rows))).collect()
    want = []
    prints = {}
    for d, t in rows:
        t = t or ""
        after, k = ahead[d, hashlib.sha256(t.encode()).hexdigest()], len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["edited_sha256"], set()).add(r["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    return {r["doc_id"]: r for r in got}


def test_odd_texts_order_and_repeats(spark):
    rows = list(enumerate(ODD)) + [(20, "same words in two places here"), (21, "same words in two places here"), (22, "b"), (22, "b"), (22, "c"), (None, "no id"), (None, None)]
    by_id = check(spark, rows)
    assert by_id[20]["fingerprint"] == by_id[21]["fingerprint"] and by_id[21]["near_next"] == 1
    assert by_id[0]["fingerprint"] == by_id[2]["fingerprint"] == "" and len(by_id[3]["fingerprint"]) == op.BINS


def test_many_ranges(spark):
    draw = random.Random(2)
    ids = draw.sample(range(-(10**12), 10**12), 150)
    check(spark, [(i, prose(i, draw.randrange(0, 60))) for i in ids])


@pytest.mark.parametrize("rows", [[], [(1, "only one text here")], [(1, None)]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_every_bin_borrows_alike(spark):
    """With one shingle all bins hold its value; none stays empty."""
    df = spark.createDataFrame([("a b c d e",), ("one",)], "t string")
    for r in op.fingerprints(df, "t", "f").select(op.written(F.col("f")).alias("w")).collect():
        assert len(r["w"]) == op.BINS and len(set(r["w"])) == 1
