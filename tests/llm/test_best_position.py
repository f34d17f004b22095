from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from palimpsest.llm import best_position as op

from .helpers import ODD, clashing, docs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, top=50):
    held = [(d, Counter(terms(t))) for d, t in rows]
    held = [(d, c, c.total()) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for d, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def check(spark, rows, items, **sizes):
    made = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = op.search(clashing(docs(spark, rows)), made, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, items, sizes.get("top", op.TOP))


def test_odd_texts_ties_repeats_and_nulls(spark):
    rows = [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "word x"), (None, "word x"), (7, "x word"), (7, "x word"), (8, "ÉTÉ été x-y a1b2"), (9, "!!! ...")]
    items = [(1, "word"), (2, "x WORD x"), (3, None), (4, ""), (5, "été ß a1b2 😀"), (6, "unknown terms only"), (None, "word"), (1, "a"), (1, "a"), (10, "...")]
    check(spark, rows, items)


def zipf_rows(seed, n, vocabulary=300):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    chances = [1 / (k + 1) for k in range(vocabulary)]
    rows = [(i * 7 % 10_007, " ".join(draw.choices(words, chances, k=draw.randrange(1, 80)))) for i in range(n)]
    rows += [(20_000 + i, "w3 w50 w299 copies") for i in range(n // 3)]  # a hot group of equal scores
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 25)))) for i in range(30)] + [(99, "copies w3")]
    return rows, items


@pytest.mark.parametrize("sizes", [{}, {"top": 1}, {"top": 7, "block_terms": 40, "shard": 100}])
def test_against_brute_force(spark, sizes):
    check(spark, *zipf_rows(3, 900), **sizes)


def test_empty_tables(spark):
    some, none = docs(spark, [(1, "word")]), docs(spark, [])
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert op.search(none, items).collect() == [] and op.search(some, items.limit(0)).collect() == []
    assert op.search(docs(spark, [(1, None), (2, " ")]), items).collect() == []


def test_reading_stops_at_the_best_positions(monkeypatch):
    """Far fewer documents are looked up than the lists hold, and the result has every tie."""
    draw = np.random.default_rng(1)
    documents, vocabulary = 20_000, 6
    impact = draw.zipf(1.6, (documents, vocabulary)).clip(0, 10_000)
    doc, term = np.nonzero(draw.random((documents, vocabulary)) < 0.5)
    shard = op.Shard(term, doc, impact[doc, term], documents, vocabulary)
    looked, honest = [], shard.positions
    shard.positions = lambda d: looked.append(len(d)) or honest(d)
    asked = np.ones(vocabulary, bool)
    found, scores = shard.best(np.arange(vocabulary), asked, 10)
    held = np.zeros(documents, np.int64)
    np.add.at(held, doc, impact[doc, term])
    tenth = np.sort(held)[-10]
    assert sorted(found.tolist()) == np.flatnonzero(held >= tenth).tolist() and (scores == held[found]).all()
    assert sum(looked) < documents / 4 and not shard.known.any()
