from __future__ import annotations

import hashlib
import random
import re

from palimpsest.llm import exact_dedup as op

from .helpers import ODD, clashing, docs


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        text = text or ""
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text).encode()).hexdigest()
        groups.setdefault(digest, []).append((doc_id is None, -len(text), doc_id))
    out = []
    for digest, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(m[2], keep, len(members), m[2] == keep, digest) for m in members]
    return sorted(out, key=str)


def check(spark, rows):
    got = [tuple(r) for r in op.exact_groups(clashing(docs(spark, rows))).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_odd_texts_ties_and_repeats(spark):
    rows = list(enumerate(ODD)) + [(50 + i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "a"), (None, "only"), (None, "only"), (90, "w o r d"), (91, "word "), (92, " word")]
    check(spark, rows)


def test_hot_group(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 40}") for i in range(600)]
    check(spark, rows)


def test_empty_table(spark):
    assert op.exact_groups(docs(spark, [])).collect() == []


def test_filter_grows_deletes_and_travels():
    rng, bucket = random.Random(1), op.Bucket(cells=2)
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    for i, k in enumerate(keys):
        bucket.insert(k, i, 1, 1)
    assert len(bucket.filter.cells) > 500 and all(k in bucket.filter for k in keys)
    gone = set(rng.sample(keys, 1000))
    for k in gone:
        bucket.delete(k)
        bucket.delete(k)
    live = [k for k in keys if k not in gone]
    again = op.CuckooFilter.from_bytes(bucket.filter.to_bytes())
    assert all(k in again for k in live) and bucket.size == len(live)
    assert sum(k in again for k in gone) < 20


def test_index_inserts_deletes_and_answers(spark):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    made = lambda rows: spark.createDataFrame(rows, op.CHANGES)
    first = op.cut(op.update(op.empty_index(spark), made([(digest(i), i, 5, 1) for i in range(50)]), 8))
    second = op.cut(op.update(first, made([(digest(i), None, None, 0) for i in range(0, 20, 2)] + [(digest(1), 0, 5, 2), (digest(99), 99, 5, 1)]), 8))
    asked = spark.createDataFrame([(digest(i), i) for i in (0, 1, 3, 99, 77)], "digest string, n int")
    got = {r["n"]: (r["keep_id"], r["copies"]) for r in op.lookup(second, asked, 8).collect()}
    assert got == {1: (0, 3), 3: (3, 1), 99: (99, 1)}
