from __future__ import annotations

import hashlib
import random
import re
from itertools import accumulate

from palimpsest.llm import secret_ledger as op
from pyspark.sql import functions as F

from .helpers import ODD, clashing, docs

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
MORE = [(r.kind, re.compile(r.pattern), lambda m: True) for r in op.RULES[3:]]


def brute(text, rules):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(rules) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def samples():
    draw = random.Random(3)
    bits = ["token", "= ", ":", '"', "'", " ", "secret", "API_KEY=", "apikey: ", "Passwd", "AKIA", "AKIAAKIA", "A1B2C3D4E5F6G7H8", "abcdef0123456789" * 2, "f" * 31, "é😀", "\n", "x", "ſecret=longenough", "/+=._-", "short"]
    bits += ["-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "ghp_" + "a1" * 20, "12345678"]
    return ["".join(draw.choice(bits) for _ in range(draw.randrange(1, 25))) for _ in range(250)]


def test_same_spans_as_plain_search(spark):
    texts = samples() + ODD + ["token=" + "a" * 9 + " "] + ["token=abcdefgh " * 700]
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, texts[6]), (None, texts[7]), (None, texts[8])]
    got = op.secrets(clashing(docs(spark, rows))).collect()
    want = []
    for doc_id, text in rows:
        base = brute(text, BASE)
        counts = tuple(sum(s.startswith(k + ":") for s in base.split(",")) for k in ("assign", "access", "hex"))
        want.append((doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), brute(text, BASE + MORE)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_only_unseen_pairs_are_scanned(spark):
    first = docs(spark, [(1, "token=abcdefgh"), (2, "nothing"), (3, "token=abcdefgh")])
    base, pem = op.RULES[:3], op.RULES[:4]
    ledger, _ = op.update(op.empty_ledger(spark), first, rules=base)
    assert ledger.count() == 2
    # another path, one new blob
    second = docs(spark, [(9, "nothing"), (10, "-----BEGIN PRIVATE KEY----- password: 12345678"), (11, "token=abcdefgh")])
    again, found = op.update(ledger, second, rules=base)
    assert again.count() == 3
    assert {r["path"]: len(r["spans"]) for r in found.collect()} == {9: 0, 10: 1, 11: 1}
    # a new rule runs alone on the old blobs
    newer, found = op.update(again, second, rules=pem)
    added = newer.join(again, ["blob", "rules"], "left_anti").collect()
    assert len(added) == 3 and all(r["rules"] == [pem[3].version] for r in added)
    assert {r["path"]: [s["kind"] for s in r["spans"]] for r in found.collect()} == {9: [], 10: ["pem", "assign"], 11: ["assign"]}
    # nothing new: nothing to scan
    assert op.update(newer, second, rules=pem)[0].count() == newer.count()


def test_empty_table(spark):
    assert op.secrets(docs(spark, [])).collect() == []


def test_running_sum(spark):
    draw = random.Random(1)
    arrays = [[draw.randrange(100) for _ in range(n)] for n in (0, 1, 2, 255, 256, 257, 512, 1000)]
    df = spark.createDataFrame([(a,) for a in arrays], "a array<bigint>").select("a", op.running_sum(F.col("a")).alias("s"))
    assert all(r["s"] == list(accumulate(r["a"])) for r in df.collect())
