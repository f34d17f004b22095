from __future__ import annotations

from collections import Counter

import regex
from palimpsest.llm import rank_language as op

from .helpers import ODD, clashing, docs

SF = "/root/testdata/sf0.01"


def plain_list(texts):
    counts = Counter()
    for text in texts:
        for word in regex.findall(r"\p{L}+", (text or "").lower()):
            padded = f"_{word}_"
            counts.update(word)
            counts.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][: op.PROFILE]


def named(gram):
    points = (gram >> 2 * op.BITS, gram >> op.BITS & (1 << op.BITS) - 1, gram & (1 << op.BITS) - 1)
    return "".join(chr(p) for p in points if p)


def brute(profiles, text):
    grams = plain_list([text])
    if not grams or not profiles:
        return "und", 0.0
    sums = {l: sum(abs(p.index(g) - i) if g in p else op.PROFILE for i, g in enumerate(grams)) for l, p in profiles.items()}
    best = min(sorted(sums), key=sums.get)
    return best, 1 - sums[best] / (op.PROFILE * len(grams))


def test_same_as_plain_lists(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table.collect()]
    rows += [(2000 + i, t, "en" if i % 2 else None) for i, t in enumerate(ODD[:7])] + [rows[0], (None, "x y", "xx"), (3000, "²³ ½", "zz"), (3001, None, "zz")]
    table = clashing(docs(spark, rows))
    held = {r["doc_id"] for r in table.select("doc_id").where(op.held_out(table["doc_id"])).collect()}
    learned = op.profiles(table)
    want = {}
    for lang in {r[2] for r in rows} - {None}:
        texts = [r[1] for r in rows if r[2] == lang and r[0] not in held]
        if plain_list(texts):
            want[lang] = plain_list(texts)
    assert {lang: [named(g) for g in p] for lang, p in learned.items()} == want
    got = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in op.identify(table, learned).collect()), key=str)
    assert got == sorted(((d, d in held, *(x if isinstance(x, str) else round(x, 9) for x in brute(want, t))) for d, t, _ in rows), key=str)


def test_no_letters_and_no_training(spark):
    table = docs(spark, [(0, "12 ²", "en"), (1, None, "en"), (2, "words", None)])
    learned = op.profiles(table)
    assert learned == {}
    assert {(r["lang_pred"], r["score"]) for r in op.identify(table, learned).collect()} == {("und", 0.0)}
    assert op.identify(docs(spark, []), learned).collect() == []


def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = op.identify(table, op.profiles(table)).filter("held_out").join(table.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.95
