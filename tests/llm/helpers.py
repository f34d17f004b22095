"""Small document tables for the corpus operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Texts that every operator must take: null, empty, white space, marks, emoji, one very long text.
ODD = [None, "", " \t\n", "a", "É́ ß ﬀ", "😀 😀 😀", "\u0000x", "word " * 30_000, "x" * 50_000]


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    """Extra columns named like the ones that operators make for themselves."""
    from pyspark.sql import functions as F

    for name in ("digest", "fp", "bucket", "keep_id", "root", "tokens", "score", "topic", "blob", "piece"):
        df = df.withColumn(name, F.lit("x"))
    return df


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))
