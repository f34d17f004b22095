"""Language identification by rank-order profiles of letter n-grams.

A profile lists the PROFILE most frequent n-grams (1 to 3 letters of a word, the
ends of the word counting as letters of their own) of all training texts of a
language. A document's own list is compared to each: an n-gram found d places
away adds d, one that the profile lacks adds PROFILE, and the smallest sum wins.
Ties in a list go by the n-gram's code points, ties between languages by name.

An n-gram is a number: its code points side by side, so that numbers sort as
the n-grams do. Each task sums the n-grams it meets before anything is shuffled,
and lists are cut per task and language before they meet.

Defined results: `und` with score 0 for a text without a letter, null included,
and for all texts if there is nothing to learn from. Score is 1 less the share
of the largest possible distance. Words are runs of letters, in lower case.
Training reads text and lang of documents that are not held out; a null lang is
not learned. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, held_out, small_batches

PROFILE = 300
UNDETERMINED = "und"
#: Profiles that are broadcast: more learned languages than this are refused, not dropped.
MOST_LANGUAGES = 5000
#: Code points of a language that a task gathers before it counts them, and n-grams before it hands them on.
GATHER = 1 << 20
REMEMBERED = 1 << 20
#: Code points from here on are no letters.
NO_LETTERS = 0x32400
#: The end of a word; no letter.
EDGE = ord("_")
BITS = 21


def letters() -> np.ndarray:
    """For each code point that may be a letter, itself; EDGE for the others."""
    return np.array([c if chr(c).isalpha() else EDGE for c in range(NO_LETTERS)] + [EDGE], np.int64)


def ngrams(text: str, known: np.ndarray) -> np.ndarray:
    """Numbers of all n-grams of a text, in no order."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    points = known[np.minimum(points, NO_LETTERS)]
    edge = points == EDGE
    if edge.all():
        return np.zeros(0, np.int64)
    # one edge between words, one before the first and one after the last
    keep = np.ones(len(points), bool)
    keep[1:] = ~(edge[1:] & edge[:-1])
    points = points[keep]
    points = np.concatenate([[EDGE] * int(points[0] != EDGE), points, [EDGE] * int(points[-1] != EDGE)]).astype(np.int64)
    inner = points != EDGE
    first, second = points << 2 * BITS, points << BITS
    middle = inner[1:-1]
    return np.concatenate([first[inner], first[:-1] | second[1:], (first[:-2] | second[1:-1] | points[2:])[middle]])


def ranked(text: str | None, known: np.ndarray, length: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams, the most frequent first."""
    found, counts = np.unique(ngrams(text or "", known), return_counts=True)
    if len(found) > length:
        enough = counts >= np.partition(counts, -length)[-length]
        found, counts = found[enough], counts[enough]
    return found[np.argsort(-counts, kind="stable")][:length]


def profiles(docs: DataFrame) -> dict[str, list[int]]:
    """Language to its n-grams, the most frequent first, from all documents that may be learned from."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = letters()
        texts: dict[str, list[str]] = defaultdict(list)
        gathered: dict[str, int] = defaultdict(int)
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def count(lang: str) -> None:
            grams, counts = np.unique(ngrams("\n".join(texts.pop(lang)), known), return_counts=True)
            gathered[lang] = 0
            if lang in sums:
                grams, counts = np.concatenate([sums[lang][0], grams]), np.concatenate([sums[lang][1], counts])
                grams, number = np.unique(grams, return_inverse=True)
                counts = np.bincount(number, counts).astype(np.int64)
            sums[lang] = grams, counts

        def told() -> Iterator[pa.RecordBatch]:
            for lang in list(texts):
                count(lang)
            for lang, (grams, counts) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])
            sums.clear()

        for batch in small_batches(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts[lang].append(text)
                gathered[lang] += len(text)
                if gathered[lang] > GATHER:
                    count(lang)
            if sum(len(s[0]) for s in sums.values()) > REMEMBERED or sum(gathered.values()) > 8 * GATHER:
                yield from told()
        yield from told()

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    counts = rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = cut(counts.withColumn("place", place).filter(F.col("place") <= PROFILE).select("lang", "gram", "place"))
    if top.count() > PROFILE * MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages to learn")
    out: dict[str, list[int]] = defaultdict(list)
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["place"])):
        out[r["lang"]].append(r["gram"])
    return dict(out)


class Judge:
    """Out-of-place distances of a ranked list to every profile at once."""

    def __init__(self, learned: dict[str, list[int]]):
        self.langs = sorted(learned)
        self.grams = np.unique(np.array([g for p in learned.values() for g in p], np.int64))
        self.places = np.full((len(self.grams) + 1, len(learned)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.places[np.searchsorted(self.grams, learned[lang]), i] = np.arange(len(learned[lang]))

    def __call__(self, grams: np.ndarray) -> tuple[str, float]:
        if not len(grams) or not self.langs:
            return UNDETERMINED, 0.0
        row = np.searchsorted(self.grams, grams)
        known = self.grams[np.minimum(row, len(self.grams) - 1)] == grams
        places = self.places[np.where(known, row, len(self.grams))]
        apart = np.abs(places - np.arange(len(grams))[:, None])
        sums = np.where(places < 0, PROFILE, apart).sum(axis=0)
        best = int(np.argmin(sums))
        return self.langs[best], 1 - float(sums[best]) / (PROFILE * len(grams))


def identify(docs: DataFrame, learned: dict[str, list[int]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, judge = letters(), Judge(shared.value)
        for batch in small_batches(batches):
            found = [judge(ranked(t, known)) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judged, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
