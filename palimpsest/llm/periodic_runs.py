"""Periodic runs of words, from Lyndon arrays made by Baier's grouping.

A run is a stretch of words with smallest period q, at least LEAST words and
TIMES periods long, that no neighbouring word extends. Every run has a Lyndon
root, under some order of the words or its reverse, that is the longest Lyndon
word at a place inside the run. So the two Lyndon arrays of a text name all
candidates (place, period), and each is extended to both sides as far as words
one period apart are equal.

Lyndon arrays come out of the first phase of Baier's suffix sorter directly:
suffixes are grouped by their first word, groups are taken from the highest to
the lowest, and each lets the nearest lower suffix to the left of its members
rise into a group just above its own, longer by the members it stands before.
When a group is taken its common prefix is the longest Lyndon word at each of
its places. Nothing is sorted beyond that.

Common extensions (LCE) are found for all candidates of a stretch at once, by
halving on prefix sums of word hashes; what they give is held against the words
themselves, and a stretch where hashes deceive is extended word by word.

A run holds each of its words at least three times, so a word that a stretch
holds less often parts it. Stretches are cut so until nothing changes, MOST_CUTS times
at most; those under LEAST words hold no run and are not grouped. Texts without repeats
therefore cost a count of their words.

Each text is worked on by itself in the task that reads it; nothing is shuffled
until the caller does so.

Defined results: a null text has no words. Rows that repeat a doc_id are texts
of their own. An empty table gives an empty result. Only doc_id and text are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import small_batches

#: Least words and least periods of a run; TIMES must be at least 2.
LEAST = 24
TIMES = 3
#: Primes under 2^32 and bases of the two prefix hashes.
HASHES = ((4294967291, 1000003), (4294967279, 998244353))
#: Times that a part is cut further before it is taken as it is.
MOST_CUTS = 8
WORD = r"[^\x20\x09-\x0D]+"

RUNS = "array<struct<start:long,length:long,period:long>>"


def lyndon_array(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every place of `codes` (numbers from 0, ordered as numbers)."""
    n, groups = len(codes), max(codes, default=-1) + 1
    group = list(codes)  # the group that each suffix is in
    members: list[list[int]] = [[] for _ in range(groups)]
    for i, c in enumerate(codes):
        members[c].append(i)
    lower, higher = list(range(-1, groups - 1)), list(range(1, groups + 1))
    width = [1] * groups  # length of what the suffixes of a group have in common
    before, after = list(range(-1, n)), list(range(1, n + 2))  # the nearest places whose group is still to come
    out = [0] * n
    current = groups - 1
    while current >= 0:
        size, risen = width[current], {}
        for i in members[current]:  # from left to right
            if group[i] != current:
                continue
            out[i] = size
            left, right = before[i], after[i]
            before[right] = left
            if left >= 0:
                after[left] = right
                risen[left] = risen.get(left, 0) + 1
        made: dict[tuple[int, int], int] = {}
        for j, times in risen.items():
            old = group[j]
            new = made.get((times, old))
            if new is None:
                new = made[times, old] = len(members)
                members.append([])
                width.append(width[old] + times * size)
                lower.append(-1)
                higher.append(-1)
            group[j] = new
            members[new].append(j)
        # just above the old group; who stands before more members of this one rises higher
        for times, old in sorted(made, reverse=True):
            new, up = made[times, old], higher[old]
            lower[new], higher[new], lower[up], higher[old] = old, up, new, new
        members[current] = []
        current = lower[current]
    return out


def stretches(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Parts (from, to) of `codes` outside which no run lies; a word that a part holds under `times` times ends it."""
    out, due = [], [(0, len(codes), 0)]
    while due:
        a, b, cuts = due.pop()
        if b - a < max(least, times):
            continue
        _, inverse, counts = np.unique(codes[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[inverse] < times)
        if not len(rare) or cuts == MOST_CUTS:
            out.append((a, b))
            continue
        edges = np.concatenate([[-1], rare, [b - a]])
        for k in np.flatnonzero(np.diff(edges) > least).tolist():
            due.append((a + int(edges[k]) + 1, a + int(edges[k + 1]), cuts + 1))
    return sorted(out)


def _prefix_hashes(codes: np.ndarray, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of `base`, and sums of the words up to each place times them, by a prime under 2^32."""
    n, p = len(codes), np.uint64(prime)
    powers = np.ones(1, np.uint64)
    while len(powers) <= n:  # the powers so far, and those times the next one
        powers = np.append(powers, powers * (powers[-1] * np.uint64(base) % p) % p)
    words = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(2654435761) % p
    terms = words * powers[:n] % p
    return powers, np.append(np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64) % p)


def _equal_length(codes: np.ndarray, one: np.ndarray, two: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each pair of places, how many words from there on are equal, up to `most`; too many where hashes deceive."""
    tables = [(np.uint64(prime), *_prefix_hashes(codes, prime, base)) for prime, base in HASHES]
    out = np.zeros(len(one), np.int64)
    for k in reversed(range(int(most.max(initial=0)).bit_length())):
        longer = out + (1 << k)
        same = longer <= most
        longer = np.minimum(longer, most)
        for p, powers, sums in tables:
            left, right = (sums[at + longer] + p - sums[at] for at in (one, two))
            same &= left % p * powers[two - one] % p == right % p
        out = np.where(same, longer, out)
    return out


def _extended(codes: np.ndarray, place: np.ndarray, period: np.ndarray) -> np.ndarray:
    """start, length, period of the stretch that each candidate extends to."""
    n, back = len(codes), codes[::-1]
    right = _equal_length(codes, place, place + period, n - place - period)
    left = _equal_length(back, n - place - period, n - place, place)
    return np.stack([place - left, left + period + right, period], axis=1)


def _is_run(codes: np.ndarray, start: int, length: int, period: int) -> bool:
    end = start + length
    return (
        np.array_equal(codes[start : end - period], codes[start + period : end])
        and (start == 0 or codes[start - 1] != codes[start - 1 + period])
        and (end == len(codes) or codes[end] != codes[end - period])
    )


def _extended_plainly(codes: list[int], place: int, period: int) -> tuple[int, int, int]:
    start, end = place, place + period
    while start and codes[start - 1] == codes[start - 1 + period]:
        start -= 1
    while end < len(codes) and codes[end] == codes[end - period]:
        end += 1
    return start, end - start, period


def _runs_of_stretch(codes: np.ndarray, least: int, times: int) -> np.ndarray:
    _, inverse = np.unique(codes, return_inverse=True)
    n, top = len(inverse), int(inverse.max())
    roots = np.concatenate([lyndon_array(inverse.tolist()), lyndon_array((top - inverse).tolist())]).astype(np.int64)
    place = np.tile(np.arange(n), 2)
    good = (times * roots <= n) & (place + roots < n)
    place, period = place[good], roots[good]
    good = inverse[place] == inverse[place + period]
    place, period = place[good], period[good]
    found = _extended(inverse, place, period)
    found = np.unique(found[found[:, 1] >= np.maximum(least, times * period)], axis=0)
    if not all(_is_run(inverse, *run) for run in found.tolist()):
        plain = inverse.tolist()
        found = np.array([_extended_plainly(plain, i, p) for i, p in zip(place.tolist(), period.tolist(), strict=True)]).reshape(-1, 3)
        found = np.unique(found[found[:, 1] >= np.maximum(least, times * found[:, 2])], axis=0)
    return found


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """start, length and period of every run in `codes`, by start, then period."""
    found = [_runs_of_stretch(codes[a:b], least, times) + [a, 0, 0] for a, b in stretches(codes, least, times)]
    every = np.concatenate([np.zeros((0, 3), np.int64), *found])
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text without the repeats of its runs, its words parted by one space, for every row of `docs`."""

    def one(raw: bytes) -> tuple[int, list[dict], bytes]:
        words = raw.split()  # on bytes: the six ASCII white-space characters
        numbers: dict[bytes, int] = {}
        codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        runs = runs_of(codes, least, times)
        if len(runs):
            words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
        return len(codes), [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()], b" ".join(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in small_batches(batches):
            found = [one(t or b"") for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), kind, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "runs", "text"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, text binary").withColumn("text", F.col("text").cast("string"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of the runs and of the text, of `collapsed` rows."""

    def higher(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    top = F.aggregate("runs", F.lit(None).cast(RUNS[len("array<") : -1]), higher)
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    found = found.withColumn("top", top)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
