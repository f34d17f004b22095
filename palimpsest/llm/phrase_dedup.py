"""Removal of repeated passages by prefix-free parsing.

A byte is removed if a string of LENGTH bytes that covers it also starts
anywhere else. A rolling hash of TRIGGER bytes cuts each text into phrases:
where it hits, a phrase ends and the next begins. What a position's suffix of
LENGTH bytes looks like is then given by the rest of its phrase (the dictionary
part) and by what follows from the phrase's end (the parse part). Whether two
such suffixes are equal is all the contract asks, so the classes of the sorted
order are named by 128-bit digests instead of ranks, and nothing is sorted
across the corpus.

1. Positions of a phrase form up to three units by their distance to its end,
   and one unit each where no end is near. A unit has two names: `g` for all its
   suffixes together, and `k` for the part of the parse that each of them
   contains. Units whose `k` is met nowhere else are dropped; that is nearly all.
2. Units with a repeated `g` are covered as a whole: exact copies and the inside
   of long passages need no more.
3. What is left lies at the ends of repeats. Where its `k` is shared with another
   unit, the suffixes of both are named one by one, and equal names are covered.

Copies are folded in the task that reads them. What it finds repeated is settled
there, and one row for each name goes on to meet other tasks, so a passage that
a third of all texts share arrives as one row per task. Only step 3 joins on a
name, which adaptive execution splits. Texts are moved twice, by document; units
and names move without them.

Defined results: a null text is the empty text. Rows that repeat a doc_id are
documents of their own, and repeats of each other if their texts are. Texts under
LENGTH bytes lose nothing. An empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, small_batches

LENGTH = 400
#: Bytes that the rolling hash sees, a power of two, and phrases' mean length as a power of two.
TRIGGER = 16
MEAN_BITS = 6
#: Distances to the phrase's end, as shares of LENGTH, that bound the units of a phrase.
REACH = (0.2, 0.68, 0.92)
#: Units or suffixes that a task folds at a time.
FOLD = 1 << 18

_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
#: States of a row: a unit that may have equals, one that has, a run that is covered.
OPEN, MET, COVERED = 0, 1, 2

UNITS = "route long, doc long, tag int, p0 int, p1 int, g1 long, g2 long, k long, n int, state int"
NAMES = "h1 long, h2 long, doc long, tag int, p0 int, p1 int, n int, state int"


def phrase_ends(text: np.ndarray, mean_bits: int = MEAN_BITS) -> np.ndarray:
    """Places in the bytes `text` where the rolling hash of the next TRIGGER bytes hits."""
    if len(text) < TRIGGER:
        return np.zeros(0, np.int64)
    table = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
    hashed, step = table[text], 1
    for mix in _MIX[: TRIGGER.bit_length() - 1]:
        hashed = hashed[:-step] * np.uint32(mix) + hashed[step:]
        step *= 2
    return np.flatnonzero(hashed >> np.uint32(32 - mean_bits) == 0)


def reaches(length: int) -> list[tuple[int, int]]:
    """Distance bounds of the units of a phrase; what is farther from its end stands alone.

    A suffix must hold all that the rolling hash saw of the phrase's end.
    """
    bounds = [0, *(min(round(length * r), length - TRIGGER) for r in REACH)]
    return list(itertools.pairwise(bounds))


def units_of(raw: bytes, length: int) -> Iterator[tuple[int, int, bytes, int | None]]:
    """p0, p1, g, k of every unit: starts p0 … p1 - 1; without `k` the unit is one suffix and `g` its name."""
    last = len(raw) - length  # the last start
    if last < 0:
        return
    bounds = reaches(length)
    far, named, short = bounds[-1][1], xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
    starts = [0, *(t for t in phrase_ends(np.frombuffer(raw, np.uint8)).tolist() if t)]
    for a, e in zip(starts, [*starts[1:], None], strict=True):
        if a > last:
            break
        for p in range(a, last + 1 if e is None else min(e - far, last + 1)):
            yield p, p + 1, named(raw[p : p + length]), None
        if e is None:
            continue
        for rank, (lo, hi) in enumerate(bounds):
            p0, p1 = max(a, e - hi), min(e - lo, last + 1)
            if p0 < p1:
                yield p0, p1, named(raw[p0 : p1 - 1 + length]), short(raw[e : e + length - hi], rank)


def _runs(doc: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of touching or overlapping ranges, by document; `doc` numbers the documents of the task."""
    order = np.lexsort((p0, doc))
    doc, p0, p1 = doc[order], p0[order], p1[order]
    upto = np.maximum.accumulate(p1 + doc * (1 << 40)) - doc * (1 << 40)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (p0[1:] > upto[:-1])
    first = np.flatnonzero(new)
    return doc[first], p0[first], np.maximum.reduceat(p1, first) if len(first) else p1


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each row's group of equal keys, each group's first row, and its size."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return number, first, np.bincount(number, minlength=len(first))


def _spread(doc: np.ndarray, tag: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """A route of its own for every row that needs to meet no other."""
    mixed = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (tag.astype(np.uint64) << np.uint64(32))
    mixed = (mixed + p0.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def _table(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, (types[k] for _, k in fields), strict=True)], [n for n, _ in fields])


def _parsed(length: int):
    """Units of the texts (doc, tag, text) that a task reads, folded by both names."""

    def told(docs: list, of: list, p0: list, p1: list, g: list, k: list) -> Iterator[pa.RecordBatch]:
        doc, tag = (np.array([d[i] for d in docs], np.int64) for i in (0, 1))
        of, p0, p1 = (np.array(x, np.int64) for x in (of, p0, p1))
        g1, g2 = np.frombuffer(b"".join(g), ">i8").astype(np.int64).reshape(-1, 2).T
        alone = np.array([x is None for x in k])
        k = np.array([0 if x is None else x for x in k], np.uint64).view(np.int64)
        group, first, size = _groups(g1, g2)
        twice = size[group] > 1
        run_of, run_0, run_1 = _runs(of[twice], p0[twice], p1[twice])
        zero = np.zeros(len(run_of), np.int64)
        yield _table(UNITS, _spread(doc[run_of], tag[run_of], run_0), doc[run_of], tag[run_of], run_0, run_1, zero, zero, zero, zero + 2, zero + COVERED)
        # one of each `g` goes on
        of, p0, p1, g1, g2, k, alone, size = of[first], p0[first], p1[first], g1[first], g2[first], k[first], alone[first], size
        route = np.where(alone, g1, k)
        group, head, size_k = _groups(route, alone.astype(np.int64))
        weight = np.minimum(2, np.bincount(group, np.minimum(size, 2), len(head)).astype(np.int64))
        leads = np.zeros(len(of), bool)
        leads[head] = True
        # a name that the task met twice is known to be repeated: one row tells others, the rest need to meet no one
        route = np.where(leads, route, _spread(doc[of], tag[of], p0))
        state = np.where(size > 1, MET, OPEN)
        yield _table(UNITS, route, doc[of], tag[of], p0, p1, g1, g2, np.where(alone, 0, k), np.where(leads, weight[group], 2), state + np.where(alone, 4, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, rows = [], ([], [], [], [], [])
        for batch in small_batches(batches):
            for doc, tag, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = len(docs)
                docs.append((doc, tag))
                for unit in units_of(raw, length):
                    rows[0].append(number)
                    for column, value in zip(rows[1:], unit, strict=True):
                        column.append(value)
            if len(rows[0]) >= FOLD:
                yield from told(docs, *rows)
                docs, rows = [], ([], [], [], [], [])
        if rows[0]:
            yield from told(docs, *rows)

    return run


def _named(length: int):
    """Suffixes of the units of (doc, tag, text, units), one by one, folded by name."""

    def told(docs: list, of: list, place: list, met: list, names: list) -> Iterator[pa.RecordBatch]:
        doc, tag = (np.array([d[i] for d in docs], np.int64) for i in (0, 1))
        of, place, met = np.array(of, np.int64), np.array(place, np.int64), np.array(met, bool)
        h1, h2 = np.frombuffer(b"".join(names), ">i8").astype(np.int64).reshape(-1, 2).T
        group, first, size = _groups(h1, h2)
        again = (size > 1) | (np.bincount(group, met, len(first)) > 0)
        found = again[group] & ~met
        run_of, run_0, run_1 = _runs(of[found], place[found], place[found] + 1)
        own, zero = _spread(doc[run_of], tag[run_of], run_0), np.zeros(len(run_of), np.int64)
        yield _table(NAMES, own, own, doc[run_of], tag[run_of], run_0, run_1, zero + 2, zero + COVERED)
        of, place = of[first], place[first]
        yield _table(NAMES, h1[first], h2[first], doc[of], tag[of], place, place + 1, 1 + again, np.where(again, MET, OPEN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, rows = [], ([], [], [], [])
        for batch in small_batches(batches):
            for doc, tag, raw, units in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = len(docs)
                docs.append((doc, tag))
                for unit in units:
                    for p in range(unit["p0"], unit["p1"]):
                        rows[0].append(number)
                        rows[1].append(p)
                        rows[2].append(unit["met"])
                        rows[3].append(xxhash.xxh3_128_digest(raw[p : p + length]))
                if len(rows[0]) >= FOLD:
                    yield from told(docs, *rows)
                    docs, rows = [], ([], [], [], [])
        if rows[0]:
            yield from told(docs, *rows)

    return run


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, doc, tag, text: the text as bytes, and a key of the row; rows with equal id and text share it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("doc"), F.hash(text).alias("tag"), text.cast("binary").alias("text"))


def _several(*keys: str) -> Column:
    return F.sum("n").over(Window.partitionBy(*keys)) > 1


def covered_starts(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, tag, p0, p1: ranges of places where a string of `length` bytes starts that starts elsewhere too."""
    long_enough = rows.filter(F.octet_length("text") >= length).select("doc", "tag", "text")
    units = long_enough.mapInArrow(_parsed(length), UNITS)
    kept = cut(units.withColumn("several", _several("route")).filter("several").drop("several", "route", "n"))
    # `g` of a unit in four or more states stands for one suffix, which nothing but `g` decides
    same = Window.partitionBy("g1", "g2")
    marked = kept.filter(F.col("state") != COVERED).withColumn("met", F.sum(1 + F.col("state") % 4).over(same) > 1)
    marked = cut(marked.withColumn("first", F.row_number().over(same.orderBy("doc", "tag", "p0")) == 1).drop("g1", "g2"))
    open_units = marked.filter((F.col("state") < 4) & (~F.col("met") | F.col("first"))).select("doc", "tag", "p0", "p1", "k", "met")
    shared = open_units.groupBy("k").agg(F.count("*").alias("n"), F.bool_and("met").alias("all_met")).filter("n > 1 and not all_met")
    open_units = open_units.join(shared, "k", "left_semi")
    open_units = open_units.groupBy("doc", "tag").agg(F.collect_list(F.struct("p0", "p1", "met")).alias("units"))
    due = long_enough.join(open_units.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "units")
    named = due.mapInArrow(_named(length), NAMES).withColumn("several", _several("h1", "h2"))
    found = cut(named.filter(F.col("several") & (F.col("state") != MET)).select("doc", "tag", "p0", "p1"))
    ranges = kept.filter(F.col("state") == COVERED).select("doc", "tag", "p0", "p1")
    return ranges.union(marked.filter("met").select("doc", "tag", "p0", "p1")).union(found)


def removed_runs(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings of `length` bytes cover, from ranges of their starts."""
    runs: list[list[int]] = []
    for p0, p1 in sorted(starts):
        if runs and p0 <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], p1 - 1 + length)
        else:
            runs.append([p0, p1 - 1 + length])
    return [(a, b) for a, b in runs]


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, stop in bytes) and the kept bytes, for every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            kept, removed = [], []
            for raw, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = removed_runs([(s["p0"], s["p1"]) for s in starts or ()], length)
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"start": a, "stop": b} for a, b in runs])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            sizes = pa.array([len(r) for r in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    rows = texts(docs)
    starts = covered_starts(rows, length).groupBy("doc", "tag").agg(F.collect_list(F.struct("p0", "p1")).alias("starts"))
    joined = rows.join(starts.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")


def summary(found: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of `deduplicated` rows; `with_text` also the kept `text`.

    A cut may part a character: in `text` what is left of one becomes U+FFFD, the digest is of the bytes.
    """
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    columns = [removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    if with_text:
        columns.append(F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
    return found.select("doc_id", "n_bytes", *columns)
