"""Removal of repeated lines, by a sharded minimal perfect hash over line hashes.

A line's key is the line without ASCII white space at its ends, A-Z lowered. A
key that several documents hold keeps its lines only in the document with the
smallest id.

1. Each task hashes the keys (128 bits) of the texts it reads and folds them:
   one row for each key it met, with the smallest holder, the number of holders
   and who they are. A line that a third of all documents share is one row for
   each FOLD keys that a task reads.
2. The distinct hashes are dealt to shards by their first bits, about SHARD_KEYS
   to a shard. A shard gives each of its hashes a place of its own, without gaps:
   level by level, hashes that meet no other in a bit table stay there, the rest
   go on to the next level; a place is the rank of its bit. Places index packed
   arrays of fingerprints (the other 64 bits of the hash), counts and smallest
   holders. The index is a table of one row per shard; hashes are not stored.
3. The folded rows are sent to the shards' arrays and probe them batch by batch.
   A wrong place is told by its fingerprint, so unknown lines can be asked as
   well (`probe`). Shards that are asked more than ASKED times are asked in
   several tasks, each with its own copy of the arrays. Only answers that drop a
   line go back to its document.

Line texts are never shuffled but with their document, once, to be cut.

Defined results: a null text is the empty text, one empty line. A null doc_id
counts as larger than any id. Rows that repeat a doc_id are one document: none
of them drops a line that only they hold. An empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, small_batches

#: Shortest keys, in code points, that count.
LEAST = 10
#: Lines whose keys a task folds at a time.
FOLD = 1 << 17
#: Keys that a shard is planned for, and askers that a task is planned for.
SHARD_KEYS = 1 << 15
ASKED = 1 << 20
#: Bits of a level for each key that comes to it; levels before what is left is listed.
SPARE = 2
LEVELS = 24
NO_ID = (1 << 63) - 1

_CONTINUED = bytes(range(0x80, 0xC0))
FOLDED = "h1 long, h2 long, first long, n long, docs array<long>"
INDEX = "shard long, keys long, sizes array<long>, bits binary, rest binary, marks binary, counts binary, firsts binary"


def key_hashes(raw: bytes, least: int = LEAST) -> list[bytes | None]:
    """Hash of the key of every line of a text; None for keys under `least` code points."""
    out: list[bytes | None] = []
    for line in raw.split(b"\n"):
        key = line.strip()  # on bytes: the six ASCII white-space characters
        long_enough = len(key) >= least and (key.isascii() or len(key.translate(None, _CONTINUED)) >= least)
        out.append(xxhash.xxh3_128_digest(key.lower()) if long_enough else None)
    return out


def _longs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, doc, tag, text: the text as bytes, and a key of the row; rows with equal id and text share it."""
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("text"))


def folded(rows: DataFrame, least: int = LEAST, fold: int = FOLD) -> DataFrame:
    """Keys of the rows (doc, tag, text) that a task reads: h1, h2, smallest holder, number of holders, and their doc and tag in turn."""

    def told(docs: list[int], of: list[int], hashes: list[bytes]) -> pa.RecordBatch:
        both, who = _longs(hashes), np.array(docs, np.int64).reshape(-1, 2)[np.array(of)]
        order = np.lexsort((who[:, 0], both[:, 1], both[:, 0]))
        both, who = both[order], who[order]
        starts = np.flatnonzero(np.append(True, (both[1:] != both[:-1]).any(axis=1)))
        ends = pa.array(np.append(2 * starts, who.size).astype(np.int32))
        counts = np.diff(np.append(starts, len(both)))
        columns = [both[starts, 0], both[starts, 1], who[starts, 0], counts]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(ends, pa.array(who.ravel()))], ["h1", "h2", "first", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, of, hashes = [], [], []
        for batch in small_batches(batches):
            for doc, tag, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = set(key_hashes(raw, least))
                held.discard(None)
                if held:
                    of += [len(docs) // 2] * len(held)
                    docs += [doc, tag]
                    hashes += held
                if len(hashes) >= fold:
                    yield told(docs, of, hashes)
                    docs, of, hashes = [], [], []
        if hashes:
            yield told(docs, of, hashes)

    return rows.select("doc", "tag", "text").mapInArrow(run, FOLDED)


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1.view(np.uint64) + (h2.view(np.uint64) ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Places 0 … n - 1 of n distinct pairs of longs; `bits` has the levels one after the other, each of whole words."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        self.at = {tuple(pair): int(self.before[-1]) + i for i, pair in enumerate(rest.tolist())}

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, tables = [], []
        for level in range(LEVELS):
            if not len(h1):
                break
            size = 64 * -(-SPARE * len(h1) // 64)
            slot = (_mixed(h1, h2, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            tables.append(np.packbits(alone, bitorder="little").view(np.uint64))
            met = ~alone[slot]
            h1, h2 = h1[met], h2[met]
        return cls(sizes, np.concatenate(tables) if tables else np.zeros(0, np.uint64), np.stack([h1, h2], axis=1))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each pair; -1, or the place of another, for a pair that is not in the set."""
        found, due, start = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            slot = (_mixed(h1[due], h2[due], level) % np.uint64(size)).astype(np.int64)
            word, bit = start + (slot >> 6), (slot & 63).astype(np.uint64)
            here = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = self.bits[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            found[due[here]] = self.before[word[here]] + np.bitwise_count(below)
            due, start = due[~here], start + (size >> 6)
        if self.at:
            found[due] = [self.at.get(pair, -1) for pair in zip(h1[due].tolist(), h2[due].tolist(), strict=True)]
        return found


def _shard(shards: int):
    return F.pmod(F.shiftright("h1", 20), F.lit(shards))


def _built(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = (rows[c].to_numpy(np.int64) for c in ("h1", "h2"))
    hashed = PerfectHash.of(h1, h2)
    order = np.empty(len(rows), np.int64)
    order[hashed.places(h1, h2)] = np.arange(len(rows))
    counts = np.minimum(rows["n"].to_numpy(np.int64), (1 << 32) - 1)[order].astype("<u4")
    arrays = [hashed.bits.astype("<u8"), hashed.rest.astype("<i8"), h2[order].astype("<i8"), counts, rows["first"].to_numpy(np.int64)[order].astype("<i8")]
    return pd.DataFrame([[key[0], len(rows), hashed.sizes, *(a.tobytes() for a in arrays)]], columns=[f.split()[0] for f in INDEX.split(", ")])


def shard_count(keys: int, shard_keys: int = SHARD_KEYS) -> int:
    return max(1, -(-keys // shard_keys))


def build(rows: DataFrame, shards: int) -> DataFrame:
    """The index of folded rows (h1, h2, first, n): one row per shard."""
    distinct = rows.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    return distinct.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_built, INDEX)


class Arrays:
    """The arrays of one shard."""

    def __init__(self, sizes: list[int], bits: bytes, rest: bytes, marks: bytes, counts: bytes, firsts: bytes):
        self.hashed = PerfectHash(list(sizes), np.frombuffer(bits, "<u8"), np.frombuffer(rest, "<i8").reshape(-1, 2))
        self.marks, self.counts, self.firsts = np.frombuffer(marks, "<i8"), np.frombuffer(counts, "<u4"), np.frombuffer(firsts, "<i8")

    def answer(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of holders (0: unknown) and smallest holder of each hash."""
        place = self.hashed.places(h1, h2)
        known = place >= 0
        known[known] = self.marks[place[known]] == h2[known]
        place = np.where(known, place, 0)
        return np.where(known, self.counts[place], 0), np.where(known, self.firsts[place], NO_ID)


_ARRAYS = ["sizes", "bits", "rest", "marks", "counts", "firsts"]


def probe(index: DataFrame, asked: DataFrame, shards: int, most: int = ASKED, least_holders: int = 0) -> DataFrame:
    """h1, h2, docs of `asked` with `holders` (0: not in the index) and `smallest`, the smallest id that holds the line; those with `least_holders`."""
    asked = asked.select("h1", "h2", "docs").withColumn("shard", _shard(shards))
    # a shard that is asked very often is copied to several tasks; there are at most askers / `most` of those
    hot = asked.groupBy("shard").agg(F.sum(F.size("docs")).alias("n")).select("shard", F.ceil(F.col("n") / (2 * most)).alias("copies")).filter("copies > 1")
    hot = cut(hot)
    copy = F.pmod(F.xxhash64("h1", F.element_at("docs", 1), F.element_at("docs", 2)), F.coalesce("copies", F.lit(1)))
    asks = asked.join(hot, "shard", "left").select("shard", copy.alias("copy"), F.lit(1).alias("kind"), "h1", "h2", "docs", *(F.lit(None).alias(c) for c in _ARRAYS))
    nothing = F.lit(None)
    arrays = index.join(hot, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1)))
    arrays = arrays.select("shard", "copy", F.lit(0).alias("kind"), nothing.alias("h1"), nothing.alias("h2"), nothing.alias("docs"), *_ARRAYS)
    met = arrays.unionByName(asks).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Arrays | None = None
        for batch in batches:
            kinds = batch.column(2).to_numpy()
            edges = [0, *(i for k in np.flatnonzero(kinds == 0).tolist() for i in (k, k + 1)), batch.num_rows]
            for at, lo, hi in zip(range(len(edges)), edges[:-1], edges[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if at % 2:  # the arrays of the next shard
                    held = Arrays(*(part.column(c)[0].as_py() for c in _ARRAYS))
                elif hi > lo:
                    h1, h2 = (part.column(c).to_numpy() for c in ("h1", "h2"))
                    holders, smallest = held.answer(h1, h2)
                    columns = [part.column("h1"), part.column("h2"), part.column("docs"), pa.array(holders.astype(np.int64)), pa.array(smallest)]
                    told = pa.RecordBatch.from_arrays(columns, ["h1", "h2", "docs", "holders", "smallest"])
                    yield told.filter(pa.array(holders >= least_holders))

    return met.mapInArrow(run, "h1 long, h2 long, docs array<long>, holders long, smallest long")


def deduplicated(docs: DataFrame, least: int = LEAST, fold: int = FOLD, shard_keys: int = SHARD_KEYS, asked: int = ASKED) -> DataFrame:
    """doc_id, n_lines, dropped (numbers of the lines that go, from 0) and the kept text, for every row of `docs`."""
    rows = texts(docs)
    keys = cut(folded(rows, least, fold))
    shards = shard_count(keys.count(), shard_keys)
    index = cut(build(keys, shards))
    answers = probe(index, keys, shards, asked, least_holders=2)
    # one row for each holder but the smallest
    pairs = F.sequence(F.lit(1), F.size("docs") - 1, F.lit(2))
    holders = answers.select("h1", "h2", "smallest", F.explode(F.transform(pairs, lambda i: F.struct(F.col("docs")[i - 1].alias("doc"), F.col("docs")[i].alias("tag")))).alias("by"))
    gone = holders.filter("by.doc > smallest").select("by.doc", "by.tag", F.struct("h1", "h2").alias("hash"))
    gone = gone.groupBy("doc", "tag").agg(F.collect_set("hash").alias("gone"))
    due = rows.join(gone.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            lines, dropped, kept = [], [], []
            for raw, hashes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = raw.split(b"\n")
                out = {(g["h1"].to_bytes(8, "big", signed=True) + g["h2"].to_bytes(8, "big", signed=True)) for g in hashes or ()}
                places = [i for i, h in enumerate(key_hashes(raw, least)) if h in out] if out else []
                for i in reversed(places):
                    parts[i] = None
                lines.append(len(parts))
                dropped.append(places)
                kept.append(b"\n".join(p for p in parts if p is not None) if places else raw)
            columns = [batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.list_(pa.int32())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "dropped", "kept"])

    return due.mapInArrow(run, "doc_id long, n_lines long, dropped array<int>, kept binary").withColumn("kept", F.col("kept").cast("string"))


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of `deduplicated` rows."""
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
