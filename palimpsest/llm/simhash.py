"""Near-duplicates by SimHash, compared bit-sliced.

Fingerprints are made one text at a time. Distinct fingerprints meet where a
choice of their bits is equal: with `radius` + j blocks of bits, two that differ
in at most `radius` bits agree on at least j blocks, so one table per choice of
j blocks finds every link. More blocks make longer keys; how many are taken
follows from the number of distinct fingerprints, and any number gives the same
links. Inside a group of equal keys, fingerprints lie as bit planes: 64 of them
fill a machine word of each plane, and carry-save adders count the differing
bits of all of them at once. A row of comparisons is given up as soon as every
counter in it is beyond the radius.

A group over TILE fingerprints is cut into chunks by hash, and one task compares
each pair of chunks. Copies share a fingerprint, so a group is never larger than
what differs: inside a ball of the radius there are at most 679,121
fingerprints, which bounds how often one is repeated; those that lie
further apart are parted by longer keys as the table grows. A tile emits one
link per fingerprint to the first of its cluster, not all pairs; no link between
two clusters is lost.

Defined results: a null text is the empty text; a text without words has
fingerprint zero and links like any other. Equal ids of several rows are rows of
one component if they link. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, small_batches
from palimpsest.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 2048
#: Shingle hashes whose bits are spread out at a time.
SPREAD = 1 << 14
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(raw: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text: bits set in over half of its shingles' hashes."""
    words = raw.lower().split()  # on bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, SPREAD):
        part = hashes[k : k + SPREAD]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, the fingerprint as a long (its 64 bits, sign included) and the columns `carried`."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(1).to_pylist()
            bits = np.fromiter((simhash(t or b"", shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits), *batch.columns[2:]], ["doc_id", "fp", *carried])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *carried)
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return plain.mapInArrow(made, "doc_id long, fp long" + more)


def plan_keys(distinct: int, radius: int = RADIUS) -> list[int]:
    """Masks of the key of each table: blocks of bits that two linked fingerprints may share."""

    def cost(agree: int) -> float:
        blocks = radius + agree
        tables = len(list(itertools.combinations(range(blocks), agree)))
        return tables * distinct * (1 + distinct / 2 ** (64 * agree / blocks) / 256)

    agree = min(range(1, 5), key=cost)
    blocks = radius + agree
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(masks, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of `fps`; lane i of a plane is bit i % 64 of its word i // 64."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((-(-len(fps) // 64) * 64, 64), np.uint8)
    padded[: len(fps)] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view(np.uint64)


def _lanes_upto(n: int, words: int) -> np.ndarray:
    """For each of n rows, the lanes up to and with its own number."""
    return np.packbits(np.tri(n, words * 64, dtype=np.uint8), axis=1, bitorder="little").view(np.uint64)


def near(rows: np.ndarray, lanes: np.ndarray, same: bool, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a lane within the radius, and the lanes of each as packed words.

    `same`: rows and lanes are the same fingerprints; only lanes after a row's own number count.
    """
    sliced, alive = planes(lanes), np.arange(len(rows))
    words = sliced.shape[1]
    over = _lanes_upto(len(rows), words) if same else np.zeros((len(rows), words), np.uint64)
    if len(lanes) % 64:  # lanes that hold no fingerprint
        over[:, -1] |= ALL << np.uint64(len(lanes) % 64)
    ones, twos, fours, eights = (np.zeros_like(over) for _ in range(4))
    for bit in range(0, 64, 4):
        flips = np.where((rows[alive][:, None] >> np.arange(bit, bit + 4, dtype=np.uint64)) & np.uint64(1), ALL, np.uint64(0))
        a, b, c, d = (sliced[bit + k][None, :] ^ flips[:, k, None] for k in range(4))
        ones, up = _add(ones, a, b)
        ones, up_2 = _add(ones, c, d)
        twos, up_4 = _add(twos, up, up_2)
        eights |= fours & up_4
        fours ^= up_4
        gone = over | _beyond(ones, twos, fours, eights, radius)
        live = (gone != ALL).any(axis=1)
        if not live.any():
            return np.zeros(0, np.int64), np.zeros((0, words), np.uint64)
        if bit % 8 == 4 and live.sum() < 0.75 * len(alive):
            alive, over = alive[live], over[live]
            ones, twos, fours, eights = ones[live], twos[live], fours[live], eights[live]
    within = ~(over | _beyond(ones, twos, fours, eights, radius))
    some = within.any(axis=1)
    return alive[some], within[some]


def _add(total: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder of three bits in every lane: sum and carry."""
    half = total ^ x
    return half ^ y, (total & x) | (half & y)


def _beyond(ones, twos, fours, eights, radius: int) -> np.ndarray:
    """Lanes whose count is over `radius` (0 to 7); a count of eight or more stays marked in `eights`."""
    more, equal = eights.copy(), ~np.zeros_like(eights)
    for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            equal &= plane
        else:
            more |= equal & plane
            equal &= ~plane
    return more


def clusters(left: np.ndarray, right: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first of its cluster) within `left`, or between `left` and `right`."""
    same = right is None
    lanes = left if same else right
    where, within = near(left, lanes, same, radius)
    if not len(where):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    base = 0 if same else len(left)
    every = left if same else np.concatenate([left, right])
    label = np.arange(len(every))
    for row, packed in zip(where.tolist(), within, strict=True):
        found = base + np.flatnonzero(np.unpackbits(packed.view(np.uint8), bitorder="little"))
        met = np.unique(np.append(label[found], label[row]))
        if len(met) > 1:
            label[np.isin(label, met[1:]) if len(met) > 2 else label == met[1]] = met[0]
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


def _compare(radius: int):
    """Clusters of each tile in a partition sorted by tile and side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, kept = None, []

        def told() -> pd.DataFrame:
            rows = np.concatenate(kept)
            side, fps = rows["side"], rows["fp"].view(np.uint64)
            a, b = clusters(fps[side == 0], fps[side == 1] if held[2] != held[3] else None, radius)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            keys = batch[["t", "k", "i", "j"]].to_numpy()
            rows = np.empty(len(batch), [("side", np.int64), ("fp", np.int64)])
            rows["side"], rows["fp"] = batch["side"], batch["fp"]
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(batch)]):
                key = tuple(keys[lo].tolist()) if hi > lo else held
                if held is not None and key != held:
                    if sum(map(len, kept)) > 1:
                        yield told()
                    kept = []
                held = key
                kept.append(rows[lo:hi])
        if sum(map(len, kept)) > 1:
            yield told()

    return run


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links that join exactly those fingerprints of `fps` (column fp, distinct) that chains within the radius join."""
    tables = [_signed(m) for m in plan_keys(fps.count(), radius)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for t, m in enumerate(tables)])
    rows = fps.select("fp", F.explode(keys).alias("key")).select("key.t", "key.k", "fp")
    hot = cut(rows.groupBy("t", "k").agg(F.ceil(F.count("*") / tile).alias("chunks")).filter("chunks > 1"))
    rows = rows.join(hot, ["t", "k"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    tiles = rows.select(
        "t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp"
    )
    tiles = tiles.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return tiles.mapInPandas(_compare(radius), "a long, b long")


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """`distinct` (column fp) with the root of each fingerprint's component."""
    ends = components(links(distinct.select("fp"), radius))
    return cut(distinct.join(ends.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id of the component) for every row of `docs`."""
    rows = cut(fingerprints(docs, shingle))
    rooted = _rooted(cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))), radius)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    component = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, row: str, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """`row` of one row of `docs` for each component: that of the least doc_id (null last), then of the least `row`."""
    rank = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", row)
    distinct = cut(fingerprints(docs, shingle, [row]).groupBy("fp").agg(F.min(rank).alias("first")))
    return _rooted(distinct, radius).groupBy("root").agg(F.min("first").alias("first")).select(f"first.{row}")
