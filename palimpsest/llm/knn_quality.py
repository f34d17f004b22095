"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors.

Words and word shapes are hashed into FEATURES weights; a truncated singular
value decomposition of a bounded sample of labelled texts gives the latent
space. The labelled vectors of that sample are broadcast: their size is bounded
by PER_CLASS, FEATURES and RANK, whatever the table. Every document's vector is
multiplied with all of them, block by block, and its NEIGHBOURS nearest vote for
their labels, weighted by cosine.

Documented bound: the model is fitted on at most PER_CLASS labelled texts of
each label, those whose ids hash lowest. Everything else reads all documents,
and whole texts.

Defined results: labels other than 0 and 1 are not learned from; an id labelled
twice counts with the lower label. A text without words, null included, scores
0. Without any labelled text every other document scores 0.5. Repeated rows are
scored one by one; ids, languages and sources are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, held_out, small_batches

FEATURES = 1 << 13
RANK = 64
PER_CLASS = 2048
NEIGHBOURS = 25
#: Power of the cosine that weighs a vote.
SHARPNESS = 4
#: Words whose features a task remembers.
REMEMBERED = 300_000
#: Weights gathered at a time, in rows of RANK numbers.
GATHER = 1 << 15

_SHAPES = bytes(
    ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


class Model(NamedTuple):
    """projection: FEATURES × rank, with the features' inverse frequencies; vectors: labelled unit vectors."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


class Features(dict):
    """Word to its two hashed features; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_SHAPES))
        found = self[word] = (zlib.crc32(word.lower()) % FEATURES, zlib.crc32(shape, 1) % FEATURES)
        return found


def weigh(texts: list[bytes | None], known: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts one after the other: text number, feature and log weight, sorted by number and feature."""
    where, counts, sizes = [], [], []
    for text in texts:
        words = Counter((text or b"").split())
        for word in words:
            where += known[word]
        for n in words.values():
            counts += (n, n)
        sizes.append(2 * len(words))
    if not where:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.float32)
    keys = np.repeat(np.arange(len(texts)), sizes) * FEATURES + np.array(where)
    order = np.argsort(keys, kind="stable")
    keys, starts = np.unique(keys[order], return_index=True)
    weights = np.log1p(np.add.reduceat(np.array(counts, np.float64)[order], starts)).astype(np.float32)
    return keys // FEATURES, keys % FEATURES, weights


def latent(texts: list[bytes | None], projection: np.ndarray, known: Features) -> np.ndarray:
    """Unit vectors of the texts in the latent space; zero where a text has nothing to say."""
    number, feature, weight = weigh(texts, known)
    out = np.zeros((len(texts), projection.shape[1]), np.float32)
    for k in range(0, len(number), GATHER):
        part = slice(k, k + GATHER)
        rows = projection[feature[part]] * weight[part, None]
        starts = np.flatnonzero(np.diff(number[part], prepend=-1))
        out[number[part][starts]] += np.add.reduceat(rows, starts, axis=0)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 1e-12)


def vote(vectors: np.ndarray, model: Model) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by cosine."""
    k = min(NEIGHBOURS, len(model.labels))
    cosines = vectors @ model.vectors.T
    nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weights = np.clip(np.take_along_axis(cosines, nearest, axis=1), 0, 1).astype(np.float64) ** SHARPNESS
    total = weights.sum(axis=1)
    share = np.divide((weights * model.labels[nearest]).sum(axis=1), total, out=np.full(len(total), 0.5), where=total > 0)
    return np.where(vectors.any(axis=1), np.clip(share, 0, 1), 0.0)


def training_rows(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id and label of the texts to learn from: the `per_class` of each label whose ids hash lowest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = [known.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    return cut(chosen[0].union(chosen[1]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """A model from at most `per_class` labelled texts of each label; None without any."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for batch in small_batches(batches):
            number, feature, weight = weigh(batch.column(1).to_pylist(), known)
            ends = np.searchsorted(number, np.arange(batch.num_rows + 1))
            rows = [(feature[a:b].astype("<u2").tobytes(), weight[a:b].astype("<f2").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "features", "weights", "label"])

    chosen = F.broadcast(training_rows(labels, per_class))  # at most 2 * per_class rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(chosen, "doc_id")
    rows = texts.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(weighed, "doc_id long, features binary, weights binary, label int")
    # one row for each id, also where the documents repeat it
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("features", "weights", "label")).alias("r")).select("r.*").orderBy("doc_id").collect()
    rows = [r for r in rows if r["features"]]
    if not rows:
        return None
    dense = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        dense[i, np.frombuffer(r["features"], "<u2")] = np.frombuffer(r["weights"], "<f2")
    rarity = np.log((1 + len(rows)) / (1 + (dense > 0).sum(axis=0))).astype(np.float32) + 1
    dense *= rarity
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    basis = singular_vectors(dense, min(RANK, len(rows)))
    vectors = dense @ basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(rarity[:, None] * basis, vectors.astype(np.float32), np.array([r["label"] for r in rows], np.float64))


def singular_vectors(rows: np.ndarray, rank: int) -> np.ndarray:
    """The first `rank` right singular vectors of `rows`, by random projection and power iterations."""
    probes = np.random.default_rng(0).standard_normal((rows.shape[1], min(rank + 8, *rows.shape))).astype(np.float32)
    for _ in range(3):
        probes = rows.T @ np.linalg.qr(rows @ probes)[0]
        probes /= np.abs(probes).max()
    return np.ascontiguousarray(np.linalg.svd(probes, full_matrices=False)[0][:, :rank].astype(np.float32))


def _scores(texts: list[bytes | None], model: Model | None, known: Features) -> np.ndarray:
    if model is None:
        return np.array([0.5 if (t or b"").split() else 0.0 for t in texts])
    return vote(latent(texts, model.projection, known), model)


def _shared(docs: DataFrame, model: Model | None) -> Callable[[], Model | None]:
    """Hands a task the model. Its arrays alone are broadcast: a class would be looked up on the executor by its module's name."""
    arrays = docs.sparkSession.sparkContext.broadcast(None if model is None else tuple(model))

    def held() -> Model | None:
        return None if arrays.value is None else Model(*arrays.value)

    return held


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    shared = _shared(docs, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Features(), shared()
        for batch in small_batches(batches):
            scores = _scores(batch.column(1).to_pylist(), held, known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = plain.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """Rows of `docs`, with all their columns, that score `least` or more; nothing is shuffled."""
    shared, place = _shared(docs, model), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Features(), shared()
        for batch in small_batches(batches):
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(_scores(texts, held, known) >= least))

    return docs.mapInArrow(kept, docs.schema)
