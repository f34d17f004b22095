"""Ranked lexical search by the Best Position Algorithm over impact lists.

Every item is a query against all documents; each gets its `top` documents.

1. Items are dealt to blocks of about BLOCK_TERMS terms; a block's vocabulary is
   broadcast. One pass tokenises every text and writes, for each document, its
   number of terms and its counts of the block's terms.
2. Document counts of terms, the number of documents and of all terms are sums
   over that table; they give each term its weight.
3. Documents are dealt to shards of about SHARD by hash. In a shard each term has
   an impact list: what the term adds to a document's score, highest first. For
   each item the lists of its terms are read from the top in step. A document met
   for the first time is looked up in all lists at once (direct access), which
   gives its whole score and marks its positions there as seen. The best position
   of a list is the last one before which nothing is unseen. What the lists hold
   at their best positions adds up to the most that an unseen document can score;
   once that is strictly below the `top`-th score, reading stops, so ties are
   never cut. A list seen to its end adds nothing.
4. The shards' best rows are ranked together; a group limit before the exchange
   keeps `top` rows for each item and task.

A term that a third of all documents hold is spread over all shards. Scores are
whole numbers and hang on sums over the corpus only, so the result does not
depend on how documents are dealt.

Defined results: a null text has no terms; texts without terms do not count as
documents. An empty item gives no row. Rows that repeat a doc_id are documents of
their own; rows that repeat an item_id are one item with the terms of all. A
null doc_id comes last among equal scores. An empty table gives an empty result.
Only item_id, doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, small_batches

TOP = 50
#: Terms of items in a block, and documents in a shard.
BLOCK_TERMS = 200_000
SHARD = 8_192
#: Positions of each list in the first round of sorted accesses; each round doubles it, up to MOST_STEP.
STEP = 16
MOST_STEP = 1024
NO_ID = (1 << 63) - 1

#: Bytes that part terms become spaces, A-Z become a-z; all bytes of other characters belong to terms.
_TABLE = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"


def terms_of(raw: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: maximal stretches of ASCII letters and digits and of all other characters beyond ASCII."""
    return raw.translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each distinct term of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [(i, t) for i, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in sorted(set(terms_of(raw or b"")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "term"])

    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, "item_id long, term binary").distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, and the numbers and counts of the terms in `vocabulary`, for every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in small_batches(batches):
            ids, sizes, ends, terms, counts = [], [], [0], [], []
            for doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = terms_of(raw or b"")
                if not words:
                    continue
                held = Counter(w for w in words if w in known)
                ids.append(doc_id)
                sizes.append(len(words))
                terms += [known[w] for w in held]
                counts += held.values()
                ends.append(len(terms))
            edges = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(v, pa.int32())) for v in (terms, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, POSTINGS)


def weights(rows: DataFrame, documents: int, terms: int) -> np.ndarray:
    """Weight of each of `terms` vocabulary numbers; 0 for terms that no document holds."""
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2.0) / (2 * F.col("df") + 1)))
    known = held.select("term", weight.alias("w")).toPandas()  # at most as many rows as the vocabulary has terms
    out = np.zeros(terms, np.int64)
    out[known["term"].to_numpy(np.int64)] = known["w"].to_numpy(np.int64)
    return out


class Shard:
    """Impact lists of the documents of one shard.

    Postings are numbered by (term, impact from the highest, document); `number` holds those of each document in turn.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, documents: int, terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.term = doc[order], impact[order], term[order]
        self.starts = np.searchsorted(self.term, np.arange(terms + 1))
        self.number = np.argsort(self.doc, kind="stable")
        self.ends = np.searchsorted(self.doc[self.number], np.arange(documents + 1))
        self.known = np.zeros(documents, bool)

    def positions(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All postings of `docs`, and which of `docs` each belongs to."""
        sizes = self.ends[docs + 1] - self.ends[docs]
        which = np.repeat(np.arange(len(docs)), sizes)
        within = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.number[self.ends[docs][which] + within], which

    def best(self, terms: np.ndarray, asked: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score is at least the `top`-th, with ties, and their scores; `asked` tells of each term whether it is one of `terms`."""
        lists = [(a, b) for a, b in zip(self.starts[terms].tolist(), self.starts[terms + 1].tolist(), strict=True) if a < b and self.impact[a] > 0]
        seen = {a: np.zeros(b - a, bool) for a, b in lists}
        best = dict.fromkeys(seen, 0)  # positions from the top that are all seen
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, step, last = 0, STEP, 0
        while lists:
            # sorted access: the next positions of every list
            met = np.unique(np.concatenate([self.doc[a + at : min(a + at + step, b)] for a, b in lists]))
            met = met[~self.known[met]]
            self.known[met] = True
            # direct access: scores and positions of new documents in all lists
            found, which = self.positions(met)
            mine = asked[self.term[found]]
            found, which = found[mine], which[mine]
            sums = np.append(0, np.cumsum(self.impact[found]))
            edges = np.searchsorted(which, np.arange(len(met) + 1))
            docs.append(met)
            scores.append(sums[edges[1:]] - sums[edges[:-1]])
            found.sort()
            bounds = np.searchsorted(found, [edge for pair in lists for edge in pair]).tolist()
            most = 0
            for k, (a, b) in enumerate(lists):
                marks = seen[a]
                marks[found[bounds[2 * k] : bounds[2 * k + 1]] - a] = True
                ahead = marks[best[a] :]
                gap = int(ahead.argmin())
                best[a] = b - a if ahead[gap] else best[a] + gap
                if best[a] < b - a:  # what the list holds at its best position
                    most += int(self.impact[a + best[a] - 1])
            lists = [(a, b) for a, b in lists if best[a] < b - a]
            every = np.concatenate(scores)
            if len(every) >= top:
                last = int(np.partition(every, len(every) - top)[len(every) - top])
                if most < last:
                    break
            at, step = at + step, min(2 * step, MOST_STEP)
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        self.known[docs] = False
        good = scores >= max(last, 1)
        return docs[good], scores[good]


def _ranked(items: list[tuple[int | None, list[int]]], weight: np.ndarray, documents: int, all_terms: int, top: int):
    """Best documents of one shard for every item."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
        sizes = table.column("n").to_numpy()
        lists = [table.column(c).combine_chunks() for c in ("terms", "counts")]
        term, count = (v.flatten().to_numpy().astype(np.int64) for v in lists)
        doc = np.repeat(np.arange(len(ids)), np.diff(lists[0].offsets.to_numpy()))
        norm = 50 + 50 * sizes * documents // all_terms
        impact = weight[term] * (1_000_000_000 * count // (1000 * count + 20 * norm[doc]))
        shard, asked, rows = Shard(term, doc, impact, len(ids), len(weight)), np.zeros(len(weight), bool), []
        for item, terms in items:
            terms = np.array(terms, np.int64)
            asked[terms] = True
            found, scores = shard.best(terms, asked, top)
            asked[terms] = False
            order = np.lexsort((ids[found], -scores))[:top]
            rows.append((item, ids[found[order]], scores[order]))
        item = [r[0] for r in rows for _ in range(len(r[1]))]
        doc_id, score = (np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)]) for k in (1, 2))
        return pa.table([pa.array(item, pa.int64()), pa.array(doc_id, mask=doc_id == NO_ID), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, shard: int = SHARD) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the `top` documents of each item."""
    asked = cut(item_terms(items))
    blocks = -(-asked.count() // block_terms)
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about `block_terms` rows
        vocabulary = {term: k for k, term in enumerate(sorted({bytes(r["term"]) for r in mine}))}
        by_item: dict[int | None, list[int]] = {}
        for r in mine:
            by_item.setdefault(r["item_id"], []).append(vocabulary[bytes(r["term"])])
        rows = cut(postings(docs, vocabulary))
        totals = rows.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        if not totals["documents"]:
            break
        weight = weights(rows, totals["documents"], len(vocabulary))
        shards = max(1, -(-totals["documents"] // shard))
        # rows are dealt by where they stand in the written table, so equal rows part as well
        part = F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(shards))
        dealt = rows.select("*", part.alias("part")).filter(F.size("terms") > 0)
        ranked = _ranked(sorted(by_item.items(), key=str), weight, totals["documents"], totals["terms"], top)
        found = found.union(dealt.groupBy("part").applyInArrow(ranked, "item_id long, doc_id long, score long"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
