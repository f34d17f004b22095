"""Packing documents into windows of tokens by best-fit decreasing.

A document's ids, with the end id, are cut into full windows and a rest. Pieces
are dealt out by hash into groups of about GROUP; in a group they are placed from
the longest to the shortest, each into the open window with the least room that
still holds it. A segment tree over remaining capacities finds that window in
log2(window) steps.

Only numbers, lengths and hashes of pieces are placed, a few hundred kB a group;
the places then join the pieces, whose ids the JVM moves once and Python never
sees again. Groups are independent, so a lost executor repeats only its own
groups, and the padding of a group's last windows is the price of packing on
many machines: it falls as 1 / GROUP. Rows of equal id and text of which there
are more than GROUP are spread over all groups.

Defined results: a null text is the empty text, whose only id is the end id.
Rows that repeat a doc_id are packed one by one. An empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, per_worker, power_of_two, small_batches

WINDOW = 4096
END = 2
GROUP = 16_384
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Bytes of a generation of stretches, with their ids, that a Python worker remembers (about 200 each besides).
REMEMBERED = 4_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece long, ids binary"


class Ids:
    """Ids of the stretches between spaces, as little-endian 32-bit numbers.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its stretches one after the other. New stretches are encoded
    together as one text. A stretch of letters is one word, and a word's last id
    says that it ends one; if there are not as many ends as stretches, and for
    other stretches, offsets tell them apart. Two generations of about REMEMBERED
    bytes are kept; one batch may go beyond.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if suffix and word.endswith(suffix)]] = True
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def of(self, texts: list[str]) -> list[bytes]:
        split = [text.replace("\n", " ").split(" ") for text in texts]
        new = list(set().union(*split).difference(self.now))
        if new and self.held > REMEMBERED:
            self.now, self.before, self.held = {}, self.now, 0
            new = list(set().union(*split))
        self.held += sum(map(len, new))
        self.now.update((w, self.before[w]) for w in new if w in self.before)
        unknown = [w for w in new if w not in self.now]
        # a comma or full stop after a letter is a token of its own
        marked = [w for w in unknown if w[-1:] in (",", ".") and w[-2:-1].isascii() and w[-2:-1].isalpha()]
        plain = set(unknown).difference(marked).union([",", "."], (w[:-1] for w in marked)).difference(self.now)
        words = [w for w in plain if w.isalpha()]
        self._learn([*plain.difference(words), *self._learn_words(words)])
        self.now.update((w, self.now[w[:-1]] + self.now[w[-1]]) for w in marked)
        return [b"".join(map(self.now.__getitem__, stretches)) for stretches in split]

    def _learn_words(self, words: list[str]) -> list[str]:
        """Learns words of letters; returns those of parts in which the ends do not tell them apart."""
        left = []
        for k in range(0, len(words), 8192):
            part = words[k : k + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                left += part
                continue
            found, at = ids.tobytes(), (4 * ends).tolist()
            self.now.update((w, found[a:b]) for w, a, b in zip(part, [0, *at[:-1]], at, strict=True))
        return left

    def _learn(self, stretches: list[str]) -> None:
        for k in range(0, len(stretches), 8192):
            part = stretches[k : k + 8192]
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.searchsorted([o[0] for o in found.offsets], starts).tolist()
            self.now.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, ends[:-1], ends[1:], strict=True))


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece of every document: where it starts, its length and checksum, its number, and its ids."""
    last = np.array([end], "<u4").tobytes()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker(f"ids {tokenizer}", lambda: Ids(tokenizer))
        number = TaskContext.get().partitionId() << 36
        for batch in small_batches(batches):
            rows = []
            texts = known.of([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids += last
                for at in range(0, len(ids), 4 * window):
                    part = ids[at : at + 4 * window]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, number, part if with_ids else None))
                    number += 1
            types = [pa.int64()] * 6 + [pa.binary()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece", "ids"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(made, PIECES)


class OpenWindows:
    """Windows by remaining capacity; a segment tree counts how many have each."""

    def __init__(self, window: int):
        self.leaves = power_of_two(window + 1)
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, number: int, room: int) -> None:
        self.held[room].append(number)
        self._change(room, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes the window with the least room of at least `size`: its number and room."""
        node = size + self.leaves
        if not self.count[node]:
            # up to the first right-hand subtree with a window, then down its left-most branch
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.count[2 * node])
        room = node - self.leaves
        self._change(room, -1)
        return self.held[room].pop(), room


def best_fit(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each size, longest first; equal sizes in the given order."""
    number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_windows, made = OpenWindows(window), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = open_windows.tightest(size) if size < window else None
        if found is None:
            found, made = (made, window), made + 1
        number[i], offset[i] = found[0], window - found[1]
        if found[1] > size:
            open_windows.put(found[0], found[1] - size)
    return number, offset


def _placed(window: int, stride: int):
    def run(group: pa.Table) -> pa.Table:
        # an order of the pieces that does not hang on how they arrived; equal ones may stand for each other
        group = group.sort_by([("length", "descending"), ("key", "ascending"), ("piece", "ascending")])
        number, offset = best_fit(group.column("length").to_numpy(), window)
        sequence = number * stride + group.column("part").to_numpy()
        return pa.table([group.column("piece"), pa.array(sequence), pa.array(offset)], ["piece", "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end: int = END, group: int = GROUP, with_ids: bool = True
) -> DataFrame:
    """One row per piece with its sequence and place in it; with `with_ids` also its ids (32-bit little-endian)."""
    made = cut(pieces(docs, window, tokenizer, end, with_ids))
    groups = max(1, -(-made.count() // group))
    keys = made.select("piece", "length", F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens").alias("key"))
    hot = cut(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("key", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.col("piece")).otherwise(0)
    dealt = keys.join(hot, "key", "left").select("piece", "length", "key", F.pmod(F.xxhash64("key", salt), F.lit(groups)).alias("part"))
    places = dealt.groupBy("part").applyInArrow(_placed(window, groups), "piece long, sequence_id long, offset long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return made.join(places.hint("shuffle_hash"), "piece").select(columns)
