"""Exact deduplication on a cuckoo-filter index.

The index is a table of digest buckets. A bucket holds the live digests (its
content) and a cuckoo filter over them. A digest is first asked of the filter;
only a hit is verified against the content of the bucket, so that a false hit
never merges two texts. A filter that overflows is made anew at twice the size
from the stored digests. `update` inserts and deletes digests in one job.

Copies are folded twice: each map task folds what it reads on an index of its
own, then one task per bucket folds what the map tasks found. A text with a
third of all rows therefore reaches its bucket as one row per map task, and
bucket sizes follow the number of distinct texts.

Defined results: a null text is the empty text. Rows that repeat a doc_id are
documents of their own with equal ids; a null doc_id stays only if its whole
group has null ids. An empty table gives an empty result. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import cut, power_of_two

#: Digests that a bucket is planned for, and the least number of buckets.
KEYS_PER_BUCKET = 16_384
LEAST_BUCKETS = 256
#: Digests that a map task folds before it hands them on.
FOLD_KEYS = 100_000

STATE = T.StructType(
    [
        T.StructField("bucket", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("n_points", T.LongType()),
        T.StructField("copies", T.LongType()),
        T.StructField("filter", T.BinaryType()),
    ]
)
CHANGES = "digest string, keep_id long, n_points long, copies long"


class CuckooFilter:
    """Set membership with deletion: 16-bit fingerprints, two candidate cells of four slots each."""

    SLOTS = 4
    KICKS = 256

    def __init__(self, cells: int):
        self.mask = power_of_two(max(2, cells)) - 1
        self.cells: list[list[int]] = [[] for _ in range(self.mask + 1)]

    def _places(self, digest: str) -> tuple[int, int, int]:
        # the first 16 hex digits choose the bucket of the index, later ones are used here
        mark = int(digest[16:20], 16) or 1
        one = int(digest[20:32], 16) & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, cell: int, mark: int) -> int:
        return (cell ^ (mark * 0x5BD1E995)) & self.mask

    def __contains__(self, digest: str) -> bool:
        mark, one, two = self._places(digest)
        return mark in self.cells[one] or mark in self.cells[two]

    def add(self, digest: str) -> bool:
        """False if there is no room; the filter must then be made anew, as a mark was pushed out."""
        mark, one, two = self._places(digest)
        for cell in (one, two):
            if len(self.cells[cell]) < self.SLOTS:
                self.cells[cell].append(mark)
                return True
        cell = two
        for kick in range(self.KICKS):
            slots = self.cells[cell]
            slots[kick % self.SLOTS], mark = mark, slots[kick % self.SLOTS]
            cell = self._other(cell, mark)
            if len(self.cells[cell]) < self.SLOTS:
                self.cells[cell].append(mark)
                return True
        return False

    def discard(self, digest: str) -> None:
        mark, one, two = self._places(digest)
        for cell in (one, two):
            if mark in self.cells[cell]:
                self.cells[cell].remove(mark)
                return

    def to_bytes(self) -> bytes:
        return b"".join(m.to_bytes(2, "little") for slots in self.cells for m in [*slots, 0, 0, 0, 0][: self.SLOTS])

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls(len(raw) // (2 * cls.SLOTS))
        marks = [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]
        out.cells = [[m for m in marks[i : i + cls.SLOTS] if m] for i in range(0, len(marks), cls.SLOTS)]
        return out


class Bucket:
    """Live digests of one bucket: content by digest prefix, and the filter before it."""

    def __init__(self, cells: int = 64):
        self.filter = CuckooFilter(cells)
        self.content: dict[str, list[list]] = {}
        self.size = 0

    def _find(self, digest: str) -> list | None:
        if digest not in self.filter:
            return None
        return next((e for e in self.content.get(digest[:12], ()) if e[0] == digest), None)

    def _enter(self, digest: str) -> None:
        # `digest` is in the content already, so a new filter is made from the content alone
        cells, fits = len(self.filter.cells), self.filter.add(digest)
        while not fits:
            cells *= 2
            self.filter = CuckooFilter(cells)
            fits = all(self.filter.add(e[0]) for e in self.entries())

    def insert(self, digest: str, keep_id: int | None, n_points: int, copies: int) -> None:
        entry = self._find(digest)
        if entry is None:
            self.content.setdefault(digest[:12], []).append([digest, keep_id, n_points, copies])
            self.size += 1
            self._enter(digest)
            return
        entry[3] += copies
        # null ids never stay where another id can; longer originals first, then smaller ids
        if _order(keep_id, n_points) < _order(entry[1], entry[2]):
            entry[1], entry[2] = keep_id, n_points

    def delete(self, digest: str) -> None:
        entry = self._find(digest)
        if entry is not None:
            self.content[digest[:12]].remove(entry)
            self.size -= 1
            self.filter.discard(digest)

    def entries(self) -> Iterator[list]:
        return (e for slots in self.content.values() for e in slots)


def _order(keep_id: int | None, n_points: int) -> tuple:
    return (keep_id is None, -n_points, 0 if keep_id is None else keep_id)


def _id(value) -> int | None:
    return None if pd.isna(value) else int(value)


def digest(text: Column) -> Column:
    """SHA-256 of a text without its white space."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")
    return F.sha2(bare.cast("binary"), 256)


def digests(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, n_points (code points of the original text), text_sha256 of the text without its white space, and `carried`."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
        digest(F.col("text")).alias("text_sha256"),
        *carried,
    )


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own = Bucket()

    def told(bucket: Bucket) -> pd.DataFrame:
        out = pd.DataFrame(bucket.entries(), columns=["digest", "keep_id", "n_points", "copies"])
        return out.astype({"keep_id": "Int64"})

    for batch in batches:
        for doc_id, n_points, digest in zip(batch["doc_id"], batch["n_points"], batch["text_sha256"], strict=True):
            own.insert(digest, _id(doc_id), n_points, 1)
        if own.size >= FOLD_KEYS:
            yield told(own)
            own = Bucket()
    yield told(own)


def _change(key: tuple, state: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    bucket = Bucket()
    stored = state[state["digest"].notna()]
    for row in state.loc[state["digest"].isna(), "filter"]:
        bucket.filter = CuckooFilter.from_bytes(row)
    for digest, keep_id, n_points, copies in stored[["digest", "keep_id", "n_points", "copies"]].itertuples(index=False):
        bucket.content.setdefault(digest[:12], []).append([digest, _id(keep_id), int(n_points), int(copies)])
        bucket.size += 1
    # deletions first: a digest that one batch deletes and inserts is live afterwards
    for digest in changes.loc[changes["copies"] <= 0, "digest"]:
        bucket.delete(digest)
    added = changes[changes["copies"] > 0]
    for digest, keep_id, n_points, copies in added[["digest", "keep_id", "n_points", "copies"]].itertuples(index=False):
        bucket.insert(digest, _id(keep_id), int(n_points), int(copies))
    rows = [[key[0], *e, None] for e in bucket.entries()] + [[key[0], None, None, None, None, bucket.filter.to_bytes()]]
    return pd.DataFrame(rows, columns=STATE.names).astype({c: "Int64" for c in ("keep_id", "n_points", "copies")})


def bucket_count(keys: int) -> int:
    return max(LEAST_BUCKETS, power_of_two(-(-keys // KEYS_PER_BUCKET)))


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def update(index: DataFrame, changes: DataFrame, buckets: int) -> DataFrame:
    """The index after `changes` (digest, keep_id, n_points, copies).

    A row with `copies` over 0 inserts its digest or adds to it; any other row
    deletes its digest. One row per bucket has no digest: it holds the filter.
    `buckets` must be the same for the whole life of an index.
    """
    dealt = changes.withColumn("bucket", F.pmod(F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"), F.lit(buckets)))
    return index.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(_change, STATE)


def lookup(index: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """Rows of `asked` (digest, …) that are live, with keep_id and copies.

    Only what passes the filter of its bucket goes on to the stored digests.
    """
    schema = T.StructType([T.StructField("digest", T.StringType())])

    def hits(_, filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        known = [CuckooFilter.from_bytes(raw) for raw in filters["filter"]]
        return rows.loc[[any(d in f for f in known) for d in rows["digest"]], ["digest"]]

    keys = asked.select("digest").distinct()
    dealt = keys.withColumn("bucket", F.pmod(F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"), F.lit(buckets)))
    filters = index.filter(F.col("digest").isNull()).select("bucket", "filter")
    maybe = filters.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(hits, schema)
    live = maybe.join(index.select("digest", "keep_id", "copies"), "digest")
    return asked.join(live, "digest")


def exact_groups(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the columns `carried` for every row of `docs`."""
    rows = cut(digests(docs, *carried))
    buckets = bucket_count(rows.count())
    index = update(empty_index(docs.sparkSession), rows.drop(*carried).mapInPandas(_fold, CHANGES), buckets)
    groups = index.filter(F.col("digest").isNotNull()).select(
        F.col("digest").alias("text_sha256"), "keep_id", F.col("copies").alias("group_size")
    )
    return rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *carried
    )
