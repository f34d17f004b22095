"""What the corpus operators share: reading, hashing, sizes."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import cut

__all__ = ["ROW", "cut", "documents", "held_out", "keyed", "per_worker", "power_of_two", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that no model learns from; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def power_of_two(n: int) -> int:
    """The smallest power of two that is at least `n`."""
    return 1 << max(0, n - 1).bit_length()


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """What `make` gives, kept by the Python worker for the tasks that it runs next; only for what can be made anew."""
    held = sys.modules.setdefault("_palimpsest_worker", types.ModuleType("_palimpsest_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


#: Name of the column that `keyed` adds.
ROW = "_row_key"


def keyed(docs: DataFrame) -> DataFrame:
    """`docs`, written, with a key of each row: where it stands in the written table."""
    return cut(docs).select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(ROW))
