"""A corpus through five operators: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of documents; the last returns packed pieces. `run`
writes each result as Parquet in the shared folder and reads it again.

Defined results: every stage decides row by row, by where a row stands in the
written table, whatever its id: exactly one row of each group of copies stays.
The draw of the mixture hangs on id and cell. Columns besides doc_id, text, lang and source pass
through. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from palimpsest.llm import exact_dedup, knn_quality, mixture, packing, simhash
from palimpsest.llm.common import ROW, cut, documents, keyed, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of `docs` whose key is among those of `kept`, which holds each at most once."""
    return docs.join(kept.select(ROW).hint("shuffle_hash"), ROW, "left_semi").drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return knn_quality.accepted(docs, knn_quality.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    rows = keyed(docs)
    ranked = rows.withColumn("_rank", F.struct((-F.length(F.coalesce("text", F.lit("")))).alias("shorter"), ROW))
    # rows may share the kept id: the longest original of them stays, as among ids
    kept = exact_dedup.exact_groups(ranked, "_rank").filter("kept").groupBy("text_sha256").agg(F.min("_rank").alias("first"))
    return _only(rows, kept.select(f"first.{ROW}"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, as the SimHash operator links them."""
    rows = keyed(docs)
    return _only(rows, simhash.first_rows(rows, ROW))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic come near their target weights."""
    rows = keyed(docs)
    return _only(rows, mixture.mix(rows, carried=[ROW]).filter("sampled"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents in sequences of at most 4096 tokens, with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs


#: No SQL for a classifier, components and raking; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLES: dict[str, str] = {}
