"""Versions of a table as immutable folders `path/commit_id=…`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "commit_id"


def write_version(df: DataFrame, path: str, commit_id: str) -> str:
    """Write one version; an existing version is never overwritten."""
    target = f"{path.rstrip('/')}/{COMMIT}={commit_id}"
    df.drop(COMMIT).write.mode("errorifexists").parquet(target)
    return target


def load_version(
    spark: SparkSession,
    path: str,
    commit_id: str | None = None,
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """One version of a table, or a plain Parquet table without `commit_id`."""
    target = path if commit_id is None else f"{path.rstrip('/')}/{COMMIT}={commit_id}"
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(target)
    return df.select(*columns) if columns else df


def load_versions(spark: SparkSession, path: str, commits: DataFrame | None = None) -> DataFrame:
    """All versions with their `commit_id`; folders are pruned by a filter or by
    the join with `commits`.

    Of `commits` only the ids of folders are broadcast, which the driver has listed
    anyway: an exchange by `commit_id` would put a version into one task."""
    df = spark.read.option("mergeSchema", "true").parquet(path).withColumn(COMMIT, F.col(COMMIT).cast("string"))
    if commits is None:
        return df
    wanted = df.select(COMMIT).distinct().join(commits.select(COMMIT), COMMIT, "left_semi")
    return df.join(F.broadcast(wanted), COMMIT, "left_semi")
