"""Session settings and the lineage cut used by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Settings the operators are planned for. They are ordinary Spark options, so a
# cluster may set its own; `recommended` never overrides an open session.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def recommended(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from `spark.checkpoint.dir`.

    A local session without the setting gets a scratch folder; a cluster
    session without it is refused, because a folder of one machine is lost
    with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="palimpsest-")
    return _local[app]


#: Bytes of files from which on their size says nothing of their rows' size, and up
#: to which Spark may still take a few columns of them for small.
UNCLEAR = (1 << 20, 1 << 28)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The Parquet files at `path`.

    Before it has run anything Spark takes the compressed size of the columns for
    the size of the rows, which can be a twentieth of it, and would collect such a
    table in the driver to broadcast it. Where the size of the files leaves that
    open, the next join is told to exchange its sides.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    table = reader.parquet(path)
    return table.hint("merge") if UNCLEAR[0] < size < UNCLEAR[1] else table


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used between rounds of an iterative operator. A written table survives the
    loss of executors, ends the lineage, and gives the next join a true size,
    so that Spark only broadcasts what it has measured.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for open_scope in _scopes:
        open_scope.append((spark, path))
    return read_table(spark, path, df.schema)


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what `cut` has written in it.

    Write or collect results before it ends: they may read those tables.
    """
    made: list[tuple[SparkSession, str]] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for spark, path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
