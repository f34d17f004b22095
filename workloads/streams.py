"""The streaming operators run over the event file, to its end."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import cut, shared_dir
from palimpsest.sources import ingest
from palimpsest.streaming import streams
from workloads import history
from workloads.data import Data, oracle

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return register


def _stream(d: Data, table: str) -> DataFrame:
    reader = d.spark.readStream.schema(d[table].schema).option("pathGlobFilter", f"{table}.parquet")
    return reader.parquet(d.dir)


def _folder(d: Data) -> str:
    return f"{shared_dir(d.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run(d: Data, df: DataFrame) -> DataFrame:
    out = _folder(d)
    writer = df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/_progress")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return d.spark.read.schema(df.schema).parquet(f"{out}/rows")


@query(
    "audit_windows_stream",
    """WITH w AS (SELECT cast(floor(epoch(ts) / 3600) * 3600 AS bigint) AS window_start, event_type, count(*) AS n_events FROM {events} GROUP BY 1, 2)
SELECT * FROM w WHERE window_start + 3600 <= (SELECT max(epoch(ts)) - 600 FROM {events})""",
)
def audit_windows_stream(d):
    events = _stream(d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = _run(d, streams.audit_windows_stream(events, "1 hour", "10 minutes", ["event_type"]))
    return found.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n_events")


@query("head_moves_stream", history.ORACLES["head_moves"])
def head_moves_stream(d):
    """Proposals are derived with windows, which a stream cannot do, so the
    derived table is stored and streamed from its folder."""
    out = _folder(d)
    proposals = cut(d["head_proposals"])
    # four micro-batches in the order of seq
    bounds = [float("-inf"), *proposals.approxQuantile("seq", [0.25, 0.5, 0.75], 0.01), float("inf")]
    for low, high in itertools.pairwise(bounds):
        part = proposals.where((F.col("seq") > low) & (F.col("seq") <= high))
        part.coalesce(1).write.mode("append").parquet(f"{out}/in")
    arriving = d.spark.readStream.schema(proposals.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    streams.head_moves_stream(d["branch_starts"], arriving, f"{out}/out").awaitTermination()
    return d.spark.read.parquet(f"{out}/out/judged").drop("epoch")


@query(
    "ingest_stream_events",
    """SELECT cast(event_id AS string) AS row_key, 'unknown_reference' AS construct, 'user_id' AS object, cast(user_id AS string) AS detail
FROM {events} WHERE user_id NOT IN (SELECT c_custkey FROM {customer_pruned})
UNION ALL SELECT cast(event_id AS string), 'too_long', 'event_type', event_type FROM {events} WHERE length(event_type) > 6
UNION ALL SELECT NULL, 'unmapped_column', 'ts', 'timestamp (not imported)'
UNION ALL SELECT NULL, 'unmapped_column', 'value', 'double (not imported)'
UNION ALL SELECT NULL, 'unmapped_column', 'props', 'string (not imported)'""",
)
def ingest_stream_events(d):
    out = _folder(d)
    events = _stream(d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    wanted = [ingest.Column("event_id", "bigint", False), ingest.Column("user_id", "bigint"), ingest.Column("event_type", "varchar(6)")]
    parents = [ingest.Reference("user_id", d["customer_pruned"], "c_custkey")]
    streams.ingest_stream(events, ["event_id"], wanted, parents, "ts", "1 hour", out).awaitTermination()
    return d.spark.read.parquet(f"{out}/quarantine").drop("epoch").dropDuplicates()


@query(
    "changes_stream_orders",
    """SELECT o.o_orderkey AS k, 'cell_changed' AS kind, 'status' AS property, b.status AS from_value, o.o_orderstatus AS to_value
FROM {orders} o JOIN {orders_ours} b ON b.k = o.o_orderkey WHERE b.status <> o.o_orderstatus
UNION ALL SELECT o.o_orderkey, 'cell_changed', 'cust', cast(b.cust AS string), cast(o.o_custkey AS string)
FROM {orders} o JOIN {orders_ours} b ON b.k = o.o_orderkey WHERE b.cust IS DISTINCT FROM o.o_custkey
UNION ALL SELECT o.o_orderkey, 'row_added', NULL, NULL, NULL FROM {orders} o WHERE o.o_orderkey NOT IN (SELECT k FROM {orders_ours})""",
)
def changes_stream_orders(d):
    arriving = _stream(d, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust")
    )
    return _run(d, streams.changes_stream(arriving, d["orders_ours"], ["k"], ["status", "cust"]))
