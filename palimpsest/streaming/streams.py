"""The log-like operators on streams. Each gives what its batch twin gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.cells import any_of, comparable, key_text, same, text
from palimpsest.operators.history import head_moves
from palimpsest.session import cut
from palimpsest.sources.ingest import Column, Reference, ingest


def audit_windows_stream(events: DataFrame, width: str, late: str, by: Sequence[str]) -> DataFrame:
    """Events per tumbling window and group; rows later than `late` are dropped
    and a window is emitted once it is closed."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n_events")
    )


def changes_stream(incoming: DataFrame, base: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Cell changes of incoming rows against a static version, in append mode.

    A row that is not in `base` is row_added; a stream cannot tell that a row
    was dropped."""
    was = base.select(*key, F.struct(*cols).alias("was"))
    met = incoming.select(*key, F.struct(*cols).alias("now")).join(was, list(key), "left")
    entry = lambda kind, prop, a, b: F.struct(
        F.lit(kind).alias("kind"), prop.cast("string").alias("property"), a.cast("string").alias("from_value"), b.cast("string").alias("to_value")
    )
    none = F.lit(None)
    cells = []
    for c in cols:
        dtype = base.schema[c].dataType
        a, b = F.col(f"was.`{c}`"), F.col(f"now.`{c}`")
        cells.append(F.when(~same(comparable(a, dtype), comparable(b, dtype)), entry("cell_changed", F.lit(c), text(a, dtype), text(b, dtype))))
    changes = F.when(F.col("was").isNull(), F.array(entry("row_added", none, none, none))).otherwise(F.array_compact(F.array(*cells)))
    return met.select(*key, F.explode(changes).alias("c")).select(*key, "c.*")


def _epoch(path: str, name: str, epoch: int) -> str:
    return f"{path.rstrip('/')}/{name}/epoch={epoch}"


def _earlier(spark: SparkSession, out: str, name: str, epoch: int, schema: T.StructType) -> DataFrame:
    """What the epochs before `epoch` wrote; an epoch that is run again does not see itself."""
    kept = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    if epoch == 0:
        return spark.createDataFrame([], kept)
    return spark.read.schema(kept).parquet(f"{out.rstrip('/')}/{name}").where(F.col("epoch") < epoch)


def ingest_stream(
    raw: DataFrame,
    key: Sequence[str],
    columns: Sequence[Column],
    references: Sequence[Reference],
    event_time: str,
    late: str,
    out: str,
) -> StreamingQuery:
    """Check arriving rows against types and static parents; accepted rows and
    quarantine records go to two tables under `out`, and every row to one of
    them. A key that comes again within `late`, and a row that is more than
    `late` behind the newest of earlier epochs, go to quarantine as
    `repeated_key` and `late_row`. An epoch that is run again replaces its
    folder, so a restart writes nothing twice."""
    seen_schema = T.StructType([raw.schema[k] for k in key] + [T.StructField("_time", T.TimestampType())])

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({"_time": F.col(event_time).cast("timestamp"), "_n": F.monotonically_increasing_id()})
        arrived = f"{_epoch(out, 'arrived', epoch)}"
        rows.write.mode("overwrite").parquet(arrived)
        rows = spark.read.schema(rows.schema).parquet(arrived)
        earlier = _earlier(spark, out, "seen", epoch, seen_schema)
        newest = earlier.agg(F.max("_time")).first()[0]
        bound = (F.lit(newest) - F.expr(f"INTERVAL {late}")) if newest is not None else F.lit(None).cast("timestamp")
        is_late = F.coalesce(F.col("_time") < bound, F.lit(False))
        known = earlier.where(F.coalesce(F.col("_time") >= bound, F.lit(False))).select(*key).distinct().withColumn("_known", F.lit(True))
        # the first arrival of a key that is not late is the one that counts
        first = rows.where(~is_late).groupBy(*key).agg(F.min("_n").alias("_first"))
        judged = rows.join(known, list(key), "left").join(first, list(key), "left")
        unkeyed = any_of([F.col(f"`{k}`").isNull() for k in key])
        again = ~unkeyed & (F.coalesce("_known", F.lit(False)) | (F.col("_n") != F.col("_first")))
        fault = F.when(is_late, "late_row").when(again, "repeated_key")
        judged = judged.withColumn("_fault", fault)
        accepted, quarantine = ingest(judged.where("_fault IS NULL").select(*batch.columns), key, columns, references)
        if epoch:  # told once
            quarantine = quarantine.where("construct <> 'unmapped_column'")
        held = judged.where("_fault IS NOT NULL").select(
            key_text(key, raw.schema).alias("row_key"), F.col("_fault").alias("construct"), F.lit(event_time).alias("object"), F.col("_time").cast("string").alias("detail")
        )
        accepted.write.mode("overwrite").parquet(_epoch(out, "accepted", epoch))
        quarantine.unionByName(held).write.mode("overwrite").parquet(_epoch(out, "quarantine", epoch))
        fresh = judged.where("_fault IS NULL").select(*key, "_time")
        fresh.write.mode("overwrite").parquet(_epoch(out, "seen", epoch))

    query = raw.writeStream.foreachBatch(write).option("checkpointLocation", f"{out.rstrip('/')}/_progress")
    return query.trigger(availableNow=True).start()


def head_moves_stream(branches: DataFrame, proposals: DataFrame, out: str) -> StreamingQuery:
    """Compare-and-swap of heads over arriving proposals.

    Each micro-batch is judged by the batch operator against the heads the
    earlier ones left, so a branch that gets most of the proposals is not read
    in order by one task. A commit id that an earlier epoch has seen on the
    branch, accepted or not, is a repeated one. Each epoch writes only the heads
    that it moved; an epoch that is run again starts from the same heads."""
    spark: SparkSession = branches.sparkSession
    judged_schema = T.StructType([*proposals.schema.fields, T.StructField("status", T.StringType())])
    start = branches.select("branch_id", "head_commit_id")

    def write(batch: DataFrame, epoch: int) -> None:
        moved = _earlier(spark, out, "heads", epoch, start.schema)
        last = moved.groupBy("branch_id").agg(F.max_by("head_commit_id", "epoch").alias("moved"))
        heads = start.join(last, "branch_id", "left").select("branch_id", F.coalesce("moved", "head_commit_id").alias("head_commit_id"))
        ids = ["branch_id", "commit_id"]
        seen = _earlier(spark, out, "judged", epoch, judged_schema).select(*ids)
        seen = seen.unionByName(start.select("branch_id", F.col("head_commit_id").alias("commit_id"))).distinct()
        repeated = batch.join(seen, ids, "left_semi").withColumn("status", F.lit("repeated_commit"))
        # stored: a batch may be one file, which one task would read each time it is asked for
        unseen = cut(batch.join(seen, ids, "left_anti"))
        judged = head_moves(heads, unseen).unionByName(repeated)
        judged_at = _epoch(out, "judged", epoch)
        judged.select(*judged_schema.names).write.mode("overwrite").parquet(judged_at)
        accepted = spark.read.schema(judged_schema).parquet(judged_at).where("status = 'accepted'")
        after = accepted.groupBy("branch_id").agg(F.max_by("commit_id", "seq").alias("head_commit_id"))
        after.write.mode("overwrite").parquet(_epoch(out, "heads", epoch))

    query = proposals.writeStream.foreachBatch(write).option("checkpointLocation", f"{out.rstrip('/')}/_progress")
    return query.trigger(availableNow=True).start()
