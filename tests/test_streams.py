"""Streams against their batch twins, over several micro-batches."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.history import head_moves
from palimpsest.operators.lists import rank_lists
from palimpsest.sources import ingest
from palimpsest.streaming import streams

PROPOSAL = "branch_id string, seq long, commit_id string, expected_head string"


def fed(spark, path, schema, batches):
    """A stream that reads each of `batches` as a micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_head_moves_over_three_batches(spark, tmp_path):
    branches = spark.createDataFrame([("b", "c0"), ("d", "x0")], "branch_id string, head_commit_id string")
    batches = [
        [("b", 1, "c1", "c0"), ("b", 2, "c2", "c1"), ("b", 3, "s", "c1")],
        [("b", 4, "c1", "c2"), ("b", 5, "s", "c2"), ("b", 6, "c3", "c2"), ("d", 7, "c1", "x0")],
        [("b", 8, "c0", "c3"), ("b", 9, "c4", "c3"), ("d", 10, "x1", "x0")],
    ]
    arriving = fed(spark, f"{tmp_path}/in", PROPOSAL, batches)
    streams.head_moves_stream(branches, arriving, f"{tmp_path}/out").awaitTermination()
    got = {(r["seq"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out/judged").collect()}
    twin = head_moves(branches, spark.createDataFrame([p for b in batches for p in b], PROPOSAL))
    assert got == {(r["seq"], r["status"]) for r in twin.collect()}
    assert {s for n, s in got if n in (4, 5, 8)} == {"repeated_commit"}
    heads = spark.read.parquet(f"{tmp_path}/out/heads").where("epoch = 2").select("branch_id", "head_commit_id").collect()
    assert {tuple(r) for r in heads} == {("b", "c4")}


def test_ingest_keeps_every_row(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 10, minute)
    schema = "id long, v string, ts timestamp"
    batches = [[(1, "a", at(0)), (1, "b", at(1)), (2, "c", at(30))], [(2, "d", at(31)), (3, "e", at(5)), (4, "f", at(40))], [(1, "g", at(41)), (5, "toolong", at(42))]]
    arriving = fed(spark, f"{tmp_path}/in", schema, batches)
    wanted = [ingest.Column("id", "bigint", False), ingest.Column("v", "varchar(3)")]
    streams.ingest_stream(arriving, ["id"], wanted, [], "ts", "20 minutes", f"{tmp_path}/out").awaitTermination()
    accepted = spark.read.parquet(f"{tmp_path}/out/accepted").collect()
    assert {(r["id"], r["v"]) for r in accepted} >= {(1, "a"), (2, "c"), (4, "f"), (1, "g")}
    held = spark.read.parquet(f"{tmp_path}/out/quarantine")
    found = {(r["row_key"], r["construct"]) for r in held.where("row_key IS NOT NULL").collect()}
    assert found == {("1", "repeated_key"), ("2", "repeated_key"), ("3", "late_row"), ("5", "too_long")}
    assert held.where("construct = 'unmapped_column'").groupBy("object").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("rows", [[("a", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("x", None)]])
def test_a_cycle_is_refused(spark, rows):
    with pytest.raises(ValueError, match="cyclic_history"):
        rank_lists(spark.createDataFrame(rows, "id string, pred string"))


def test_a_long_list_is_ranked(spark):
    nodes = spark.range(1000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("pred"))
    assert rank_lists(nodes).where("dist <> id OR head <> 0").isEmpty()
