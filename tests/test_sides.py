"""Sides of joins that grow with the input are exchanged and not collected in the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import spread
from palimpsest.operators.catalog import Catalog
from palimpsest.operators.catalog_merge import shown_conflicts
from palimpsest.operators.match import _reuse, table_classes
from palimpsest.operators.spread import lookup, lookup_large, number_within, running_last
from palimpsest.session import cut
from palimpsest.sources.versions import load_versions, write_version
from workloads.data import Data


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_of_many_rows_are_exchanged(spark, tmp_path):
    rows = spark.range(600_000).select("id", (F.col("id") % 7).alias("x"))
    stored = cut(rows)
    rows.write.parquet(f"{tmp_path}/part.parquet")
    many = spark.range(700_000, numPartitions=4)
    for table in (stored, Data(spark, str(tmp_path))["part"]):
        ids = table.select("id")
        for how, n in (("inner", 600_000), ("left_anti", 100_000)):
            met = many.join(ids, "id", how)
            assert "Broadcast" not in plan(met) and met.count() == n
    inside = "SELECT count(*) AS n FROM {a} WHERE id IN (SELECT max(id) FROM {b} GROUP BY x)"
    assert "Broadcast" not in plan(found := spark.sql(inside, a=many, b=stored)) and found.first()["n"] == 7


def test_few_rows_are_left_to_spark(spark):
    small = cut(spark.range(100))
    assert "BroadcastHashJoin" in plan(spark.range(1000).join(small, "id"))


def test_repeats_are_not_taken_for_the_rows_they_come_from(spark):
    few = cut(spark.range(300).withColumn("k", F.col("id") % 3))
    big = few.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(999))))
    small = cut(spark.range(1000).select(F.col("id").cast("int").alias("at"), (F.col("id") * 2).alias("v")))
    for met in (lookup_large(big, small, ["at"], ["id"]), lookup(big, small, ["at"], ["id"])):
        got = met.select("id", "at", "v").collect()
        last = plan(met.select("id", "at", "v"))
        assert len(got) == 300_000 and all(r["v"] == 2 * r["at"] for r in got)
        assert "SortMergeJoin" in last
        assert met._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 1


def test_versions_are_not_exchanged_by_their_commit(spark, tmp_path):
    path = f"{tmp_path}/versions"
    for name in ("a", "b", "c"):
        write_version(spark.range(50).withColumn("x", F.lit(name)), path, name)
    wanted = spark.createDataFrame([("a",), ("a",), ("c",), ("gone",), (None,)], "commit_id string")
    got = load_versions(spark, path, wanted)
    assert sorted((r["commit_id"], r["n"]) for r in got.groupBy("commit_id").agg(F.count("id").alias("n")).collect()) == [("a", 50), ("c", 50)]
    assert "SortMergeJoin" not in plan(got).split("BroadcastExchange")[0]


def test_commits_are_derived_once(spark, tmp_path):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("view", "error", "purchase")]), (F.col("id") % 3 + 1).cast("int"))
    rows = spark.range(30).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 2).alias("user_id"), kinds.alias("event_type"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    d = Data(spark, str(tmp_path))
    assert "Window" not in plan(d["commits"]) and d["commits"].count() == 30
    assert d["branches"].count() == 4


def test_groups_of_one_bucket_carry_nothing(spark, monkeypatch):
    """Many small groups are numbered and scanned without collecting a row for each."""
    stored = cut(spark.range(20_000).select((F.col("id") % 5000).alias("g"), F.col("id").alias("s"), F.col("id").alias("v")))
    carried, plain = [], spread._carried
    monkeypatch.setattr(spread, "_carried", lambda rows, summary, part: carried.append(summary) or plain(rows, summary, part))
    numbered = number_within(stored, ["g"], "s", "n")
    scanned = running_last(stored, ["g"], "s", {"p": F.col("v")}, inclusive=False)
    assert all(r["n"] == r["s"] // 5000 + 1 for r in numbered.collect())
    assert all(r["p"] == (r["s"] - 5000 if r["s"] >= 5000 else None) for r in scanned.collect())
    assert [summary.count() for summary in carried] == [0, 0]


def test_tokens_of_classes_are_exchanged(spark):
    columns = cut(spark.range(400).selectExpr("id % 50 project_id", "id table_id", "id column_id", "'n' || id name", "'t' type", "1 position"))
    _, _, good = table_classes(columns, columns)
    assert {(r["a"] == r["b"], r["score"]) for r in good.collect()} == {(True, 1.0)} and good.count() == 400
    assert good._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 3


def test_members_of_the_head_are_exchanged(spark):
    members = cut(spark.range(60).selectExpr("id % 5 project_id", "id % 10 table_id", "id constraint_id", "'n' || id name", "1 ordinal"))
    fresh = members.withColumn("constraint_id", F.col("constraint_id") + 1000)
    got = _reuse(fresh, members, "constraint_id", F.col("name"))
    assert sorted(r["constraint_id"] for r in got.collect()) == list(range(60))
    assert "strategy=merge" in got._jdf.queryExecution().optimizedPlan().toString()


def test_descriptions_of_conflicts_are_exchanged(spark):
    ids = "project_id long, table_id long, "
    side = Catalog(
        spark.createDataFrame([(1, 1, "t", 1)], ids + "name string, ordinal long"),
        spark.createDataFrame([(1, 1, 5, "c", "text", [], True, "", 1)], ids + "column_id long, name string, type_base string, type_params array<int>, nullable boolean, default_expr string, position int"),
        spark.createDataFrame(
            [(1, 1, 7, "u", "unique", [5], None, [], "", "", "", 1)],
            ids + "constraint_id long, name string, kind string, column_ids array<long>, ref_table_id long, ref_column_ids array<long>, on_delete string, on_update string, expr string, ordinal long",
        ),
        spark.createDataFrame([(1, 1, 9, "x", [(5, True)], False, "", 1)], ids + "index_id long, name string, columns array<struct<column_id:long,desc:boolean>>, is_unique boolean, method string, ordinal long"),
    )
    told = "base_value string, ours_value string, theirs_value string"
    rows = [(1, 1, "7", "constraint:1:1:7", "a", "b", "c"), (1, 1, "9", "index:1:1:9", "a", "b", "c")]
    shown = shown_conflicts(spark.createDataFrame(rows, ids + f"object_id string, conflict_id string, {told}"), side, side, side)
    assert sorted({r["base_value"], r["theirs_value"]} == {r["ours_value"]} and r["ours_value"] for r in shown.collect()) == ["(c DESC)", "UNIQUE (c)"]
    # six descriptions, and the three lookups of referenced tables
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 9
