"""No cap on columns or ordinals; the fixed reading orders."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.catalog import Catalog, plain_columns, typed_columns
from palimpsest.operators.catalog_checks import check_catalog
from palimpsest.operators.catalog_diff import KINDS, order_changes
from palimpsest.operators.catalog_replay import replay_catalog
from palimpsest.operators.history import head_moves
from palimpsest.operators.merge import ordered_conflicts
from palimpsest.plans.migration import ordered_plan
from tests.small import COLUMNS, CONSTRAINTS, INDEXES, TABLES
from tests.test_catalog_replay import LOG, frames, log_row


def test_a_table_of_5000_columns_keeps_its_order(spark):
    state = {1: {"name": "t", "columns": {1: {"name": "a", "type": "text", "nullable": True, "default": ""}}, "constraints": {}, "indexes": {}}}
    made = [{"column_id": 100 + i, "name": f"c{i}", "type": "text", "nullable": True} for i in range(5000)]
    stamp = 1 << 55  # nanoseconds
    log = [
        {"op": "create_table", "seq": stamp, "table_id": 2, "name": "wide", "columns": made},
        {"op": "add_column", "seq": stamp + 1, "table_id": 2, "column_id": 7, "name": "late", "type": "text", "nullable": True},
    ]
    edits = spark.createDataFrame([log_row(1, e) for e in log], LOG)
    after, errors = replay_catalog(frames(spark, {1: state}), edits)
    assert errors.isEmpty()
    wide = {r["name"]: r["position"] for r in after.columns.where("table_id = 2").collect()}
    assert wide["late"] == 5001 and all(wide[f"c{i}"] == i + 1 for i in range(5000))


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_repeated_index_names_at_any_ordinal(spark, kind):
    places = [(1, 2047), (2, 2048), (3, 2_000_000_000)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn(
        "ordinal" if "ordinal" in schema else "position", F.col("ordinal" if "ordinal" in schema else "position").cast(kind)
    )
    catalog = Catalog(
        make([(1, t, f"t{t}", n) for t, n in places], TABLES),
        make([(1, t, t * 10, "a", "text", [], True, "", 1) for t, _ in places], COLUMNS),
        make([], CONSTRAINTS),
        make([(1, t, t * 100 + i, "same", [(t * 10, False)], False, "", 1 << 30 if i else 1) for t, _ in places for i in (0, 1)], INDEXES),
    )
    found = check_catalog(catalog).collect()
    assert {r["code"] for r in found} == {"duplicate_index_name"}
    on = ["t1", "t1", "t2", "t2", "t3", "t3"]
    assert sorted(r["message"] for r in found) == sorted(f'two indexes are named "same" (on "{a}" and "{b}")' for a, b in zip(on, on[1:]))


def shuffled(rows, seed=3):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return rows


def test_reading_orders(spark):
    changes = [(1, t, k, o, i) for t in ("a", "b") for k in KINDS for o, i in (("x", "1"), ("x", "2"), ("y", "0"))]
    df = spark.createDataFrame(shuffled(changes), "project_id int, table string, kind string, object string, object_id string")
    assert [tuple(r) for r in order_changes(df).collect()] == changes
    conflicts = [(t, o, p, f"id{n}") for t in (1, 2) for o in (1, 2) for p in ("name", "type") for n in (1, 2)]
    df = spark.createDataFrame(shuffled(conflicts), "t int, o int, property string, conflict_id string")
    assert [tuple(r) for r in ordered_conflicts(df, ["t"], ["o"]).collect()] == conflicts
    names = ["project_id", "phase", "table_order", "table", "object_order", "object", "action"]
    steps = [(1, p, n, f"t{n}", o, f"o{o}", a) for p in (1, 2, 13) for n in (0, 10, 2000) for o in (0, 9, 10) for a in ("a", "b")]
    df = spark.createDataFrame(shuffled(steps), ", ".join(f"{n} {'int' if n in ('project_id', 'phase', 'table_order', 'object_order') else 'string'}" for n in names))
    assert [tuple(r) for r in ordered_plan(df).collect()] == steps


def test_heads_of_no_proposals(spark):
    branches = spark.createDataFrame([("b", "c")], "branch_id string, head_commit_id string")
    assert head_moves(branches, spark.createDataFrame([], "branch_id string, seq long, commit_id string, expected_head string")).isEmpty()


def test_type_parameters_keep_their_sign(spark):
    rows = [(1, 1, i, f"c{i}", base, params, True, "", i) for i, (base, params) in enumerate([("numeric", [10, -2]), ("text", []), ("varchar", [255])])]
    columns = spark.createDataFrame(rows, COLUMNS)
    back = typed_columns(plain_columns(columns)).select("column_id", "type_base", "type_params").collect()
    assert sorted(tuple(r) for r in back) == [(r[2], r[4], r[5]) for r in rows]
