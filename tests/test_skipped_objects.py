"""Objects whose id is repeated or null."""

from __future__ import annotations

from dataclasses import replace

import pytest
from palimpsest.operators.catalog import OBJECTS
from palimpsest.operators.catalog_diff import catalog_diff, catalog_diff_summary
from palimpsest.operators.catalog_merge import merge_catalogs
from palimpsest.plans.migration import migration_plan

from .small import FK, IX, O_USER, ORDERS, catalog, shop

IDS = {"table": ORDERS, "column": O_USER, "constraint": FK, "index": IX}


def doubled(cat, what):
    attr, ident = OBJECTS[what]
    rows = getattr(cat, attr)
    return replace(cat, **{attr: rows.union(rows.where(rows[ident] == IDS[what]))})


@pytest.mark.parametrize("what", list(OBJECTS))
def test_a_repeated_id_is_told(spark, what):
    base = catalog(spark, {7: shop()})
    ours = doubled(base, what)
    found = [r for r in catalog_diff(base, ours).collect() if r["kind"] == "duplicate_key"]
    assert [(r["project_id"], r["table_id"], r["object"], r["from_value"], r["to_value"]) for r in found] == [(7, ORDERS, what, "1", "2")]
    steps = [r for r in migration_plan(base, ours).collect() if r["action"] == "duplicate_key"]
    assert [(r["phase"], r["from_value"], r["to_value"], r["warning_code"]) for r in steps] == [(0, "1", "2", "duplicate_key")]
    attempt = merge_catalogs(base, ours, base)
    assert "duplicate_key" in {r["code"] for r in attempt.problems().collect()}
    gates = attempt.gate(spark.createDataFrame([(7,)], "project_id long")).collect()
    assert [r["clean"] for r in gates] == [False]


def test_a_null_id_is_told_and_counted(spark):
    base = catalog(spark, {7: shop()})
    row = base.columns.first().asDict() | {"column_id": None}
    ours = replace(base, columns=base.columns.union(spark.createDataFrame([tuple(row.values())], base.columns.schema)))
    found = [r for r in catalog_diff(base, ours).collect() if r["kind"] == "null_key"]
    assert [(r["object"], r["object_id"], r["from_value"], r["to_value"]) for r in found] == [("column", None, "0", "1")]
    assert catalog_diff_summary(base, ours).first()["n_changes"] == 1
    gates = merge_catalogs(base, ours, base).gate(spark.createDataFrame([(7,)], "project_id long")).collect()
    assert [r["decision"] for r in gates] == ["problems"]


def test_nothing_is_told_of_sound_catalogs(spark):
    base = catalog(spark, {7: shop()})
    assert catalog_diff(base, base).isEmpty() and migration_plan(base, base).isEmpty()
    gates = merge_catalogs(base, base, base).gate(spark.createDataFrame([(7,)], "project_id long")).collect()
    assert [r["decision"] for r in gates] == ["commit"]
