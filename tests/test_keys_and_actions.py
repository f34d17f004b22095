"""Keys that cannot be compared, ids that only look like an answer's, actions on delete, and limits that are none."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.cells import key_text
from palimpsest.operators import diff, merge, referential, spread
from palimpsest.operators.integrity import ForeignKey
from palimpsest.session import cut, scratch, shared_dir

KV = "k long, a string"


def test_repeated_and_null_keys_stop_the_gate(spark):
    base = spark.createDataFrame([(1, "x"), (2, "x")], KV)
    ours = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "n"), (None, "m")], KV)
    attempt = merge.merge3(base, ours, base, ["k"], ["a"], staged=True)
    assert [tuple(r)[:2] for r in attempt.merged.collect()] == [(2, "x")]
    assert {tuple(r) for r in attempt.key_problems.collect()} == {("ours", "duplicate_key", 1, 2), ("ours", "null_key", None, 2)}
    assert attempt.gate().first().asDict() == {"n_conflicts": 0, "n_problems": 2, "clean": False, "decision": "problems"}
    assert merge.merge3(base, base, base, ["k"], ["a"]).gate().first()["decision"] == "commit"

    assert {tuple(r) for r in diff.diff_keys(base, ours, ["k"]).collect()} == {(1, "duplicate_key"), (2, "common"), (None, "null_key")}
    for changed_only in (False, True):
        cells = diff.diff_cells(base, ours, ["k"], ["a"], changed_only=changed_only).collect()
        assert {tuple(r) for r in cells} == {(1, "duplicate_key", None, "1", "2"), (None, "null_key", None, "0", "2")}
    summary = diff.diff_summary(base, ours, ["k"], ["a"]).first().asDict()
    assert summary == {"added": 0, "dropped": 0, "changed": 0, "unchanged": 1, "changed_cells": 0, "skipped_keys": 2}


def test_answers_on_timestamp_keys(spark):
    schema = "at timestamp, k long, a string"
    side = lambda v: spark.sql(f"SELECT timestamp'2024-01-01 10:05:00' AS at, 1L AS k, '{v}' AS a")
    attempt = merge.merge3(side("b"), side("o"), side("t"), ["at", "k"], ["a"])
    ident = attempt.conflicts.first()["conflict_id"]
    answers = spark.createDataFrame([(ident, "theirs", None)], "conflict_id string, choice string, custom string")
    attempt = merge.merge3(side("b"), side("o"), side("t"), ["at", "k"], ["a"], answers)
    row = attempt.merged.first()
    assert (row["a"], row["provisional"]) == ("t", False) and attempt.conflicts.isEmpty() and attempt.resolution_problems.isEmpty()
    assert side("b").schema.simpleString() == f"struct<{schema.replace(' ', ':').replace(',:', ',')}>".replace("long", "bigint")


def test_ids_that_only_parse_alike(spark):
    side = lambda v: spark.createDataFrame([(1, v)], KV)
    schema = "conflict_id string, choice string, custom string"
    for ids in (["cell:a:01"], ["cell:a:01", "cell:a:1"], ["cell:a:", "cell:a", "cell:a:1:2"]):
        answers = spark.createDataFrame([(i, "theirs", None) for i in ids], schema)
        attempt = merge.merge3(side("b"), side("o"), side("t"), ["k"], ["a"], answers)
        known = "cell:a:1" in ids
        assert attempt.merged.first()["a"] == ("t" if known else "o")
        assert attempt.conflicts.isEmpty() == known
        odd = {(r["conflict_id"], r["problem"]) for r in attempt.resolution_problems.collect()}
        assert odd == {(i, "unknown_conflict") for i in ids if i != "cell:a:1"}


def test_key_texts_do_not_collide(spark):
    rows = [("a", None), (None, "a"), ("a:", "b"), ("a", ":b"), ("\\N", None), (None, None), ("", ""), (None, "")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(key_text(["x", "y"], df.schema).alias("t")).distinct().count() == len(rows)


@pytest.mark.parametrize(("action", "effects"), [("restrict", {"blocked", "delete"}), ("no_action", {"delete"})])
def test_blocked_at_once_or_at_the_end(spark, action, effects):
    parent = spark.createDataFrame([(1,), (2,)], "p long")
    child = spark.createDataFrame([(10, 1, 1)], "c long, one long, two long")
    fks = [ForeignKey("child", ("one",), "parent", ("p",), "cascade"), ForeignKey("child", ("two",), "parent", ("p",), action)]
    out = referential.referential_effects({"parent": parent, "child": child}, {"parent": ["p"], "child": ["c"]}, fks, {"parent": parent.where("p = 1")})
    found = out.collect()
    assert {r["effect"] for r in found} == effects
    assert {(r["effect"], r["columns"]) for r in found} <= {("delete", "one"), ("blocked", "two")}


def test_two_references_to_one_parent_are_told_apart(spark):
    parent = spark.createDataFrame([(1,)], "p long")
    child = spark.createDataFrame([(10, 1, 1)], "c long, one long, two long")
    fks = [ForeignKey("child", (c,), "parent", ("p",), "set_null") for c in ("one", "two")]
    out = referential.referential_effects({"parent": parent, "child": child}, {"parent": ["p"], "child": ["c"]}, fks, {"parent": parent})
    assert sorted(r["columns"] for r in out.collect()) == ["one", "two"]


def test_order_by_two_columns_at_any_size(spark):
    rows = [(1, t, o) for t in (2047, 2048, 3_000_000_000) for o in (0, 5, 1 << 30)]
    df = spark.createDataFrame(rows, "g int, t long, o int")
    out = spread.running_last(df, ["g"], "t", {"was": F.struct("t", "o")}, inclusive=False, tie=["o"])
    got = sorted((r["t"], r["o"], r["was"] and tuple(r["was"])) for r in out.collect())
    assert got == [(t, o, rows[i - 1][1:] if i else None) for i, (_, t, o) in enumerate(rows)]


def test_scratch_deletes_what_it_cut(spark):
    before = cut(spark.range(3))
    with scratch():
        inside = cut(spark.range(5))
        files = inside.inputFiles()
        assert inside.count() == 5
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert before.count() == 3


class _Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, name, default=None):
        return self.values.get(name, default)


@pytest.mark.parametrize("master", ["yarn", "spark://host", "local-cluster[2,1,1024]", ""])
def test_a_cluster_must_name_its_shared_folder(master):
    session = type("S", (), {"conf": _Conf(**{"spark.master": master})})()
    with pytest.raises(ValueError):
        shared_dir(session)
