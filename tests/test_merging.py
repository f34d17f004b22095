"""Merges of branches, many in one job."""

from __future__ import annotations

from palimpsest.operators import history
from palimpsest.operators.catalog import Catalog
from palimpsest.plans.merging import merge_refs
from pyspark.sql import functions as F
from tests.small import O_STATUS, ORDERS, U_EMAIL, U_NAME, USERS, catalog, edited, index, shop


def setup(spark):
    """One project per story; commit ids are project * 100 + step."""
    email = lambda name: lambda s: s[USERS]["columns"][U_EMAIL].update(name=name)
    stories = {
        1: (shop(), edited(shop(), email("mail")), edited(shop(), lambda s: s[ORDERS]["columns"][O_STATUS].update(default="'new'"))),
        2: (shop(), edited(shop(), email("mail")), edited(shop(), email("contact"))),
        3: (shop(), edited(shop(), lambda s: s[USERS]["indexes"].update({301: index("by_name", [U_NAME])})), edited(shop(), lambda s: s[USERS]["columns"].pop(U_NAME))),
        4: (shop(), edited(shop(), email("mail")), edited(shop(), email("other"))),
    }
    parts, commits, branches = [], [], []
    for p, versions in stories.items():
        for step, schema in enumerate(versions):
            one = catalog(spark, {p: schema})
            parts.append(one.map(lambda df, c=p * 100 + step: df.withColumn("commit_id", F.lit(c).cast("long"))))
        root = None if p == 4 else p * 100  # two roots: the branches of project 4 share nothing
        commits += [(p, p * 100, None, None), (p, p * 100 + 1, p * 100, None), (p, p * 100 + 2, root, None)]
        branches += [(f"m{p}", p, "main", p * 100 + 1), (f"f{p}", p, "work", p * 100 + 2)]
    snapshots = parts[0]
    for other in parts[1:]:
        snapshots = Catalog(*[getattr(snapshots, a).unionByName(getattr(other, a)) for a in ("tables", "columns", "constraints", "indexes")])
    graph = history.graph(spark.createDataFrame(commits, "project_id long, commit_id long, parent_id long, parent2_id long"))
    return snapshots, graph, spark.createDataFrame(branches, "branch_id string, project_id long, name string, head_commit_id long")


def test_every_outcome_and_answers(spark):
    snapshots, graph, branches = setup(spark)
    asked = [(10, "m1", "f1"), (20, "m2", "f2"), (21, "f2", "m2"), (30, "m3", "f3"), (40, "m4", "f4"), (50, "m1", "m1"), (60, "m1", "f2"), (70, "m1", "gone")]
    requests = spark.createDataFrame(asked, "merge_id long, into_ref string, from_ref string")
    got = merge_refs(snapshots, graph, branches, requests)
    rows = {r.merge_id: r for r in got.status.collect()}
    assert {m: r.status for m, r in rows.items()} == {
        10: "merged", 20: "conflicts", 21: "conflicts", 30: "problems", 40: "no_common_ancestor", 50: "same_branch", 60: "cross_project", 70: "unknown_branch",
    }
    assert (rows[10].base, rows[10].message, rows[10].n_changes) == (100, "Merge work into main", 1)
    assert (rows[30].n_problems, rows[30].n_new_problems, rows[20].n_conflicts) == (1, 1, 1)
    assert {(r.project_id, r.code, r.new) for r in got.problems.collect()} == {(30, "index_missing_column", True)}
    merged = {(r.project_id, r.column_id): (r.name, r.default_expr) for r in got.merged.columns.collect()}
    assert {p for p, _ in merged} == {10} and merged[10, U_EMAIL][0] == "mail" and merged[10, O_STATUS][1] == "'new'"

    # answers hold the request, so each is answered by itself
    answers = spark.createDataFrame(
        [(f"column_name:20:{USERS}:{U_EMAIL}", "theirs", None), (f"column_name:21:{USERS}:{U_EMAIL}", "custom", " ")], "conflict_id string, choice string, custom string"
    )
    got = merge_refs(snapshots, graph, branches, requests.where("merge_id in (20, 21)"), answers)
    assert {r.merge_id: r.status for r in got.status.collect()} == {20: "merged", 21: "invalid_resolution"}
    assert [r.name for r in got.merged.columns.where(F.col("column_id") == U_EMAIL).collect()] == ["contact"]
