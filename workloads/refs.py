"""Merges of branches and commits to them, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.operators import history
from palimpsest.plans import merging
from palimpsest.session import cut, shared_dir
from palimpsest.sources.commits import CommitStore
from workloads.data import Data, oracle
from workloads.fleet_data import keyed_snapshots
from workloads.history import MERGE_BASE

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return register


_ENDS = """(SELECT i.head_commit_id AS a, f.head_commit_id AS b FROM {merge_requests} r JOIN {ref_branches} i ON i.branch_id = r.into_ref
  JOIN {ref_branches} f ON f.branch_id = r.from_ref WHERE i.project_id = f.project_id AND i.branch_id <> f.branch_id)"""
_TYPE = lambda x: f"({x}.type_base || '(' || cast({x}.type_param AS string) || ')')"


def _apart(of) -> str:
    b, o, t = (of(x) for x in "bot")
    return f"CASE WHEN {b} <> {o} AND {b} <> {t} AND {o} <> {t} THEN 1 ELSE 0 END"


def _stays(has) -> str:
    """Whether what only appears and goes, never changes, is in the merge of base, ours and theirs."""
    return f"CASE WHEN {has('x.base')} THEN {has('x.ours')} AND {has('x.theirs')} ELSE {has('x.ours')} OR {has('x.theirs')} END"


_NOTE = _stays(lambda c: f"{c} % 2 = 0")
_KEY = _stays(lambda c: f"{c} % 4 = 0")
_SIDES = "FROM vb b JOIN vo o ON o.merge_id = b.merge_id AND o.column_id = b.column_id JOIN vt t ON t.merge_id = b.merge_id AND t.column_id = b.column_id"
_SIDE = lambda name, commit: f"{name} AS MATERIALIZED (SELECT x.merge_id, c.* FROM x JOIN {{snapshot_columns}} c ON c.commit_id = x.{commit})"
_STEPS, _FOUND = MERGE_BASE.replace("{commit_pairs}", _ENDS).removeprefix("WITH RECURSIVE ").rsplit("\nSELECT q.a", 1)
_MERGES = f"""{_STEPS},
bs AS MATERIALIZED (SELECT q.a{_FOUND}),
r AS (SELECT r.merge_id, i.head_commit_id AS ours, f.head_commit_id AS theirs, CASE WHEN i.branch_id IS NULL OR f.branch_id IS NULL THEN 'unknown_branch'
   WHEN i.project_id <> f.project_id THEN 'cross_project' WHEN i.branch_id = f.branch_id THEN 'same_branch' END AS refused
  FROM {{merge_requests}} r LEFT JOIN {{ref_branches}} i ON i.branch_id = r.into_ref LEFT JOIN {{ref_branches}} f ON f.branch_id = r.from_ref),
x AS MATERIALIZED (SELECT r.*, bs.base FROM r LEFT JOIN bs ON bs.a = r.ours AND bs.b = r.theirs AND r.refused IS NULL),
{_SIDE("vb", "base")}, {_SIDE("vo", "ours")}, {_SIDE("vt", "theirs")},
n AS (SELECT b.merge_id, sum({_apart(lambda s: f"{s}.name")} + {_apart(_TYPE)} + {_apart(lambda s: f"{s}.nullable")}) AS n
  {_SIDES} WHERE b.column_id IN (1, 2) GROUP BY b.merge_id),
s AS (SELECT x.*, coalesce(n.n, 0) AS n_conflicts, CASE WHEN x.base IS NOT NULL AND ({_KEY}) AND NOT ({_NOTE}) THEN 1 ELSE 0 END AS n_problems FROM x LEFT JOIN n ON n.merge_id = x.merge_id),
m AS MATERIALIZED (SELECT *, CASE WHEN refused IS NOT NULL THEN refused WHEN base IS NULL THEN 'no_common_ancestor' WHEN n_conflicts > 0 THEN 'conflicts'
   WHEN n_problems > 0 THEN 'problems' ELSE 'merged' END AS status FROM s)"""


def _merged(d) -> merging.RefMerges:
    return merging.merge_refs(keyed_snapshots(d), history.graph(d["commits"]), d["ref_branches"], d["merge_requests"])


@query(
    "merge_refs",
    f"WITH RECURSIVE {_MERGES} SELECT merge_id, status, base, cast(n_conflicts AS bigint) AS n_conflicts, cast(n_problems AS bigint) AS n_problems, cast(n_problems AS bigint) AS n_new_problems FROM m",
)
def merge_refs(d):
    return _merged(d).status.select("merge_id", "status", "base", "n_conflicts", "n_problems", "n_new_problems")


_PICK = lambda of: f"CASE WHEN {of('b')} = {of('o')} THEN {of('t')} ELSE {of('o')} END"


@query(
    "merge_refs_columns",
    f"""WITH RECURSIVE {_MERGES} SELECT b.merge_id, b.column_id, {_PICK(lambda s: f"{s}.name")} AS name, {_PICK(_TYPE)} AS type, {_PICK(lambda s: f"{s}.nullable")} AS nullable
{_SIDES} JOIN m ON m.merge_id = b.merge_id WHERE m.status = 'merged' AND b.column_id IN (1, 2)
UNION ALL SELECT merge_id, 3, 'note', 'text(1)', true FROM m x WHERE status = 'merged' AND ({_NOTE})""",
)
def merge_refs_columns(d):
    kind = F.concat("type_base", F.lit("("), F.col("type_params")[0].cast("string"), F.lit(")"))
    return _merged(d).merged.columns.select(F.col("project_id").alias("merge_id"), "column_id", "name", kind.alias("type"), "nullable")


@query(
    "commit_results",
    """WITH b AS (SELECT branch_id, cast(substr(branch_id, 2) AS bigint) AS n FROM {ref_branches}),
t AS (SELECT branch_id, 'second-' || branch_id AS commit_id, CASE WHEN n % 8 = 0 THEN 'branch_moved' WHEN n % 4 = 1 THEN 'branch_moved' WHEN n % 4 = 2 THEN 'no_change' ELSE 'committed' END AS status,
   CASE WHEN n % 8 = 0 THEN 'other-' WHEN n % 4 IN (1, 2) THEN 'first-' ELSE 'second-' END || branch_id AS head FROM b
  UNION ALL SELECT 'new-' || branch_id, 'made-' || branch_id, 'committed', 'made-' || branch_id FROM b WHERE n % 4 = 0
  UNION ALL SELECT branch_id, 'first-' || branch_id, 'repeated_commit', 'other-' || branch_id FROM b WHERE n % 8 = 0)
SELECT t.branch_id, t.commit_id, t.status, t.head, (SELECT count(*) FROM {snapshot_columns} c JOIN {ref_branches} r ON r.head_commit_id = c.commit_id
  WHERE r.branch_id = replace(t.branch_id, 'new-', '')) AS n_columns FROM t""",
)
def commit_results(d):
    """Two writers commit to all branches at once: who comes second sees it, nothing is lost or half done."""
    spark = d.spark
    store = CommitStore(spark, f"{shared_dir(spark).rstrip('/')}/commits-{uuid.uuid4().hex}")
    branches = d["ref_branches"].withColumn("n", F.expr("cast(substr(branch_id, 2) AS bigint)"))
    columns = d["snapshot_columns"].drop("project_id").withColumnRenamed("commit_id", "head_commit_id")
    held = cut(columns.join(branches.select("head_commit_id", "branch_id", "n"), "head_commit_id").drop("head_commit_id"))
    named = lambda prefix: F.concat(F.lit(prefix), F.col("branch_id"))
    rows = lambda df, prefix: {"columns": df.withColumn("commit_id", named(prefix)).drop("branch_id", "n")}
    ask = lambda df, prefix, head, second=None: df.select(
        "branch_id", named(prefix).alias("commit_id"), head.alias("expected_head"), (F.lit(None).cast("string") if second is None else second).alias("parent2_id")
    )
    store.commit(ask(branches, "first-", F.lit(None).cast("string")), rows(held, "first-"))

    changed = held.withColumn("name", F.when(F.col("n") % 4 == 0, F.concat("name", F.lit("_x"))).otherwise(F.col("name")))
    head = F.when(F.col("n") % 4 == 1, named("gone-")).otherwise(named("first-"))
    asked = ask(branches, "second-", head, F.when(F.col("n") % 4 == 3, F.lit("merged")))
    fresh = branches.where("n % 4 = 0")
    asked = asked.unionByName(ask(fresh, "made-", F.lit(None).cast("string")).withColumn("branch_id", named("new-")))
    asked = asked.unionByName(ask(branches.where("n % 8 = 0"), "first-", named("first-")))
    both = {"columns": rows(changed, "second-")["columns"].unionByName(rows(held.where("n % 4 = 0"), "made-")["columns"])}

    def meanwhile(left=[1]):  # noqa: B006
        if left:  # another writer, once
            left.pop()
            CommitStore(spark, store.path).commit(ask(branches.where("n % 8 = 0"), "other-", named("first-")), rows(held.where("n % 8 = 0").withColumn("name", F.lit("theirs")), "other-"))

    results = store.commit(asked, both, meanwhile)
    sizes = store.rows("columns").groupBy(F.col("commit_id").alias("head")).agg(F.count(F.lit(1)).alias("n_columns"))
    return results.join(store.heads().select("branch_id", "head"), "branch_id").join(sizes, "head").select("branch_id", "commit_id", "status", "head", "n_columns")
