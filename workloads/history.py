"""Commit graph queries over all projects at once."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from palimpsest.operators import history
from palimpsest.session import shared_dir
from palimpsest.sources.graph_index import GraphIndex
from workloads.data import Data, oracle

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return register


_HEADS = "SELECT head_commit_id AS start FROM {branches}"
_PARENTS = """links AS (SELECT commit_id, parent_id AS parent, 0 AS bit FROM {commits} WHERE parent_id IS NOT NULL
  UNION ALL SELECT commit_id, parent2_id, 1 FROM {commits} WHERE parent2_id IS NOT NULL)"""


def _starts(d):
    return d["branches"].select(F.col("head_commit_id").alias("start"))


@query(
    "ancestors",
    f"""WITH RECURSIVE {_PARENTS},
anc AS (SELECT start, start AS commit_id FROM ({_HEADS}) UNION SELECT a.start, l.parent FROM anc a JOIN links l ON l.commit_id = a.commit_id)
SELECT start, commit_id FROM anc""",
)
def ancestors(d):
    return history.ancestors(history.graph(d["commits"]), _starts(d))


# The oracle walks generation by generation and builds the parent choices only
# along shortest links to nodes no deeper than the first hit.
MERGE_BASE = f"""WITH RECURSIVE {_PARENTS}, pairs AS (SELECT DISTINCT a, b FROM {{commit_pairs}}),
anc AS (SELECT DISTINCT a, a AS node FROM pairs UNION SELECT x.a, l.parent FROM anc x JOIN links l ON l.commit_id = x.node),
walk AS (SELECT a, b, b AS node, 0 AS depth FROM pairs
  UNION SELECT w.a, w.b, l.parent, w.depth + 1 FROM walk w JOIN links l ON l.commit_id = w.node),
near AS (SELECT a, b, node, min(depth) AS depth FROM walk GROUP BY a, b, node),
hit AS (SELECT n.a, n.b, min(n.depth) AS best FROM near n JOIN anc x ON x.a = n.a AND x.node = n.node GROUP BY n.a, n.b),
path AS (SELECT a, b, b AS node, 0 AS depth, '' AS p FROM pairs
  UNION ALL SELECT p.a, p.b, l.parent, p.depth + 1, p.p || cast(l.bit AS string) FROM path p
    JOIN links l ON l.commit_id = p.node JOIN hit h ON h.a = p.a AND h.b = p.b AND p.depth < h.best
    JOIN near n ON n.a = p.a AND n.b = p.b AND n.node = l.parent AND n.depth = p.depth + 1),
won AS (SELECT p.a, p.b, arg_min(p.node, p.p) AS base FROM path p JOIN hit h ON h.a = p.a AND h.b = p.b AND p.depth = h.best
  JOIN anc x ON x.a = p.a AND x.node = p.node GROUP BY p.a, p.b)
SELECT q.a, q.b, w.base, CASE WHEN w.base IS NULL THEN 'no_common_ancestor' ELSE 'found' END AS status
FROM pairs q LEFT JOIN won w ON w.a = q.a AND w.b = q.b"""


@query("merge_base", MERGE_BASE)
def merge_base(d):
    return history.merge_base(history.graph(d["commits"]), d["commit_pairs"])


@query(
    "divergence",
    f"""WITH RECURSIVE {_PARENTS}, pairs AS (SELECT DISTINCT a, b FROM {{commit_pairs}}),
ends AS (SELECT a AS s FROM pairs UNION SELECT b FROM pairs),
anc AS (SELECT s, s AS node FROM ends UNION SELECT x.s, l.parent FROM anc x JOIN links l ON l.commit_id = x.node),
one AS (SELECT p.a, p.b, count(*) AS n FROM pairs p JOIN anc x ON x.s = p.a
  WHERE NOT EXISTS (SELECT 1 FROM anc y WHERE y.s = p.b AND y.node = x.node) GROUP BY p.a, p.b),
two AS (SELECT p.a, p.b, count(*) AS n FROM pairs p JOIN anc x ON x.s = p.b
  WHERE NOT EXISTS (SELECT 1 FROM anc y WHERE y.s = p.a AND y.node = x.node) GROUP BY p.a, p.b)
SELECT p.a, p.b, coalesce(one.n, 0) AS a_only, coalesce(two.n, 0) AS b_only FROM pairs p
LEFT JOIN one ON one.a = p.a AND one.b = p.b LEFT JOIN two ON two.a = p.a AND two.b = p.b""",
)
def divergence(d):
    return history.divergence(history.graph(d["commits"]), d["commit_pairs"])


def _kept(d):
    """The graph of all commits, appended in three parts by their ids."""
    index = GraphIndex(d.spark, f"{shared_dir(d.spark).rstrip('/')}/graph-{uuid.uuid4().hex}")
    commits = d["commits"]
    bounds = [float("-inf"), *commits.approxQuantile("commit_id", [0.4, 0.8], 0.01), float("inf")]
    for low, high in itertools.pairwise(bounds):
        index.append(commits.where((F.col("commit_id") > low) & (F.col("commit_id") <= high)))
    return index.graph()


@query("merge_base_kept", MERGE_BASE)
def merge_base_kept(d):
    return history.merge_base(_kept(d), d["commit_pairs"])


_LINE = f"""line AS (SELECT start, 0 AS depth, start AS commit_id FROM ({_HEADS})
  UNION ALL SELECT l.start, l.depth + 1, c.parent_id FROM line l JOIN {{commits}} c ON c.commit_id = l.commit_id
  WHERE c.parent_id IS NOT NULL AND l.depth + 1 < 100)"""


@query("first_parent_history", f"WITH RECURSIVE {_LINE} SELECT start, depth, commit_id FROM line")
def first_parent_history(d):
    return history.first_parent_history(history.graph(d["commits"]), _starts(d), 100)


@query("first_parent_history_kept", ORACLES["first_parent_history"])
def first_parent_history_kept(d):
    return history.first_parent_history(_kept(d), _starts(d), 100)


@query(
    "commit_list",
    f"""WITH RECURSIVE {_LINE}, n AS (SELECT commit_id, count(*) AS n FROM {{commit_tables}} GROUP BY commit_id)
SELECT start, depth, line.commit_id, coalesce(n.n, 0) AS n_tables FROM line LEFT JOIN n ON n.commit_id = line.commit_id""",
)
def commit_list(d):
    return history.commit_list(history.graph(d["commits"]), _starts(d), d["commit_tables"], 100)


@query(
    "commit_graph",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, commit_id DESC) AS rank FROM {commits})
SELECT project_id, commit_id, rank, concat_ws(',', cast(parent_id AS string), cast(parent2_id AS string)) AS parents,
  (parent_id IS NOT NULL AND parent2_id IS NOT NULL) AS is_merge,
  (SELECT count(*) FROM {branches} b WHERE b.head_commit_id = r.commit_id) AS n_heads
FROM r WHERE rank <= 200""",
)
def commit_graph(d):
    drawn = history.commit_graph(d["commits"], d["branches"], 200)
    return drawn.withColumn("parents", F.array_join(F.transform("parents", lambda p: p.cast("string")), ","))


@query(
    "commit_heads",
    "SELECT c.project_id, c.commit_id, b.name AS branch FROM {commits} c JOIN {branches} b ON b.head_commit_id = c.commit_id",
)
def commit_heads(d):
    return history.commit_heads(d["commits"], d["branches"])


@query(
    "head_moves",
    """WITH RECURSIVE nxt AS (SELECT branch_id, expected_head, min(seq) AS seq FROM {head_proposals}
  WHERE expected_head IS NOT NULL GROUP BY branch_id, expected_head),
live AS (SELECT n.branch_id, n.seq FROM nxt n JOIN {branch_starts} s ON s.branch_id = n.branch_id AND s.head_commit_id = n.expected_head
  UNION ALL SELECT n.branch_id, n.seq FROM live l JOIN nxt n ON n.branch_id = l.branch_id AND n.expected_head = l.seq)
SELECT p.branch_id, p.seq, p.commit_id, p.expected_head,
  CASE WHEN p.commit_id IN (SELECT head_commit_id FROM {branch_starts}) THEN 'repeated_commit'
       WHEN EXISTS (SELECT 1 FROM live l WHERE l.branch_id = p.branch_id AND l.seq = p.seq) THEN 'accepted' ELSE 'stale' END AS status
FROM {head_proposals} p""",
)
def head_moves(d):
    return history.head_moves(d["branch_starts"], d["head_proposals"])


@query(
    "audit_windows",
    """SELECT cast(floor(epoch(ts) / 3600) * 3600 AS bigint) AS window_start, event_type, count(*) AS n_events,
  cast(sum(cast(json_extract(props, '$.k') AS bigint)) AS bigint) AS sum_k
FROM {events} GROUP BY 1, 2""",
)
def audit_windows(d):
    found = history.audit_windows(d["events"], "1 hour", ["event_type"], "props", "k bigint")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', cast(window_start AS timestamp_ntz))")
    return found.withColumn("window_start", seconds)
