"""Queries on versions of tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import collisions, diff, merge
from workloads.data import Data, oracle

COLS = ["cust", "status", "prio", "price", "code"]
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return register


@query(
    "diff_keys_orders",
    """
SELECT coalesce(b.k, o.k) AS k,
       CASE WHEN b.k IS NULL THEN 'added' WHEN o.k IS NULL THEN 'dropped' ELSE 'common' END AS change
FROM {orders_base} b FULL JOIN {orders_ours} o ON b.k = o.k
""",
)
def diff_keys_orders(d):
    return diff.diff_keys(d["orders_base"], d["orders_ours"], ["k"])


_CELLS = " UNION ALL ".join(
    f"""SELECT b.k, 'cell_changed' AS kind, '{c}' AS property, cast(b.{c} AS string) AS from_value,
    cast(o.{c} AS string) AS to_value FROM {{frm}} b JOIN {{to}} o ON b.k = o.k
    WHERE b.{c} IS DISTINCT FROM o.{c}"""
    for c in COLS
)
_ROWS = """ UNION ALL SELECT k, 'row_added', NULL, NULL, NULL FROM {to} WHERE k NOT IN (SELECT k FROM {frm})
UNION ALL SELECT k, 'row_dropped', NULL, NULL, NULL FROM {frm} WHERE k NOT IN (SELECT k FROM {to})"""
_DIFF = (_CELLS + _ROWS).replace("{frm}", "{orders_base}").replace("{to}", "{orders_ours}")


@query("diff_cells_orders", _DIFF)
def diff_cells_orders(d):
    return diff.diff_cells(d["orders_base"], d["orders_ours"], ["k"], COLS)


@query("diff_cells_orders_digest", _DIFF)
def diff_cells_orders_digest(d):
    return diff.diff_cells(d["orders_base"], d["orders_ours"], ["k"], COLS, changed_only=True)


@query(
    "diff_summary_orders",
    """
WITH j AS (SELECT b.k AS bk, o.k AS ok,
  (CASE WHEN b.cust IS DISTINCT FROM o.cust THEN 1 ELSE 0 END + CASE WHEN b.status IS DISTINCT FROM o.status THEN 1 ELSE 0 END
   + CASE WHEN b.prio IS DISTINCT FROM o.prio THEN 1 ELSE 0 END + CASE WHEN b.price IS DISTINCT FROM o.price THEN 1 ELSE 0 END
   + CASE WHEN b.code IS DISTINCT FROM o.code THEN 1 ELSE 0 END) AS n
  FROM {orders_base} b FULL JOIN {orders_ours} o ON b.k = o.k)
SELECT count(*) FILTER (bk IS NULL) AS added, count(*) FILTER (ok IS NULL) AS dropped,
  count(*) FILTER (bk = ok AND n > 0) AS changed, count(*) FILTER (bk = ok AND n = 0) AS unchanged,
  cast(sum(CASE WHEN bk = ok THEN n ELSE 0 END) AS bigint) AS changed_cells,
  cast((SELECT count(*) FROM (SELECT k FROM {orders_base} GROUP BY k HAVING count(*) > 1 OR k IS NULL
    UNION SELECT k FROM {orders_ours} GROUP BY k HAVING count(*) > 1 OR k IS NULL)) AS bigint) AS skipped_keys FROM j
""",
)
def diff_summary_orders(d):
    return diff.diff_summary(d["orders_base"], d["orders_ours"], ["k"], COLS)


# --- merge --------------------------------------------------------------------

_VAL = {c: c for c in COLS}
_JOINED = """j AS (SELECT coalesce(b.k, o.k, t.k) AS k, b.k IS NOT NULL AS hb, o.k IS NOT NULL AS ho, t.k IS NOT NULL AS ht,
""" + ",\n".join(f"b.{c} AS b_{c}, o.{c} AS o_{c}, t.{c} AS t_{c}" for c in COLS) + """
FROM {orders_base} b FULL JOIN {orders_ours} o ON b.k = o.k FULL JOIN {orders_theirs} t ON coalesce(b.k, o.k) = t.k)"""


def _row_diff(a: str, b: str) -> str:
    return "(" + " OR ".join(f"{a}_{c} IS DISTINCT FROM {b}_{c}" for c in COLS) + ")"


def _split(c: str) -> str:
    return (
        f"(hb AND ho AND ht AND o_{c} IS DISTINCT FROM t_{c} AND b_{c} IS DISTINCT FROM o_{c} "
        f"AND b_{c} IS DISTINCT FROM t_{c})"
    )


_ALL_CONFLICTS = "c AS (" + " UNION ALL ".join(
    f"""SELECT k, 'cell:{c}:' || cast(k AS string) AS conflict_id, 'cell_cell' AS class, '{c}' AS property,
    cast(b_{c} AS string) AS base_value, cast(o_{c} AS string) AS ours_value, cast(t_{c} AS string) AS theirs_value,
    true AS allow_custom FROM j WHERE {_split(c)}"""
    for c in COLS
) + f""" UNION ALL SELECT k, 'row_existence:' || cast(k AS string), 'delete_modify', 'existence', 'exists', 'dropped', 'modified', false
FROM j WHERE hb AND NOT ho AND ht AND {_row_diff('b', 't')}
UNION ALL SELECT k, 'row_existence:' || cast(k AS string), 'delete_modify', 'existence', 'exists', 'modified', 'dropped', false
FROM j WHERE hb AND ho AND NOT ht AND {_row_diff('b', 'o')})"""

_ANSWERS = """a AS (SELECT conflict_id, arg_max(choice, seq) AS choice, arg_max(coalesce(custom, ''), seq) AS custom,
  count(*) AS n_answers FROM {orders_answers} GROUP BY conflict_id),
x AS (SELECT c.*, a.choice, a.custom, a.n_answers,
  CASE WHEN choice NOT IN ('ours', 'theirs', 'custom') THEN 'unknown_choice'
       WHEN choice = 'custom' AND trim(custom) = '' THEN 'blank_custom'
       WHEN choice = 'custom' AND NOT allow_custom THEN 'custom_not_accepted'
       WHEN choice = 'custom' AND property = 'cust' AND try_cast(custom AS bigint) IS NULL THEN 'unparsable_custom' END AS wrong
  FROM c JOIN a ON a.conflict_id = c.conflict_id),
g AS (SELECT k, """ + ", ".join(
    f"max(CASE WHEN property = '{p}' THEN choice END) AS c_{p}, max(CASE WHEN property = '{p}' THEN custom END) AS v_{p}"
    for p in ["existence", *COLS]
) + " FROM x WHERE wrong IS NULL GROUP BY k)"


def _merged_sql(resolved: bool) -> str:
    def value(c: str) -> str:
        three = f"CASE WHEN b_{c} IS NOT DISTINCT FROM o_{c} THEN t_{c} ELSE o_{c} END"
        if resolved:
            cast = {"cust": "bigint", "price": "decimal(12,2)"}.get(c, "string")
            pick = f"CASE WHEN c_{c} = 'theirs' THEN t_{c} WHEN c_{c} = 'custom' THEN try_cast(v_{c} AS {cast}) ELSE o_{c} END"
        else:
            pick = f"o_{c}"
        inner = f"CASE WHEN {_split(c)} THEN {pick} ELSE {three} END"
        return (
            f"CASE WHEN hb AND ho AND ht THEN {inner} WHEN ho THEN o_{c} ELSE t_{c} END AS {c}"
        )

    ce = "c_existence" if resolved else "cast(NULL AS string)"
    unanswered = " OR ".join(
        [f"({_split(c)} AND {'c_' + c if resolved else 'cast(NULL AS string)'} IS NULL)" for c in COLS]
        + [f"(hb AND NOT ho AND ht AND {ce} IS NULL) OR (hb AND ho AND NOT ht AND {ce} IS NULL)"]
    )
    src = "j LEFT JOIN g ON g.k = j.k" if resolved else "j"
    return f"""WITH {_JOINED}{", " + _ALL_CONFLICTS + ", " + _ANSWERS if resolved else ""}
SELECT j.k AS k, {", ".join(value(c) for c in COLS)},
  CASE WHEN hb THEN 0 WHEN ho THEN 1 ELSE 2 END AS origin, ({unanswered}) AS provisional
FROM {src}
WHERE (hb AND ho AND ht) OR (NOT hb) OR (ho AND NOT ht AND {_row_diff('b', 'o')} AND coalesce({ce}, 'ours') <> 'theirs')
   OR (NOT ho AND ht AND {_row_diff('b', 't')} AND coalesce({ce}, 'ours') = 'theirs')"""


def _merge(d, answers=None):
    return merge.merge3(d["orders_base"], d["orders_ours"], d["orders_theirs"], ["k"], COLS, answers)


@query("merge3_orders", _merged_sql(False))
def merge3_orders(d):
    return _merge(d).merged.withColumn("origin", F.col("origin").cast("int"))


@query("merge3_conflicts_orders", f"WITH {_JOINED}, {_ALL_CONFLICTS} SELECT * FROM c")
def merge3_conflicts_orders(d):
    return merge.ordered_conflicts(_merge(d).conflicts, [], ["k"])


@query(
    "merge3_conflict_summary",
    f"WITH {_JOINED}, {_ALL_CONFLICTS} SELECT class, property, count(*) AS n_conflicts FROM c GROUP BY class, property",
)
def merge3_conflict_summary(d):
    return merge.conflict_summary(_merge(d).conflicts)


@query(
    "merge3_delete_modify",
    f"WITH {_JOINED}, {_ALL_CONFLICTS} SELECT k, ours_value, theirs_value FROM c WHERE class = 'delete_modify'",
)
def merge3_delete_modify(d):
    return _merge(d).conflicts.where("class = 'delete_modify'").select("k", "ours_value", "theirs_value")


@query("merge3_resolved_orders", _merged_sql(True))
def merge3_resolved_orders(d):
    return _merge(d, d["orders_answers"]).merged.withColumn("origin", F.col("origin").cast("int"))


@query(
    "merge3_open_conflicts",
    f"""WITH {_JOINED}, {_ALL_CONFLICTS}, {_ANSWERS}
SELECT k, conflict_id, class, property FROM c WHERE conflict_id NOT IN (SELECT conflict_id FROM x WHERE wrong IS NULL)""",
)
def merge3_open_conflicts(d):
    return _merge(d, d["orders_answers"]).conflicts.select("k", "conflict_id", "class", "property")


@query(
    "resolution_errors_orders",
    f"""WITH {_JOINED}, {_ALL_CONFLICTS}, {_ANSWERS},
r AS (SELECT a.conflict_id, a.choice, a.custom, a.n_answers, c.property, c.allow_custom FROM a LEFT JOIN c ON a.conflict_id = c.conflict_id)
SELECT conflict_id, problem, severity FROM (
  SELECT conflict_id, CASE WHEN choice NOT IN ('ours', 'theirs', 'custom') THEN 'unknown_choice'
       WHEN choice = 'custom' AND trim(custom) = '' THEN 'blank_custom'
       WHEN choice = 'custom' AND allow_custom = false THEN 'custom_not_accepted'
       WHEN choice = 'custom' AND property = 'cust' AND try_cast(custom AS bigint) IS NULL THEN 'unparsable_custom' END AS problem,
    'error' AS severity FROM r
  UNION ALL SELECT conflict_id, CASE WHEN property IS NULL THEN 'unknown_conflict' END, 'warning' FROM r
  UNION ALL SELECT conflict_id, CASE WHEN n_answers > 1 THEN 'repeated_answer' END, 'warning' FROM r
) WHERE problem IS NOT NULL""",
)
def resolution_errors_orders(d):
    return _merge(d, d["orders_answers"]).resolution_problems


def _vs_ours_sql() -> str:
    merged = "m AS (" + _merged_sql(False).split("\n", 0)[0].replace("WITH " + _JOINED, "").strip() + ")"
    return (
        f"WITH {_JOINED}, {merged} "
        + (_CELLS + _ROWS).replace("{frm}", "{orders_ours}").replace("{to}", "m")
    )


@query("merge3_changes_vs_ours", _vs_ours_sql())
def merge3_changes_vs_ours(d):
    return merge.changes_to_ours(d["orders_ours"], _merge(d))


_COLLIDE = """dup AS (SELECT code, min(k) AS first_k FROM m WHERE code IS NOT NULL GROUP BY code HAVING count(*) > 1)"""


@query(
    "unique_collisions_orders",
    f"""WITH {_JOINED}, m AS ({_merged_sql(False).replace("WITH " + _JOINED, "").strip()}),
r AS (SELECT k, code, row_number() OVER (PARTITION BY code ORDER BY origin, k) AS rn,
  first_value(k) OVER (PARTITION BY code ORDER BY origin, k) AS first_k FROM m)
SELECT k, 'unique_collision:' || cast(first_k AS string) || ':' || cast(k AS string) AS conflict_id,
  'unique_collision' AS class, 'code' AS property, code AS value, first_k FROM r WHERE rn > 1""",
)
def unique_collisions_orders(d):
    return collisions.unique_collisions(_merge(d).merged, ["code"], ["k"])


@query(
    "merge_gate_orders",
    f"""WITH {_JOINED}, {_ALL_CONFLICTS}, {_ANSWERS},
o AS (SELECT count(*) AS n FROM c WHERE conflict_id NOT IN (SELECT conflict_id FROM x WHERE wrong IS NULL)),
m AS ({_merged_sql(False).replace("WITH " + _JOINED, "").strip()}),
p AS (SELECT coalesce(sum(n - 1), 0) AS n FROM (SELECT code, count(*) AS n FROM m GROUP BY code HAVING count(*) > 1))
SELECT o.n AS n_conflicts, cast(p.n AS bigint) AS n_problems, (o.n = 0 AND p.n = 0) AS clean,
  CASE WHEN o.n > 0 THEN 'conflicts' WHEN p.n > 0 THEN 'problems' ELSE 'commit' END AS decision FROM o, p""",
)
def merge_gate_orders(d):
    attempt = _merge(d, d["orders_answers"])
    return attempt.gate(collisions.unique_collisions(attempt.merged, ["code"], ["k"]))


# Seven merges in one job: the key starts with the merge.
@query(
    "merge_gate_batched",
    f"""WITH {_JOINED}, {_ALL_CONFLICTS}, ids AS (SELECT DISTINCT k % 7 AS merge_id FROM {{orders_base}}),
n AS (SELECT k % 7 AS merge_id, count(*) AS n FROM c GROUP BY 1)
SELECT ids.merge_id, coalesce(n.n, 0) AS n_conflicts, cast(0 AS bigint) AS n_problems, coalesce(n.n, 0) = 0 AS clean,
  CASE WHEN coalesce(n.n, 0) > 0 THEN 'conflicts' ELSE 'commit' END AS decision FROM ids LEFT JOIN n ON n.merge_id = ids.merge_id""",
)
def merge_gate_batched(d):
    sides = [d[f"orders_{s}"].withColumn("merge_id", F.col("k") % 7) for s in ("base", "ours", "theirs")]
    attempt = merge.merge3(*sides, ["merge_id", "k"], COLS)
    return attempt.gate(merges=sides[0].select("merge_id").distinct())
