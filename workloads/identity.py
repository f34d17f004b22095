"""Identity matching queries, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import match
from palimpsest.plans import reimport
from workloads.data import Data, oracle
from workloads.fleet import problems_sql
from workloads.fleet_data import catalog

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return register


_TYPE = "type_base || '(' || cast(type_param AS string) || ')'"
_BASE = f"""h AS (SELECT c.*, {_TYPE} AS type, t.name AS tname FROM {{columns_head}} c JOIN {{tables_head}} t ON t.table_id = c.table_id),
n AS (SELECT c.*, {_TYPE} AS type, t.name AS tname FROM {{columns_new}} c JOIN {{tables_new}} t ON t.table_id = c.table_id),
lost_t AS (SELECT * FROM {{tables_head}} a WHERE NOT EXISTS (SELECT 1 FROM {{tables_new}} b WHERE b.project_id = a.project_id AND b.name = a.name)),
free_t AS (SELECT * FROM {{tables_new}} a WHERE NOT EXISTS (SELECT 1 FROM {{tables_head}} b WHERE b.project_id = a.project_id AND b.name = a.name)),
ts AS (SELECT a.project_id, a.table_id AS old_id, a.name AS old_name, b.table_id AS new_id, b.name AS new_name, b.ordinal,
  2.0 * (SELECT count(*) FROM h JOIN n ON h.name = n.name AND h.type = n.type WHERE h.table_id = a.table_id AND n.table_id = b.table_id)
  / ((SELECT count(*) FROM h WHERE h.table_id = a.table_id) + (SELECT count(*) FROM n WHERE n.table_id = b.table_id)) AS score
  FROM lost_t a JOIN free_t b ON a.project_id = b.project_id),
tp AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY score DESC, ordinal) AS rn FROM ts WHERE score >= 0.4),
same_t AS (SELECT a.project_id, a.table_id AS ht, b.table_id AS nt FROM {{tables_head}} a JOIN {{tables_new}} b ON a.project_id = b.project_id AND a.name = b.name),
cs AS (SELECT h.project_id, n.tname AS tbl, h.column_id AS old_id, h.name AS old_name, h.position AS old_pos, n.column_id AS new_id, n.name AS new_name, n.position AS pos, s.ht,
  (CASE WHEN h.type = n.type THEN 0.5 WHEN h.type_base = n.type_base THEN 0.3 ELSE 0 END
   + CASE WHEN h.position = n.position THEN 0.2 WHEN abs(h.position - n.position) = 1 THEN 0.1 ELSE 0 END
   + 0.3 * (1 - cast(levenshtein(h.name, n.name) AS double) / greatest(length(h.name), length(n.name)))) AS score
  FROM same_t s JOIN h ON h.table_id = s.ht JOIN n ON n.table_id = s.nt
  WHERE NOT EXISTS (SELECT 1 FROM n x WHERE x.table_id = s.nt AND x.name = h.name)
    AND NOT EXISTS (SELECT 1 FROM h x WHERE x.table_id = s.ht AND x.name = n.name)),
cp AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY round(score, 9) DESC, pos) AS rn FROM cs WHERE score >= 0.5)"""


@query(
    "table_rename_proposals",
    f"""WITH {_BASE} SELECT project_id, old_id, old_name, new_id, new_name, floor(score * 100 + 0.5) / 100 AS confidence,
  count(*) OVER (PARTITION BY new_id) > 1 AS contested FROM tp WHERE rn = 1""",
)
def table_rename_proposals(d):
    found = match.rename_proposals(catalog(d, "head"), catalog(d, "new")).proposals
    return found.where("kind = 'table'").select("project_id", "old_id", "old_name", "new_id", "new_name", "confidence", "contested")


@query(
    "column_rename_proposals",
    f"""WITH {_BASE} SELECT project_id, tbl AS "table", old_id, old_name, new_id, new_name, floor(round(score, 9) * 100 + 0.5) / 100 AS confidence,
  floor(round(score, 9) * 100 + 0.5) / 100 >= 0.7 AS preselected, count(*) OVER (PARTITION BY new_id) > 1 AS contested FROM cp WHERE rn = 1""",
)
def column_rename_proposals(d):
    found = match.rename_proposals(catalog(d, "head"), catalog(d, "new")).proposals
    return found.where("kind = 'column'").drop("kind")


@query(
    "name_matches",
    f"""WITH {_BASE} SELECT h.project_id, h.column_id AS old_id, n.column_id AS new_id FROM same_t s JOIN h ON h.table_id = s.ht
JOIN n ON n.table_id = s.nt AND n.name = h.name""",
)
def name_matches(d):
    return match.match_by_name(catalog(d, "head"), catalog(d, "new"))[1].select("project_id", "old_id", "new_id")


# Accepted head columns are served one after another, each taking its best
# candidate that is still free; the list of taken ones is carried along.
_SERVED = """ct AS (SELECT ht, nt FROM same_t UNION ALL SELECT old_id, new_id FROM tp WHERE rn = 1 AND old_id % 16 = 0),
cd AS (SELECT h.project_id, n.tname AS tbl, h.column_id AS old_id, h.name AS old_name, h.position AS old_pos, n.column_id AS new_id, n.name AS new_name, n.position AS pos, s.ht,
  round(CASE WHEN h.type = n.type THEN 0.5 WHEN h.type_base = n.type_base THEN 0.3 ELSE 0 END
   + CASE WHEN h.position = n.position THEN 0.2 WHEN abs(h.position - n.position) = 1 THEN 0.1 ELSE 0 END
   + 0.3 * (1 - cast(levenshtein(h.name, n.name) AS double) / greatest(length(h.name), length(n.name))), 9) AS score
  FROM ct s JOIN h ON h.table_id = s.ht JOIN n ON n.table_id = s.nt
  WHERE NOT EXISTS (SELECT 1 FROM n x WHERE x.table_id = s.nt AND x.name = h.name)
    AND NOT EXISTS (SELECT 1 FROM h x WHERE x.table_id = s.ht AND x.name = n.name)),
cg AS (SELECT cd.*, r.rename FROM cd LEFT JOIN {rename_decisions} r ON r.old_id = cd.old_id WHERE score >= 0.5),
yes AS (SELECT *, dense_rank() OVER (PARTITION BY ht ORDER BY old_pos) AS nth FROM cg WHERE rename),
served AS (SELECT ht, cast(0 AS bigint) AS nth, cast([] AS bigint[]) AS taken, cast(NULL AS bigint) AS old_pos, cast(NULL AS bigint) AS got FROM ct
  UNION ALL SELECT ht, nth, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got) END, old_pos, got FROM (
    SELECT s.ht, s.nth + 1 AS nth, s.taken, y.old_pos, arg_max(CASE WHEN NOT list_contains(s.taken, y.new_id) THEN y.new_id END,
      CASE WHEN NOT list_contains(s.taken, y.new_id) THEN y.score * 1000 - y.pos * 0.0001 END) AS got
    FROM served s JOIN yes y ON y.ht = s.ht AND y.nth = s.nth + 1 GROUP BY s.ht, s.nth, s.taken, y.old_pos)),
open AS (SELECT g.*, row_number() OVER (PARTITION BY g.old_id ORDER BY g.score DESC, g.pos) AS rn FROM cg g
  WHERE g.rename IS NULL AND NOT EXISTS (SELECT 1 FROM served v WHERE v.ht = g.ht AND v.got = g.new_id AND v.old_pos < g.old_pos))"""


@query(
    "rename_decisions",
    f"""WITH RECURSIVE {_BASE}, {_SERVED}
SELECT project_id, 'column' AS kind, tbl AS "table", old_id, old_name, new_id, new_name, floor(score * 100 + 0.5) / 100 AS confidence,
  floor(score * 100 + 0.5) / 100 >= 0.7 AS preselected, count(*) OVER (PARTITION BY ht, new_id) > 1 AS contested FROM open WHERE rn = 1""",
)
def rename_decisions(d):
    decisions = d["rename_decisions"].withColumn("kind", F.lit("column"))
    decisions = decisions.unionByName(d["table_decisions"].withColumn("kind", F.lit("table")))
    return match.rename_proposals(catalog(d, "head"), catalog(d, "new"), decisions).proposals


# Confirmed: proposals left open count as drop and add. Moving ids does not make
# or mend a problem, so the new schema can be checked under its own ids.
@query(
    "reimport_status",
    f"""WITH {_BASE}, {_SERVED.split("cg AS")[0].rstrip().rstrip(",")}, np AS (SELECT project_id, count(DISTINCT old_id) AS n FROM cd WHERE score >= 0.5 GROUP BY 1),
pr AS (SELECT project_id, count(*) AS n FROM ({problems_sql("new")}) GROUP BY 1)
SELECT p.project_id, coalesce(np.n, 0) AS n_proposals, coalesce(pr.n, 0) AS n_problems, CASE WHEN coalesce(pr.n, 0) > 0 THEN 'invalid' ELSE 'commit' END AS status
FROM (SELECT DISTINCT project_id FROM {{tables_new}}) p LEFT JOIN np ON np.project_id = p.project_id LEFT JOIN pr ON pr.project_id = p.project_id""",
)
def reimport_status(d):
    decisions = d["table_decisions"].withColumn("kind", F.lit("table"))
    found = reimport.reimport(catalog(d, "head"), catalog(d, "new"), decisions, confirm=True).status
    return found.select("project_id", "n_proposals", "n_problems", "status")


@query(
    "reimport_same",
    "SELECT DISTINCT project_id, cast(0 AS bigint) AS n_proposals, cast(0 AS bigint) AS n_changes FROM {tables_head}",
)
def reimport_same(d):
    """The head loaded again as it is, under new ids: nothing may change."""
    head = catalog(d, "head")
    shift = 1000000000000
    again = match.Catalog(
        head.tables.withColumn("table_id", F.col("table_id") + shift),
        head.columns.withColumns({"table_id": F.col("table_id") + shift, "column_id": F.col("column_id") + shift}),
        head.constraints.withColumns(
            {
                "table_id": F.col("table_id") + shift,
                "constraint_id": F.col("constraint_id") + shift,
                "column_ids": F.transform("column_ids", lambda c: c + shift),
            }
        ),
        head.indexes.withColumns(
            {
                "table_id": F.col("table_id") + shift,
                "index_id": F.col("index_id") + shift,
                "columns": F.transform("columns", lambda c: F.struct((c["column_id"] + shift).alias("column_id"), c["desc"].alias("desc"))),
            }
        ),
    )
    return reimport.reimport(head, again).status.select("project_id", "n_proposals", "n_changes")
