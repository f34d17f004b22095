"""A fleet of schemas derived from `part`: 80 parts to a project, 8 to a table.

Three versions (base, ours, theirs) and a broken one. Arrays are spelled
differently by the two engines, so the shared SQL keeps scalars (c1, r1, …) and
`catalog` packs them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators.catalog import Catalog
from palimpsest.session import cut
from workloads.data import Data, view

view(
    "columns_base",
    """
SELECT cast(floor(p_partkey / 80.0) AS bigint) AS project_id, cast(floor(p_partkey / 8.0) AS bigint) AS table_id,
       p_partkey AS column_id, replace(p_name, ' ', '_') AS name, lower(p_type) AS type_base, p_size AS type_param,
       p_size % 2 = 0 AS nullable, CASE WHEN p_partkey % 6 = 0 THEN '0' ELSE '' END AS default_expr,
       cast(p_partkey % 8 + 1 AS int) AS position
FROM {part}
""",
)
view(
    "tables_base",
    """
SELECT DISTINCT project_id, table_id, 't' || cast(table_id % 10 AS string) AS name, table_id AS ordinal FROM {columns_base}
""",
)
view(
    "constraints_base",
    """
SELECT project_id, table_id, table_id * 10 + 1 AS constraint_id, '' AS name, 'primary_key' AS kind, table_id * 8 AS c1,
       cast(NULL AS bigint) AS ref_table_id, cast(NULL AS bigint) AS r1, '' AS on_delete, '' AS expr, 1 AS ordinal
FROM {tables_base} WHERE table_id % 13 <> 0
UNION ALL
SELECT project_id, table_id, table_id * 10 + 2, 'link', 'foreign_key', table_id * 8 + 1,
       CASE WHEN table_id % 10 = 9 THEN table_id - 9 ELSE table_id + 1 END,
       CASE WHEN table_id % 10 = 9 THEN table_id - 9 ELSE table_id + 1 END * 8, 'no_action', '', 2
FROM {tables_base}
UNION ALL
SELECT project_id, table_id, table_id * 10 + 3, '', 'unique', table_id * 8 + 2, NULL, NULL, '', '', 3 FROM {tables_base}
UNION ALL
SELECT project_id, table_id, table_id * 10 + 4, 'positive', 'check', NULL, NULL, NULL, '', 'p > 0', 4
FROM {tables_base} WHERE table_id % 3 = 0
""",
)
view(
    "indexes_base",
    """
SELECT project_id, table_id, table_id * 10 + 9 AS index_id, 'ix_' || cast(table_id % 10 AS string) AS name,
       table_id * 8 + 2 AS i1, table_id * 8 + 3 AS i2, table_id % 2 = 0 AS is_unique, '' AS method, 1 AS ordinal
FROM {tables_base}
""",
)

# --- our edits ----------------------------------------------------------------

view(
    "tables_ours",
    """
SELECT project_id, table_id, CASE WHEN table_id % 7 = 0 THEN name || '_o' ELSE name END AS name, ordinal
FROM {tables_base} WHERE table_id % 23 <> 0
UNION ALL
SELECT DISTINCT project_id, project_id + 100000000, 'fresh', project_id + 100000000 FROM {tables_base} WHERE project_id % 3 = 0
""",
)
view(
    "columns_ours",
    """
SELECT project_id, table_id, column_id, CASE WHEN column_id % 10 = 0 THEN name || '_o' ELSE name END AS name, type_base,
       CASE WHEN column_id % 9 = 0 THEN type_param + 1 ELSE type_param END AS type_param,
       CASE WHEN column_id % 16 = 0 THEN NOT nullable ELSE nullable END AS nullable,
       CASE WHEN column_id % 12 = 0 THEN '1' ELSE default_expr END AS default_expr, position
FROM {columns_base} WHERE column_id % 19 <> 0 AND table_id % 23 <> 0
UNION ALL
SELECT project_id, table_id, column_id + 100000000, 'extra', 'numeric', 5, true, '', 9
FROM {columns_base} WHERE column_id % 50 = 0 AND table_id % 23 <> 0
UNION ALL
SELECT DISTINCT project_id, project_id + 100000000, project_id + 500000000, 'id', 'bigint', 8, false, '', 1
FROM {tables_base} WHERE project_id % 3 = 0
""",
)
view(
    "constraints_ours",
    """
SELECT project_id, table_id, constraint_id, name, kind,
       CASE WHEN kind = 'unique' AND table_id % 4 = 0 THEN c1 + 1 ELSE c1 END AS c1, ref_table_id, r1,
       CASE WHEN kind = 'foreign_key' AND table_id % 5 = 0 THEN 'cascade' ELSE on_delete END AS on_delete, expr, ordinal
FROM {constraints_base}
WHERE table_id % 23 <> 0 AND NOT (kind = 'check' AND table_id % 6 = 0) AND NOT (kind = 'primary_key' AND table_id % 11 = 0)
UNION ALL
SELECT project_id, table_id, table_id * 10 + 5, '', 'check', NULL, NULL, NULL, '', 'q > 0', 5
FROM {tables_base} WHERE table_id % 8 = 0 AND table_id % 23 <> 0
UNION ALL
SELECT project_id, table_id, table_id * 10 + 7, '', 'primary_key', table_id * 8, NULL, NULL, '', '', 6
FROM {tables_base} WHERE table_id % 13 = 0 AND table_id % 23 <> 0
""",
)
view(
    "indexes_ours",
    """
SELECT project_id, table_id, index_id, CASE WHEN table_id % 12 = 0 THEN 'ix_x' ELSE name END AS name,
       CASE WHEN table_id % 5 = 0 THEN i1 + 2 ELSE i1 END AS i1, i2, is_unique, method, ordinal
FROM {indexes_base} WHERE table_id % 23 <> 0 AND table_id % 19 <> 6
UNION ALL
SELECT project_id, table_id, table_id + 700000000, 'ix_new', table_id * 8, table_id * 8 + 1, false, 'hash', 2
FROM {tables_base} WHERE table_id % 25 IN (0, 4) AND table_id % 23 <> 0
""",
)

# --- their edits --------------------------------------------------------------

view(
    "tables_theirs",
    """
SELECT project_id, table_id, CASE WHEN table_id % 14 = 0 THEN name || '_t' WHEN table_id % 9 = 0 THEN name || '_o' ELSE name END
       AS name, ordinal
FROM {tables_base} WHERE table_id % 29 <> 0
UNION ALL
SELECT DISTINCT project_id, project_id + 200000000, 'fresh', project_id + 200000000 FROM {tables_base} WHERE project_id % 2 = 0
""",
)
view(
    "columns_theirs",
    """
SELECT project_id, table_id, column_id, CASE WHEN column_id % 15 = 0 THEN name || '_t' ELSE name END AS name, type_base,
       CASE WHEN column_id % 27 = 0 THEN type_param + 2 WHEN column_id % 18 = 0 THEN type_param + 1 ELSE type_param END AS type_param,
       CASE WHEN column_id % 32 = 0 THEN NOT nullable ELSE nullable END AS nullable,
       CASE WHEN column_id % 24 = 0 THEN '2' ELSE default_expr END AS default_expr, position
FROM {columns_base} WHERE column_id % 21 <> 0 AND table_id % 29 <> 0
UNION ALL
SELECT project_id, table_id, column_id + 200000000, 'extra', 'text', 7, true, '', 9
FROM {columns_base} WHERE column_id % 60 = 0 AND table_id % 29 <> 0
UNION ALL
SELECT DISTINCT project_id, project_id + 200000000, project_id + 600000000, 'id', 'bigint', 8, false, '', 1
FROM {tables_base} WHERE project_id % 2 = 0
""",
)
view(
    "constraints_theirs",
    """
SELECT project_id, table_id, constraint_id, CASE WHEN kind = 'foreign_key' AND table_id % 31 = 0 THEN 'ref' ELSE name END AS name, kind,
       CASE WHEN kind = 'unique' AND table_id % 8 = 0 THEN c1 + 2 ELSE c1 END AS c1, ref_table_id, r1,
       CASE WHEN kind = 'foreign_key' AND table_id % 10 = 0 THEN 'set_null' ELSE on_delete END AS on_delete,
       CASE WHEN kind = 'check' AND table_id % 12 = 0 THEN 'p > 1' ELSE expr END AS expr, ordinal
FROM {constraints_base} WHERE table_id % 29 <> 0
UNION ALL
SELECT project_id, table_id, table_id * 10 + 6, '', 'check', NULL, NULL, NULL, '', 'q > 0', 5
FROM {tables_base} WHERE table_id % 8 = 0 AND table_id % 29 <> 0
UNION ALL
SELECT project_id, table_id, table_id * 10 + 8, '', 'primary_key', table_id * 8 + 2, NULL, NULL, '', '', 6
FROM {tables_base} WHERE table_id % 26 = 0 AND table_id % 29 <> 0
""",
)
view(
    "indexes_theirs",
    """
SELECT project_id, table_id, index_id, CASE WHEN table_id % 16 = 0 THEN 'ix_y' ELSE name END AS name,
       CASE WHEN table_id % 10 = 0 THEN i1 + 3 ELSE i1 END AS i1, i2, is_unique, method, ordinal
FROM {indexes_base} WHERE table_id % 29 <> 0 AND table_id % 17 <> 0
UNION ALL
SELECT project_id, table_id, table_id + 800000000, 'ix_new', table_id * 8, table_id * 8 + 1, false, '', 2
FROM {tables_base} WHERE table_id % 25 = 1 AND table_id % 29 <> 0
""",
)

# --- a broken fleet: each problem code occurs ---------------------------------

view(
    "tables_broken",
    "SELECT project_id, table_id, CASE WHEN table_id % 33 IN (0, 2) THEN 't1' ELSE name END AS name, ordinal FROM {tables_ours}",
)
view("columns_broken", "SELECT * FROM {columns_ours} WHERE table_id % 37 NOT IN (0, 3)")
view(
    "constraints_broken",
    """
SELECT project_id, table_id, constraint_id, name, kind, CASE WHEN kind = 'unique' AND table_id % 31 IN (0, 4) THEN NULL ELSE c1 END AS c1,
       ref_table_id, CASE WHEN table_id % 16 = 0 THEN NULL ELSE r1 END AS r1, on_delete,
       CASE WHEN table_id % 15 = 0 THEN '' ELSE expr END AS expr, ordinal
FROM {constraints_ours}
UNION ALL
SELECT project_id, table_id, table_id + 900000000, '', 'primary_key', table_id * 8 + 5, NULL, NULL, '', '', 7
FROM {tables_ours} WHERE table_id % 20 = 1
""",
)
view(
    "indexes_broken",
    """
SELECT project_id, table_id, index_id, CASE WHEN table_id % 21 IN (7, 8) THEN 'ix_twice' ELSE name END AS name,
       CASE WHEN table_id % 27 IN (0, 5) THEN NULL ELSE i1 END AS i1,
       CASE WHEN table_id % 27 IN (0, 5) THEN NULL ELSE i2 END AS i2, is_unique, method, ordinal
FROM {indexes_ours}
""",
)


def _listed(*cols: str):
    return F.array_compact(F.array(*[F.col(c) for c in cols]))


def catalog(d: Data, side: str) -> Catalog:
    index_cols = F.array_compact(
        F.array(
            F.when(F.col("i1").isNotNull(), F.struct(F.col("i1").alias("column_id"), F.lit(False).alias("desc"))),
            F.when(F.col("i2").isNotNull(), F.struct(F.col("i2").alias("column_id"), F.lit(True).alias("desc"))),
        )
    )
    # Stored once, as a crawl would be: the operators read each table several times.
    return Catalog(
        d[f"tables_{side}"],
        d[f"columns_{side}"].withColumn("type_params", F.array("type_param")).drop("type_param"),
        d[f"constraints_{side}"]
        .withColumns({"column_ids": _listed("c1"), "ref_column_ids": _listed("r1"), "on_update": F.lit("")})
        .drop("c1", "r1"),
        d[f"indexes_{side}"].withColumn("columns", index_cols).drop("i1", "i2"),
    ).map(cut)


# Answers to conflicts of the fleet merge, by id.
view(
    "fleet_answers",
    """
SELECT 'table_name:' || cast(project_id AS string) || ':' || cast(table_id AS string) AS conflict_id,
       CASE WHEN table_id % 4 = 0 THEN 'theirs' WHEN table_id % 4 = 1 THEN 'custom' ELSE 'ours' END AS choice,
       CASE WHEN table_id % 4 = 1 THEN 'picked_' || cast(table_id AS string) END AS custom
FROM {tables_base} WHERE table_id % 14 = 0
UNION ALL
SELECT 'table_existence:' || cast(project_id AS string) || ':' || cast(table_id AS string),
       CASE WHEN table_id % 2 = 0 THEN 'theirs' ELSE 'ours' END, NULL
FROM {tables_base} WHERE table_id % 23 = 0 OR table_id % 29 = 0
UNION ALL
SELECT 'column_name:' || cast(project_id AS string) || ':' || cast(table_id AS string) || ':' || cast(column_id AS string), 'theirs', NULL
FROM {columns_base} WHERE column_id % 30 = 0
UNION ALL
SELECT 'column_type:' || cast(project_id AS string) || ':' || cast(table_id AS string) || ':' || cast(column_id AS string), 'custom',
       CASE WHEN column_id % 2 = 0 THEN 'numeric(10,2)' ELSE 'numeric(' END
FROM {columns_base} WHERE column_id % 27 = 0
""",
)

# Every column takes the name of the next one in its table; with the dropped
# columns the tables hold whole cycles as well as open chains.
view(
    "names_before",
    """SELECT project_id, table_id, column_id, 'c' || cast(position AS string) AS name FROM {columns_base} WHERE column_id % 19 <> 0""",
)
view(
    "names_after",
    """SELECT project_id, table_id, column_id, 'c' || cast(position % 8 + 1 AS string) AS name FROM {columns_base} WHERE column_id % 19 <> 0""",
)

# --- loaded again without ids -------------------------------------------------
# The head keeps one column per name; the new load loses some, renames some,
# retypes some, and renames every eighth table.

view(
    "columns_head",
    """
SELECT project_id, table_id, column_id, name, type_base, type_param, nullable, default_expr,
       cast(row_number() OVER (PARTITION BY project_id, table_id ORDER BY column_id) AS int) AS position
FROM {columns_base} b
WHERE column_id IN (SELECT min(column_id) FROM {columns_base} GROUP BY project_id, table_id, name)
""",
)
view(
    "columns_new",
    """
SELECT project_id, table_id + 1000000000000 AS table_id, column_id + 1000000000000 AS column_id,
       CASE WHEN column_id % 9 = 0 THEN name || '_v2' ELSE name END AS name,
       CASE WHEN column_id % 17 = 0 THEN 'promo' ELSE type_base END AS type_base, type_param, nullable, default_expr,
       cast(row_number() OVER (PARTITION BY project_id, table_id ORDER BY column_id) AS int) AS position
FROM {columns_head} WHERE column_id % 13 <> 0
""",
)
view("tables_head", "SELECT * FROM {tables_base}")
view(
    "tables_new",
    """
SELECT project_id, table_id + 1000000000000 AS table_id, CASE WHEN table_id % 8 = 0 THEN name || '_r' ELSE name END AS name,
       ordinal
FROM {tables_base}
""",
)
view("constraints_head", "SELECT * FROM {constraints_base} WHERE kind <> 'foreign_key' AND c1 IN (SELECT column_id FROM {columns_head})")
view(
    "constraints_new",
    """
SELECT project_id, table_id + 1000000000000 AS table_id, constraint_id + 1000000000000 AS constraint_id, name, kind,
       c1 + 1000000000000 AS c1, ref_table_id, r1, on_delete, expr, ordinal
FROM {constraints_head} WHERE c1 % 13 <> 0
""",
)
view("indexes_head", "SELECT * FROM {indexes_base} WHERE i1 IN (SELECT column_id FROM {columns_head}) AND i2 IN (SELECT column_id FROM {columns_head})")
view(
    "indexes_new",
    """
SELECT project_id, table_id + 1000000000000 AS table_id, index_id + 1000000000000 AS index_id, name, i1 + 1000000000000 AS i1,
       i2 + 1000000000000 AS i2, is_unique, method, ordinal
FROM {indexes_head} WHERE i1 % 13 <> 0 AND i2 % 13 <> 0
""",
)
view(
    "rename_decisions",
    """
SELECT column_id AS old_id, column_id % 5 <> 0 AS rename FROM {columns_head} WHERE column_id % 2 = 0 OR column_id % 5 = 0
""",
)
view("table_decisions", "SELECT table_id AS old_id, table_id % 16 = 0 AS rename FROM {tables_base} WHERE table_id % 8 = 0")

# --- an edit log on the fleet -------------------------------------------------
# Dropping a column that a key or an index of its table uses fails, and with it
# the whole stream of that project.

view(
    "fleet_edits",
    """
SELECT project_id, column_id % 80 * 10 + 1 AS seq, 'rename_column' AS op, table_id, column_id, name || '_o' AS name,
       cast(NULL AS string) AS type, cast(NULL AS boolean) AS nullable, cast(NULL AS string) AS default_expr
FROM {columns_base} WHERE column_id % 10 = 0
UNION ALL
SELECT project_id, column_id % 80 * 10 + 2, 'retype_column', table_id, column_id, NULL, 'numeric(7)', NULL, NULL
FROM {columns_base} WHERE column_id % 9 = 0
UNION ALL
SELECT project_id, column_id % 80 * 10 + 3, 'set_nullable', table_id, column_id, NULL, NULL, true, NULL
FROM {columns_base} WHERE column_id % 16 = 3
UNION ALL
SELECT project_id, column_id % 80 * 10 + 4, 'set_default', table_id, column_id, NULL, NULL, NULL, '1'
FROM {columns_base} WHERE column_id % 12 = 0
UNION ALL
SELECT project_id, column_id % 80 * 10 + 5, 'drop_column', table_id, column_id, NULL, NULL, NULL, NULL
FROM {columns_base} WHERE column_id % 37 = 0
UNION ALL
SELECT project_id, column_id % 80 * 10 + 6, 'add_column', table_id, column_id + 100000000, 'extra_' || cast(column_id AS string), 'text', true, ''
FROM {columns_base} WHERE column_id % 50 = 0
""",
)

# Edits of tables, constraints and indexes; c1 and c2 are the columns of a made table.
view(
    "structure_edits",
    """
SELECT project_id, 1000000000 + table_id AS seq, 'create_table' AS op, table_id + 10000000 AS table_id, 'made_' || cast(table_id AS string) AS name,
       cast(NULL AS bigint) AS constraint_id, cast(NULL AS bigint) AS index_id, table_id + 100000000 AS c1, table_id + 200000000 AS c2
FROM {tables_base} WHERE table_id % 5 = 0
UNION ALL
SELECT project_id, 2000000000 + table_id, 'rename_table', table_id, name || '_r', NULL, NULL, NULL, NULL FROM {tables_base} WHERE table_id % 7 = 1
UNION ALL
SELECT project_id, 3000000000 + table_id, 'add_constraint', table_id + 10000000, 'one', table_id + 300000000, NULL, table_id + 100000000, NULL
FROM {tables_base} WHERE table_id % 5 = 0
UNION ALL
SELECT project_id, 4000000000 + table_id, 'drop_constraint', table_id, NULL, table_id * 10 + 4, NULL, NULL, NULL
FROM {tables_base} WHERE table_id % 6 = 0
UNION ALL
SELECT project_id, 5000000000 + table_id, 'add_index', table_id + 10000000, 'made_ix_' || cast(table_id AS string), NULL, table_id + 400000000, table_id + 100000000, NULL
FROM {tables_base} WHERE table_id % 5 = 0
UNION ALL
SELECT project_id, 6000000000 + table_id, 'drop_index', table_id, NULL, NULL, table_id * 10 + 9, NULL, NULL FROM {tables_base} WHERE table_id % 4 = 0
UNION ALL
SELECT project_id, 7000000000 + table_id, 'drop_table', table_id + 10000000, NULL, NULL, NULL, NULL, NULL FROM {tables_base} WHERE table_id % 10 = 0
""",
)

# --- one faulty edit for every table, each table a project of its own ----------

view("tables_solo", "SELECT table_id AS project_id, table_id, name, ordinal FROM {tables_base}")
view(
    "columns_solo",
    "SELECT table_id AS project_id, table_id, column_id, name, type_base, type_param, nullable, default_expr, position FROM {columns_base}",
)
view(
    "constraints_solo",
    """
SELECT table_id AS project_id, table_id, constraint_id, name, kind, c1, ref_table_id, r1, on_delete, expr, ordinal
FROM {constraints_base} WHERE kind <> 'foreign_key'
""",
)
view("indexes_solo", "SELECT table_id AS project_id, table_id, index_id, name, i1, i2, is_unique, method, ordinal FROM {indexes_base}")
#: What is wrong with the edit of a table, by table_id modulo their number.
FAULTS = [
    ("explode_table", "unknown_operation"),
    ("rename_table", "missing_table_id"),
    ("rename_table", "table_not_found"),
    ("drop_column", "missing_column_id"),
    ("rename_column", "column_not_found"),
    ("drop_constraint", "constraint_not_found"),
    ("drop_index", "index_not_found"),
    ("rename_table", "name_empty"),
    ("retype_column", "type_missing"),
    ("create_table", "no_columns"),
    ("create_table", "column_incomplete"),
    ("set_nullable", "value_missing"),
    ("add_constraint", "unknown_kind"),
    ("add_constraint", "no_columns"),
    ("add_constraint", "column_lists_differ"),
    ("add_constraint", "no_expression"),
    ("add_constraint", "ref_table_not_found"),
    ("rename_column", "name_taken"),
    ("add_constraint", "has_primary_key"),
    ("drop_column", "still_referenced"),
    ("add_constraint", "ref_column_not_found"),
    ("create_table", "id_in_use"),
]


def _fault(reason: str, what: str, otherwise: str = "NULL") -> str:
    """SQL: `what` where the edit of the table has this fault."""
    n = [r for _, r in FAULTS].index(reason) if reason != "no_columns" else 13
    return f"CASE WHEN table_id % {len(FAULTS)} = {n} THEN {what} ELSE {otherwise} END"


_FAR = "5000000000"
_CASE = " ".join(f"WHEN {n} THEN '{op}'" for n, (op, _) in enumerate(FAULTS))
_KINDS = " ".join(f"WHEN {n} THEN '{kind}'" for n, kind in [(12, "exclude"), (13, "unique"), (14, "foreign_key"), (15, "check"), (16, "foreign_key"), (18, "primary_key"), (20, "foreign_key")])
view(
    "faulty_edits",
    f"""
SELECT table_id AS project_id, cast(1 AS bigint) AS seq, 'set_default' AS op, table_id, table_id * 8 AS column_id, cast(NULL AS bigint) AS constraint_id,
       cast(NULL AS bigint) AS index_id, cast(NULL AS string) AS name, cast(NULL AS string) AS type, cast(NULL AS boolean) AS nullable,
       '1' AS default_expr, cast(NULL AS string) AS kind, cast(NULL AS string) AS expr, cast(NULL AS bigint) AS ref_table_id,
       cast(NULL AS bigint) AS c1, cast(NULL AS bigint) AS r1
FROM {{tables_base}}
UNION ALL
SELECT table_id, 2, CASE table_id % {len(FAULTS)} {_CASE} END,
       CASE WHEN table_id % {len(FAULTS)} = 1 THEN NULL WHEN table_id % {len(FAULTS)} IN (2, 9, 10) THEN table_id + {_FAR} ELSE table_id END,
       CASE WHEN table_id % {len(FAULTS)} = 3 THEN NULL WHEN table_id % {len(FAULTS)} = 4 THEN table_id * 8 + {_FAR}
            WHEN table_id % {len(FAULTS)} = 19 THEN table_id * 8 + 2 ELSE table_id * 8 END,
       {_fault("constraint_not_found", f"table_id + {_FAR}", "table_id + 6000000000")}, table_id + 7000000000,
       CASE WHEN table_id % {len(FAULTS)} = 7 THEN '' WHEN table_id % {len(FAULTS)} = 17
            THEN (SELECT max(c.name) FROM {{columns_base}} c WHERE c.column_id = t.table_id * 8 + 1) ELSE 'other' END,
       {_fault("type_missing", "'  '", "'text'")}, CAST(NULL AS boolean), NULL, CASE table_id % {len(FAULTS)} {_KINDS} END, '  ',
       {_fault("ref_table_not_found", f"table_id + {_FAR}", "table_id")},
       CASE WHEN table_id % {len(FAULTS)} = 13 THEN NULL ELSE table_id * 8 END,
       CASE WHEN table_id % {len(FAULTS)} = 16 THEN table_id * 8 WHEN table_id % {len(FAULTS)} = 20 THEN table_id * 8 + {_FAR} END
FROM {{tables_base}} t
""",
)

# --- names that several objects claim, and answers -----------------------------

view(
    "claims",
    """
SELECT 'table' AS space, project_id, cast(0 AS bigint) AS home, table_id AS id, 't' || cast(table_id % 3 AS string) AS name, cast(ordinal AS bigint) AS ord
FROM {tables_base}
UNION ALL
SELECT 'column', project_id, table_id, column_id, substr(name, 1, 1), cast(position AS bigint) FROM {columns_base}
UNION ALL
SELECT 'index', project_id, 0, index_id, 'ix_' || cast(table_id % 2 AS string), table_id FROM {indexes_base}
""",
)
# Each object is answered against the one before it and against the first; which
# of the answers count depends on who holds the name by then.
view(
    "claim_answers",
    """
SELECT DISTINCT 'name_collision:' || space || ':' || cast(other AS string) || ':' || space || ':' || cast(id AS string) AS conflict_id,
       CASE WHEN (id + other) % 5 = 0 THEN 'ours' WHEN (id + other) % 5 = 3 THEN 'custom' ELSE 'theirs' END AS choice,
       CASE WHEN (id + other) % 5 = 3 THEN name || '_' || cast(id AS string) END AS custom
FROM (SELECT *, lag(id) OVER (PARTITION BY space, project_id, home, name ORDER BY ord, id) AS other FROM {claims}
      UNION ALL SELECT *, first_value(id) OVER (PARTITION BY space, project_id, home, name ORDER BY ord, id) FROM {claims}) t
WHERE other <> id AND (id + other) % 5 <> 4
""",
)

# --- snapshots of the commit graph --------------------------------------------
# One table of two or three columns per commit; what an event carried becomes
# the type of a column.

view(
    "snapshot_columns",
    """
SELECT c.project_id, c.commit_id, c.project_id AS table_id, cast(1 AS bigint) AS column_id, 'event' AS name, c.event_type AS type_base,
       cast(0 AS int) AS type_param, true AS nullable, '' AS default_expr, 1 AS position FROM {commits} c
UNION ALL
SELECT c.project_id, c.commit_id, c.project_id, 2, CASE WHEN c.commit_id % 7 = 0 THEN 'amount' ELSE 'value' END, 'numeric',
       cast(c.commit_id % 4 AS int), c.commit_id % 5 <> 0, '', 2 FROM {commits} c
UNION ALL
SELECT c.project_id, c.commit_id, c.project_id, 3, 'note', 'text', 1, true, '', 3 FROM {commits} c WHERE c.commit_id % 2 = 0
""",
)
view(
    "snapshot_tables",
    "SELECT project_id, commit_id, project_id AS table_id, 'log' AS name, project_id AS ordinal FROM {commits}",
)
view(
    "ref_branches",
    "SELECT 'b' || cast(branch_id AS string) AS branch_id, project_id, name, head_commit_id FROM {branches}",
)
view(
    "ref_pairs",
    """
SELECT m.project_id AS pair_id, m.branch_id AS from_ref, cast(f.head_commit_id AS string) AS to_ref
FROM {ref_branches} m JOIN {ref_branches} f ON m.project_id = f.project_id WHERE m.name = 'main' AND f.name = 'feature'
""",
)
# Into main, back into the feature, into itself, across projects, into nowhere.
view(
    "merge_requests",
    """
SELECT m.project_id * 10 AS merge_id, m.branch_id AS into_ref, f.branch_id AS from_ref
FROM {ref_branches} m JOIN {ref_branches} f ON m.project_id = f.project_id WHERE m.name = 'main' AND f.name = 'feature'
UNION ALL
SELECT m.project_id * 10 + 1, f.branch_id, m.branch_id
FROM {ref_branches} m JOIN {ref_branches} f ON m.project_id = f.project_id WHERE m.name = 'main' AND f.name = 'feature'
UNION ALL
SELECT project_id * 10 + 2, branch_id, branch_id FROM {ref_branches} WHERE name = 'main'
UNION ALL
SELECT m.project_id * 10 + 3, m.branch_id, o.branch_id FROM {ref_branches} m JOIN {ref_branches} o ON o.project_id = m.project_id + 1 AND o.name = m.name
WHERE m.name = 'main'
UNION ALL
SELECT project_id * 10 + 4, branch_id, 'nowhere' FROM {ref_branches} WHERE name = 'main' AND project_id % 4 = 0
""",
)


def snapshots(d: Data) -> Catalog:
    """Catalog with `commit_id`; these snapshots have no constraints or indexes."""
    spark = d.spark
    nothing = "project_id long, commit_id long, table_id long, "
    constraints = spark.createDataFrame(
        [],
        nothing + "constraint_id long, name string, kind string, column_ids array<long>, ref_table_id long, ref_column_ids array<long>, "
        "on_delete string, on_update string, expr string, ordinal long",
    )
    indexes = spark.createDataFrame(
        [], nothing + "index_id long, name string, columns array<struct<column_id:long,desc:boolean>>, is_unique boolean, method string, ordinal long"
    )
    columns = d["snapshot_columns"].withColumn("type_params", F.array("type_param")).drop("type_param")
    return Catalog(d["snapshot_tables"], columns, constraints, indexes)


def keyed_snapshots(d: Data) -> Catalog:
    """The snapshots, and a key on the note in every fourth commit: coherent there, not in each merge."""
    plain = snapshots(d)
    keys = d["commits"].where("commit_id % 4 = 0").select(
        "project_id",
        "commit_id",
        F.col("project_id").alias("table_id"),
        F.lit(1).cast("long").alias("constraint_id"),
        F.lit("").alias("name"),
        F.lit("unique").alias("kind"),
        F.array(F.lit(3).cast("long")).alias("column_ids"),
        F.lit(None).cast("long").alias("ref_table_id"),
        F.array().cast("array<bigint>").alias("ref_column_ids"),
        F.lit("").alias("on_delete"),
        F.lit("").alias("on_update"),
        F.lit("").alias("expr"),
        F.lit(1).cast("long").alias("ordinal"),
    )
    return Catalog(plain.tables, plain.columns, keys, plain.indexes)
