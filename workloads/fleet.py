"""Queries on fleets of schemas, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import words
from palimpsest.functions.types import render_type
from palimpsest.operators import catalog_checks, catalog_diff, catalog_merge, catalog_replay, collisions
from palimpsest.operators.catalog import describe_constraints, describe_indexes
from palimpsest.plans import migration
from palimpsest.session import cut
from palimpsest.sources.snapshots import explode_snapshots, nest_snapshots
from workloads.data import Data, oracle
from workloads.fleet_data import FAULTS, catalog, snapshots

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return register


def constraint_text(src: str, cols: str, tables: str) -> str:
    """Definition of each row of `src`, by scalar lookups."""
    column = lambda t, c: f"coalesce((SELECT x.name FROM {cols} x WHERE x.project_id = s.project_id AND x.table_id = {t} AND x.column_id = {c}), '?')"
    table = f"(SELECT x.name FROM {tables} x WHERE x.project_id = s.project_id AND x.table_id = s.ref_table_id)"
    local = f"CASE WHEN s.c1 IS NULL THEN '' ELSE {column('s.table_id', 's.c1')} END"
    ref = f"CASE WHEN s.r1 IS NULL THEN '' ELSE {column('s.ref_table_id', 's.r1')} END"
    return f"""SELECT s.project_id, s.table_id, s.constraint_id, CASE kind
  WHEN 'primary_key' THEN 'PRIMARY KEY (' || {local} || ')' WHEN 'unique' THEN 'UNIQUE (' || {local} || ')'
  WHEN 'check' THEN 'CHECK (' || expr || ')'
  ELSE 'FOREIGN KEY (' || {local} || ') → ' || CASE WHEN {table} IS NULL THEN '?(?)' ELSE {table} || '(' || {ref} || ')' END
    || CASE WHEN on_delete IN ('', 'no_action') THEN '' ELSE ' ON DELETE ' || upper(replace(on_delete, '_', ' ')) END END AS definition
  FROM {src} s"""


def index_text(src: str, cols: str) -> str:
    column = lambda c: f"CASE WHEN s.{c} IS NULL THEN NULL ELSE coalesce((SELECT x.name FROM {cols} x WHERE x.project_id = s.project_id AND x.table_id = s.table_id AND x.column_id = s.{c}), '?') END"
    return f"""SELECT s.project_id, s.table_id, s.index_id, s.name, CASE WHEN is_unique THEN 'UNIQUE ' ELSE '' END || '('
  || concat_ws(', ', {column('i1')}, {column('i2')} || ' DESC') || ')' || CASE WHEN method = '' THEN '' ELSE ' USING ' || method END
  AS definition FROM {src} s"""


def _columns(side: str) -> str:
    return f"""(SELECT project_id, table_id, column_id, name, type_base || '(' || cast(type_param AS string) || ')' AS type,
  CASE WHEN nullable THEN 'nullable' ELSE 'NOT NULL' END AS nul, CASE WHEN default_expr = '' THEN 'none' ELSE default_expr END AS def,
  type_base || '(' || cast(type_param AS string) || ')' || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END
  || CASE WHEN default_expr = '' THEN '' ELSE ' DEFAULT ' || default_expr END AS txt FROM {{columns_{side}}})"""


def diff_sql(frm: str, to: str) -> str:
    on = "a.project_id = b.project_id AND a.table_id = b.table_id"
    common = f"common AS (SELECT b.project_id, b.table_id, b.name AS tname, a.name AS oname FROM {{tables_{frm}}} a JOIN {{tables_{to}}} b ON {on})"
    ta = f"{{tables_{frm}}}"
    tb = f"{{tables_{to}}}"
    same = lambda x, y, i: f"{x}.project_id = {y}.project_id AND {x}.table_id = {y}.table_id AND {x}.{i} = {y}.{i}"
    gone = lambda src, other, i: f"NOT EXISTS (SELECT 1 FROM {other} y WHERE {same('x', 'y', i)})"
    in_c = "JOIN common c ON c.project_id = x.project_id AND c.table_id = x.table_id"
    parts = [
        f"""SELECT b.project_id, 'table_added' AS kind, b.name AS tbl, b.table_id, cast(NULL AS string) AS object, cast(NULL AS string) AS object_id,
  cast(NULL AS string) AS from_value, cast(NULL AS string) AS to_value, 'added table ' || b.name || ' (' ||
  cast((SELECT count(*) FROM {{columns_{to}}} k WHERE k.project_id = b.project_id AND k.table_id = b.table_id) AS string) || ' columns)' AS text
  FROM {tb} b WHERE NOT EXISTS (SELECT 1 FROM {ta} a WHERE {on})""",
        f"SELECT a.project_id, 'table_dropped', a.name, a.table_id, NULL, NULL, NULL, NULL, 'dropped table ' || a.name FROM {ta} a WHERE NOT EXISTS (SELECT 1 FROM {tb} b WHERE {on})",
        "SELECT project_id, 'table_renamed', tname, table_id, NULL, NULL, oname, tname, 'renamed table ' || oname || ' → ' || tname FROM common WHERE oname <> tname",
        f"SELECT x.project_id, 'column_added', c.tname, x.table_id, x.name, cast(x.column_id AS string), NULL, x.txt, 'added column ' || c.tname || '.' || x.name || ' ' || x.txt FROM cb x {in_c} WHERE {gone('x', 'ca', 'column_id')}",
        f"SELECT x.project_id, 'column_dropped', c.tname, x.table_id, x.name, cast(x.column_id AS string), x.txt, NULL, 'dropped column ' || c.tname || '.' || x.name FROM ca x {in_c} WHERE {gone('x', 'cb', 'column_id')}",
    ]
    for kind, col, text in [
        ("column_renamed", "name", "'renamed ' || c.tname || '.' || z.name || ' → ' || x.name"),
        ("column_retyped", "type", "'changed type of ' || c.tname || '.' || x.name || ': ' || z.type || ' → ' || x.type"),
        ("nullability_changed", "nul", "c.tname || '.' || x.name || ' is now ' || x.nul"),
        ("default_changed", "def", "'changed default of ' || c.tname || '.' || x.name || ': ' || z.def || ' → ' || x.def"),
    ]:
        parts.append(
            f"SELECT x.project_id, '{kind}', c.tname, x.table_id, x.name, cast(x.column_id AS string), z.{col}, x.{col}, {text} "
            f"FROM cb x JOIN ca z ON {same('x', 'z', 'column_id')} {in_c} WHERE z.{col} <> x.{col}"
        )
    cid = "cast(x.constraint_id AS string)"
    parts += [
        f"SELECT x.project_id, 'constraint_added', c.tname, x.table_id, x.definition, {cid}, NULL, x.definition, 'added ' || x.definition || ' on ' || c.tname FROM kb x {in_c} WHERE {gone('x', 'ka', 'constraint_id')}",
        f"SELECT x.project_id, 'constraint_dropped', c.tname, x.table_id, x.definition, {cid}, x.definition, NULL, 'dropped ' || x.definition || ' on ' || c.tname FROM ka x {in_c} WHERE {gone('x', 'kb', 'constraint_id')}",
        f"SELECT x.project_id, 'constraint_modified', c.tname, x.table_id, x.definition, {cid}, z.definition, x.definition, 'changed constraint on ' || c.tname || ': ' || z.definition || ' → ' || x.definition FROM kb x JOIN ka z ON {same('x', 'z', 'constraint_id')} {in_c} WHERE x.definition <> z.definition",
    ]
    iid = "cast(x.index_id AS string)"
    parts += [
        f"SELECT x.project_id, 'index_added', c.tname, x.table_id, x.name, {iid}, NULL, x.definition, 'added index ' || x.name || ' ' || x.definition FROM ib x {in_c} WHERE {gone('x', 'ia', 'index_id')}",
        f"SELECT x.project_id, 'index_dropped', c.tname, x.table_id, x.name, {iid}, x.definition, NULL, 'dropped index ' || x.name FROM ia x {in_c} WHERE {gone('x', 'ib', 'index_id')}",
        f"SELECT x.project_id, 'index_modified', c.tname, x.table_id, x.name, {iid}, z.name || ' ' || z.definition, x.name || ' ' || x.definition, 'changed index ' || x.name || ': ' || z.definition || ' → ' || x.definition FROM ib x JOIN ia z ON {same('x', 'z', 'index_id')} {in_c} WHERE x.definition <> z.definition OR x.name <> z.name",
    ]
    cols = f"{{columns_{to}}}"
    return f"""{common}, ca AS {_columns(frm)}, cb AS {_columns(to)},
ka AS ({constraint_text(f'{{constraints_{frm}}}', cols, tb)}), kb AS ({constraint_text(f'{{constraints_{to}}}', cols, tb)}),
ia AS ({index_text(f'{{indexes_{frm}}}', cols)}), ib AS ({index_text(f'{{indexes_{to}}}', cols)}),
diff AS ({" UNION ALL ".join(parts)})"""


_DIFF = diff_sql("base", "ours")
_SELECT = 'SELECT project_id, kind, tbl AS "table", table_id, object, object_id, from_value, to_value, text FROM diff'


@query("catalog_diff", f"WITH {_DIFF} {_SELECT}")
def catalog_diff_query(d):
    return catalog_diff.order_changes(catalog_diff.catalog_diff(catalog(d, "base"), catalog(d, "ours")))


@query("catalog_renames", f"WITH {_DIFF} SELECT project_id, table_id, object_id, from_value, to_value FROM diff WHERE kind IN ('table_renamed', 'column_renamed')")
def catalog_renames(d):
    changes = catalog_diff.catalog_diff(catalog(d, "base"), catalog(d, "ours"))
    return changes.where("kind IN ('table_renamed', 'column_renamed')").select(
        "project_id", "table_id", "object_id", "from_value", "to_value"
    )


@query(
    "change_groups",
    f"""WITH {_DIFF} SELECT project_id, tbl AS "table", CASE WHEN kind LIKE '%_added' THEN '+' WHEN kind LIKE '%_dropped' THEN '-' ELSE '~' END AS sign,
  count(*) AS n FROM diff GROUP BY 1, 2, 3""",
)
def change_groups(d):
    return catalog_diff.change_groups(catalog_diff.catalog_diff(catalog(d, "base"), catalog(d, "ours")))


def _unchanged(ident: str, attr: str, what: str) -> str:
    return f"""(SELECT count(*) FROM {{{attr}_base}} a JOIN {{{attr}_ours}} b ON a.project_id = b.project_id AND a.table_id = b.table_id
   AND a.{ident} = b.{ident} JOIN common c ON c.project_id = a.project_id AND c.table_id = a.table_id
   WHERE a.project_id = p.project_id AND NOT EXISTS (SELECT 1 FROM diff x WHERE x.project_id = a.project_id AND x.table_id = a.table_id
     AND x.object_id = cast(a.{ident} AS string) AND x.kind IN ({what}))) """


@query(
    "catalog_diff_summary",
    f"""WITH {_DIFF}, p AS (SELECT project_id FROM {{tables_base}} UNION SELECT project_id FROM {{tables_ours}}),
u AS (SELECT p.project_id, (SELECT count(*) FROM diff x WHERE x.project_id = p.project_id) AS n_changes,
 {_unchanged('column_id', 'columns', "'column_renamed','column_retyped','nullability_changed','default_changed'")} AS unchanged_columns,
 {_unchanged('constraint_id', 'constraints', "'constraint_modified'")} AS unchanged_constraints,
 {_unchanged('index_id', 'indexes', "'index_modified'")} AS unchanged_indexes,
 (SELECT count(*) FROM common c WHERE c.project_id = p.project_id AND NOT EXISTS (SELECT 1 FROM diff x WHERE x.project_id = c.project_id AND x.table_id = c.table_id)) AS unchanged_tables
FROM p)
SELECT *, unchanged_columns + unchanged_constraints + unchanged_indexes + unchanged_tables AS unchanged FROM u""",
)
def catalog_diff_summary(d):
    return catalog_diff.catalog_diff_summary(catalog(d, "base"), catalog(d, "ours"))


@query(
    "describe_constraints",
    constraint_text("{constraints_broken}", "{columns_broken}", "{tables_broken}"),
)
def describe_constraints_query(d):
    cat = catalog(d, "broken")
    return describe_constraints(cat.constraints, cat).select("project_id", "table_id", "constraint_id", "definition")


@query("describe_indexes", index_text("{indexes_broken}", "{columns_broken}"))
def describe_indexes_query(d):
    cat = catalog(d, "broken")
    return describe_indexes(cat.indexes, cat).select("project_id", "table_id", "index_id", "name", "definition")


# --- coherence ----------------------------------------------------------------



def _q(x: str) -> str:
    return f"('\"' || {x} || '\"')"


def problems_sql(side: str) -> str:
    t, c, k, i = (f"{{{n}_{side}}}" for n in ("tables", "columns", "constraints", "indexes"))
    join_t = f"JOIN {t} t ON t.project_id = s.project_id AND t.table_id = s.table_id"
    label = "CASE WHEN s.name <> '' THEN s.name ELSE s.kind END"
    has = lambda tid, cid: f"EXISTS (SELECT 1 FROM {c} x WHERE x.project_id = s.project_id AND x.table_id = {tid} AND x.column_id = {cid})"
    target = f"(SELECT r.name FROM {t} r WHERE r.project_id = s.project_id AND r.table_id = s.ref_table_id)"
    n_local = "CASE WHEN s.c1 IS NULL THEN 0 ELSE 1 END"
    n_ref = "CASE WHEN s.r1 IS NULL THEN 0 ELSE 1 END"
    rows = [
        f"SELECT project_id, 'duplicate_table_name' AS code, name AS tbl, '' AS object, 'two tables are named ' || {_q('name')} AS message FROM (SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY ordinal, table_id) AS rn FROM {t}) WHERE rn > 1",
        f"SELECT t.project_id, 'table_no_columns', t.name, '', 'table ' || {_q('t.name')} || ' has no columns' FROM {t} t WHERE NOT EXISTS (SELECT 1 FROM {c} x WHERE x.project_id = t.project_id AND x.table_id = t.table_id)",
        f"SELECT s.project_id, 'duplicate_column_name', t.name, s.name, 'table ' || {_q('t.name')} || ' has two columns named ' || {_q('s.name')} FROM (SELECT *, row_number() OVER (PARTITION BY project_id, table_id, name ORDER BY position, column_id) AS rn FROM {c}) s {join_t} WHERE rn > 1",
        f"SELECT s.project_id, 'constraint_missing_column', t.name, {label}, {label} || ' on ' || {_q('t.name')} || ' references a column that no longer exists' FROM {k} s {join_t} WHERE s.c1 IS NOT NULL AND NOT {has('s.table_id', 's.c1')}",
        f"SELECT s.project_id, 'pk_nullable_column', t.name, x.name, 'primary key column ' || {_q('x.name')} || ' on ' || {_q('t.name')} || ' is nullable' FROM {k} s {join_t} JOIN {c} x ON x.project_id = s.project_id AND x.table_id = s.table_id AND x.column_id = s.c1 WHERE s.kind = 'primary_key' AND x.nullable",
        f"SELECT s.project_id, 'constraint_no_columns', t.name, {label}, CASE WHEN s.kind = 'unique' THEN 'unique constraint' ELSE 'primary key' END || ' on ' || {_q('t.name')} || ' has no columns' FROM {k} s {join_t} WHERE s.kind IN ('unique', 'primary_key') AND s.c1 IS NULL",
        f"SELECT s.project_id, 'fk_missing_table', t.name, {label}, 'foreign key on ' || {_q('t.name')} || ' points at a table that no longer exists' FROM {k} s {join_t} WHERE s.kind = 'foreign_key' AND {target} IS NULL",
        f"SELECT s.project_id, 'fk_column_count_mismatch', t.name, {label}, 'foreign key on ' || {_q('t.name')} || ' has mismatched column lists (' || cast({n_local} AS string) || ' local, ' || cast({n_ref} AS string) || ' referenced)' FROM {k} s {join_t} WHERE s.kind = 'foreign_key' AND {target} IS NOT NULL AND ({n_local} <> {n_ref} OR s.c1 IS NULL)",
        f"SELECT s.project_id, 'fk_missing_column', t.name, {label}, 'foreign key on ' || {_q('t.name')} || ' references a column that no longer exists on ' || {_q(target)} FROM {k} s {join_t} WHERE s.kind = 'foreign_key' AND {target} IS NOT NULL AND s.r1 IS NOT NULL AND NOT {has('s.ref_table_id', 's.r1')}",
        f"SELECT s.project_id, 'check_no_expression', t.name, {label}, 'check constraint on ' || {_q('t.name')} || ' has no expression' FROM {k} s {join_t} WHERE s.kind = 'check' AND s.expr = ''",
        f"SELECT s.project_id, 'multiple_primary_keys', max(t.name), '', 'table ' || {_q('max(t.name)')} || ' has ' || cast(count(*) AS string) || ' primary keys' FROM {k} s {join_t} WHERE s.kind = 'primary_key' GROUP BY s.project_id, s.table_id HAVING count(*) > 1",
        f"SELECT project_id, 'duplicate_index_name', tname, name, 'two indexes are named ' || {_q('name')} || ' (on ' || {_q('other')} || ' and ' || {_q('tname')} || ')' FROM (SELECT s.*, t.name AS tname, lag(t.name) OVER (PARTITION BY s.project_id, s.name ORDER BY t.ordinal, s.ordinal) AS other FROM {i} s {join_t}) WHERE other IS NOT NULL",
        f"SELECT s.project_id, 'index_no_columns', t.name, s.name, 'index ' || {_q('s.name')} || ' has no columns' FROM {i} s {join_t} WHERE s.i1 IS NULL AND s.i2 IS NULL",
        f"SELECT s.project_id, 'index_missing_column', t.name, s.name, 'index ' || {_q('s.name')} || ' references a column that no longer exists on ' || {_q('t.name')} FROM {i} s {join_t} WHERE s.i1 IS NOT NULL AND NOT {has('s.table_id', 's.i1')}",
        f"SELECT s.project_id, 'index_missing_column', t.name, s.name, 'index ' || {_q('s.name')} || ' references a column that no longer exists on ' || {_q('t.name')} FROM {i} s {join_t} WHERE s.i2 IS NOT NULL AND NOT {has('s.table_id', 's.i2')}",
    ]
    return 'SELECT project_id, code, tbl AS "table", object, message FROM (' + " UNION ALL ".join(rows) + ")"


@query("catalog_problems", problems_sql("broken"))
def catalog_problems(d):
    return catalog_checks.check_catalog(catalog(d, "broken"))


@query(
    "catalog_problem_counts",
    f"SELECT code, count(*) AS n FROM ({problems_sql('broken')}) GROUP BY code",
)
def catalog_problem_counts(d):
    return catalog_checks.check_catalog(catalog(d, "broken")).groupBy("code").count().withColumnRenamed("count", "n")


# --- merge --------------------------------------------------------------------


def _side(s: str) -> str:
    """Columns, constraints and indexes of a side as (project, table, kind, id, value)."""
    return f"""SELECT project_id, table_id, 'column' AS what, column_id AS id, name || '~' || type_base || '(' || cast(type_param AS string) || ')~'
   || cast(nullable AS string) || '~' || default_expr AS v FROM {{columns_{s}}}
 UNION ALL SELECT project_id, table_id, 'constraint', constraint_id, kind || '|' || coalesce(cast(c1 AS string), '') || '|→|'
   || coalesce(cast(ref_table_id AS string), '') || '|' || coalesce(cast(r1 AS string), '') || '|' || on_delete || '||' || expr FROM {{constraints_{s}}}
 UNION ALL SELECT project_id, table_id, 'index', index_id, name || '~' || cast(i1 AS string) || '|' || cast(i2 AS string) || '|'
   || cast(is_unique AS string) || method FROM {{indexes_{s}}}"""


_SIDES = "sb AS (" + _side("base") + "), so AS (" + _side("ours") + "), st AS (" + _side("theirs") + ")"
_K = "a.project_id = b.project_id AND a.table_id = b.table_id"
# Tables in the three versions, whether a side changed them, and what becomes of them.
_MODES = f"""{_SIDES},
mo AS (SELECT DISTINCT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.table_id, b.table_id) AS table_id FROM sb a
  FULL JOIN so b ON {_K} AND a.what = b.what AND a.id = b.id WHERE a.v IS DISTINCT FROM b.v),
mt AS (SELECT DISTINCT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.table_id, b.table_id) AS table_id FROM sb a
  FULL JOIN st b ON {_K} AND a.what = b.what AND a.id = b.id WHERE a.v IS DISTINCT FROM b.v),
ids AS (SELECT project_id, table_id FROM {{tables_base}} UNION SELECT project_id, table_id FROM {{tables_ours}} UNION SELECT project_id, table_id FROM {{tables_theirs}}),
tt AS (SELECT i.project_id, i.table_id, b.name AS bn, o.name AS oname, t.name AS tn,
  (o.name IS DISTINCT FROM b.name OR EXISTS (SELECT 1 FROM mo WHERE mo.project_id = i.project_id AND mo.table_id = i.table_id)) AS mod_o,
  (t.name IS DISTINCT FROM b.name OR EXISTS (SELECT 1 FROM mt WHERE mt.project_id = i.project_id AND mt.table_id = i.table_id)) AS mod_t
  FROM ids i LEFT JOIN {{tables_base}} b ON b.project_id = i.project_id AND b.table_id = i.table_id
  LEFT JOIN {{tables_ours}} o ON o.project_id = i.project_id AND o.table_id = i.table_id
  LEFT JOIN {{tables_theirs}} t ON t.project_id = i.project_id AND t.table_id = i.table_id),
te AS (SELECT *, (bn IS NOT NULL AND oname IS NULL AND tn IS NOT NULL AND mod_t) AS og, (bn IS NOT NULL AND oname IS NOT NULL AND tn IS NULL AND mod_o) AS tg,
  'table_existence:' || cast(project_id AS string) || ':' || cast(table_id AS string) AS eid FROM tt),
modes AS (SELECT *, CASE WHEN oname IS NOT NULL AND tn IS NOT NULL THEN 'merge' WHEN bn IS NULL AND oname IS NOT NULL THEN 'ours'
  WHEN bn IS NULL THEN 'theirs' WHEN og AND ANSWER = 'theirs' THEN 'theirs' WHEN tg AND coalesce(ANSWER, 'ours') <> 'theirs' THEN 'ours' ELSE 'gone' END AS mode FROM te),"""


def _props(s: str) -> str:
    """A side's columns of the tables that are merged or taken from it."""
    return f"""(SELECT c.project_id, c.table_id, c.column_id, c.name, c.type_base || '(' || cast(c.type_param AS string) || ')' AS type, c.nullable, c.default_expr AS def,
   c.position, m.mode FROM {{columns_{s}}} c JOIN modes m ON m.project_id = c.project_id AND m.table_id = c.table_id)"""


_COLS = f"""cj AS (SELECT coalesce(o.project_id, t.project_id, b.project_id) AS project_id, coalesce(o.table_id, t.table_id, b.table_id) AS table_id,
  coalesce(o.column_id, t.column_id, b.column_id) AS column_id, coalesce(o.mode, t.mode, b.mode) AS mode,
  b.column_id IS NOT NULL AS hb, o.column_id IS NOT NULL AS ho, t.column_id IS NOT NULL AS ht,
  {", ".join(f"{s}.{p} AS {s}_{p}" for s in "bot" for p in ("name", "type", "nullable", "def", "position"))}
  FROM {_props("base")} b FULL JOIN {_props("ours")} o ON b.project_id = o.project_id AND b.table_id = o.table_id AND b.column_id = o.column_id
  FULL JOIN {_props("theirs")} t ON coalesce(b.project_id, o.project_id) = t.project_id AND coalesce(b.table_id, o.table_id) = t.table_id AND coalesce(b.column_id, o.column_id) = t.column_id),
ck AS (SELECT *, cast(project_id AS string) || ':' || cast(table_id AS string) || ':' || cast(column_id AS string) AS kt,
  (b_name IS DISTINCT FROM o_name OR b_type IS DISTINCT FROM o_type OR b_nullable IS DISTINCT FROM o_nullable OR b_def IS DISTINCT FROM o_def) AS d_o,
  (b_name IS DISTINCT FROM t_name OR b_type IS DISTINCT FROM t_type OR b_nullable IS DISTINCT FROM t_nullable OR b_def IS DISTINCT FROM t_def) AS d_t
  FROM cj WHERE mode <> 'gone')"""


def _csplit(p: str) -> str:
    return f"(mode = 'merge' AND hb AND ho AND ht AND o_{p} <> t_{p} AND b_{p} <> o_{p} AND b_{p} <> t_{p})"


def _cvalue(p: str, prefix: str | None) -> str:
    cast_null = f"(SELECT choice FROM ans WHERE ans.conflict_id = '{prefix}:' || kt)" if prefix else "cast(NULL AS string)"
    custom = f"(SELECT custom FROM ans WHERE ans.conflict_id = '{prefix}:' || kt)" if prefix else f"o_{p}"
    pick = f"CASE WHEN {cast_null} = 'theirs' THEN t_{p} WHEN {cast_null} = 'custom' THEN {custom} ELSE o_{p} END" if prefix else f"o_{p}"
    return f"""CASE WHEN mode = 'ours' THEN o_{p} WHEN mode = 'theirs' THEN t_{p} WHEN hb AND ho AND ht THEN
   CASE WHEN {_csplit(p)} THEN {pick} WHEN b_{p} = o_{p} THEN t_{p} ELSE o_{p} END WHEN ho THEN o_{p} ELSE t_{p} END"""


def _merged_columns(resolved: bool) -> str:
    keep = """((mode = 'ours' AND ho) OR (mode = 'theirs' AND ht) OR (mode = 'merge' AND ((hb AND ho AND ht) OR NOT hb
   OR (hb AND ho AND NOT ht AND d_o))))"""
    return f"""cm AS (SELECT project_id, table_id, column_id, {_cvalue("name", "column_name" if resolved else None)} AS name,
  {_cvalue("type", "column_type" if resolved else None)} AS type, {_cvalue("nullable", None)} AS nullable, {_cvalue("def", None)} AS def,
  CASE WHEN mode = 'merge' THEN CASE WHEN hb THEN 0 WHEN ho THEN 1 ELSE 2 END WHEN mode = 'ours' THEN 0 ELSE 0 END AS origin,
  CASE WHEN mode = 'ours' THEN o_position WHEN mode = 'theirs' THEN t_position ELSE coalesce(b_position, o_position, t_position) END AS pos
  FROM ck WHERE {keep})"""


_ANS = """ans AS (SELECT * FROM {fleet_answers} WHERE choice <> 'custom' OR custom NOT LIKE '%('),"""
_TABLES_MERGED = """tm AS (SELECT project_id, table_id, CASE WHEN mode = 'ours' THEN oname WHEN mode = 'theirs' THEN tn
   WHEN oname <> tn AND bn <> oname AND bn <> tn THEN TPICK WHEN bn = oname THEN tn ELSE oname END AS name,
   CASE WHEN bn IS NOT NULL THEN 0 WHEN oname IS NOT NULL THEN 1 ELSE 2 END AS origin, table_id AS ordinal FROM modes WHERE mode <> 'gone')"""
_TANS = "(SELECT {} FROM ans WHERE ans.conflict_id = 'table_name:' || cast(modes.project_id AS string) || ':' || cast(modes.table_id AS string))"
_TPICK = f"CASE WHEN {_TANS.format('choice')} = 'theirs' THEN tn WHEN {_TANS.format('choice')} = 'custom' THEN {_TANS.format('custom')} ELSE oname END"


def merge_sql(resolved: bool) -> str:
    answer = "(SELECT choice FROM ans WHERE ans.conflict_id = te.eid)" if resolved else "cast(NULL AS string)"
    tables = _TABLES_MERGED.replace("TPICK", _TPICK if resolved else "oname")
    head = _ANS if resolved else ""
    return f"{head} {_MODES.replace('ANSWER', answer)} {tables}, {_COLS}, {_merged_columns(resolved)}"


_MERGE = merge_sql(False)
_POSITIONS = """SELECT project_id, table_id, column_id, name, type, nullable, def AS default_expr,
  cast(row_number() OVER (PARTITION BY project_id, table_id ORDER BY origin, pos, column_id) AS int) AS position FROM cm"""


def _fleet_merge(d, answers=None):
    return catalog_merge.merge_catalogs(catalog(d, "base"), catalog(d, "ours"), catalog(d, "theirs"), answers)


def _flat(columns):
    return columns.select(
        "project_id",
        "table_id",
        "column_id",
        "name",
        render_type(F.col("type_base"), F.col("type_params")).alias("type"),
        "nullable",
        "default_expr",
        "position",
    )


@query("catalog_merge", f"WITH {_MERGE} {_POSITIONS}")
def catalog_merge_query(d):
    return _flat(_fleet_merge(d).merged.columns)


@query("catalog_merge_tables", f"WITH {_MERGE} SELECT project_id, table_id, name FROM tm")
def catalog_merge_tables(d):
    return _fleet_merge(d).merged.tables.select("project_id", "table_id", "name")


_COLUMN_CONFLICTS = " UNION ALL ".join(
    f"SELECT project_id, '{prefix}:' || kt AS conflict_id, '{cls}' AS class, '{label}' AS property FROM ck WHERE {_csplit(p)}"
    for p, prefix, cls, label in [
        ("name", "column_name", "rename_rename", "name"),
        ("type", "column_type", "retype_retype", "type"),
        ("def", "column_default", "default_default", "default"),
    ]
) + """ UNION ALL SELECT project_id, 'column_existence:' || kt, 'delete_modify', 'existence' FROM ck
 WHERE mode = 'merge' AND ((hb AND NOT ho AND ht AND d_t) OR (hb AND ho AND NOT ht AND d_o))"""
_TABLE_CONFLICTS = """SELECT project_id, eid AS conflict_id, 'delete_modify' AS class, 'existence' AS property FROM te WHERE og OR tg
 UNION ALL SELECT project_id, 'table_name:' || cast(project_id AS string) || ':' || cast(table_id AS string), 'rename_rename', 'name' FROM tt
 WHERE oname <> tn AND bn <> oname AND bn <> tn
 UNION ALL SELECT project_id, 'name_collision:' || cast(project_id AS string) || ':' || cast(f AS string) || ':' || cast(project_id AS string) || ':' || cast(table_id AS string), 'name_collision', 'name'
 FROM (SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY origin, ordinal, table_id) AS rn,
   first_value(table_id) OVER (PARTITION BY project_id, name ORDER BY origin, ordinal, table_id) AS f FROM tm) WHERE rn > 1
 UNION ALL SELECT project_id, 'name_collision:' || cast(project_id AS string) || ':' || cast(table_id AS string) || ':' || cast(f AS string) || ':' || cast(project_id AS string) || ':'
   || cast(table_id AS string) || ':' || cast(column_id AS string), 'name_collision', 'name'
 FROM (SELECT *, row_number() OVER (PARTITION BY project_id, table_id, name ORDER BY origin, pos, column_id) AS rn,
   first_value(column_id) OVER (PARTITION BY project_id, table_id, name ORDER BY origin, pos, column_id) AS f FROM cm) WHERE rn > 1"""


@query("catalog_conflicts", f"WITH {_MERGE} {_COLUMN_CONFLICTS} UNION ALL {_TABLE_CONFLICTS}")
def catalog_conflicts(d):
    found = _fleet_merge(d).conflicts.where(
        "NOT conflict_id LIKE 'constraint%' AND NOT conflict_id LIKE 'index%' AND class <> 'pk_pk' "
        "AND NOT (class = 'name_collision' AND base_value LIKE 'no index%')"
    )
    return found.select("project_id", "conflict_id", "class", "property")


@query("catalog_merge_resolved", f"WITH {merge_sql(True)} SELECT project_id, table_id, column_id, name, type, nullable, def AS default_expr FROM cm")
def catalog_merge_resolved(d):
    return _flat(_fleet_merge(d, d["fleet_answers"]).merged.columns).drop("position")


def _canonical(x: str) -> str:
    return f"({x}.kind || '|' || coalesce(cast({x}.c1 AS string), '') || '|' || coalesce(cast({x}.ref_table_id AS string), '') || '|' || coalesce(cast({x}.r1 AS string), '') || '|' || {x}.on_delete || '|' || {x}.expr)"


def _member_sql(attr: str, ident: str, canon, prefix: str, cls: str, kind: str) -> str:
    """Constraints or indexes merged by definition and name, with conflicts."""
    src = lambda s: f"""(SELECT c.project_id, c.table_id, c.{ident} AS id, c.name AS n, {canon('c')} AS d, c.ordinal, {kind} AS kind, m.mode
  FROM {{{attr}_{s}}} c JOIN modes m ON m.project_id = c.project_id AND m.table_id = c.table_id)"""  # noqa: E731
    split = lambda p: f"(mode = 'merge' AND hb AND ho AND ht AND o_{p} <> t_{p} AND b_{p} <> o_{p} AND b_{p} <> t_{p})"
    value = lambda p: f"""CASE WHEN mode = 'ours' THEN o_{p} WHEN mode = 'theirs' THEN t_{p} WHEN hb AND ho AND ht THEN
   CASE WHEN {split(p)} THEN o_{p} WHEN b_{p} = o_{p} THEN t_{p} ELSE o_{p} END WHEN ho THEN o_{p} ELSE t_{p} END"""  # noqa: E731
    fields = ", ".join(f"{s}.{f} AS {s}_{f}" for s in "bot" for f in ("n", "d", "ordinal", "kind"))
    kt = "cast(project_id AS string) || ':' || cast(table_id AS string) || ':' || cast(id AS string)"
    return f"""xj AS (SELECT coalesce(o.project_id, t.project_id, b.project_id) AS project_id, coalesce(o.table_id, t.table_id, b.table_id) AS table_id,
  coalesce(o.id, t.id, b.id) AS id, coalesce(o.mode, t.mode, b.mode) AS mode, b.id IS NOT NULL AS hb, o.id IS NOT NULL AS ho, t.id IS NOT NULL AS ht, {fields}
  FROM {src('base')} b FULL JOIN {src('ours')} o ON b.project_id = o.project_id AND b.table_id = o.table_id AND b.id = o.id
  FULL JOIN {src('theirs')} t ON coalesce(b.project_id, o.project_id) = t.project_id AND coalesce(b.table_id, o.table_id) = t.table_id AND coalesce(b.id, o.id) = t.id),
xk AS (SELECT *, {kt} AS kt, (b_n <> o_n OR b_d <> o_d) AS d_o, (b_n <> t_n OR b_d <> t_d) AS d_t FROM xj WHERE mode <> 'gone'),
xm AS (SELECT project_id, table_id, id, {value('n')} AS name, {value('d')} AS d, coalesce(o_kind, t_kind) AS kind,
  CASE WHEN mode <> 'merge' OR hb THEN 0 WHEN ho THEN 1 ELSE 2 END AS origin,
  CASE WHEN mode = 'ours' THEN o_ordinal WHEN mode = 'theirs' THEN t_ordinal ELSE coalesce(b_ordinal, o_ordinal, t_ordinal) END AS ord
  FROM xk WHERE (mode = 'ours' AND ho) OR (mode = 'theirs' AND ht) OR (mode = 'merge' AND ((hb AND ho AND ht) OR NOT hb OR (ho AND NOT ht AND d_o)))),
xc AS (SELECT project_id, '{prefix}:' || kt AS conflict_id, '{cls}' AS class FROM xk WHERE {split('d')}
  UNION ALL SELECT project_id, '{prefix}_name:' || kt, 'rename_rename' FROM xk WHERE {split('n')}
  UNION ALL SELECT project_id, '{prefix}_existence:' || kt, 'delete_modify' FROM xk
   WHERE mode = 'merge' AND ((hb AND NOT ho AND ht AND d_t) OR (hb AND ho AND NOT ht AND d_o)))"""


_CONSTRAINT_MERGE = _member_sql("constraints", "constraint_id", _canonical, "constraint", "constraint_constraint", "c.kind")
_KEPT = """once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, table_id, d ORDER BY origin, ord, id) AS rn FROM xm) WHERE rn = 1),
keys AS (SELECT *, row_number() OVER (PARTITION BY project_id, table_id ORDER BY origin, ord, id) AS nth FROM once k WHERE kind = 'primary_key'
  AND NOT EXISTS (SELECT 1 FROM {constraints_base} b WHERE b.project_id = k.project_id AND b.table_id = k.table_id AND b.kind = 'primary_key'))"""
_INDEX_MERGE = _member_sql(
    "indexes",
    "index_id",
    lambda x: f"(cast({x}.i1 AS string) || '|' || cast({x}.i2 AS string) || '|' || cast({x}.is_unique AS string) || {x}.method)",
    "index",
    "index_index",
    "''",
)


@query(
    "catalog_merge_constraints",
    f"""WITH {_MERGE}, {_CONSTRAINT_MERGE}, {_KEPT} SELECT project_id, table_id, id AS constraint_id, name, kind,
  cast(row_number() OVER (PARTITION BY project_id, table_id ORDER BY origin, ord, id) AS int) AS ordinal
FROM once WHERE id NOT IN (SELECT id FROM keys WHERE nth = 2)""",
)
def catalog_merge_constraints(d):
    found = _fleet_merge(d).merged.constraints
    return found.select("project_id", "table_id", "constraint_id", "name", "kind", "ordinal")


@query("catalog_merge_indexes", f"WITH {_MERGE}, {_INDEX_MERGE} SELECT project_id, table_id, id AS index_id, name FROM xm")
def catalog_merge_indexes(d):
    return _fleet_merge(d).merged.indexes.select("project_id", "table_id", "index_id", "name")


@query(
    "member_conflicts",
    f"""WITH {_MERGE}, {_CONSTRAINT_MERGE}, {_KEPT}
SELECT * FROM xc UNION ALL SELECT project_id, 'pk:' || cast(project_id AS string) || ':' || cast(table_id AS string), 'pk_pk' FROM keys WHERE nth = 2""",
)
def member_conflicts(d):
    found = _fleet_merge(d).conflicts.where("conflict_id LIKE 'constraint%' OR class = 'pk_pk'")
    return found.select("project_id", "conflict_id", "class")


@query("index_conflicts", f"WITH {_MERGE}, {_INDEX_MERGE} SELECT * FROM xc")
def index_conflicts(d):
    return _fleet_merge(d).conflicts.where("conflict_id LIKE 'index%'").select("project_id", "conflict_id", "class")


def _told(side: str) -> str:
    return "(" + constraint_text(f"{{constraints_{side}}}", f"{{columns_{side}}}", f"{{tables_{side}}}") + ")"


@query(
    "conflicts_shown",
    f"""WITH {_MERGE}, {_CONSTRAINT_MERGE} SELECT xc.project_id, xc.conflict_id, b.definition AS base_value, o.definition AS ours_value, t.definition AS theirs_value
FROM xk JOIN xc ON xc.conflict_id = 'constraint:' || xk.kt JOIN {_told('base')} b ON b.project_id = xk.project_id AND b.constraint_id = xk.id
JOIN {_told('ours')} o ON o.project_id = xk.project_id AND o.constraint_id = xk.id JOIN {_told('theirs')} t ON t.project_id = xk.project_id AND t.constraint_id = xk.id""",
)
def conflicts_shown(d):
    sides = [catalog(d, s) for s in ("base", "ours", "theirs")]
    found = cut(catalog_merge.merge_catalogs(*sides).conflicts)
    shown = catalog_merge.shown_conflicts(found, *sides).where("class = 'constraint_constraint'")
    return shown.select("project_id", "conflict_id", "base_value", "ours_value", "theirs_value")


@query(
    "name_collisions",
    """SELECT project_id, table_id, cast(table_id AS string) AS object_id, 'table' AS scope FROM (SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY ordinal, table_id) AS rn FROM {tables_broken}) WHERE rn > 1
UNION ALL SELECT project_id, table_id, cast(column_id AS string), 'column' FROM (SELECT *, row_number() OVER (PARTITION BY project_id, table_id, name ORDER BY position, column_id) AS rn FROM {columns_broken}) WHERE rn > 1
UNION ALL SELECT project_id, table_id, cast(index_id AS string), 'index' FROM (SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY ordinal, table_id, index_id) AS rn FROM {indexes_broken}) WHERE rn > 1""",
)
def name_collisions(d):
    return catalog_merge.name_collisions(catalog(d, "broken")).select("project_id", "table_id", "object_id", "scope")


@query(
    "collision_answers",
    """WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY space, project_id, home, name ORDER BY ord, id) AS rn FROM {claims}),
w AS (SELECT space, project_id, home, name, rn, id, id AS holder, cast(NULL AS bigint) AS met, cast(NULL AS varchar) AS choice, cast(NULL AS varchar) AS custom FROM m WHERE rn = 1
  UNION ALL SELECT m.space, m.project_id, m.home, m.name, m.rn, m.id, CASE WHEN a.choice = 'theirs' THEN m.id ELSE w.holder END, w.holder, a.choice, a.custom
  FROM w JOIN m ON m.space = w.space AND m.project_id = w.project_id AND m.home = w.home AND m.name = w.name AND m.rn = w.rn + 1
  LEFT JOIN {claim_answers} a ON a.conflict_id = 'name_collision:' || m.space || ':' || cast(w.holder AS varchar) || ':' || m.space || ':' || cast(m.id AS varchar))
SELECT space, project_id, home, id, coalesce(custom, name) AS name,
  CASE WHEN met IS NOT NULL AND choice IS NULL THEN 'name_collision:' || space || ':' || cast(met AS varchar) || ':' || space || ':' || cast(id AS varchar) END AS open_conflict
FROM w WHERE (choice IS NULL OR choice <> 'ours') AND (space, id) NOT IN (SELECT (space, met) FROM w WHERE choice = 'theirs')""",
)
def collision_answers(d):
    """Names of tables, columns and indexes claimed by several objects, answered by conflict ids."""
    kept, still = collisions.resolve_collisions(
        d["claims"], ["space", "project_id", "home", "name"], "name", ["space", "id"], ["ord"], d["claim_answers"]
    )
    told = still.select("space", "id", F.col("conflict_id").alias("open_conflict"))
    return kept.join(told, ["space", "id"], "left").select("space", "project_id", "home", "id", "name", "open_conflict")


# --- evolution plans ----------------------------------------------------------


def plan_sql(frm: str, to: str) -> str:
    both = f"""bt AS (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.table_id, b.table_id) AS table_id, a.name AS fn, b.name AS tn
  FROM {{tables_{frm}}} a FULL JOIN {{tables_{to}}} b ON {_K})"""
    t = "JOIN bt ON bt.project_id = s.project_id AND bt.table_id = s.table_id"
    no = lambda src, i, extra: f"NOT EXISTS (SELECT 1 FROM {src} y WHERE y.project_id = s.project_id AND y.table_id = s.table_id AND y.{i} = s.{i} {extra})"
    iy = "AND y.name = s.name AND y.i1 IS NOT DISTINCT FROM s.i1 AND y.i2 IS NOT DISTINCT FROM s.i2 AND y.is_unique = s.is_unique AND y.method = s.method"
    ky = f"AND {_canonical('y')} = {_canonical('s')}"

    def cname(side: str, tname: str) -> str:
        first = f"coalesce((SELECT x.name FROM {{columns_{side}}} x WHERE x.project_id = s.project_id AND x.table_id = s.table_id AND x.column_id = s.c1), '')"
        return f"""CASE WHEN s.name <> '' THEN s.name WHEN kind = 'primary_key' THEN {tname} || '_pkey' WHEN kind = 'unique' THEN {tname} || '_' || {first} || '_key'
   WHEN kind = 'foreign_key' THEN {tname} || '_' || {first} || '_fkey' ELSE {tname} || '_' || {first} || '_check' END"""

    cf, ct = _columns(frm).replace(" AS txt", " AS txt, nullable, default_expr"), _columns(to).replace(" AS txt", " AS txt, nullable, default_expr")
    on3 = "a.project_id = b.project_id AND a.table_id = b.table_id AND a.column_id = b.column_id"
    alive = "bt.fn IS NOT NULL AND bt.tn IS NOT NULL"
    jc = f"FROM pa a JOIN pb b ON {on3} JOIN bt ON bt.project_id = b.project_id AND bt.table_id = b.table_id"
    same2 = "x.project_id = y.project_id AND x.table_id = y.table_id AND x.column_id = y.column_id"
    hold = f"(SELECT count(*) FROM pa x JOIN pb y ON {same2} WHERE x.project_id = b.project_id AND x.table_id = b.table_id AND x.name = b.name AND"
    rows = [
        f"SELECT s.project_id, 1 AS phase, 'drop_index' AS action, bt.fn AS tbl, s.name AS object, cast(NULL AS string) AS from_value, cast(NULL AS string) AS to_value, cast(NULL AS string) AS warning_code FROM {{indexes_{frm}}} s {t} WHERE bt.tn IS NOT NULL AND {no(f'{{indexes_{to}}}', 'index_id', iy)}",
        f"SELECT s.project_id, CASE WHEN kind = 'foreign_key' THEN 2 ELSE 3 END, 'drop_constraint', bt.fn, {cname(frm, 'bt.fn')}, kind, NULL, NULL FROM {{constraints_{frm}}} s {t} WHERE bt.tn IS NOT NULL AND {no(f'{{constraints_{to}}}', 'constraint_id', ky)}",
        f"SELECT s.project_id, 4, 'drop_column', bt.fn, s.name, s.txt, NULL, NULL FROM pa s {t} WHERE {alive} AND {no('pb', 'column_id', '')}",
        "SELECT project_id, 5, 'drop_table', fn, NULL, NULL, NULL, NULL FROM bt WHERE tn IS NULL",
        "SELECT project_id, 6, 'rename_table', fn, cast(table_id AS string), fn, tn, NULL FROM bt WHERE fn <> tn",
        f"SELECT b.project_id, 7, 'rename_column', bt.tn, cast(b.column_id AS string), a.name, b.name, CASE WHEN {hold} (x.name = y.name)) > 0 OR {hold} (x.name <> y.name)) > 1 OR EXISTS (SELECT 1 FROM pa x JOIN pb y ON {same2} WHERE x.project_id = b.project_id AND x.table_id = b.table_id AND y.name = b.name AND x.name <> y.name AND x.column_id < b.column_id) THEN 'name_taken' END {jc} WHERE {alive} AND a.name <> b.name",
        f"SELECT s.project_id, 8, 'create_table', tn, NULL, NULL, cast((SELECT count(*) FROM pb x WHERE x.project_id = s.project_id AND x.table_id = s.table_id) AS string) || ' columns, ' || cast((SELECT count(*) FROM {{constraints_{to}}} x WHERE x.project_id = s.project_id AND x.table_id = s.table_id AND x.kind <> 'foreign_key') AS string) || ' constraints', NULL FROM bt s WHERE fn IS NULL",
        f"SELECT s.project_id, 9, 'add_column', bt.tn, s.name, NULL, s.txt, CASE WHEN NOT s.nullable AND s.default_expr = '' THEN 'add_not_null_no_default' END FROM pb s {t} WHERE {alive} AND {no('pa', 'column_id', '')}",
        f"SELECT b.project_id, 10, 'alter_type', bt.tn, b.name, a.type, b.type, 'retype_needs_using' {jc} WHERE {alive} AND a.type <> b.type",
        f"SELECT b.project_id, 10, CASE WHEN b.default_expr = '' THEN 'drop_default' ELSE 'set_default' END, bt.tn, b.name, a.default_expr, b.default_expr, NULL {jc} WHERE {alive} AND a.default_expr <> b.default_expr",
        f"SELECT b.project_id, 10, CASE WHEN b.nullable THEN 'drop_not_null' ELSE 'set_not_null' END, bt.tn, b.name, cast(a.nullable AS string), cast(b.nullable AS string), CASE WHEN NOT b.nullable THEN 'set_not_null' END {jc} WHERE {alive} AND a.nullable <> b.nullable",
        f"SELECT s.project_id, CASE WHEN kind = 'foreign_key' THEN 12 ELSE 11 END, 'add_constraint', bt.tn, {cname(to, 'bt.tn')}, NULL, kind, NULL FROM {{constraints_{to}}} s {t} WHERE bt.tn IS NOT NULL AND (bt.fn IS NOT NULL OR kind = 'foreign_key') AND {no(f'{{constraints_{frm}}}', 'constraint_id', ky)}",
        f"SELECT s.project_id, 13, 'create_index', bt.tn, s.name, NULL, NULL, NULL FROM {{indexes_{to}}} s {t} WHERE bt.tn IS NOT NULL AND {no(f'{{indexes_{frm}}}', 'index_id', iy)}",
    ]
    return f"""WITH {both}, pa AS {cf}, pb AS {ct} SELECT project_id, phase, action, tbl AS "table", object, from_value, to_value, warning_code FROM ({" UNION ALL ".join(rows)})"""


_STEP = ["project_id", "phase", "action", "table", "object", "from_value", "to_value", "warning_code"]


@query("migration_plan", plan_sql("ours", "theirs"))
def migration_plan(d):
    return migration.ordered_plan(migration.migration_plan(catalog(d, "ours"), catalog(d, "theirs"))).select(*_STEP)


@query(
    "export_plan",
    """WITH t AS (SELECT * FROM {tables_theirs})
SELECT project_id, phase, count(*) AS n FROM (
  SELECT project_id, 8 AS phase FROM t UNION ALL SELECT s.project_id, 12 FROM {constraints_theirs} s JOIN t ON t.project_id = s.project_id AND t.table_id = s.table_id WHERE kind = 'foreign_key'
  UNION ALL SELECT s.project_id, 13 FROM {indexes_theirs} s JOIN t ON t.project_id = s.project_id AND t.table_id = s.table_id) GROUP BY 1, 2""",
)
def export_plan(d):
    return migration.export_plan(catalog(d, "theirs")).groupBy("project_id", "phase").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rename_order",
    """WITH RECURSIVE r AS (SELECT a.project_id, a.table_id, a.column_id, a.name AS cur, b.name AS tgt FROM {names_before} a JOIN {names_after} b ON a.column_id = b.column_id),
w AS (SELECT r.*, h.column_id AS holder FROM r LEFT JOIN r h ON h.table_id = r.table_id AND h.cur = r.tgt),
l AS (SELECT column_id, 0 AS ord FROM w WHERE holder IS NULL UNION ALL SELECT w.column_id, l.ord + 1 FROM l JOIN w ON w.holder = l.column_id),
c AS (SELECT * FROM w WHERE column_id NOT IN (SELECT column_id FROM l)),
m AS (SELECT table_id, min(column_id) AS low, count(*) AS size FROM c GROUP BY table_id),
k AS (SELECT low AS column_id, low, 0 AS ord FROM m UNION ALL SELECT c.column_id, k.low, k.ord + 1 FROM k JOIN c ON c.holder = k.column_id AND c.column_id <> k.low)
SELECT r.project_id, r.table_id, r.column_id, ord AS rename_order, cur AS from_name, tgt AS to_name FROM l JOIN r ON r.column_id = l.column_id
UNION ALL SELECT r.project_id, r.table_id, r.column_id, ord, cur, CASE WHEN ord = 0 THEN '__tmp_' || cast(r.column_id AS string) ELSE tgt END FROM k JOIN r ON r.column_id = k.column_id
UNION ALL SELECT r.project_id, r.table_id, r.column_id, m.size, '__tmp_' || cast(r.column_id AS string), tgt FROM m JOIN r ON r.column_id = m.low""",
)
def rename_order(d):
    before, after = d["names_before"], d["names_after"]
    renames = before.withColumnRenamed("name", "current").join(
        after.withColumnRenamed("name", "target"), ["project_id", "table_id", "column_id"]
    )
    found = migration.order_renames(renames, before, ["project_id", "table_id"], "column_id")
    return found.drop("warning_code")


# --- edit logs ----------------------------------------------------------------

_EDIT_ERRORS = """bad AS (SELECT e.project_id, e.seq, e.op, 'still_referenced' AS reason, row_number() OVER (PARTITION BY e.project_id ORDER BY e.seq) AS rn
  FROM {fleet_edits} e WHERE e.op = 'drop_column' AND (EXISTS (SELECT 1 FROM {constraints_base} k WHERE k.table_id = e.table_id
    AND (k.c1 = e.column_id OR k.r1 = e.column_id)) OR EXISTS (SELECT 1 FROM {indexes_base} x WHERE x.table_id = e.table_id
    AND (x.i1 = e.column_id OR x.i2 = e.column_id))))"""


def _edited(op: str, v: str, old: str) -> str:
    return f"coalesce((SELECT max(e.{v}) FROM {{fleet_edits}} e WHERE e.column_id = c.column_id AND e.op = '{op}'), {old})"


@query("oplog_errors_catalog", f"WITH {_EDIT_ERRORS} SELECT project_id, seq, op, reason FROM bad WHERE rn = 1")
def oplog_errors_catalog(d):
    return catalog_replay.replay_catalog(catalog(d, "base"), _log(d))[1]


_REASONS = " ".join(f"WHEN {n} THEN '{reason}'" for n, (_, reason) in enumerate(FAULTS))


@query(
    "oplog_error_reasons",
    f"""SELECT e.project_id, e.seq, e.op, CASE e.project_id % {len(FAULTS)} {_REASONS} END AS reason FROM {{faulty_edits}} e
WHERE e.seq = 2 AND (e.project_id % {len(FAULTS)} <> 18 OR EXISTS (SELECT 1 FROM {{constraints_solo}} k WHERE k.project_id = e.project_id AND k.kind = 'primary_key'))
  AND (e.project_id % {len(FAULTS)} <> 17 OR EXISTS (SELECT 1 FROM {{columns_solo}} c WHERE c.column_id = e.column_id AND c.name <> e.name))""",
)
def oplog_error_reasons(d):
    """One faulty edit in each stream, of every kind that a stream can be refused for."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<bigint>"))
    made, adds = F.col("op") == "create_table", F.col("op") == "add_constraint"
    column = lambda kind: F.struct(
        (F.col("table_id") + 1).alias("column_id"), F.lit("a").alias("name"), kind.alias("type"), F.lit(True).alias("nullable"), F.lit("").alias("default_expr")
    )
    blank = F.col("project_id") % len(FAULTS) == 10
    some = F.array(column(F.when(blank, F.lit(" ")).otherwise(F.lit("text"))))
    log = d["faulty_edits"].withColumns(
        {
            "columns": F.when(made & (F.col("project_id") % len(FAULTS) != 9), some),
            "column_ids": F.when(adds, one("c1")),
            "ref_column_ids": F.when(adds, one("r1")),
        }
    )
    return catalog_replay.replay_catalog(catalog(d, "solo"), _with_unused(log.drop("c1", "r1")))[1]


@query(
    "oplog_replay_catalog",
    f"""WITH {_EDIT_ERRORS}, ok AS (SELECT DISTINCT project_id FROM {{columns_base}} WHERE project_id NOT IN (SELECT project_id FROM bad)),
s AS (SELECT c.project_id, c.table_id, c.column_id, {_edited('rename_column', 'name', 'c.name')} AS name,
  {_edited('retype_column', 'type', "c.type_base || '(' || cast(c.type_param AS string) || ')'")} AS type,
  {_edited('set_nullable', 'nullable', 'c.nullable')} AS nullable, {_edited('set_default', 'default_expr', 'c.default_expr')} AS default_expr, 0 AS g, c.position AS o
  FROM {{columns_base}} c WHERE c.project_id IN (SELECT project_id FROM ok) AND c.column_id % 37 <> 0
 UNION ALL SELECT project_id, table_id, column_id, name, type, nullable, default_expr, 1, seq FROM {{fleet_edits}} WHERE op = 'add_column' AND project_id IN (SELECT project_id FROM ok)
 UNION ALL SELECT project_id, table_id, column_id, name, type_base || '(' || cast(type_param AS string) || ')', nullable, default_expr, 0, position
  FROM {{columns_base}} WHERE project_id NOT IN (SELECT project_id FROM ok))
SELECT project_id, table_id, column_id, name, type, nullable, default_expr,
  cast(row_number() OVER (PARTITION BY project_id, table_id ORDER BY g, o) AS int) AS position FROM s""",
)
def oplog_replay_catalog(d):
    return _flat(catalog_replay.replay_catalog(catalog(d, "base"), _log(d))[0].columns)


def _log(d):
    """The edits with the fields they do not use, as nulls."""
    return _with_unused(d["fleet_edits"])


def _structure_log(d):
    c = lambda i, name, kind: F.struct(
        F.col(i).alias("column_id"), F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(False).alias("nullable"), F.lit("").alias("default_expr")
    )
    makes, adds, indexes = (F.col("op") == op for op in ("create_table", "add_constraint", "add_index"))
    log = d["structure_edits"].withColumns(
        {
            "columns": F.when(makes, F.array(c("c1", "a", "bigint"), c("c2", "b", "text"))),
            "kind": F.when(adds, F.lit("unique")),
            "column_ids": F.when(adds, F.array("c1")),
            "index_columns": F.when(indexes, F.array(F.struct(F.col("c1").alias("column_id"), F.lit(False).alias("desc")))),
            "is_unique": F.when(indexes, F.lit(False)),
        }
    )
    return _with_unused(log.drop("c1", "c2"))


# What the edits of tables, constraints and indexes leave.
_MADE = "made AS (SELECT * FROM {structure_edits} e WHERE NOT EXISTS (SELECT 1 FROM {structure_edits} x WHERE x.op = 'drop_table' AND x.table_id = e.table_id))"


@query(
    "oplog_tables",
    f"""WITH {_MADE}, s AS (
  SELECT t.project_id, t.table_id, coalesce(r.name, t.name) AS name, 0 AS g, t.ordinal AS o FROM {{tables_base}} t
  LEFT JOIN {{structure_edits}} r ON r.op = 'rename_table' AND r.table_id = t.table_id
  UNION ALL SELECT project_id, table_id, name, 1, seq FROM made WHERE op = 'create_table')
SELECT project_id, table_id, name, cast(row_number() OVER (PARTITION BY project_id ORDER BY g, o) AS bigint) AS ordinal FROM s""",
)
def oplog_tables(d):
    after = catalog_replay.replay_catalog(catalog(d, "base"), _structure_log(d))[0].tables
    return after.select("project_id", "table_id", "name", F.col("ordinal").cast("long").alias("ordinal"))


@query(
    "oplog_constraints",
    f"""WITH {_MADE}, s AS (
  SELECT project_id, table_id, constraint_id, kind, c1, 0 AS g, ordinal AS o FROM {{constraints_base}}
  WHERE constraint_id NOT IN (SELECT constraint_id FROM {{structure_edits}} WHERE op = 'drop_constraint')
  UNION ALL SELECT project_id, table_id, constraint_id, 'unique', c1, 1, seq FROM made WHERE op = 'add_constraint')
SELECT project_id, table_id, constraint_id, kind, c1, cast(row_number() OVER (PARTITION BY project_id, table_id ORDER BY g, o) AS bigint) AS ordinal FROM s""",
)
def oplog_constraints(d):
    after = catalog_replay.replay_catalog(catalog(d, "base"), _structure_log(d))[0].constraints
    first = F.get("column_ids", F.lit(0)).alias("c1")
    return after.select("project_id", "table_id", "constraint_id", "kind", first, F.col("ordinal").cast("long").alias("ordinal"))


@query(
    "oplog_indexes",
    f"""WITH {_MADE}
SELECT project_id, table_id, index_id, name, i1 FROM {{indexes_base}} WHERE index_id NOT IN (SELECT index_id FROM {{structure_edits}} WHERE op = 'drop_index')
UNION ALL SELECT project_id, table_id, index_id, name, c1 FROM made WHERE op = 'add_index'""",
)
def oplog_indexes(d):
    after = catalog_replay.replay_catalog(catalog(d, "base"), _structure_log(d))[0].indexes
    return after.select("project_id", "table_id", "index_id", "name", F.get("columns", F.lit(0))["column_id"].alias("i1"))


@query(
    "oplog_structure_columns",
    f"""WITH {_MADE}, m AS (SELECT * FROM made WHERE op = 'create_table')
SELECT project_id, table_id, column_id, name, position FROM {{columns_base}}
UNION ALL SELECT project_id, table_id, c1, 'a', 1 FROM m UNION ALL SELECT project_id, table_id, c2, 'b', 2 FROM m""",
)
def oplog_structure_columns(d):
    after = catalog_replay.replay_catalog(catalog(d, "base"), _structure_log(d))[0].columns
    return after.select("project_id", "table_id", "column_id", "name", "position")


def _with_unused(log):
    unused = (
        "constraint_id long, index_id long, columns array<struct<column_id:long,name:string,type:string,nullable:boolean,default_expr:string>>, "
        "kind string, column_ids array<long>, ref_table_id long, ref_column_ids array<long>, on_delete string, on_update string, expr string, "
        "index_columns array<struct<column_id:long,desc:boolean>>, is_unique boolean, method string"
    )
    schema = T.StructType.fromDDL(unused)
    schema = T.StructType([f for f in schema.fields if f.name not in log.columns])
    named = T.StructType.fromDDL("column_id long, name string, type string, nullable boolean, default_expr string")
    schema = T.StructType([*schema.fields, *[f for f in named.fields if f.name not in log.columns]])
    return log.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields})


@query(
    "oplog_messages",
    """WITH e AS (SELECT e.project_id, e.seq, CASE op WHEN 'rename_column' THEN 'rename ' || p || ' → ' || e.name WHEN 'retype_column' THEN 'retype ' || p || ' → ' || e.type
  WHEN 'set_nullable' THEN 'set ' || p || ' nullable' WHEN 'set_default' THEN 'set default on ' || p WHEN 'drop_column' THEN 'drop column ' || p
  ELSE 'add column ' || t || '.' || e.name END AS text FROM (SELECT e.*, t.name AS t, t.name || '.' || coalesce(c.name, '?') AS p FROM {fleet_edits} e
  JOIN {tables_base} t ON t.project_id = e.project_id AND t.table_id = e.table_id LEFT JOIN {columns_base} c ON c.column_id = e.column_id) e)
SELECT project_id, string_agg(text, '; ' ORDER BY seq) AS message FROM e GROUP BY project_id""",
)
def oplog_messages(d):
    """The message of one commit per project: its edits in words, in order."""
    tables = d["tables_base"].select("project_id", "table_id", F.col("name").alias("tab"))
    columns = d["columns_base"].select("project_id", "table_id", "column_id", F.col("name").alias("col"))
    edits = d["fleet_edits"].join(tables, ["project_id", "table_id"]).join(columns, ["project_id", "table_id", "column_id"], "left")
    target = F.concat("tab", F.lit("."), F.when(F.col("op") == "add_column", F.col("name")).otherwise(F.coalesce("col", F.lit("?"))))
    value = F.coalesce("name", "type", F.col("nullable").cast("string"), "default_expr")
    told = edits.withColumn("text", words.edit_description(F.col("op"), F.col("tab"), target, value))
    return words.commit_messages(told, ["project_id"])


# --- refs and history ---------------------------------------------------------


def _snapshot_diff(pairs: str) -> str:
    """Changes between the snapshots of `pairs(id, f, t)`."""
    ty = lambda x: f"({x}.type_base || '(' || cast({x}.type_param AS string) || ')')"
    join = "JOIN {snapshot_columns} a ON a.commit_id = p.f JOIN {snapshot_columns} b ON b.commit_id = p.t AND b.column_id = a.column_id AND b.table_id = a.table_id"
    nul = lambda x: f"CASE WHEN {x}.nullable THEN 'nullable' ELSE 'NOT NULL' END"
    one = lambda kind, x, y, test: f"SELECT p.id AS project_id, '{kind}' AS kind, b.name AS object, {x} AS from_value, {y} AS to_value FROM p {join} WHERE {test}"
    has = lambda c, o: f"EXISTS (SELECT 1 FROM {{snapshot_columns}} z WHERE z.commit_id = {c} AND z.column_id = {o}.column_id)"
    return f"""WITH p AS ({pairs}) {one('column_renamed', 'a.name', 'b.name', 'a.name <> b.name')}
UNION ALL {one('column_retyped', ty('a'), ty('b'), f"{ty('a')} <> {ty('b')}")}
UNION ALL {one('nullability_changed', nul('a'), nul('b'), 'a.nullable <> b.nullable')}
UNION ALL SELECT p.id, 'column_added', b.name, NULL, {ty('b')} FROM p JOIN {{snapshot_columns}} b ON b.commit_id = p.t WHERE NOT {has('p.f', 'b')}
UNION ALL SELECT p.id, 'column_dropped', a.name, {ty('a')}, NULL FROM p JOIN {{snapshot_columns}} a ON a.commit_id = p.f WHERE NOT {has('p.t', 'a')}"""


_CHANGE = ["project_id", "kind", "object", "from_value", "to_value"]


@query("history_diff", _snapshot_diff("SELECT commit_id AS id, parent_id AS f, commit_id AS t FROM {commits} WHERE parent_id IS NOT NULL"))
def history_diff(d):
    return catalog_diff.history_diff(snapshots(d), d["commits"]).select(*_CHANGE)


_REFS = "SELECT m.project_id AS id, m.head_commit_id AS f, f.head_commit_id AS t FROM {ref_branches} m JOIN {ref_branches} f ON m.project_id = f.project_id WHERE m.name = 'main' AND f.name = 'feature'"


@query("diff_refs", _snapshot_diff(_REFS))
def diff_refs(d):
    return catalog_diff.diff_refs(snapshots(d), d["commits"], d["ref_branches"], d["ref_pairs"]).select(*_CHANGE)


@query(
    "plan_refs",
    f"""WITH x AS ({_snapshot_diff(_REFS)}) SELECT project_id, CASE kind WHEN 'column_renamed' THEN 'rename_column' WHEN 'column_retyped' THEN 'alter_type'
  WHEN 'column_added' THEN 'add_column' WHEN 'column_dropped' THEN 'drop_column' WHEN 'nullability_changed' THEN
  CASE WHEN to_value = 'nullable' THEN 'drop_not_null' ELSE 'set_not_null' END END AS action, count(*) AS n FROM x GROUP BY 1, 2""",
)
def plan_refs(d):
    plan = migration.plan_refs(snapshots(d), d["commits"], d["ref_branches"], d["ref_pairs"])
    return plan.groupBy("project_id", "action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snapshot_round_trip",
    """SELECT project_id, commit_id, table_id, column_id, name, type_base, type_param, nullable, position FROM {snapshot_columns}""",
)
def snapshot_round_trip(d):
    """Long tables nested to one JSON text per commit and exploded again."""
    back = explode_snapshots(nest_snapshots(snapshots(d))).columns
    return back.select(
        "project_id",
        "commit_id",
        F.col("table_id").cast("long").alias("table_id"),
        F.col("column_id").cast("long").alias("column_id"),
        "name",
        "type_base",
        F.col("type_params")[0].alias("type_param"),
        "nullable",
        "position",
    )


@query(
    "catalog_gate",
    f"""WITH {_MERGE}, c AS ({_COLUMN_CONFLICTS} UNION ALL {_TABLE_CONFLICTS}),
p AS (SELECT DISTINCT project_id FROM {{tables_base}})
SELECT p.project_id, EXISTS (SELECT 1 FROM c WHERE c.project_id = p.project_id) AS blocked FROM p""",
)
def catalog_gate(d):
    attempt = _fleet_merge(d)
    projects = d["tables_base"].select("project_id").distinct()
    decided = attempt.gate(projects)
    return decided.select("project_id", (F.col("decision") == "conflicts").alias("blocked"))
