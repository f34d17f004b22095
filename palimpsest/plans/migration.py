"""Ordered evolution plans: thirteen phases that need no dependency sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.words import column_description, has_text
from palimpsest.operators.align import align, unique_only
from palimpsest.operators.catalog import (
    PROJECT,
    SCOPE,
    TABLE,
    TABLE_SALTS,
    Catalog,
    canonical_constraint,
    canonical_index,
    plain_columns,
    skipped_objects,
)
from palimpsest.operators.catalog_diff import resolve_refs, snapshots_at
from palimpsest.operators.lists import rank_lists_and_cycles
from palimpsest.operators.spread import lookup
from palimpsest.session import cut

# The phases in order.
PHASES = [
    "drop indexes",
    "drop foreign keys",
    "drop constraints",
    "drop columns",
    "drop tables",
    "rename tables",
    "rename columns",
    "create tables",
    "add columns",
    "alter columns",
    "add constraints",
    "add foreign keys",
    "create indexes",
]
OUT = [
    PROJECT,
    "phase",
    "table_order",
    "object_order",
    "action",
    "table",
    "object",
    "from_value",
    "to_value",
    "warning_code",
]
TEMPORARY = "__tmp_"


def order_renames(renames: DataFrame, occupied: DataFrame, scope: Sequence[str], ident: str) -> DataFrame:
    """`(scope…, ident, rename_order, from_name, to_name, warning_code)`.

    `renames(scope…, ident, current, target)`; `occupied(scope…, ident, name)`
    are the names held before. A rename waits for the holder of its target to
    move away. Each name has one holder, so the waits form lists and cycles; a
    cycle is opened by moving its least id to a temporary name first. A target
    whose holder stays, or that two renames want, is reported as name_taken.
    """
    scope = list(scope)
    renames = cut(renames.select(*scope, ident, "current", "target"))
    moving = renames.select(*scope, ident, F.lit(True).alias("moves"))
    held = occupied.join(moving, [*scope, ident], "left").groupBy(*scope, F.col("name").alias("target"))
    holders = held.agg(
        F.min(F.when(F.col("moves"), F.col(ident))).alias("holder"),
        F.count("moves").alias("movers"),
        F.count_if(F.col("moves").isNull()).alias("stayers"),
    )
    firsts = renames.groupBy(*scope, "target").agg(F.min(ident).alias("claimant"))
    judged = renames.join(holders, [*scope, "target"], "left").join(firsts, [*scope, "target"])
    several = F.coalesce((F.col("stayers") > 0) | (F.col("movers") > 1), F.lit(False))
    taken = several | (F.col("claimant") != F.col(ident))
    judged = cut(judged.withColumn("taken", taken))
    node = lambda c: F.struct(*scope, F.col(c).alias(ident))
    pred = F.when(F.col("holder").isNotNull() & ~F.col("taken"), node("holder"))
    nodes = judged.select(node(ident).alias("id"), pred.alias("pred"))
    longest = renames.groupBy(*scope).count().agg(F.max("count")).first()[0] or 0
    lists, cycles = rank_lists_and_cycles(nodes, longest)
    flat = lambda df: df.select("id.*", *[c for c in df.columns if c != "id"])
    key = [*scope, ident]
    in_lists = judged.join(flat(lists), key).select(
        *key,
        F.col("dist").alias("rename_order"),
        F.col("current").alias("from_name"),
        F.col("target").alias("to_name"),
        F.when(F.col("taken"), "name_taken").alias("warning_code"),
    )
    tmp = F.concat(F.lit(TEMPORARY), F.col(ident).cast("string"))
    step = lambda order, a, b: F.struct(order.alias("rename_order"), a.alias("from_name"), b.alias("to_name"))
    moves = F.when(
        F.col("dist") == 0,
        F.array(step(F.lit(0).cast("long"), F.col("current"), tmp), step(F.col("size"), tmp, F.col("target"))),
    ).otherwise(F.array(step(F.col("dist"), F.col("current"), F.col("target"))))
    in_cycles = judged.join(flat(cycles), key).select(*key, F.explode(moves).alias("m")).select(
        *key, "m.*", F.lit(None).cast("string").alias("warning_code")
    )
    return in_lists.unionByName(in_cycles)


def _pair(frm: DataFrame, to: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return unique_only(align({"frm": frm, "to": to}, key, cols), ("frm", "to"))


def _none() -> Column:
    return F.lit(None).cast("string")


def _rows(
    df: DataFrame,
    phase: int | Column,
    action: str | Column,
    table: Column,
    obj: Column,
    frm: Column,
    to: Column,
    warning: Column | None = None,
    table_order: Column | None = None,
    object_order: Column | None = None,
) -> DataFrame:
    as_col = lambda v: F.lit(v) if isinstance(v, (int, str)) else v
    zero = F.lit(0)
    return df.select(
        PROJECT,
        as_col(phase).cast("int").alias("phase"),
        (table_order if table_order is not None else zero).cast("long").alias("table_order"),
        (object_order if object_order is not None else zero).cast("long").alias("object_order"),
        as_col(action).alias("action"),
        table.alias("table"),
        obj.cast("string").alias("object"),
        frm.cast("string").alias("from_value"),
        to.cast("string").alias("to_value"),
        (warning if warning is not None else _none()).alias("warning_code"),
    )


def _with_tables(df: DataFrame, tables: DataFrame, ident: str) -> DataFrame:
    """Attach the old and new table: structs `tf`, `tt`, null where absent."""
    both = tables.select(*SCOPE, F.col("frm").alias("tf"), F.col("to").alias("tt"))
    return lookup(df, both, SCOPE, [ident], salts=TABLE_SALTS)


def _first_column(df: DataFrame, columns: DataFrame, ident: str) -> DataFrame:
    """Add `first_name`, the name of the first member of a constraint."""
    head = F.try_element_at("column_ids", F.lit(1))
    named = df.withColumn("_c", head).join(
        columns.select(*SCOPE, F.col("column_id").alias("_c"), F.col("name").alias("first_name")), [*SCOPE, "_c"], "left"
    )
    return named.drop("_c")


def default_constraint_name(table: Column) -> Column:
    """The recorded name, or the usual one of an unnamed constraint."""
    first = F.coalesce("first_name", F.lit(""))
    made = F.when(F.col("kind") == "primary_key", F.concat(table, F.lit("_pkey"))).otherwise(
        F.concat(
            table,
            F.lit("_"),
            first,
            F.when(F.col("kind") == "unique", "_key").when(F.col("kind") == "foreign_key", "_fkey").otherwise("_check"),
        )
    )
    return F.when(has_text(F.col("name")), F.col("name")).otherwise(made)


def _constraint_steps(frm: Catalog, to: Catalog, tables: DataFrame) -> list[DataFrame]:
    fields = ["name", "kind", "column_ids", "ordinal", "canonical"]
    pair = _pair(
        frm.constraints.withColumn("canonical", canonical_constraint()),
        to.constraints.withColumn("canonical", canonical_constraint()),
        [*SCOPE, "constraint_id"],
        fields,
    )
    changed = pair.where(~F.coalesce(F.col("frm.canonical") == F.col("to.canonical"), F.lit(False)))
    placed = cut(_with_tables(changed, tables, "constraint_id"))
    # Members of a dropped table go with it; a new table carries all but its foreign keys.
    drops = placed.where(F.col("frm").isNotNull() & F.col("tt").isNotNull()).select(
        *SCOPE, "constraint_id", "frm.*", F.col("tf.name").alias("tname"), F.col("tf.ordinal").alias("tord")
    )
    adds = placed.where(
        F.col("to").isNotNull() & (F.col("tf").isNotNull() | (F.col("to.kind") == "foreign_key"))
    ).select(*SCOPE, "constraint_id", "to.*", F.col("tt.name").alias("tname"), F.col("tt.ordinal").alias("tord"))
    foreign = F.col("kind") == "foreign_key"
    out = []
    for df, cat, action, phase in (
        (drops, frm, "drop_constraint", F.when(foreign, 2).otherwise(3)),
        (adds, to, "add_constraint", F.when(foreign, 12).otherwise(11)),
    ):
        named = _first_column(df, cat.columns, "constraint_id")
        name = default_constraint_name(F.col("tname"))
        kind = F.col("kind")
        frm_v, to_v = (kind, _none()) if action == "drop_constraint" else (_none(), kind)
        out.append(
            _rows(named, phase, action, F.col("tname"), name, frm_v, to_v, None, F.col("tord"), F.col("ordinal"))
        )
    return out


def _index_steps(frm: Catalog, to: Catalog, tables: DataFrame) -> list[DataFrame]:
    pair = _pair(
        frm.indexes.withColumn("canonical", canonical_index()),
        to.indexes.withColumn("canonical", canonical_index()),
        [*SCOPE, "index_id"],
        ["name", "canonical", "ordinal"],
    )
    same = (F.col("frm.canonical") == F.col("to.canonical")) & (F.col("frm.name") == F.col("to.name"))
    placed = _with_tables(pair.where(~F.coalesce(same, F.lit(False))), tables, "index_id")
    drops = placed.where(F.col("frm").isNotNull() & F.col("tt").isNotNull())
    adds = placed.where(F.col("to").isNotNull())
    tf, tt = F.col("tf"), F.col("tt")
    return [
        _rows(drops, 1, "drop_index", tf["name"], F.col("frm.name"), _none(), _none(), None, tf["ordinal"], F.col("frm.ordinal")),
        _rows(adds, 13, "create_index", tt["name"], F.col("to.name"), _none(), _none(), None, tt["ordinal"], F.col("to.ordinal")),
    ]


def _column_steps(frm: Catalog, to: Catalog, tables: DataFrame) -> list[DataFrame]:
    cols = ["name", "type", "nullable", "default", "position"]
    pair = _pair(plain_columns(frm.columns), plain_columns(to.columns), [*SCOPE, "column_id"], cols)
    differ = F.lit(False)
    for c in cols[:-1]:
        differ = differ | (F.col(f"frm.{c}") != F.col(f"to.{c}"))
    changed = pair.where(F.col("frm").isNull() | F.col("to").isNull() | differ)
    placed = cut(_with_tables(changed, tables, "column_id").where(F.col("tf").isNotNull() & F.col("tt").isNotNull()))
    a, b, tf, tt = F.col("frm"), F.col("to"), F.col("tf"), F.col("tt")
    described = lambda c: column_description(c["type"], c["nullable"], c["default"])
    drops = _rows(
        placed.where(b.isNull()), 4, "drop_column", tf["name"], a["name"], described(a), _none(), None, tf["ordinal"], a["position"]
    )
    hard = F.when(~b["nullable"] & (b["default"] == ""), "add_not_null_no_default")
    adds = _rows(
        placed.where(a.isNull()), 9, "add_column", tt["name"], b["name"], _none(), described(b), hard, tt["ordinal"], b["position"]
    )
    step = lambda test, action, x, y, warning: F.when(
        test,
        F.struct(
            (action if isinstance(action, Column) else F.lit(action)).alias("action"),
            x.cast("string").alias("x"),
            y.cast("string").alias("y"),
            (warning if isinstance(warning, Column) else F.lit(warning).cast("string")).alias("w"),
        ),
    )
    alters = F.array_compact(
        F.array(
            step(a["type"] != b["type"], "alter_type", a["type"], b["type"], "retype_needs_using"),
            step(
                a["default"] != b["default"],
                F.when(b["default"] == "", "drop_default").otherwise("set_default"),
                a["default"],
                b["default"],
                None,
            ),
            step(
                a["nullable"] != b["nullable"],
                F.when(b["nullable"], "drop_not_null").otherwise("set_not_null"),
                a["nullable"],
                b["nullable"],
                F.when(~b["nullable"], "set_not_null"),
            ),
        )
    )
    both = placed.where(a.isNotNull() & b.isNotNull())
    altered = both.select("*", F.posexplode(alters).alias("i", "s"))
    alter_rows = _rows(
        altered,
        10,
        F.col("s.action"),
        tt["name"],
        b["name"],
        F.col("s.x"),
        F.col("s.y"),
        F.col("s.w"),
        tt["ordinal"],
        b["position"] * 3 + F.col("i"),
    )
    renamed = both.where(a["name"] != b["name"]).select(
        *SCOPE, "column_id", a["name"].alias("current"), b["name"].alias("target"), tt["name"].alias("tname"), tt["ordinal"].alias("tord")
    )
    staying = pair.where(a.isNotNull() & b.isNotNull()).select(*SCOPE, "column_id", a["name"].alias("name"))
    ordered = order_renames(renamed, staying, SCOPE, "column_id")
    named = ordered.join(renamed.select(*SCOPE, "column_id", "tname", "tord"), [*SCOPE, "column_id"])
    renames = _rows(
        named,
        7,
        "rename_column",
        F.col("tname"),
        F.col("column_id"),
        F.col("from_name"),
        F.col("to_name"),
        F.col("warning_code"),
        F.col("tord"),
        F.col("rename_order"),
    )
    return [drops, renames, adds, alter_rows]


def _table_steps(frm: Catalog, to: Catalog, tables: DataFrame) -> list[DataFrame]:
    a, b = F.col("frm"), F.col("to")
    drops = _rows(tables.where(b.isNull()), 5, "drop_table", a["name"], _none(), _none(), _none(), None, a["ordinal"])
    sizes = to.columns.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"))
    inline = to.constraints.where(F.col("kind") != "foreign_key").groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("m"))
    new = tables.where(a.isNull()).join(sizes, SCOPE, "left").join(inline, SCOPE, "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    body = F.concat(count("n"), F.lit(" columns, "), count("m"), F.lit(" constraints"))
    creates = _rows(new, 8, "create_table", b["name"], _none(), _none(), body, None, b["ordinal"])
    both = tables.where(a.isNotNull() & b.isNotNull())
    renamed = both.where(a["name"] != b["name"]).select(*SCOPE, a["name"].alias("current"), b["name"].alias("target"))
    staying = both.select(*SCOPE, a["name"].alias("name"))
    ordered = order_renames(renamed, staying, [PROJECT], TABLE)
    renames = _rows(
        ordered,
        6,
        "rename_table",
        F.col("from_name"),
        F.col(TABLE),
        F.col("from_name"),
        F.col("to_name"),
        F.col("warning_code"),
        F.col("rename_order"),
    )
    return [drops, renames, creates]


def _skipped_steps(frm: Catalog, to: Catalog) -> DataFrame:
    """Phase 0: objects without a step, because their id is repeated or null; how often it stands on each side."""
    skipped = skipped_objects({"frm": frm, "to": to})
    ident = F.concat_ws(" ", "what", F.coalesce("object_id", F.lit("null")))
    return _rows(skipped, 0, F.col("problem"), F.col(TABLE).cast("string"), ident, F.col("n_frm"), F.col("n_to"), F.col("problem"))


def migration_plan(frm: Catalog, to: Catalog) -> DataFrame:
    """Every step from `frm` to `to` for all projects, with its phase and the
    order inside the phase. Modified constraints and indexes are dropped and
    added again; foreign keys come after all tables, so cycles do no harm."""
    tables = cut(_pair(frm.tables, to.tables, SCOPE, ["name", "ordinal"]))
    parts = [
        *_index_steps(frm, to, tables),
        *_constraint_steps(frm, to, tables),
        *_column_steps(frm, to, tables),
        *_table_steps(frm, to, tables),
        _skipped_steps(frm, to),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*OUT)


def ordered_plan(plan: DataFrame) -> DataFrame:
    return plan.orderBy(PROJECT, "phase", "table_order", "table", "object_order", "object", "action")


def export_plan(cat: Catalog) -> DataFrame:
    """A whole version as one plan from nothing."""
    return migration_plan(cat.empty(), cat)


def plan_refs(snapshots: Catalog, commits: DataFrame, branches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Plans between `(pair_id, from_ref, to_ref)`; `project_id` is the pair."""
    ends = resolve_refs(commits, branches, pairs).where(F.col("from_commit").isNotNull() & F.col("to_commit").isNotNull())
    frm = snapshots_at(snapshots, ends.select(F.col("pair_id").alias(PROJECT), F.col("from_commit").alias("commit_id")))
    to = snapshots_at(snapshots, ends.select(F.col("pair_id").alias(PROJECT), F.col("to_commit").alias("commit_id")))
    return migration_plan(frm, to)
