"""Semantic difference of two fleets of schemas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.words import column_description, nullability, or_none
from palimpsest.operators.align import align, unique_only
from palimpsest.operators.catalog import (
    PROJECT,
    SCOPE,
    TABLE,
    TABLE_SALTS,
    Catalog,
    canonical_constraint,
    canonical_index,
    describe_constraints,
    describe_indexes,
    plain_columns,
    skipped_objects,
    told,
)
from palimpsest.operators.spread import lookup
from palimpsest.session import cut

# Change kinds in reading order.
KINDS = [
    "table_renamed",
    "table_added",
    "table_dropped",
    "column_added",
    "column_dropped",
    "column_renamed",
    "column_retyped",
    "nullability_changed",
    "default_changed",
    "constraint_added",
    "constraint_dropped",
    "constraint_modified",
    "index_added",
    "index_dropped",
    "index_modified",
    # objects that are not compared
    "duplicate_key",
    "null_key",
]
OUT = [PROJECT, "kind", "table", TABLE, "object", "object_id", "from_value", "to_value", "text"]
SIDES = ("frm", "to")
ARROW = " → "


def _pair(frm: DataFrame, to: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return unique_only(align({"frm": frm, "to": to}, key, cols), SIDES)


def aligned_tables(frm: Catalog, to: Catalog) -> DataFrame:
    return _pair(frm.tables, to.tables, SCOPE, ["name"])


def common_tables(frm: Catalog, to: Catalog, pair: DataFrame | None = None) -> DataFrame:
    """`(project_id, table_id, table, renamed)` of tables on both sides, by
    their new name. Only their children are compared."""
    pair = aligned_tables(frm, to) if pair is None else pair
    both = pair.where(F.col("frm").isNotNull() & F.col("to").isNotNull())
    return both.select(*SCOPE, F.col("to.name").alias("table"), (F.col("frm.name") != F.col("to.name")).alias("renamed"))


def aligned_columns(frm: Catalog, to: Catalog) -> DataFrame:
    cols = ["name", "type", "nullable", "default", "position"]
    return _pair(plain_columns(frm.columns), plain_columns(to.columns), [*SCOPE, "column_id"], cols)


def _entry(kind: str, obj: Column, frm: Column, to: Column, text: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        obj.alias("object"),
        frm.cast("string").alias("from_value"),
        to.cast("string").alias("to_value"),
        text.alias("text"),
    )


def _none() -> Column:
    return F.lit(None).cast("string")


def table_changes(frm: Catalog, to: Catalog, pair: DataFrame | None = None) -> DataFrame:
    pair = aligned_tables(frm, to) if pair is None else pair
    sizes = to.columns.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"))
    changed = pair.where(F.col("frm").isNull() | F.col("to").isNull() | (F.col("frm.name") != F.col("to.name")))
    sized = changed.join(sizes, SCOPE, "left")
    a, b = F.col("frm.name"), F.col("to.name")
    n = F.coalesce("n", F.lit(0)).cast("string")
    change = (
        F.when(
            F.col("frm").isNull(),
            _entry("table_added", _none(), _none(), _none(), F.concat(F.lit("added table "), b, F.lit(" ("), n, F.lit(" columns)"))),
        )
        .when(F.col("to").isNull(), _entry("table_dropped", _none(), _none(), _none(), F.concat(F.lit("dropped table "), a)))
        .otherwise(_entry("table_renamed", _none(), a, b, F.concat(F.lit("renamed table "), a, F.lit(ARROW), b)))
    )
    return sized.select(*SCOPE, F.coalesce(b, a).alias("table"), _none().alias("object_id"), change.alias("c")).select(
        *SCOPE, "table", "object_id", "c.*"
    )


def _described(side: str) -> Column:
    return column_description(F.col(f"{side}.type"), F.col(f"{side}.nullable"), F.col(f"{side}.default"))


def column_changes(frm: Catalog, to: Catalog, tables: DataFrame | None = None) -> DataFrame:
    """Changed properties of columns of common tables. Only changed columns go
    on to meet their table. `tables`: the aligned tables, where they are at hand."""
    pair = aligned_columns(frm, to)
    differs = lambda p: F.col(f"frm.{p}") != F.col(f"to.{p}")
    moved = F.col("frm").isNull() | F.col("to").isNull()
    for p in ("name", "type", "nullable", "default"):
        moved = moved | differs(p)
    named = lookup(pair.where(moved), common_tables(frm, to, tables), SCOPE, ["column_id"], salts=TABLE_SALTS)
    table, a, b = F.col("table"), F.col("frm.name"), F.col("to.name")
    dot = lambda c: F.concat(table, F.lit("."), c)
    step = lambda x, y: F.concat(x, F.lit(ARROW), y)
    null_a, null_b = nullability(F.col("frm.nullable")), nullability(F.col("to.nullable"))
    def_a, def_b = or_none(F.col("frm.default")), or_none(F.col("to.default"))
    both = F.array(
        F.when(differs("name"), _entry("column_renamed", b, a, b, F.concat(F.lit("renamed "), step(dot(a), b)))),
        F.when(
            differs("type"),
            _entry(
                "column_retyped",
                b,
                F.col("frm.type"),
                F.col("to.type"),
                F.concat(F.lit("changed type of "), dot(b), F.lit(": "), step(F.col("frm.type"), F.col("to.type"))),
            ),
        ),
        F.when(
            differs("nullable"),
            _entry("nullability_changed", b, null_a, null_b, F.concat(dot(b), F.lit(" is now "), null_b)),
        ),
        F.when(
            differs("default"),
            _entry(
                "default_changed",
                b,
                def_a,
                def_b,
                F.concat(F.lit("changed default of "), dot(b), F.lit(": "), step(def_a, def_b)),
            ),
        ),
    )
    added = _entry("column_added", b, _none(), _described("to"), F.concat(F.lit("added column "), dot(b), F.lit(" "), _described("to")))
    dropped = _entry("column_dropped", a, _described("frm"), _none(), F.concat(F.lit("dropped column "), dot(a)))
    changes = (
        F.when(F.col("frm").isNull(), F.array(added))
        .when(F.col("to").isNull(), F.array(dropped))
        .otherwise(F.array_compact(both))
    )
    return named.select(
        *SCOPE, "table", F.col("column_id").cast("string").alias("object_id"), F.explode(changes).alias("c")
    ).select(*SCOPE, "table", "object_id", "c.*")


def _member_pairs(frm: DataFrame, to: DataFrame, ident: str, canonical: Column, payload: list[str]) -> DataFrame:
    cols = ["canonical", *payload]
    pair = _pair(frm.withColumn("canonical", canonical), to.withColumn("canonical", canonical), [*SCOPE, ident], cols)
    same = F.col("frm.canonical").eqNullSafe(F.col("to.canonical")) & F.col("frm.name").eqNullSafe(F.col("to.name"))
    return pair.where(~F.coalesce(same, F.lit(False)))


def _sides(changed: DataFrame, ident: str, payload: list[str]) -> DataFrame:
    parts = [
        changed.where(F.col(s).isNotNull()).select(
            *SCOPE, ident, "table", *[F.col(f"{s}.{c}") for c in payload], F.lit(s).alias("side")
        )
        for s in SIDES
    ]
    return parts[0].unionByName(parts[1])


def _both(described: DataFrame, ident: str) -> DataFrame:
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return described.groupBy(*SCOPE, ident).agg(
        F.max("table").alias("table"),
        side("frm", "definition").alias("a"),
        side("to", "definition").alias("b"),
        side("frm", "name").alias("a_name"),
        side("to", "name").alias("b_name"),
    )


CONSTRAINT_FIELDS = ["name", "kind", "column_ids", "ref_table_id", "ref_column_ids", "on_delete", "on_update", "expr"]
INDEX_FIELDS = ["name", "columns", "is_unique", "method"]


def constraint_changes(frm: Catalog, to: Catalog, tables: DataFrame | None = None) -> DataFrame:
    """Definitions are compared as text resolved on the new side, so a renamed
    column never reads as a modified constraint. Text is only built where the
    ids differ."""
    changed = _member_pairs(frm.constraints, to.constraints, "constraint_id", canonical_constraint(), CONSTRAINT_FIELDS)
    scoped = lookup(changed, common_tables(frm, to, tables), SCOPE, ["constraint_id"], salts=TABLE_SALTS)
    described = describe_constraints(_sides(scoped, "constraint_id", CONSTRAINT_FIELDS), to, ["side"])
    pairs = _both(described, "constraint_id")
    a, b, on = F.col("a"), F.col("b"), F.concat(F.lit(" on "), F.col("table"))
    change = (
        F.when(a.isNull(), _entry("constraint_added", b, _none(), b, F.concat(F.lit("added "), b, on)))
        .when(b.isNull(), _entry("constraint_dropped", a, a, _none(), F.concat(F.lit("dropped "), a, on)))
        .when(
            a != b,
            _entry(
                "constraint_modified",
                b,
                a,
                b,
                F.concat(F.lit("changed constraint"), on, F.lit(": "), a, F.lit(ARROW), b),
            ),
        )
    )
    return _members(pairs, "constraint_id", change)


def index_changes(frm: Catalog, to: Catalog, tables: DataFrame | None = None) -> DataFrame:
    changed = _member_pairs(frm.indexes, to.indexes, "index_id", canonical_index(), INDEX_FIELDS)
    scoped = lookup(changed, common_tables(frm, to, tables), SCOPE, ["index_id"], salts=TABLE_SALTS)
    described = describe_indexes(_sides(scoped, "index_id", INDEX_FIELDS), to, ["side"])
    pairs = _both(described, "index_id")
    a, b, an, bn = F.col("a"), F.col("b"), F.col("a_name"), F.col("b_name")
    named = lambda n, d: F.concat(n, F.lit(" "), d)
    change = (
        F.when(a.isNull(), _entry("index_added", bn, _none(), b, F.concat(F.lit("added index "), named(bn, b))))
        .when(b.isNull(), _entry("index_dropped", an, a, _none(), F.concat(F.lit("dropped index "), an)))
        .when(
            (a != b) | (an != bn),
            _entry(
                "index_modified",
                bn,
                named(an, a),
                named(bn, b),
                F.concat(F.lit("changed index "), bn, F.lit(": "), a, F.lit(ARROW), b),
            ),
        )
    )
    return _members(pairs, "index_id", change)


def _members(pairs: DataFrame, ident: str, change: Column) -> DataFrame:
    return (
        pairs.select(*SCOPE, "table", F.col(ident).cast("string").alias("object_id"), change.alias("c"))
        .where(F.col("c").isNotNull())
        .select(*SCOPE, "table", "object_id", "c.*")
    )


def skipped_changes(frm: Catalog, to: Catalog) -> DataFrame:
    """Objects that are not compared: what they are as `object`, and how often their id stands on each side."""
    skipped = skipped_objects({"frm": frm, "to": to})
    change = _entry("", F.col("what"), F.col("n_frm"), F.col("n_to"), told(SIDES)).withField("kind", F.col("problem"))
    return skipped.select(*SCOPE, _none().alias("table"), "object_id", change.alias("c")).select(*SCOPE, "table", "object_id", "c.*")


def catalog_diff(frm: Catalog, to: Catalog) -> DataFrame:
    """Every semantic change from `frm` to `to`, for all projects, and the
    objects whose id is repeated or null.

    Tables are aligned once and written; what is in them is aligned once for
    each type of object."""
    return _diff(frm, to, cut(aligned_tables(frm, to)))


def _diff(frm: Catalog, to: Catalog, tables: DataFrame) -> DataFrame:
    parts = [f(frm, to, tables) for f in (table_changes, column_changes, constraint_changes, index_changes)]
    out = skipped_changes(frm, to)
    for p in parts:
        out = out.unionByName(p)
    return out.select(*OUT)


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def order_changes(changes: DataFrame) -> DataFrame:
    """Reading order: project, table, kind, object."""
    return changes.orderBy(PROJECT, "table", kind_rank(F.col("kind")), "object", "object_id")


def change_groups(changes: DataFrame) -> DataFrame:
    """`(project_id, table, sign, n)` with sign +, - or ~."""
    sign = F.when(F.col("kind").endswith("_added"), "+").when(F.col("kind").endswith("_dropped"), "-").otherwise("~")
    return changes.groupBy(PROJECT, "table", sign.alias("sign")).agg(F.count(F.lit(1)).alias("n"))


def catalog_diff_summary(frm: Catalog, to: Catalog) -> DataFrame:
    """Changes and unchanged objects per project. Unchanged are the objects on
    both sides less those with a change; a table counts when nothing in it
    changed."""
    tables = cut(aligned_tables(frm, to))
    changes = cut(_diff(frm, to, tables))
    common = common_tables(frm, to, tables).select(*SCOPE)
    kind_of = F.substring_index("kind", "_", 1)
    kind_of = F.when(kind_of.isin("nullability", "default"), "column").otherwise(kind_of)
    one = changes.select(
        *SCOPE,
        "object_id",
        kind_of.alias("what"),
        (F.col("kind").endswith("_added") | F.col("kind").endswith("_dropped")).alias("came_or_went"),
    )
    objects = one.where(F.col("object_id").isNotNull()).groupBy(*SCOPE, "what", "object_id").agg(F.max("came_or_went").alias("came_or_went"))
    ids = {"column": ("columns", "column_id"), "constraint": ("constraints", "constraint_id"), "index": ("indexes", "index_id")}
    # Everything that is counted as rows of (project, what is counted, how many), summed once.
    tally = lambda df, what, n=1: df.select(PROJECT, F.lit(what).alias("counted"), F.lit(n).cast("long").alias("n"))
    parts = [
        tally(frm.tables.unionByName(to.tables, allowMissingColumns=True), "n_changes", 0),
        tally(changes, "n_changes"),
        tally(common, "shared_table"),
        tally(one.select(*SCOPE).distinct().join(common, SCOPE, "left_semi"), "dirty"),
    ]
    touched = objects.where(~F.col("came_or_went"))
    parts.append(touched.select(PROJECT, F.concat(F.lit("touched_"), "what").alias("counted"), F.lit(1).cast("long").alias("n")))
    in_tables = [
        getattr(side, attr).select(*SCOPE, F.lit(what).alias("what"), F.col(ident).cast("string").alias("id"), F.lit(i).alias("side"))
        for what, (attr, ident) in ids.items()
        for i, side in enumerate((frm, to))
    ]
    held = reduce(DataFrame.unionByName, in_tables).groupBy(*SCOPE, "what", "id").agg(
        F.count_if(F.col("side") == 0).alias("n_frm"), F.count_if(F.col("side") == 1).alias("n_to")
    )
    per_table = held.where((F.col("n_frm") == 1) & (F.col("n_to") == 1)).groupBy(*SCOPE, "what").agg(F.count(F.lit(1)).alias("n"))
    per_table = per_table.join(common, SCOPE, "left_semi")
    parts.append(per_table.select(PROJECT, F.concat(F.lit("shared_"), "what").alias("counted"), "n"))
    names = ["n_changes", "shared_table", "dirty", *[f"{p}_{w}" for p in ("touched", "shared") for w in ids]]
    out = reduce(DataFrame.unionByName, parts).groupBy(PROJECT).agg(
        *[F.coalesce(F.sum(F.when(F.col("counted") == c, F.col("n"))), F.lit(0)).alias(c) for c in names]
    )
    same = {w: F.col(f"shared_{w}") - F.col(f"touched_{w}") for w in ids}
    same["table"] = F.col("shared_table") - F.col("dirty")
    return out.select(
        PROJECT,
        "n_changes",
        *[c.alias(f"unchanged_{w}s" if w != "index" else "unchanged_indexes") for w, c in same.items()],
        sum(same.values()).alias("unchanged"),
    )


def resolve_refs(commits: DataFrame, branches: DataFrame, pairs: DataFrame) -> DataFrame:
    """`(pair_id, from_commit, to_commit)`: each ref is a branch id or a commit
    id, branches first; null where it is neither."""
    heads = branches.select(F.col("branch_id").cast("string").alias("ref"), F.col("head_commit_id").alias("head"))
    known = commits.select(F.col("commit_id").cast("string").alias("ref"), F.col("commit_id").alias("self"))
    out = pairs
    for end in ("from", "to"):
        ref = f"{end}_ref"
        out = out.join(heads.withColumnRenamed("ref", ref), ref, "left").join(known.withColumnRenamed("ref", ref), ref, "left")
        out = out.withColumn(f"{end}_commit", F.coalesce("head", "self")).drop("head", "self")
    return out.select("pair_id", "from_commit", "to_commit")


def snapshots_at(snapshots: Catalog, wanted: DataFrame) -> Catalog:
    """Snapshots of `wanted(project_id, commit_id)` under their new project id.

    `snapshots` carry a `commit_id`; one commit may be wanted many times."""
    return snapshots.map(
        lambda df: df.drop(PROJECT).join(wanted, "commit_id").select(PROJECT, *[c for c in df.columns if c not in (PROJECT, "commit_id")])
    )


def diff_refs(snapshots: Catalog, commits: DataFrame, branches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changes of every `(pair_id, from_ref, to_ref)`; `project_id` of the
    result is the pair."""
    ends = resolve_refs(commits, branches, pairs).where(F.col("from_commit").isNotNull() & F.col("to_commit").isNotNull())
    frm = snapshots_at(snapshots, ends.select(F.col("pair_id").alias(PROJECT), F.col("from_commit").alias("commit_id")))
    to = snapshots_at(snapshots, ends.select(F.col("pair_id").alias(PROJECT), F.col("to_commit").alias("commit_id")))
    return catalog_diff(frm, to)


def history_diff(snapshots: Catalog, commits: DataFrame) -> DataFrame:
    """Changes of every commit against its first parent; `project_id` of the
    result is the commit."""
    linked = commits.where(F.col("parent_id").isNotNull())
    frm = snapshots_at(snapshots, linked.select(F.col("commit_id").alias(PROJECT), F.col("parent_id").alias("commit_id")))
    to = snapshots_at(snapshots, linked.select(F.col("commit_id").alias(PROJECT), "commit_id"))
    return catalog_diff(frm, to)
