"""Three-way merge of fleets of schemas.

Tables decide first: a table both sides kept is merged property by property, a
table only one side has brings its objects along unchanged, a dropped table
takes them away. Columns, constraints and indexes then share the cell merge of
`merge`, each in its own table, and names are checked on the merged result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import any_of, key_text, rows_same
from palimpsest.functions.types import parse_type
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
    typed_columns,
)
from palimpsest.operators.catalog_checks import check_catalog
from palimpsest.operators.collisions import collisions, first_holders, resolve_collisions
from palimpsest.operators.merge import (
    SIDES,
    Merge,
    Naming,
    apply_merge,
    final_resolutions,
    gate,
    resolution_problems,
    usable_answers,
)
from palimpsest.operators.spread import lookup, number_within
from palimpsest.session import cut

TABLES = Naming("table_existence", "table_addition", {"name": ("rename_rename", "table_name", True)})
COLUMNS = Naming(
    "column_existence",
    "column_addition",
    {
        "name": ("rename_rename", "column_name", True),
        "type": ("retype_retype", "column_type", True),
        "nullable": ("null_null", "column_nullable", False),
        "default": ("default_default", "column_default", True),
    },
)
CONSTRAINTS = Naming(
    "constraint_existence",
    "constraint_addition",
    {
        "definition": ("constraint_constraint", "constraint", False),
        "name": ("rename_rename", "constraint_name", True),
    },
)
INDEXES = Naming(
    "index_existence",
    "index_addition",
    {"definition": ("index_index", "index", False), "name": ("rename_rename", "index_name", True)},
)
CONFLICT = [
    PROJECT,
    TABLE,
    "object_id",
    "conflict_id",
    "class",
    "property",
    "base_value",
    "ours_value",
    "theirs_value",
    "allow_custom",
]
COLUMN_PROPS = ["name", "type", "nullable", "default"]
CONSTRAINT_PAYLOAD = ["kind", "column_ids", "ref_table_id", "ref_column_ids", "on_delete", "on_update", "expr", "ordinal"]
INDEX_PAYLOAD = ["columns", "is_unique", "method", "ordinal"]


@dataclass(frozen=True)
class CatalogMerge:
    merged: Catalog
    conflicts: DataFrame  # still open
    resolution_problems: DataFrame
    skipped: DataFrame  # objects whose id is repeated or null on a side, which are not merged

    def problems(self) -> DataFrame:
        """`(project_id, code, table, object, message)` of the merged catalog and of what is left out of it."""
        left_out = self.skipped.select(
            PROJECT,
            F.col("problem").alias("code"),
            F.col(TABLE).cast("string").alias("table"),
            F.col("object_id").alias("object"),
            told(SIDES).alias("message"),
        )
        return check_catalog(self.merged).unionByName(left_out)

    def gate(self, projects: DataFrame) -> DataFrame:
        """One decision per project."""
        return gate(self.conflicts, self.problems(), projects, PROJECT)


def _triple(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return unique_only(align({"base": base, "ours": ours, "theirs": theirs}, key, cols), SIDES)


def _moved(a: str, b: str, cols: Sequence[str], aligned: DataFrame) -> Column:
    """One of the two is missing, or they differ."""
    one = F.col(a).isNull() != F.col(b).isNull()
    differ = F.col(a).isNotNull() & F.col(b).isNotNull() & ~rows_same(a, b, cols, aligned.schema[a].dataType)
    return one | differ


def _touched(aligned: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Tables whose objects of this kind changed on a side."""
    marks = aligned.select(
        *SCOPE, _moved("base", "ours", cols, aligned).alias("by_ours"), _moved("base", "theirs", cols, aligned).alias("by_theirs")
    )
    return marks.where(F.col("by_ours") | F.col("by_theirs"))


def _tables(base: Catalog, ours: Catalog, theirs: Catalog, children: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Aligned tables with `modified_*`: changed in any way against the base."""
    aligned = _triple(base.tables, ours.tables, theirs.tables, SCOPE, ["name", "ordinal"])
    marks = None
    for child, cols in children:
        marks = _touched(child, cols) if marks is None else marks.unionByName(_touched(child, cols))
    per_table = marks.groupBy(*SCOPE).agg(F.max("by_ours").alias("by_ours"), F.max("by_theirs").alias("by_theirs"))
    joined = aligned.join(per_table, SCOPE, "left")
    flag = lambda side: F.coalesce(F.col(f"by_{side}"), F.lit(False)) | (
        F.coalesce(F.col(f"{side}.name") != F.col("base.name"), F.lit(False))
    )
    return joined.withColumns({"modified_ours": flag("ours"), "modified_theirs": flag("theirs")}).drop("by_ours", "by_theirs")


def _table_existence(tables: DataFrame) -> DataFrame:
    """delete/modify conflicts of whole tables."""
    b, o, t = (F.col(s).isNotNull() for s in SIDES)
    ident = F.concat(F.lit("table_existence:"), key_text(SCOPE, tables.schema))
    ours_gone = b & ~o & t & F.col("modified_theirs")
    theirs_gone = b & o & ~t & F.col("modified_ours")
    kept = lambda side: F.concat(F.lit("modified ("), F.col(f"{side}.name"), F.lit(")"))
    rows = tables.where(ours_gone | theirs_gone)
    return rows.select(
        *SCOPE,
        ident.alias("conflict_id"),
        F.lit("delete_modify").alias("class"),
        F.lit("existence").alias("property"),
        F.lit("exists").alias("base_value"),
        F.when(o, kept("ours")).otherwise("dropped").alias("ours_value"),
        F.when(t, kept("theirs")).otherwise("dropped").alias("theirs_value"),
        F.lit(False).alias("allow_custom"),
    )


def _table_modes(tables: DataFrame, answered: DataFrame | None) -> DataFrame:
    """`(project_id, table_id, mode)`: merge, ours, theirs or gone."""
    b, o, t = (F.col(s).isNotNull() for s in SIDES)
    if answered is None:
        staged = tables.withColumn("choice", F.lit(None).cast("string"))
    else:
        staged = tables.join(answered.select(*SCOPE, "choice"), SCOPE, "left")
    theirs = F.coalesce(F.col("choice") == "theirs", F.lit(False))
    mode = (
        F.when(b & o & t | ~b & o & t, "merge")
        .when(~b & o, "ours")
        .when(~b & t, "theirs")
        .when(b & ~o & t & F.col("modified_theirs") & theirs, "theirs")
        .when(b & o & ~t & F.col("modified_ours") & ~theirs, "ours")
        .otherwise("gone")
    )
    return staged.select(*SCOPE, "base", "ours", "theirs", mode.alias("mode"))


def _under_tables(children: DataFrame, modes: DataFrame, ident: str) -> DataFrame:
    """Children as their table decides: all sides alike where one side's table
    is taken whole, and none where the table is gone."""
    exceptions = modes.where(F.col("mode") != "merge").select(*SCOPE, "mode")
    marked = lookup(children, exceptions, SCOPE, [ident], "left", TABLE_SALTS)
    mode = F.coalesce("mode", F.lit("merge"))
    taken = marked.where(mode != "gone")
    sides = {s: F.when(mode == "merge", F.col(s)).when(mode == "ours", F.col("ours")).otherwise(F.col("theirs")) for s in SIDES}
    return taken.select(*SCOPE, ident, *[c.alias(s) for s, c in sides.items()]).where(
        any_of([F.col(s).isNotNull() for s in SIDES])
    )


def _ordinal(field: str) -> Column:
    return F.coalesce(F.col(f"base.{field}"), F.col(f"ours.{field}"), F.col(f"theirs.{field}")).alias("ordinal_of")


def _objects(conflicts: DataFrame, ident: str | None) -> DataFrame:
    obj = F.col(ident).cast("string") if ident else F.lit(None).cast("string")
    return conflicts.withColumn("object_id", obj).select(*CONFLICT)


def _payload(side_of: Column, fields: Sequence[str]) -> list[Column]:
    """Fields of the side whose definition was chosen."""
    return [
        F.when(side_of == "ours", F.col(f"ours.{f}"))
        .when(side_of == "theirs", F.col(f"theirs.{f}"))
        .otherwise(F.col(f"base.{f}"))
        .alias(f)
        for f in fields
    ]


def _members(aligned: DataFrame, ident: str, naming: Naming, fields: list[str], answers: DataFrame | None) -> Merge:
    """Merge constraints or indexes by definition and name."""
    keep = ["base", "ours", "theirs", "ordinal_of"]
    merge = apply_merge(
        aligned.withColumn("ordinal_of", _ordinal("ordinal")), [*SCOPE, ident], ["definition", "name"], answers, naming, keep
    )
    chosen = F.col("definition")
    side_of = (
        F.when(chosen.eqNullSafe(F.col("ours.definition")), "ours")
        .when(chosen.eqNullSafe(F.col("theirs.definition")), "theirs")
        .otherwise("base")
    )
    rows = merge.merged.select(*SCOPE, ident, "name", "definition", "origin", "ordinal_of", *_payload(side_of, fields))
    return Merge(rows, merge.conflicts, merge.resolution_problems, merge.key, merge.cols)


def _once(rows: DataFrame) -> DataFrame:
    """One constraint per definition and table: the first in merged order."""
    key, scope, order = ["constraint_id"], [*SCOPE, "definition"], ["origin", "ordinal_of"]
    held = first_holders(rows, scope, key, order)
    later = lookup(rows, held, scope, key, salts=4).where(F.struct(*key) != F.col("_first"))
    return rows.join(later.select(*SCOPE, *key), [*SCOPE, *key], "left_anti")


def _key_pairs(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Tables that gained two primary keys where the base has none."""
    keys = rows.where(F.col("kind") == "primary_key")
    order = F.struct("origin", "ordinal_of", "constraint_id")
    first = keys.groupBy(*SCOPE).agg(F.min(order).alias("o"), F.min_by("definition", order).alias("first_def"))
    rest = keys.join(first, SCOPE).where(order != F.col("o"))
    second = rest.groupBy(*SCOPE, F.col("o.constraint_id").alias("first_id"), "first_def").agg(
        F.min_by("constraint_id", order).alias("second_id"), F.min_by("definition", order).alias("second_def")
    )
    had = base.where(F.col("kind") == "primary_key").select(*SCOPE)
    pairs = second.join(had, SCOPE, "left_anti")
    return pairs.select(
        *SCOPE,
        "first_id",
        "second_id",
        F.concat(F.lit("pk:"), key_text(SCOPE, rows.schema)).alias("conflict_id"),
        F.lit("pk_pk").alias("class"),
        F.lit("primary_key").alias("property"),
        F.lit("none").alias("base_value"),
        F.col("first_def").alias("ours_value"),
        F.col("second_def").alias("theirs_value"),
        F.lit(False).alias("allow_custom"),
    )


def _one_key(rows: DataFrame, base: DataFrame, answers: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(rows, open conflicts, all conflicts)`; the first key stays unless theirs."""
    pairs = _key_pairs(rows, base)
    if answers is None:
        losers, still = pairs.select(*SCOPE, F.col("second_id").alias("constraint_id")), pairs
    else:
        answered = usable_answers(pairs, answers).select(*SCOPE, "choice")
        judged = pairs.join(answered, SCOPE, "left")
        loser = F.when(F.col("choice") == "theirs", F.col("first_id")).otherwise(F.col("second_id"))
        losers = judged.select(*SCOPE, loser.alias("constraint_id"))
        still = judged.where(F.col("choice").isNull())
    kept = rows.join(losers, [*SCOPE, "constraint_id"], "left_anti")
    return kept, _objects(still, "first_id"), _objects(pairs, "first_id")


def _collision_conflicts(found: DataFrame, ident: str, described: Column, what: str) -> DataFrame:
    return found.select(
        PROJECT,
        TABLE,
        F.col(ident).cast("string").alias("object_id"),
        "conflict_id",
        F.lit("name_collision").alias("class"),
        F.lit("name").alias("property"),
        F.concat(F.lit(f"no {what} named "), F.col("name")).alias("base_value"),
        F.col("first")[ident].cast("string").alias("ours_value"),
        described.alias("theirs_value"),
        F.lit(True).alias("allow_custom"),
    )


_NAMES = {
    "table": ([PROJECT, "name"], [PROJECT, TABLE], TABLE),
    "column": ([*SCOPE, "name"], [*SCOPE, "column_id"], "column_id"),
    "index": ([PROJECT, "name"], [*SCOPE, "index_id"], "index_id"),
}
_ORDER = ["origin", "ordinal_of"]


def _settle_names(rows: DataFrame, what: str, answers: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(rows, open conflicts, all conflicts)` of one kind of name."""
    scope, key, ident = _NAMES[what]
    found = collisions(rows, scope, key, _ORDER)
    every = _collision_conflicts(found, ident, F.col(ident).cast("string"), what)
    if answers is None:
        return rows, every, every
    kept, still = resolve_collisions(rows, scope, "name", key, _ORDER, answers)
    return kept, _collision_conflicts(still, ident, F.col(ident).cast("string"), what), every


def name_collisions(merged: Catalog) -> DataFrame:
    """Names taken twice in a catalog: tables and indexes in a project, columns
    in a table."""
    origin = F.lit(0).cast("tinyint").alias("origin")
    parts = []
    for what, df, order in (
        ("table", merged.tables, "ordinal"),
        ("column", merged.columns, "position"),
        ("index", merged.indexes, "ordinal"),
    ):
        rows = df.select("*", origin, F.col(order).alias("ordinal_of"))
        parts.append(_settle_names(rows, what, None)[1].withColumn("scope", F.lit(what)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def merge_catalogs(base: Catalog, ours: Catalog, theirs: Catalog, resolutions: DataFrame | None = None) -> CatalogMerge:
    """Merge every project of three fleets; `resolutions(conflict_id, choice,
    custom)` answer conflicts by their stable ids."""
    answers = resolutions
    columns = _triple(
        *[plain_columns(c.columns) for c in (base, ours, theirs)], [*SCOPE, "column_id"], [*COLUMN_PROPS, "position"]
    )
    constraints = _triple(
        *[c.constraints.withColumn("definition", canonical_constraint()) for c in (base, ours, theirs)],
        [*SCOPE, "constraint_id"],
        ["definition", "name", *CONSTRAINT_PAYLOAD],
    )
    indexes = _triple(
        *[c.indexes.withColumn("definition", canonical_index()) for c in (base, ours, theirs)],
        [*SCOPE, "index_id"],
        ["definition", "name", *INDEX_PAYLOAD],
    )
    # Each alignment is used for the table marks and for its own merge.
    columns, constraints, indexes = cut(columns), cut(constraints), cut(indexes)
    member = ["definition", "name"]
    tables = cut(_tables(base, ours, theirs, [(columns, COLUMN_PROPS), (constraints, ["definition"]), (indexes, member)]))

    existence = _table_existence(tables)
    answered = None if answers is None else usable_answers(existence, answers)
    modes = cut(_table_modes(tables, answered))
    open_existence = existence if answered is None else existence.join(answered.select("conflict_id"), "conflict_id", "left_anti")

    def whole(s: str) -> Column:
        return F.when(F.col("mode") == "merge", F.col(s)).when(F.col("mode") == "ours", F.col("ours")).otherwise(F.col("theirs"))

    alive = modes.where(F.col("mode") != "gone").select(
        *SCOPE,
        *[whole(s).alias(s) for s in SIDES],
        # Order and origin are those of the real versions.
        F.when(F.col("base").isNotNull(), 0).when(F.col("ours").isNotNull(), 1).otherwise(2).cast("tinyint").alias("origin_of"),
        _ordinal("ordinal"),
    )
    t = apply_merge(alive, SCOPE, ["name"], answers, TABLES, ["origin_of", "ordinal_of"])
    table_rows = t.merged.select(*SCOPE, "name", F.col("origin_of").alias("origin"), "ordinal_of")

    under = lambda df, ident: _under_tables(df, modes, ident)
    c = apply_merge(
        under(columns, "column_id").withColumn("ordinal_of", _ordinal("position")),
        [*SCOPE, "column_id"],
        COLUMN_PROPS,
        _type_checked(answers),
        COLUMNS,
        ["ordinal_of"],
    )
    k = _members(under(constraints, "constraint_id"), "constraint_id", CONSTRAINTS, CONSTRAINT_PAYLOAD, answers)
    x = _members(under(indexes, "index_id"), "index_id", INDEXES, INDEX_PAYLOAD, answers)
    unique, pk_open, pk_all = _one_key(cut(_once(k.merged)), base.constraints, answers)

    table_rows, tables_open, tables_all = _settle_names(cut(table_rows), "table", answers)
    table_rows = table_rows if answers is None else cut(table_rows)
    inside = lambda df: df if answers is None else df.join(table_rows.select(*SCOPE), SCOPE, "left_semi")
    column_rows, columns_open, columns_all = _settle_names(cut(inside(c.merged)), "column", answers)
    index_rows, indexes_open, indexes_all = _settle_names(cut(inside(x.merged)), "index", answers)

    conflicts = _objects(open_existence, None)
    for part, ident in ((t.conflicts, None), (c.conflicts, "column_id"), (k.conflicts, "constraint_id"), (x.conflicts, "index_id")):
        conflicts = conflicts.unionByName(_objects(part, ident))
    for part in (pk_open, tables_open, columns_open, indexes_open):
        conflicts = conflicts.unionByName(part)

    merged = Catalog(
        number_within(table_rows, [PROJECT], "ordinal_of", "ordinal", leading=["origin"], tie=[TABLE]).select(
            *SCOPE, "name", "ordinal"
        ),
        typed_columns(
            number_within(column_rows, SCOPE, "ordinal_of", "position", leading=["origin"], tie=["column_id"]).select(
                *SCOPE, "column_id", *COLUMN_PROPS, "position"
            )
        ),
        _renumbered(inside(unique), "constraint_id", [f for f in CONSTRAINT_PAYLOAD if f != "ordinal"]),
        _renumbered(index_rows, "index_id", [f for f in INDEX_PAYLOAD if f != "ordinal"]),
    )
    if answers is None:
        problems = t.resolution_problems
    else:
        every = _objects(existence, None)
        for part in (pk_all, tables_all, columns_all, indexes_all):
            every = every.unionByName(part)
        problems = _answer_problems([every], [(t, TABLES), (c, COLUMNS), (k, CONSTRAINTS), (x, INDEXES)], answers)
    skipped = skipped_objects({"base": base, "ours": ours, "theirs": theirs})
    return CatalogMerge(merged, conflicts, problems, skipped)


def shown_conflicts(conflicts: DataFrame, base: Catalog, ours: Catalog, theirs: Catalog) -> DataFrame:
    """Conflicts with definitions in names, each side in its own: only the
    constraints and indexes that are in conflict are described."""
    out = conflicts
    for attr, ident, describe in (
        ("constraints", "constraint_id", describe_constraints),
        ("indexes", "index_id", describe_indexes),
    ):
        prefix = "constraint:" if attr == "constraints" else "index:"
        mine = F.col("conflict_id").startswith(prefix)
        wanted = conflicts.where(mine).select(*SCOPE, "object_id")
        for side, cat in zip(SIDES, (base, ours, theirs)):
            rows = getattr(cat, attr)
            some = rows.withColumn("object_id", F.col(ident).cast("string")).join(wanted, [*SCOPE, "object_id"], "left_semi")
            told = describe(some.select(*rows.columns), cat).select(
                *SCOPE, F.col(ident).cast("string").alias("object_id"), F.col("definition").alias("_told")
            )
            # Spark takes what is described for the conflicts it comes from, six times over: exchanged
            joined = out.join(told.hint("merge"), [*SCOPE, "object_id"], "left")
            value = F.when(mine, F.coalesce("_told", f"{side}_value")).otherwise(F.col(f"{side}_value"))
            out = joined.withColumn(f"{side}_value", value).select(*conflicts.columns)
    return out


def _renumbered(rows: DataFrame, ident: str, fields: list[str]) -> DataFrame:
    numbered = number_within(rows, SCOPE, "ordinal_of", "place", leading=["origin"], tie=[ident])
    return numbered.select(*SCOPE, ident, "name", *fields, F.col("place").alias("ordinal"))


def _type_checked(answers: DataFrame | None) -> DataFrame | None:
    """A custom type that does not parse counts as blank."""
    if answers is None:
        return None
    wrong = F.col("conflict_id").startswith("column_type:") & (F.col("choice") == "custom") & parse_type(F.col("custom")).isNull()
    return answers.withColumn("custom", F.when(wrong, "").otherwise(F.col("custom")))


def _answer_problems(
    conflict_sets: list[DataFrame], merges: list[tuple[Merge, Naming]], answers: DataFrame
) -> DataFrame:
    """Answers that are wrong for the conflict they name, or name none. The
    properties met by each merge carry their own report; here an answer is
    unknown only when every part says so."""
    reports = [resolution_problems(c, answers) for c in conflict_sets] + [m.resolution_problems for m, _ in merges]
    parts = len(reports)
    union = reports[0]
    for r in reports[1:]:
        union = union.unionByName(r)
    counted = union.groupBy("conflict_id", "problem", "severity").agg(F.count(F.lit(1)).alias("n"))
    typed = answers.where(
        F.col("conflict_id").startswith("column_type:") & (F.col("choice") == "custom") & parse_type(F.col("custom")).isNull()
    )
    unparsable = final_resolutions(typed).select(
        "conflict_id", F.lit("unparsable_custom").alias("problem"), F.lit("error").alias("severity")
    )
    real = counted.where((F.col("problem") != "unknown_conflict") | (F.col("n") == parts)).drop("n")
    real = real.join(unparsable.select("conflict_id"), "conflict_id", "left_anti").unionByName(unparsable)
    return real.select("conflict_id", "problem", "severity")
