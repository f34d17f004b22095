"""Three-way merge of a keyed table, cell by cell.

Conflicts are all collected in one pass; until they are answered the merged
rows carry our value and are marked provisional. `gate` decides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.cells import (
    ABSENT,
    any_of,
    comparable,
    diverged,
    key_text,
    row_text,
    rows_same,
    text,
    three_way,
)
from palimpsest.functions.words import has_text
from palimpsest.operators.align import align, by_side, key_problems, skipped_keys, unique_only
from palimpsest.operators.diff import diff_cells
from palimpsest.session import cut

SIDES = ("base", "ours", "theirs")
CHOICES = ("ours", "theirs", "custom")


@dataclass(frozen=True)
class Naming:
    """How conflicts of one kind of object are named.

    `cells` gives `(class, id prefix, accepts custom)` per property.
    """

    existence: str = "row_existence"
    addition: str = "row_addition"
    cells: Mapping[str, tuple[str, str, bool]] = field(default_factory=dict)

    def cell(self, col: str) -> tuple[str, str, bool]:
        return self.cells.get(col, ("cell_cell", f"cell:{col}", True))


ROWS = Naming()


@dataclass(frozen=True)
class Merge:
    """A merge attempt. Every field is a lazy DataFrame."""

    merged: DataFrame
    conflicts: DataFrame  # still open
    resolution_problems: DataFrame
    key: tuple[str, ...]
    cols: tuple[str, ...]
    key_problems: DataFrame | None = None  # rows that could not take part: their key is repeated or null

    def gate(self, problems: DataFrame | None = None, merges: DataFrame | None = None, by: str = "merge_id") -> DataFrame:
        """The decision on this merge; key problems always count, `problems` are further ones."""
        names = [by] if merges is not None else []
        found = [df.select(*names, F.lit(1).alias("_")) for df in (self.key_problems, problems) if df is not None]
        none = self.conflicts.where(F.lit(False)).select(*names, F.lit(1).alias("_"))
        return gate(self.conflicts, reduce(DataFrame.unionByName, found, none), merges, by)


def align3(
    base: DataFrame,
    ours: DataFrame,
    theirs: DataFrame,
    key: Sequence[str],
    cols: Sequence[str],
    *,
    changed_only: bool = False,
    keys_checked: bool = False,
) -> DataFrame:
    sides = {"base": base, "ours": ours, "theirs": theirs}
    return unique_only(align(sides, key, cols, changed_only=changed_only, keys_checked=keys_checked), SIDES)


def merge_key_problems(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Repeated or null keys of the three sides; such rows are never merged."""
    return key_problems({"base": base, "ours": ours, "theirs": theirs}, key)


def _cell(side: str, col: str, dtype: T.DataType) -> Column:
    return comparable(F.col(f"{side}.`{col}`"), dtype)


def _conflict(cls: str, ident: Column, prop: str, base, ours, theirs, custom: bool) -> Column:
    return F.struct(
        ident.alias("conflict_id"),
        F.lit(cls).alias("class"),
        F.lit(prop).alias("property"),
        base.alias("base_value"),
        ours.alias("ours_value"),
        theirs.alias("theirs_value"),
        F.lit(custom).alias("allow_custom"),
    )


def _presence() -> tuple[Column, Column, Column]:
    return tuple(F.col(s).isNotNull() for s in SIDES)


def _cell_diverged(col: str, dtype: T.DataType) -> Column:
    b, o, t = _presence()
    return b & o & t & diverged(*[_cell(s, col, dtype) for s in SIDES])


def _modified_after_drop(cols: Sequence[str], schema: T.StructType) -> tuple[Column, Column]:
    """(ours dropped and theirs modified, theirs dropped and ours modified)."""
    b, o, t = _presence()
    return (
        b & ~o & t & ~rows_same("base", "theirs", cols, schema),
        b & o & ~t & ~rows_same("base", "ours", cols, schema),
    )


def _added_apart(cols: Sequence[str], schema: T.StructType) -> Column:
    b, o, t = _presence()
    return ~b & o & t & ~rows_same("ours", "theirs", cols, schema)


def all_conflicts(aligned: DataFrame, key: Sequence[str], cols: Sequence[str], naming: Naming = ROWS) -> DataFrame:
    """Every conflict of an aligned triple, answered or not."""
    schema = aligned.schema["ours"].dataType
    ident = key_text(key, aligned.schema)
    named = lambda prefix: F.concat(F.lit(f"{prefix}:"), ident)
    ours_gone, theirs_gone = _modified_after_drop(cols, schema)
    found = []
    for c in cols:
        dtype = schema[c].dataType
        cls, prefix, custom = naming.cell(c)
        values = [text(F.col(f"{s}.`{c}`"), dtype) for s in SIDES]
        found.append(F.when(_cell_diverged(c, dtype), _conflict(cls, named(prefix), c, *values, custom)))
    gone, kept = F.lit("dropped"), F.lit("modified")
    exists = F.lit("exists")
    existence = named(naming.existence)
    found.append(
        F.when(ours_gone, _conflict("delete_modify", existence, "existence", exists, gone, kept, False))
    )
    found.append(
        F.when(theirs_gone, _conflict("delete_modify", existence, "existence", exists, kept, gone, False))
    )
    found.append(
        F.when(
            _added_apart(cols, schema),
            _conflict(
                "add_add",
                named(naming.addition),
                "row",
                F.lit(ABSENT),
                row_text("ours", cols, schema),
                row_text("theirs", cols, schema),
                False,
            ),
        )
    )
    exploded = aligned.select(*key, F.explode(F.array_compact(F.array(*found))).alias("c"))
    return exploded.select(*key, "c.*")


def final_resolutions(resolutions: DataFrame) -> DataFrame:
    """One answer per conflict id: the last by `seq` where that column exists."""
    order = [F.col("seq")] if "seq" in resolutions.columns else []
    order += [F.col("choice"), F.coalesce("custom", F.lit(""))]
    last = F.max_by(F.struct("choice", "custom"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return (
        resolutions.groupBy("conflict_id")
        .agg(last.alias("r"), F.count(F.lit(1)).alias("n_answers"))
        .select("conflict_id", "r.choice", "r.custom", "n_answers")
    )


def answer_problem(cls_cols: DataFrame, dtypes: Mapping[str, T.DataType]) -> Column:
    """Why an answer cannot be used; null when it can."""
    unparsable = any_of(
        [
            (F.col("property") == c) & F.col("custom").try_cast(d).isNull()
            for c, d in dtypes.items()
            if not isinstance(d, (T.StringType, T.StructType, T.ArrayType, T.MapType))
        ]
    )
    return (
        F.when(F.col("choice").isNull() | ~F.col("choice").isin(*CHOICES), "unknown_choice")
        .when((F.col("choice") == "custom") & ~has_text(F.col("custom")), "blank_custom")
        .when((F.col("choice") == "custom") & (F.col("allow_custom") == F.lit(False)), "custom_not_accepted")
        .when((F.col("choice") == "custom") & unparsable, "unparsable_custom")
    )


def resolution_problems(
    conflicts: DataFrame, resolutions: DataFrame, dtypes: Mapping[str, T.DataType] | None = None
) -> DataFrame:
    """`(conflict_id, problem, severity)`: answers that are wrong, refer to no
    conflict, or are given more than once."""
    answers = final_resolutions(resolutions)
    known = conflicts.select("conflict_id", "property", "allow_custom")
    joined = answers.join(known, "conflict_id", "left").withColumn("wrong", answer_problem(conflicts, dtypes or {}))
    row = lambda code, severity: F.struct(F.lit(code).alias("problem"), F.lit(severity).alias("severity"))
    notes = F.array_compact(
        F.array(
            F.when(F.col("wrong").isNotNull(), F.struct(F.col("wrong").alias("problem"), F.lit("error").alias("severity"))),
            F.when(F.col("property").isNull(), row("unknown_conflict", "warning")),
            F.when(F.col("n_answers") > 1, row("repeated_answer", "warning")),
        )
    )
    return joined.select("conflict_id", F.explode(notes).alias("n")).select("conflict_id", "n.*")


def usable_answers(
    conflicts: DataFrame, resolutions: DataFrame, dtypes: Mapping[str, T.DataType] | None = None
) -> DataFrame:
    """Conflicts with a valid answer: all conflict columns, `choice`, `custom`."""
    joined = conflicts.join(final_resolutions(resolutions).drop("n_answers"), "conflict_id")
    return joined.where(answer_problem(conflicts, dtypes or {}).isNull())


KEY_PART = r"((?:[^:\\]|\\.)*)"  # one key column inside a conflict id


def answers_by_key(
    resolutions: DataFrame,
    schema: T.StructType,
    key: Sequence[str],
    dtypes: Mapping[str, T.DataType],
    naming: Naming = ROWS,
) -> DataFrame:
    """`(key…, conflict_id, property, choice, custom)` of the answers that can be
    used, read from their conflict ids.

    An id holds the property and the key, so answers meet the aligned rows on
    the key these are already grouped by, and the rows need not be aligned a
    second time to find the conflicts first.
    """
    named = [(naming.cell(c)[1], c, naming.cell(c)[2]) for c in dtypes]
    named += [(naming.existence, "existence", False), (naming.addition, "row", False)]
    prop, custom, rest = F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for prefix, name, accepts in sorted(named, key=lambda n: len(n[0])):
        mine = F.col("conflict_id").startswith(f"{prefix}:")
        prop = F.when(mine, name).otherwise(prop)
        custom = F.when(mine, F.lit(accepts)).otherwise(custom)
        rest = F.when(mine, F.substr("conflict_id", F.lit(len(prefix) + 2))).otherwise(rest)
    final = final_resolutions(resolutions).withColumns({"property": prop, "allow_custom": custom, "_rest": rest})
    usable = final.where(F.col("property").isNotNull() & answer_problem(final, dtypes).isNull())
    # an empty match may follow the last part
    cut_up = usable.withColumn("_parts", F.regexp_extract_all("_rest", F.lit(KEY_PART + "(?::|$)"), F.lit(1)))
    parts = []
    for i, k in enumerate(key):
        part = F.regexp_replace(F.get("_parts", F.lit(i)), r"\\(.)", "$1")
        parts.append(part.try_cast(schema[k].dataType).alias(k))
    parsed = cut_up.where(F.size("_parts") >= len(key)).select(*parts, "conflict_id", "property", "choice", "custom", "_rest")
    # an id that only parses like a conflict's id ("01" for 1) is not that id
    return parsed.where(key_text(key, schema) == F.col("_rest")).drop("_rest")


def apply_merge(
    aligned: DataFrame,
    key: Sequence[str],
    cols: Sequence[str],
    resolutions: DataFrame | None = None,
    naming: Naming = ROWS,
    keep: Sequence[str] = (),
) -> Merge:
    """Merge an aligned triple; `keep` passes columns of `aligned` through."""
    spark = aligned.sparkSession
    key, cols = list(key), list(cols)
    schema = aligned.schema["ours"].dataType
    dtypes = {c: schema[c].dataType for c in cols}
    conflicts = all_conflicts(aligned, key, cols, naming)
    no_problems = spark.createDataFrame([], "conflict_id string, problem string, severity string")
    if resolutions is None:
        picks_type = "map<string,struct<choice:string,custom:string>>"
        staged = aligned.withColumn("_picks", F.lit(None).cast(picks_type))
        still_open, problems = conflicts, no_problems
    else:
        answers = answers_by_key(resolutions, aligned.schema, key, dtypes, naming)
        entry = F.struct("property", F.struct("choice", "custom"))
        picks = answers.groupBy(*key).agg(F.map_from_entries(F.collect_list(entry)).alias("_picks"))
        staged = aligned.join(picks, key, "left")
        still_open = conflicts.join(answers.select("conflict_id"), "conflict_id", "left_anti").select(*conflicts.columns)
        problems = resolution_problems(conflicts, resolutions, dtypes)
    return Merge(_merged(staged, key, cols, schema, keep), still_open, problems, tuple(key), tuple(cols))


def _merged(
    staged: DataFrame, key: list[str], cols: list[str], schema: T.StructType, keep: Sequence[str]
) -> DataFrame:
    b, o, t = _presence()
    pick = lambda prop: F.col("_picks")[prop]["choice"]
    ours_gone, theirs_gone = _modified_after_drop(cols, schema)
    ours_gone, theirs_gone = F.coalesce(ours_gone, F.lit(False)), F.coalesce(theirs_gone, F.lit(False))
    apart = F.coalesce(_added_apart(cols, schema), F.lit(False))
    keep_theirs = ours_gone & (F.coalesce(pick("existence"), F.lit("")) == "theirs")
    keep_ours = theirs_gone & (F.coalesce(pick("existence"), F.lit("ours")) != "theirs")
    row_from = (
        F.when(b & o & t, "both")
        .when(~b & o & t & apart & (F.coalesce(pick("row"), F.lit("")) == "theirs"), "theirs")
        .when(~b & o, "ours")
        .when(~b & t, "theirs")
        .when(keep_theirs, "theirs")
        .when(keep_ours, "ours")
    )
    unanswered = (
        (ours_gone | theirs_gone) & pick("existence").isNull() | apart & pick("row").isNull()
    )
    values = []
    for c in cols:
        dtype = schema[c].dataType
        base, ours, theirs = (F.col(f"{s}.`{c}`") for s in SIDES)
        split = _cell_diverged(c, dtype)
        unanswered = unanswered | (F.coalesce(split, F.lit(False)) & pick(c).isNull())
        if isinstance(dtype, T.MapType):
            plain = F.when(_cell("base", c, dtype).eqNullSafe(_cell("ours", c, dtype)), theirs).otherwise(ours)
        else:
            plain = three_way(base, ours, theirs)
        chosen = F.when(pick(c) == "theirs", theirs)
        if not isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
            chosen = chosen.when(pick(c) == "custom", F.col("_picks")[c]["custom"].try_cast(dtype))
        both = F.when(split, chosen.otherwise(ours)).otherwise(plain)
        value = F.when(F.col("row_from") == "both", both).when(F.col("row_from") == "theirs", theirs).otherwise(ours)
        values.append(value.alias(c))
    origin = F.when(b, 0).when(o, 1).otherwise(2)
    staged = staged.withColumns({"row_from": row_from, "provisional": unanswered, "origin": origin.cast("tinyint")})
    return staged.where(F.col("row_from").isNotNull()).select(*key, *values, "origin", "provisional", *keep)


def merge3(
    base: DataFrame,
    ours: DataFrame,
    theirs: DataFrame,
    key: Sequence[str],
    cols: Sequence[str],
    resolutions: DataFrame | None = None,
    *,
    naming: Naming = ROWS,
    keys_checked: bool = False,
    staged: bool = False,
) -> Merge:
    """Three-way merge by `key`; for many merges at once lead the key with
    `merge_id`. Rows whose key repeats or is null take no part; they are in
    `key_problems`, which the merge's `gate` counts.

    `staged` writes the alignment once, for callers who use several parts of the
    result.
    """
    sides = {"base": base, "ours": ours, "theirs": theirs}
    aligned = align(sides, key, cols, keys_checked=keys_checked)
    if staged:
        aligned = cut(aligned)
    merge = apply_merge(unique_only(aligned, SIDES), key, cols, resolutions, naming)
    return replace(merge, key_problems=by_side(skipped_keys(aligned, sides, key), SIDES, key))


def changes_to_ours(ours: DataFrame, merge: Merge) -> DataFrame:
    """What the merge does to our side."""
    return diff_cells(ours, merge.merged, merge.key, merge.cols)


def conflict_summary(conflicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return conflicts.groupBy(*by, "class", "property").agg(F.count(F.lit(1)).alias("n_conflicts"))


def ordered_conflicts(conflicts: DataFrame, table: Sequence[str], obj: Sequence[str]) -> DataFrame:
    """The fixed reading order: table, object, property."""
    return conflicts.orderBy(*table, *obj, "property", "conflict_id")


def gate(
    conflicts: DataFrame, problems: DataFrame, merges: DataFrame | None = None, by: str = "merge_id"
) -> DataFrame:
    """`(by, n_conflicts, n_problems, clean, decision)` for each merge.

    Without `by` in the inputs the result is one row. With it, `merges` lists
    every merge, so that those with nothing to report appear as well.
    """
    counted = conflicts.select(
        *([by] if merges is not None else []), F.lit(1).alias("c"), F.lit(0).alias("p")
    ).unionByName(
        problems.select(*([by] if merges is not None else []), F.lit(0).alias("c"), F.lit(1).alias("p"))
    )
    group = [by] if merges is not None else []
    if merges is not None:
        counted = counted.unionByName(merges.select(by, F.lit(0).alias("c"), F.lit(0).alias("p")))
    totals = counted.groupBy(*group).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_conflicts"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_problems")
    )
    clean = (F.col("n_conflicts") == 0) & (F.col("n_problems") == 0)
    decision = (
        F.when(F.col("n_conflicts") > 0, "conflicts").when(F.col("n_problems") > 0, "problems").otherwise("commit")
    )
    return totals.select(*group, "n_conflicts", "n_problems", clean.alias("clean"), decision.alias("decision"))
