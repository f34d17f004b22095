"""A fleet of schemas as four long tables, all keyed by `project_id`.

tables(project_id, table_id, name, ordinal)
columns(project_id, table_id, column_id, name, type_base, type_params, nullable, default_expr, position)
constraints(project_id, table_id, constraint_id, name, kind, column_ids, ref_table_id, ref_column_ids,
            on_delete, on_update, expr, ordinal)
indexes(project_id, table_id, index_id, name, columns array<struct<column_id, desc>>, is_unique, method, ordinal)

Objects are matched by id; references are ids, so a rename never breaks one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import any_of
from palimpsest.functions.types import action_words, render_type
from palimpsest.functions.words import has_text
from palimpsest.operators.spread import lookup

PROJECT, TABLE = "project_id", "table_id"
SCOPE = [PROJECT, TABLE]
# A table with very many columns is one hot value of a lookup of tables.
TABLE_SALTS = 8


@dataclass(frozen=True)
class Catalog:
    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    indexes: DataFrame

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> "Catalog":
        return Catalog(*[fn(getattr(self, f.name)) for f in fields(self)])

    def empty(self) -> "Catalog":
        return self.map(lambda df: df.where(F.lit(False)))


#: What a catalog holds: its table and its own id.
OBJECTS = {
    "table": ("tables", TABLE),
    "column": ("columns", "column_id"),
    "constraint": ("constraints", "constraint_id"),
    "index": ("indexes", "index_id"),
}


def skipped_objects(sides: Mapping[str, Catalog]) -> DataFrame:
    """`(project_id, table_id, what, object_id, problem, n_<side>…)`: objects whose
    id is repeated or null on a side, which are therefore not compared.

    All kinds and sides are counted in one exchange of their ids."""
    stacked = []
    for what, (attr, ident) in OBJECTS.items():
        for side, cat in sides.items():
            own = F.col(ident).cast("string").alias("object_id")
            stacked.append(getattr(cat, attr).select(*SCOPE, F.lit(what).alias("what"), own, F.lit(side).alias("_side")))
    counts = reduce(DataFrame.unionByName, stacked).groupBy(*SCOPE, "what", "object_id")
    counts = counts.agg(*[F.count_if(F.col("_side") == s).alias(f"n_{s}") for s in sides])
    absent = any_of([F.col(c).isNull() for c in (*SCOPE, "object_id")])
    repeated = any_of([F.col(f"n_{s}") > 1 for s in sides])
    found = counts.withColumn("problem", F.when(absent, "null_key").when(repeated, "duplicate_key")).where(F.col("problem").isNotNull())
    return found.select(*SCOPE, "what", "object_id", "problem", *[f"n_{s}" for s in sides])


def told(sides: Sequence[str]) -> Column:
    """A row of `skipped_objects` in words."""
    times = F.concat_ws(", ", *[F.concat(F.lit(f"{s} "), F.col(f"n_{s}").cast("string")) for s in sides])
    ident = F.coalesce("object_id", F.lit("null"))
    return F.concat(F.col("what"), F.lit(" "), ident, F.lit(" is not compared, "), F.col("problem"), F.lit(": "), times)


def blank(col: str) -> Column:
    """Missing text reads as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def plain_columns(columns: DataFrame) -> DataFrame:
    """Columns with their type as text and no null defaults."""
    return columns.select(
        *SCOPE,
        "column_id",
        "name",
        render_type(F.col("type_base"), F.col("type_params")).alias("type"),
        "nullable",
        blank("default_expr").alias("default"),
        "position",
    )


def typed_columns(columns: DataFrame) -> DataFrame:
    """The inverse of `plain_columns`."""
    digits = F.regexp_extract_all(F.substring_index("type", "(", -1), F.lit(r"(-?\d+)"), F.lit(1))
    params = F.when(F.contains(F.col("type"), F.lit("(")), F.transform(digits, lambda p: p.cast("int")))
    return columns.select(
        *SCOPE,
        "column_id",
        "name",
        F.trim(F.substring_index("type", "(", 1)).alias("type_base"),
        F.coalesce(params, F.array().cast("array<int>")).alias("type_params"),
        "nullable",
        F.col("default").alias("default_expr"),
        "position",
    )


def _ids(col: str) -> Column:
    return F.array_join(F.transform(F.coalesce(F.col(col), F.array()), lambda i: i.cast("string")), "|")


def canonical_constraint() -> Column:
    """Meaning of a constraint in ids, without its name."""
    return F.concat_ws(
        "|",
        "kind",
        _ids("column_ids"),
        F.lit("→"),
        F.coalesce(F.col("ref_table_id").cast("string"), F.lit("")),
        _ids("ref_column_ids"),
        blank("on_delete"),
        blank("on_update"),
        blank("expr"),
    )


def canonical_index() -> Column:
    parts = F.transform("columns", lambda c: F.concat(c["column_id"].cast("string"), F.lit(":"), c["desc"].cast("string")))
    return F.concat_ws("|", F.array_join(parts, "|"), F.col("is_unique").cast("string"), blank("method"))


def _names(rows: DataFrame, key: list[str], refs: Column, against: DataFrame) -> DataFrame:
    """`rows` with `_parts`, the sorted `(part, pos, name, flag)` of their
    references. A list is as long as the array it came from, and the row rides
    along, so it is read once. A column that very many rows refer to is a skewed
    join, which adaptive execution splits."""
    packed = rows.select(*key, F.struct(*rows.columns).alias("_row"), F.explode_outer(refs).alias("r"))
    exploded = packed.select(
        *key, "_row", F.col("r.table_id").alias("_t"), F.col("r.column_id").alias("_c"), "r.part", "r.pos", "r.flag"
    )
    known = against.select(PROJECT, F.col(TABLE).alias("_t"), F.col("column_id").alias("_c"), F.col("name").alias("_name"))
    named = exploded.join(known, [PROJECT, "_t", "_c"], "left")
    entry = F.struct("part", "pos", F.coalesce("_name", F.lit("?")).alias("name"), "flag")
    listed = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), entry)))
    return named.groupBy(*key).agg(F.first("_row").alias("_row"), listed.alias("_parts")).select("_row.*", "_parts")


def _refs(ids: str, table: str, part: int) -> Column:
    return F.transform(
        F.coalesce(F.col(ids), F.array()),
        lambda c, i: F.struct(
            F.lit(part).alias("part"),
            i.alias("pos"),
            F.col(table).alias("table_id"),
            c.alias("column_id"),
            F.lit(False).alias("flag"),
        ),
    )


def _listed(part: int) -> Column:
    parts = F.filter(F.coalesce(F.col("_parts"), F.array()), lambda p: p["part"] == part)
    return F.array_join(F.transform(parts, lambda p: F.concat(p["name"], F.when(p["flag"], " DESC").otherwise(""))), ", ")


def describe_constraints(constraints: DataFrame, against: Catalog, extra_key: list[str] | None = None) -> DataFrame:
    """Add `definition`, with names resolved in `against`; `?` where missing."""
    key = [*SCOPE, "constraint_id", *(extra_key or [])]
    refs = F.concat(_refs("column_ids", TABLE, 0), _refs("ref_column_ids", "ref_table_id", 1))
    named = _names(constraints, key, refs, against.columns)
    targets = against.tables.select(PROJECT, F.col(TABLE).alias("ref_table_id"), F.col("name").alias("_target"))
    full = lookup(named, targets, [PROJECT, "ref_table_id"], key, "left", TABLE_SALTS)
    action = lambda word, col: F.when(
        has_text(F.col(col)) & (F.col(col) != "no_action"), F.concat(F.lit(word), action_words(F.col(col)))
    ).otherwise("")
    target = F.when(F.col("_target").isNull(), "?(?)").otherwise(F.concat("_target", F.lit("("), _listed(1), F.lit(")")))
    definition = (
        F.when(F.col("kind") == "primary_key", F.concat(F.lit("PRIMARY KEY ("), _listed(0), F.lit(")")))
        .when(F.col("kind") == "unique", F.concat(F.lit("UNIQUE ("), _listed(0), F.lit(")")))
        .when(F.col("kind") == "check", F.concat(F.lit("CHECK ("), blank("expr"), F.lit(")")))
        .when(
            F.col("kind") == "foreign_key",
            F.concat(
                F.lit("FOREIGN KEY ("),
                _listed(0),
                F.lit(") → "),
                target,
                action(" ON DELETE ", "on_delete"),
                action(" ON UPDATE ", "on_update"),
            ),
        )
        .otherwise(F.col("kind"))
    )
    return full.withColumn("definition", definition).select(*constraints.columns, "definition")


def describe_indexes(indexes: DataFrame, against: Catalog, extra_key: list[str] | None = None) -> DataFrame:
    key = [*SCOPE, "index_id", *(extra_key or [])]
    refs = F.transform(
        F.col("columns"),
        lambda c, i: F.struct(
            F.lit(0).alias("part"),
            i.alias("pos"),
            F.col(TABLE).alias("table_id"),
            c["column_id"].alias("column_id"),
            F.coalesce(c["desc"], F.lit(False)).alias("flag"),
        ),
    )
    full = _names(indexes, key, refs, against.columns)
    definition = F.concat(
        F.when(F.col("is_unique"), "UNIQUE ").otherwise(""),
        F.lit("("),
        _listed(0),
        F.lit(")"),
        F.when(has_text(F.col("method")), F.concat(F.lit(" USING "), F.col("method"))).otherwise(""),
    )
    return full.withColumn("definition", definition).select(*indexes.columns, "definition")
