"""Coherence of whole schemas, for all projects of a fleet at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.words import has_text
from palimpsest.operators.catalog import PROJECT, SCOPE, TABLE, TABLE_SALTS, Catalog, blank
from palimpsest.operators.collisions import collisions, first_holders
from palimpsest.operators.spread import lookup, lookup_large, running_last

OUT = [PROJECT, "code", "table", "object", "message"]


def _label() -> Column:
    return F.when(has_text(F.col("name")), F.col("name")).otherwise(F.col("kind"))


def _quote(col: Column) -> Column:
    return F.concat(F.lit('"'), col, F.lit('"'))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _report(df: DataFrame, code: str, obj: Column, message: Column) -> DataFrame:
    return df.select(PROJECT, F.lit(code).alias("code"), F.col("table"), obj.alias("object"), message.alias("message"))


def _row(df: DataFrame, by: str, code: str, obj: Column, before: Column | str, after: Column | str | None) -> DataFrame:
    """A problem whose message still lacks the name of its table; without `after` it does not name it."""
    text = lambda c: c if isinstance(c, Column) else F.lit(c).cast("string")
    return df.select(
        *SCOPE, F.col(by).cast("string").alias("by"), F.lit(code).alias("code"), obj.alias("object"), text(before).alias("before"), text(after).alias("after")
    )


def _nothing() -> Column:
    return F.lit("")


def check_catalog(cat: Catalog) -> DataFrame:
    """`(project_id, code, table, object, message)`; empty when coherent.

    Names of tables are attached only to rows that are problems."""
    names = cat.tables.select(*SCOPE, F.col("name").alias("table"))

    table = F.col("table")
    filled = cat.columns.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"))
    twice = collisions(cat.columns, [*SCOPE, "name"], ["column_id"], ["position"])
    rows = [
        _row(cat.tables.select(*SCOPE).join(filled, SCOPE, "left_anti"), TABLE, "table_no_columns", _nothing(), "table ", " has no columns"),
        _row(twice, "column_id", "duplicate_column_name", F.col("name"), "table ", _say(" has two columns named ", _quote(F.col("name")))),
        *_constraint_problems(cat),
        *_index_problems(cat),
    ]
    # All problems meet the names of their tables together.
    named = lookup(reduce(DataFrame.unionByName, rows), names, SCOPE, ["by"], salts=TABLE_SALTS)
    found = named.select(PROJECT, "code", "table", "object", F.concat("before", F.coalesce(F.concat(_quote(table), "after"), F.lit(""))).alias("message"))
    same_name = collisions(cat.tables, [PROJECT, "name"], [TABLE], ["ordinal"]).withColumn("table", F.col("name"))
    found = found.unionByName(_report(same_name, "duplicate_table_name", _nothing(), _say("two tables are named ", _quote(table))))
    return found.unionByName(_repeated_index_names(cat)).select(*OUT)


def _constraint_problems(cat: Catalog) -> list[DataFrame]:
    label = _label()
    cons = cat.constraints.withColumn("label", label)
    width = lambda c: F.coalesce(F.size(c), F.lit(0))
    known = cat.columns.select(*SCOPE, "column_id", F.col("name").alias("column"), "nullable")
    members = cons.select(*SCOPE, "constraint_id", "kind", "label", F.explode("column_ids").alias("column_id"))
    met = members.join(known, [*SCOPE, "column_id"], "left")
    missing = met.where(F.col("column").isNull())
    soft = met.where((F.col("kind") == "primary_key") & F.col("nullable"))
    empty = cons.where(F.col("kind").isin("primary_key", "unique") & (width("column_ids") == 0))
    what = F.when(F.col("kind") == "primary_key", "primary key").otherwise("unique constraint")

    fks = cons.where(F.col("kind") == "foreign_key")
    targets = cat.tables.select(PROJECT, F.col(TABLE).alias("ref_table_id"), F.col("name").alias("target"))
    aimed = lookup(fks, targets, [PROJECT, "ref_table_id"], ["constraint_id"], "left", TABLE_SALTS)
    sound = aimed.where(F.col("target").isNotNull())
    uneven = sound.where((width("column_ids") != width("ref_column_ids")) | (width("column_ids") == 0))
    refs = sound.select(*SCOPE, "constraint_id", "label", "target", "ref_table_id", F.explode("ref_column_ids").alias("column_id"))
    there = cat.columns.select(PROJECT, F.col(TABLE).alias("ref_table_id"), "column_id")
    lost = refs.join(there, [PROJECT, "ref_table_id", "column_id"], "left_anti")
    bare = cons.where((F.col("kind") == "check") & (blank("expr") == ""))
    keys = cons.where(F.col("kind") == "primary_key").groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    label, cid = F.col("label"), "constraint_id"
    sizes = _say(
        " has mismatched column lists (", width("column_ids").cast("string"), " local, ", width("ref_column_ids").cast("string"), " referenced)"
    )
    nowhere = aimed.where(F.col("target").isNull())
    lost_text = _say(" references a column that no longer exists on ", _quote(F.col("target")))
    nullable = _say("primary key column ", _quote(F.col("column")), " on ")
    return [
        _row(missing, cid, "constraint_missing_column", label, _say(label, " on "), " references a column that no longer exists"),
        _row(soft, cid, "pk_nullable_column", F.col("column"), nullable, " is nullable"),
        _row(empty, cid, "constraint_no_columns", label, _say(what, " on "), " has no columns"),
        _row(nowhere, cid, "fk_missing_table", label, "foreign key on ", " points at a table that no longer exists"),
        _row(uneven, cid, "fk_column_count_mismatch", label, "foreign key on ", sizes),
        _row(lost, cid, "fk_missing_column", label, "foreign key on ", lost_text),
        _row(bare, cid, "check_no_expression", label, "check constraint on ", " has no expression"),
        _row(keys, TABLE, "multiple_primary_keys", _nothing(), "table ", _say(" has ", F.col("n").cast("string"), " primary keys")),
    ]


def _repeated_index_names(cat: Catalog) -> DataFrame:
    table, name = F.col("table"), F.col("name")
    # The other holder is the one before; only names held twice are put in order.
    held = first_holders(cat.indexes, [PROJECT, "name"], ["index_id"], ["ordinal"]).select(PROJECT, "name")
    contested = lookup_large(cat.indexes, held, [PROJECT, "name"], ["index_id"], "left_semi")
    homes = cat.tables.select(*SCOPE, F.col("name").alias("table"), F.col("ordinal").alias("t"))
    placed = lookup(contested, homes, SCOPE, ["index_id"], salts=TABLE_SALTS)
    order = {"tie": ["ordinal", "index_id"], "inclusive": False}
    before = running_last(placed, [PROJECT, "name"], "t", {"other": F.struct("table")}, **order)
    message = _say("two indexes are named ", _quote(name), " (on ", _quote(F.col("other.table")), " and ", _quote(table), ")")
    return _report(before.where(F.col("other").isNotNull()), "duplicate_index_name", name, message)


def _index_problems(cat: Catalog) -> list[DataFrame]:
    name = F.col("name")
    parts = cat.indexes.select(*SCOPE, "index_id", "name", F.explode("columns.column_id").alias("column_id"))
    lost = parts.join(cat.columns.select(*SCOPE, "column_id"), [*SCOPE, "column_id"], "left_anti")
    empty = cat.indexes.where(F.coalesce(F.size("columns"), F.lit(0)) <= 0)
    index = _say("index ", _quote(name))
    return [
        _row(empty, "index_id", "index_no_columns", name, _say(index, " has no columns"), None),
        _row(lost, "index_id", "index_missing_column", name, _say(index, " references a column that no longer exists on "), ""),
    ]
